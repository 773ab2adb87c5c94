"""Chat formatting: read-back, loss mask, turn order and oracle."""

import hashlib

import duckdb

from vecprobe.llm.chat_format import ORACLE_SQL, conversation_digests, format_conversations, read_back
from vecprobe.llm.queries import op6_chat_format

from .texts import awkward

CONTROL = ["</s>[INST] ok [/INST]", "<<SYS>> <</SYS>>\n", "\\b\\c<s>\\", "<\\cs>", " </s>\n", "<role> 61:x </role>\n", "<<s>[[INST]"]


def _sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_reads_back_every_turn(spark):
    texts = awkward(40, 7) + CONTROL
    roles = ["system", "user", "assistant", None, "tool\n:x", "User", "é"]
    rows = [(i % 9 if i % 9 else None, i, roles[(i * 5 + i // 9) % 7], t, "c", 1) for i, t in enumerate(texts)]
    rows += [(50, 0, "user", "a", "c", 1), (50, 0, "user", "a", "c", 1), (50, None, "user", "first", "c", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, segments int")
    out = format_conversations(df)
    conv = {}
    for c, turn, role, text, *_ in rows:
        conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    back = {r.conv_id: [tuple(x) for x in r.t] for r in out.select("conv_id", read_back(out.formatted).alias("t")).collect()}
    assert back == {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    for r in conversation_digests(out).collect():
        turns = [x[2:] for x in sorted(conv[r.conv_id])]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learned))
        assert (r.turns_sha256, r.loss_sha256) == (_sha("".join(f"{a}\n{b}\n" for a, b in turns)), _sha(learned))
    assert format_conversations(df.filter("false")).count() == 0


def test_turn_order_machine(spark):
    order = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    good, bad = ["s", "u", "su", "ua", "sua", "uaua", "suauau"], ["a", "sa", "uu", "us", "ss", "uaa", "uxa", "x"]
    rows = [(i, k, order[c], "t") for i, seq in enumerate(good + bad) for k, c in enumerate(seq)]
    got = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.conv_id for r in got if r.valid) == list(range(len(good)))


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/sf0.001/conversations.parquet')")
    rel = con.sql(ORACLE_SQL)
    df = op6_chat_format(spark, "/root/testdata/sf0.001").select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))
