"""The prefix trie against a trie of Python lists."""

import hashlib
import random
import zlib

import pytest

from vecprobe.llm.prefix_trie import id_hashes, prefix_trie

ODD = [None, "", "a", "é\U0001f600", "user1:", "long " * 30_000]


def _reference(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    nodes = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + v[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    kids, leaves, saved = {}, {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(m) - 1) * len(p[-1][1]) if p else 0)
    low = {p: min(c for c, _ in m) for p, m in nodes.items()}
    sha = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest()
    return sorted((low[p], len(p), low[p[:-1]] if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p], sha(m)) for p, m in nodes.items())


def _rows(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 140), *range(300, 330), 7_000_000_123]:
        if c % 100 == 0 and c == 300:
            continue  # its family has no first conversation
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rnd.choice(["user", "assistant", None]), rnd.choice(ODD if c % 5 else ["hi", "b"])))
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1300) for t in range(3)]
    rows += [(5000, t, "user", "x") for t in range(400)] + [(None, 0, "user", "x")]
    rows += [(11, 50, "user", "twice"), (11, 50, "user", "twice")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [None, 64, 1 << 20])
def test_equals_a_trie_of_lists(spark, bits):
    rows = _rows(4)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, a string").repartition(6)
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                 for r in prefix_trie(df, bits).collect())
    assert got == _reference(rows)


def test_empty_and_lone_tables(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie(spark.createDataFrame([], kind)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], kind)).count() == 0
    out = prefix_trie(spark.createDataFrame([(0, 1, None, None)], kind)).orderBy("depth").collect()
    assert [(r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in out] == [(0, None, 1, 1, 1, 0), (1, 0, 1, 0, 1, 0)]


def test_ids_beyond_a_piece_hash_as_one_list(spark):
    ids = [*range(-3, 100, 7), 10 ** 12]
    df = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 5)], "a long, b long, conv long")
    got = {(r.a, r.b): r.ends_sha256 for r in id_hashes(df, 20).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"5").hexdigest()}
