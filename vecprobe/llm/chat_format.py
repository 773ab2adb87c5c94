"""Chat formatting by a declarative template (operator 6); DataFrame functions only.

A template gives each role its opening and closing string and whether its text
is learned. Turns become segments (text, loss); the formatted conversation is
their concatenation. Control strings and backslashes inside texts are escaped
reversibly: a backslash becomes ``\\b`` and ``\\c`` goes after the first
character of a control string, so no control string occurs inside a text.

A finite-state machine over the roles checks the order of turns: an optional
system turn, then user and assistant turns in alternation. Conversations in
another order are formatted all the same and marked ``valid = false``.

A conversation is one record, gathered in one row, as its format requires."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: role -> opening, closing, learned
    roles: tuple = (("system", "<<SYS>>", "<</SYS>>", False), ("user", "[INST]", "[/INST]", False),
                    ("assistant", "<s>", "</s>", True))
    #: any other role, given as hex before the text
    other: tuple = ("<role>", "</role>")
    start: str = "start"
    #: state, role -> state; the state is named for the turn before
    moves: tuple = (("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"),
                    ("user", "assistant", "assistant"), ("assistant", "user", "user"))

    @property
    def controls(self) -> list[str]:
        return [x for _, a, b, _ in self.roles for x in (a, b)] + list(self.other)


TEMPLATE = Template()


def escape(text: Column, t: Template = TEMPLATE) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for c in t.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\c" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\c"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def _by_role(role: Column, t: Template, pick, other: Column) -> Column:
    out = None
    for name, *rest in t.roles:
        out = (F.when if out is None else out.when)(role == name, pick(*rest))
    return out.otherwise(other)


def turn_state(roles: Column, t: Template = TEMPLATE) -> Column:
    """State of the machine after ``roles``; ``invalid`` once no move fits."""
    table = F.create_map(*[F.lit(x) for s, r, to in t.moves for x in (f"{s}|{r}", to)])
    return F.aggregate(roles, F.lit(t.start),
                       lambda s, r: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("|"), r)), F.lit("invalid")))


def format_conversations(turns: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """One row per conv_id of ``turns`` (conv_id, turn, role, text): segments
    array<struct<text, loss>>, formatted, valid.

    Rows are ordered by turn, then role and text, nulls first. A null text or
    role is empty; a null conv_id is a conversation; other columns are ignored;
    an empty table gives no rows."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("row"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    seg = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def of_turn(r: Column) -> Column:
        hexed = F.concat(F.lit(t.other[0] + " "), F.lower(F.hex(F.encode(r["role"], "UTF-8"))), F.lit(":"))
        opening = _by_role(r["role"], t, lambda a, b, loss: F.lit(a + " "), hexed)
        closing = _by_role(r["role"], t, lambda a, b, loss: F.lit(f" {b}\n"), F.lit(f" {t.other[1]}\n"))
        learned = _by_role(r["role"], t, lambda a, b, loss: F.lit(loss), no)
        return F.array(seg(opening, no), seg(escape(r["text"], t), learned), seg(closing, no))

    out = conv.select("conv_id", F.flatten(F.transform("rows", of_turn)).alias("segments"),
                      (turn_state(F.transform("rows", lambda r: r["role"]), t) != "invalid").alias("valid"))
    return out.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"), "valid")


def read_back(formatted: Column, t: Template = TEMPLATE) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    closers = [b for _, _, b, _ in t.roles] + [t.other[1]]
    quote = lambda x: "".join("\\" + c if c in "[]" else c for c in x)
    parts = F.split(formatted, " (?:" + "|".join(map(quote, closers)) + ")\n", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        opening, rest = F.substring_index(p, " ", 1), F.substr(p, F.instr(p, " ") + 1)
        role = None
        for name, a, *_ in t.roles:
            role = (F.when if role is None else role.when)(opening == a, F.lit(name))
        role = role.otherwise(F.decode(F.unhex(F.substring_index(rest, ":", 1)), "UTF-8"))
        text = F.when(opening == t.other[0], F.substr(rest, F.instr(rest, ":") + 1)).otherwise(rest)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def conversation_digests(formatted: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars
    and valid, read back from the output of ``format_conversations``."""
    back = formatted.withColumn("turns", read_back(F.col("formatted"), t))
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    back = back.withColumn("learned", F.array_join(learned, ""))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(whole).alias("turns_sha256"),
                       F.char_length("learned").cast("long").alias("loss_chars"), sha(F.col("learned")).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")


def _oracle() -> str:
    t = TEMPLATE
    esc = "replace(txt, '\\', '\\b')"
    for c in t.controls:
        esc = f"replace({esc}, '{c}', '{c[0]}\\c{c[1:]}')"
    frame = " ".join(f"WHEN '{r}' THEN {len(a) + len(b) + 3}" for r, a, b, _ in t.roles)
    other = len("".join(t.other)) + 4
    order = "ORDER BY turn NULLS FIRST, rl, txt"
    return f"""
    WITH x AS (SELECT conv_id, turn, coalesce(role, '') AS rl, coalesce(text, '') AS txt FROM conversations
      UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
    g AS (SELECT conv_id, count(*) AS n, string_agg(rl || chr(10) || txt || chr(10), '' {order}) AS whole,
        coalesce(string_agg(txt, '' {order}) FILTER (WHERE rl = 'assistant'), '') AS learned,
        sum(length({esc}) + CASE rl {frame} ELSE {other} + 2 * strlen(rl) END) AS chars,
        string_agg(CASE rl WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' {order}) AS seq
      FROM x GROUP BY conv_id)
    SELECT conv_id, n AS n_turns, sha256(whole) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
      CAST(chars AS BIGINT) AS formatted_chars, regexp_full_match(seq, '(s|)(ua)*(u|)') AS valid FROM g"""


ORACLE_SQL = _oracle()
