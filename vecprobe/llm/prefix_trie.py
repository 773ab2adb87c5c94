"""Conversation prefix trie with count-min screening (operator 12).

A turn is a 128-bit digest of its role and text and a number of characters;
texts are never shuffled. The digest of a prefix is the sum of its turns'
digests, each mixed with its place, so a running sum gives all prefixes.

1. A count-min sketch of all prefix digests: tasks post cells, sums are taken
   per cell, and what leaves is a bitmap of the cells met more than once. Its
   size follows the number of prefixes up to ``SKETCH_BITS``; a fuller sketch
   proves less, and more prefixes are shuffled, but results stay exact.
2. A prefix with a cell met once is in one conversation only, and so are all
   longer ones: that tail of the conversation gives its nodes on the spot.
3. Only prefixes that may be shared are grouped by digest. Within a node the
   smallest conv_id stands for it, so what a node adds to the sums over
   subtrees rides on that conversation's path: a running sum from the end and
   one more grouping give the sums, whatever the depth.
4. Lists of ids are hashed as streams: tasks join runs of ids to pieces of
   text, and a node's pieces, in order, pass through one hash object.

One conversation is a sequence and its running sums are one task's, which
spills; everything else is grouped with partial aggregation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HEAD, FAMILY = 6, 100
#: Rows of the sketch, cells of a row per prefix, and bits of a row at most (4 MB).
SKETCH_ROWS, CELLS_PER_PREFIX, SKETCH_BITS = 2, 8, 1 << 25
#: Bytes of a piece of a list of ids.
PIECE = 1 << 16
NODE = ["a", "b"]
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv, pos (from 0), sig (digest), chars of each turn with a conv_id."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    sig = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", sig.alias("sig"), F.char_length(text).cast("long").alias("chars"))
    by = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "sig")
    return rows.select("conv", (F.row_number().over(by) - 1).alias("pos"), "sig", "chars")


def head_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEAD).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, sig, chars) of the rebuilt conversations, and all conv."""
    first = F.col("conv") - F.col("conv") % FAMILY
    heads = (turns.filter((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEAD - 1)).groupBy(F.col("conv").alias("first"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "sig", "chars"))).alias("head")))
    convs = turns.filter("pos = 0").select("conv", first.alias("first"), head_turns(F.col("conv")).alias("h"))
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:int,sig:binary,chars:bigint>>")), 1, F.col("h"))
    convs = cut_lineage(convs.join(heads, "first", "left").select("conv", "h", head.alias("head")), "conversations")
    taken = convs.select("conv", F.explode("head").alias("t")).select("conv", (F.col("t.pos") + 1).alias("depth"), "t.sig", "t.chars")
    own = (turns.filter(F.col("pos") >= head_turns(F.col("conv"))).join(convs.select("conv", "h", F.size("head").alias("n")), "conv")
           .select("conv", (F.col("pos") - F.col("h") + F.col("n") + 1).alias("depth"), "sig", "chars"))
    return taken.unionByName(own), convs.select("conv")


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds the digest (a, b) of each prefix and that of its parent (pa, pb; 0, 0
    for the root)."""
    by = Window.partitionBy("conv").orderBy("depth")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    x, y = F.xxhash64(F.lit(1), "depth", "sig"), F.xxhash64("sig", "depth", F.lit(2))
    lanes = [f(v) for v in (x, y) for f in (lambda v: F.shiftrightunsigned(v, 32), lambda v: v.bitwiseAND(0xFFFFFFFF))]
    sums = turns.select("conv", "depth", "chars", *[F.sum(v).over(so_far).alias(f"s{i}") for i, v in enumerate(lanes)])
    keyed = sums.select("conv", "depth", "chars", F.xxhash64("depth", "s0", "s1", "s2", "s3").alias("a"),
                        F.xxhash64("s3", "s2", "s1", "s0", "depth").alias("b"))
    return keyed.select("*", *[F.coalesce(F.lag(c).over(by), F.lit(0)).alias(f"p{c}") for c in NODE])


def _cells(a: np.ndarray, b: np.ndarray, bits: int) -> list[np.ndarray]:
    """A digest's cell in each row of the sketch (``bits`` cells a row, a power of two)."""
    u = np.uint64
    return [((a.view(u) + u(i) * b.view(u)) & u(bits - 1)).astype(np.int64) + i * bits for i in range(SKETCH_ROWS)]


def sketch(prefix: DataFrame, bits: int) -> np.ndarray:
    """Bitmap (64-bit words) of the count-min sketch's cells met more than once."""

    def post(batches):
        for x in batches:
            cells = np.concatenate(_cells(x.column("a").to_numpy(), x.column("b").to_numpy(), bits))
            cell, n = np.unique(cells, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.minimum(n, 2))], names=["cell", "n"])

    many = prefix.select("a", "b").mapInArrow(post, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % 64).cast("int"))
    words = many.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(-(-SKETCH_ROWS * bits // 64), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def first_singles(prefix: DataFrame, bits: int) -> DataFrame:
    """conv, depth of the first prefix proved to be in no other conversation
    (null: none proved), and len (turns)."""
    spark = prefix.sparkSession
    shared = spark.sparkContext.broadcast(sketch(prefix, bits))

    def test(batches):
        words = shared.value
        for x in batches:
            one = np.zeros(x.num_rows, bool)
            for c in _cells(x.column("a").to_numpy(), x.column("b").to_numpy(), bits):
                one |= (words[c >> 6] >> (c & 63)) & 1 == 0
            yield pa.RecordBatch.from_arrays([x.column("conv"), x.column("depth"), pa.array(one)], names=["conv", "depth", "one"])

    seen = prefix.select("conv", "depth", "a", "b").mapInArrow(test, "conv long, depth int, one boolean")
    return seen.groupBy("conv").agg(F.min(F.when(F.col("one"), F.col("depth"))).alias("single"), F.max("depth").alias("len"))


def _pieces(limit: int):
    """Rows sorted by (a, b, conv) -> pieces of their nodes' lists of ids."""

    def run(batches):
        node, first, parts, size = None, None, [], 0

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*node, first)] + [pa.array([",".join(parts)])], names=["a", "b", "first", "ids"])

        for x in batches:
            for a, b, conv in zip(*(x.column(c).to_pylist() for c in ("a", "b", "conv")), strict=True):
                if node != (a, b) or size >= limit:
                    if parts:
                        yield piece()
                    node, first, parts, size = (a, b), conv, [], 0
                parts.append(str(conv))
                size += len(parts[-1]) + 1
        if parts:
            yield piece()

    return run


def _hashes(batches):
    """Pieces sorted by (a, b, first) -> one digest per node."""
    node, h = None, None
    for x in batches:
        rows = []
        for a, b, ids in zip(*(x.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
            if node != (a, b):
                if node:
                    rows.append((*node, h.hexdigest()))
                node, h = (a, b), hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["a", "b", "ends_sha256"])
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, h.hexdigest())], names=["a", "b", "ends_sha256"])


def id_hashes(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(a, b, conv) -> a, b, ends_sha256 of each node's ascending list of ids."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (ends.select("a", "b", "conv").repartitionByRange(parts, "a", "b", "conv").sortWithinPartitions("a", "b", "conv")
            .mapInArrow(_pieces(piece), "a long, b long, first long, ids string"))
    return (runs.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "first")
            .mapInArrow(_hashes, "a long, b long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, sketch_bits: int | None = None) -> DataFrame:
    """The trie of rebuilt conversations of ``turns`` (conv_id long, turn, role,
    text; other columns are ignored whatever their names).

    Turns are ordered by ``turn``, null first, equal ones by a digest of role
    and text; null roles and texts are empty; rows without conv_id are left out
    and an empty table gives no node. The first h turns of each conversation c
    are replaced by those of conversation c - c % 100, h = crc32(c) % 6. Returns
    one row per node, the textless root included: conv_id (smallest member),
    depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. Texts of any length count whole; repeated
    rows are turns of their own. ``sketch_bits`` (a power of two; default by
    the number of prefixes) changes what is shuffled, never the result."""
    own = cut_lineage(numbered_turns(turns), "turns")
    rows, convs = rebuilt(own)
    prefix = cut_lineage(prefixes(rows), "prefixes")
    if sketch_bits is None:
        sketch_bits = min(SKETCH_BITS, 1 << max(6, (CELLS_PER_PREFIX * prefix.count() - 1).bit_length()))
    single = convs.join(first_singles(prefix, sketch_bits), "conv", "left").select("conv", "single", F.coalesce("len", F.lit(0)).alias("len"))
    single = cut_lineage(single, "singles")
    root_conv = single.agg(F.min("conv")).first()[0]

    # possibly shared prefixes, the root among them; the first node of each tail
    known = prefix.join(single, "conv")
    ending = (F.col("depth") == F.col("len")).cast("long").alias("ending")
    tail_leaf = F.col("single").isNotNull().cast("long").alias("tail_leaf")
    shared = (known.filter("single is null or depth < single").select("conv", "depth", *NODE, "pa", "pb", "chars", ending, tail_leaf)
              .unionByName(single.select("conv", F.lit(0).alias("depth"), *[F.lit(0).cast("long").alias(c) for c in (*NODE, "pa", "pb", "chars")],
                                         (F.col("len") == 0).cast("long").alias("ending"), tail_leaf)))
    shared = cut_lineage(shared, "shared")
    tails = known.filter("depth = single").select("conv", "single", "len", "pa", "pb")

    nodes = cut_lineage(shared.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.sum("ending").alias("ends"),
        *[F.min(c).alias(c) for c in ("depth", "chars", "pa", "pb")]), "nodes")
    children = (nodes.filter("depth > 0").select("pa", "pb").unionByName(tails.select("pa", "pb"))
                .groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children")))

    # what a node adds to its subtree's sums, on the path of its smallest member
    own_sums = nodes.select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
                            (F.col("ends") == F.col("n_convs")).cast("long").alias("leaf"))
    below = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = (shared.select("conv", "depth", *NODE, "tail_leaf").join(own_sums, ["conv", "depth"], "left")
            .select(*NODE, F.sum(F.coalesce("saved", F.lit(0))).over(below).alias("saved"),
                    (F.sum(F.coalesce("leaf", F.lit(0))).over(below) + F.col("tail_leaf")).alias("leaves"))
            .groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")))

    hashes = id_hashes(shared.filter("ending = 1"))
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above"))

    def with_parent(df: DataFrame, depth: str) -> DataFrame:
        """Adds parent_conv_id; the root, everyone's first parent, is no join key."""
        deep = df.filter(F.col(depth) > 1).join(above, ["pa", "pb"]).withColumnRenamed("above", "parent_conv_id").drop("pa", "pb")
        top = df.filter(F.col(depth) <= 1).withColumn("parent_conv_id", F.when(F.col(depth) == 1, F.lit(root_conv)).cast("long"))
        return deep.unionByName(top.drop("pa", "pb"))

    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    grouped = (with_parent(nodes, "depth").join(children, NODE, "left").join(sums, NODE).join(hashes, NODE, "left")
               .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
               .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))))
    alone = (with_parent(tails, "single").withColumn("depth", F.explode(F.sequence("single", "len")))
             .withColumn("parent_conv_id", F.when(F.col("depth") == F.col("single"), F.col("parent_conv_id")).otherwise(F.col("conv")))
             .select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.lit(1).alias("n_convs"),
                     (F.col("depth") < F.col("len")).cast("long").alias("n_children"), F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"),
                     F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256")))
    whole = [F.col(c).cast("long").alias(c) for c in out[:-1]]
    return grouped.select(*whole, "ends_sha256").unionByName(alone.select(*whole, "ends_sha256"))


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text in SQL, bit by bit."""
    step = "xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"list_reduce([xor(c, o), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {step})"
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT))"
    return f"xor(4294967295::BIGINT, list_reduce({codes}, lambda c, o: {byte}))"


ORACLE_SQL = f"""
WITH own AS (
  SELECT conv_id, list(coalesce(role, '') || chr(31) || coalesce(text, '') ORDER BY turn NULLS FIRST) AS t,
         list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST) AS w,
         {_crc32_sql("conv_id::VARCHAR")} % {HEAD} AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, coalesce(f.t[:o.h], []) || o.t[o.h + 1:] AS t, coalesce(f.w[:o.h], []) || o.w[o.h + 1:] AS w
  FROM own o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % {FAMILY}),
member AS (
  SELECT conv_id, d, t[:d] AS path, len(t) = d AS ending, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS chars
  FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ending), '')) AS ends_sha256
  FROM member GROUP BY path, d),
up AS (SELECT *, path[:d - 1] AS above FROM node WHERE d > 0),
child AS (SELECT above AS path, count(*) AS n FROM up GROUP BY above),
leafy AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM node n LEFT JOIN child c ON c.path = n.path),
ancestor AS (SELECT path[:k] AS path, (n_convs - 1) * chars AS saved, (n_children = 0)::INT AS leaf
             FROM (SELECT *, unnest(range(d + 1)) AS k FROM leafy)),
below AS (SELECT path, sum(saved) AS saved, sum(leaf) AS leaves FROM ancestor GROUP BY path)
SELECT l.conv_id, l.d::BIGINT AS depth, p.conv_id AS parent_conv_id, l.n_convs::BIGINT AS n_convs, l.n_children::BIGINT AS n_children,
       b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, l.ends_sha256
FROM leafy l JOIN below b ON b.path = l.path LEFT JOIN up u ON u.path = l.path LEFT JOIN node p ON p.path = u.above
"""
