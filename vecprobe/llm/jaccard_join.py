"""N-gram Jaccard join: multiple-global-order filtering (operator 10).

A document is the set of its distinct 5-word shingles (64-bit hashes; see
``textbuf.shingle_sets``). Under *every* total order of all shingles, a set of
n shingles has a prefix of its first p(n) = n - ceil(t n) + T(n). Sets of n and m
shingles with Jaccard similarity >= t share at least o = ceil(t (n + m) / (1 + t))
shingles, hence at least s = min(p(n) - (n - o), p(m) - (m - o)) >= 1 of their
prefixes: a prefix lacks at most n - o shingles of the other set. So in any
further order of the shingles inside the prefixes, the first common one comes
after at most p(n) - s and p(m) - s others. That order puts the rarest first, so
documents of a large group meet by what few of them have. Two orders are used
for the prefixes: shingles that are frequent in the corpus come last in both,
the rest follow two independent hash permutations.

1. One pass over the texts gives each document's set size and a 128-bit digest
   of the set, and per partition the shingles seen in several documents. Equal
   digests form a class, represented by its smallest doc_id. Of the summed counts
   the most frequent levels, at most ``HOT`` shingles, are broadcast; they only
   decide the orders, the result does not depend on them.
2. A second pass posts the prefix shingles of both orders. Inside a batch a
   repeated key sends one head row to the shuffle; its other documents are
   known to share the key and travel salted by document. A streaming pass over
   the sorted keys drops keys of a single document. Of the others, each document
   keeps those early enough in its prefix, the rarest first.
3. Star round: every document of a key is paired with the key's smallest
   document, if they share keys under *both* orders; each document keeps its
   best centre. These few pairs are verified and connect groups of near copies.
4. Exhaustive round: keys that still span several components give all pairs
   between different components that are early enough in both prefixes; only
   pairs found under both orders (an intersection of the two pair tables) are
   verified. No pair inside a component is formed, so a group of m near copies
   does not cost m**2 pairs, and no link between components is lost.

Verification streams each centre's partners past the centre's set (groups are
salted by size); only the documents in candidate pairs are shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.indexing import buckets_for, dense_index, hex_bucket
from ..session import cut_lineage
from .columns import set_aside
from .components import components
from .textbuf import U, mix, shingle_sets, slices, trim

ORDERS = 2
#: Shingles that the orders place last: at most this many are broadcast (6 MB).
HOT = 1 << 19
#: A prefix has one more shingle for each so many shingles of a set.
SHARED_PART = 40
#: Documents of a batch whose shingles are counted together, and posted together.
COUNTED, POSTED = 4000, 1000
#: Partners that one task verifies against one copy of a centre's set.
PARTNERS = 2_000
#: Texts are shingled in slices of so many bytes.
SHINGLED_BYTES = 1 << 19
FILTER_WORDS = 1 << 14  # 64-bit words of the filter of candidate documents (128 KB)
_SALT = mix(np.arange(101, 101 + ORDERS, dtype=U))


def least_shared(n: int) -> int:
    """Shingles of a set's prefix that it shares at least with the prefix of any
    partner of no smaller size (T in the module's text)."""
    return 1 + n // SHARED_PART


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + least_shared(n))


def prefix_sql(n: str, percent: int) -> str:
    """``prefix_length`` as an SQL expression."""
    return f"least({n}, {n} - ({percent} * {n} + 99) div 100 + 1 + {n} div {SHARED_PART})"


def shared_sql(n: str, m: str, percent: int) -> str:
    """Shingles that the prefixes of sets of ``n`` and ``m`` shingles share at
    least if the sets are similar enough (s in the module's text)."""
    common = f"({percent} * ({n} + {m}) + {percent + 99}) div {percent + 100}"
    return f"least({prefix_sql(n, percent)} - {n}, {prefix_sql(m, percent)} - {m}) + {common}"


def parts_of(batches, rows: int):
    """The batches in parts of at most so many rows."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def _digest(h: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(h + _SALT[k]).sum(dtype=U).view(np.int64)) for k in (0, 1))


def _keys(h: np.ndarray, hot: np.ndarray, rank: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of shingles under one order: a hashed value below 2**61, or
    2**61 plus the frequency rank of a hot shingle, shifted by one bit that
    names the order, so keys of different orders never meet."""
    k = mix(h ^ _SALT[order]) >> U(3)
    if len(hot) and len(h):
        at = np.searchsorted(hot, h)
        at[at == len(hot)] = 0
        is_hot = hot[at] == h
        k[is_hot] = (U(1) << U(61)) + rank[at[is_hot]].astype(U)
    return k << U(1) | U(order)


def _prefix(h: np.ndarray, hot, rank, order: int, percent: int) -> np.ndarray:
    k, p = _keys(h, hot, rank, order), prefix_length(len(h), percent)
    return np.partition(k, p - 1)[:p] if p < len(k) else k


def _scan(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                        ("shingle", pa.int64()), ("df", pa.int64())])

    def run(batches):
        for b in parts_of(batches, COUNTED):
            ids, rows, seen = b.column("doc_id"), [], []
            for s in slices(b.column("text"), SHINGLED_BYTES):
                for i, h in enumerate(shingle_sets(s, size)):
                    rows.append((ids[s.start + i].as_py(), len(h), *_digest(h)))
                    seen.append(h)
            if not rows:
                continue
            c = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*c, none, none], schema=schema)
            all_ = np.sort(np.concatenate(seen))
            if len(all_):
                head = np.flatnonzero(np.r_[True, all_[1:] != all_[:-1]])
                df = np.diff(np.r_[head, len(all_)])
                # a shingle that occurs once here waits its turn in hash order
                often = np.flatnonzero(df >= 2)
                often = often[np.argsort(-df[often], kind="stable")][:HOT // 4]
                none = pa.nulls(len(often), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, none, pa.array(all_[head[often]].view(np.int64)), pa.array(df[often])], schema=schema)
            del seen, all_
            trim()

    return run


def _post(size: int, percent: int, hot, rank):
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("center", pa.int64())])

    def run(batches):
        for b in parts_of(batches, POSTED):
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            keys, size_of, least = [], [], {}
            for s in slices(b.column("text"), SHINGLED_BYTES):
                for i, h in enumerate(shingle_sets(s, size)):
                    if not len(h):
                        continue
                    # copies in a batch post once, as the one of the smallest id
                    at = least.setdefault(_digest(h), [ids[s.start + i], len(least)])
                    if at[1] == len(size_of):
                        own = [_prefix(h, hot.value, rank.value, order, percent) for order in range(ORDERS)]
                        keys += own
                        size_of.append(sum(map(len, own)))
                    at[0] = min(at[0], ids[s.start + i])
            if not keys:
                continue
            k = np.concatenate(keys).view(np.int64)
            d = np.repeat(np.array([x[0] for x in least.values()], np.int64), size_of)
            by = np.argsort(k, kind="stable")
            k, d = k[by], d[by]
            first = np.r_[True, k[1:] != k[:-1]]
            head = np.flatnonzero(first)
            run_of = np.cumsum(first) - 1
            many = np.diff(np.r_[head, len(k)]) > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(k), pa.array(d), pa.array(d[head[run_of]], mask=~many[run_of])], schema=schema)
            del keys, k, d, run_of
            trim()

    return run


def _live(batches):
    """Rows sorted by key -> those whose key has several documents, each with a
    centre. Rows with a centre of their own batch are live as they are; heads
    (no centre, or themselves) take the first head of the key."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("center", pa.int64())])
    held = None  # (key, doc) of a head that is alone so far
    last, last_center = None, None
    for b in batches:
        k, d = b.column("key").to_numpy(), b.column("doc").to_numpy()
        c = b.column("center").fill_null(-(1 << 62)).to_numpy()
        given = (c != -(1 << 62)) & (c != d)
        if given.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[given]) for x in (k, d, c)], schema=schema)
        k, d, own = k[~given], d[~given], (c == d)[~given]
        if not len(k):
            continue
        first = np.r_[k[0] != last, k[1:] != k[:-1]]
        run_of = np.cumsum(first)  # 0: the key that the last batch ended with
        head = np.flatnonzero(first)
        centers = np.r_[last_center if last_center is not None else 0, d[head]]
        count = np.bincount(run_of, minlength=len(head) + 1)
        if held and count[0]:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*held, held[1])], schema=schema)
        live = (count[run_of] > 1) | (run_of == 0) | own
        tail = run_of == len(head)
        alone = bool(len(head)) and count[-1] == 1 and not own[-1]
        held = (int(k[-1]), int(d[-1])) if alone else (held if not len(head) and not count[0] else None)
        if alone:
            live &= ~tail
        if live.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[live]), pa.array(d[live]), pa.array(centers[run_of[live]])],
                                             schema=schema)
        last, last_center = int(k[-1]), int(centers[run_of[-1]])


def _verify(size: int, percent: int):
    """Rows sorted by (center, salt, role): a centre's set, then its partners."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        at, mine = None, None
        for b in batches:
            center, salt = b.column("center").to_numpy(), b.column("salt").to_numpy()
            role, doc = b.column("role").to_numpy(), b.column("doc").to_numpy()
            pairs = []
            for s in slices(b.column("text"), SHINGLED_BYTES):
                for i, h in enumerate(shingle_sets(s, size), s.start):
                    if role[i] == 0:
                        at, mine = (center[i], salt[i]), h
                        continue
                    if at != (center[i], salt[i]):
                        continue
                    n, m = len(mine), len(h)
                    both = len(np.intersect1d(mine, h, assume_unique=True))
                    if 100 * both >= percent * (n + m - both):
                        pairs.append((int(center[i]), int(doc[i])))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)],
                                                 schema=schema)
            trim()

    return run


def _hot_level(shared: DataFrame) -> int:
    """The lowest level of frequency from which on there are at most ``HOT``
    shingles, from the sizes of all levels (some hundred rows)."""
    least, n = 1 << 20, 0
    for r in shared.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        n += r.n
        if n > HOT:
            break
        least = r.level
    return least


class JaccardJoin:
    def __init__(self, docs: DataFrame, size: int = 5, percent: int = 80):
        self.size, self.percent = size, percent
        self.docs = docs.select("doc_id", "text").filter("doc_id is not null")
        self.spark = docs.sparkSession
        sc = self.spark.sparkContext
        scan = cut_lineage(self.docs.mapInArrow(
            _scan(size), "doc_id long, n long, d1 long, d2 long, shingle long, df long"), "shingles")
        shared = cut_lineage(scan.filter("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df"))
                             .withColumn("level", F.floor(8 * F.log2("df")).cast("int")), "frequencies")
        top = shared.filter(F.col("level") >= _hot_level(shared)).select("shingle", "df").toArrow()
        df, hot = top.column("df").to_numpy(), top.column("shingle").to_numpy().view(U)
        rank = np.empty(len(hot), np.uint32)  # the more frequent, the later
        rank[np.lexsort((hot, df))] = np.arange(1, len(hot) + 1)
        by = np.argsort(hot)
        self.hot, self.rank = sc.broadcast(hot[by]), sc.broadcast(rank[by])
        del top, df, hot, rank, by
        trim()  # on the driver
        sets = self.sets = scan.filter("doc_id is not null").select("doc_id", "n", "d1", "d2")
        key = ["n", "d1", "d2"]
        rep = sets.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("cls"))
        self.classes = cut_lineage(sets.join(rep, key, "left").select("doc_id", "cls", "n"), "classes")

    def ambiguous(self) -> bool:
        """Whether some doc_id has several different sets."""
        one = F.struct("n", "d1", "d2")
        return not self.sets.groupBy("doc_id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).filter("lo < hi").isEmpty()

    def postings(self) -> DataFrame:
        """Prefix postings of all orders over class representatives, as far as
        a similar document can be met by them: (key, doc, n, center, pos), with
        the key's smallest document and the key's place in the document's
        prefix, the rarest first."""
        p = self.docs.mapInArrow(_post(self.size, self.percent, self.hot, self.rank),
                                 "key long, doc long, center long")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        place = F.when(F.col("center").isNotNull() & (F.col("center") != F.col("doc")), F.xxhash64("key", "doc")) \
            .otherwise(F.xxhash64("key"))
        live = cut_lineage(p.repartition(parts, place).sortWithinPartitions("key")
                           .mapInArrow(_live, "key long, doc long, center long").select("key", "doc"), "live")
        # the smallest document of a key represents its class, as its copies post the same keys
        key = live.groupBy("key").agg(F.count("*").alias("df"), F.min("doc").alias("center")).filter("df > 1")
        own = self.classes.filter("cls = doc_id").select(F.col("doc_id").alias("doc"), "n").distinct()
        mine = Window.partitionBy("doc", F.col("key").bitwiseAND(1))
        others = F.expr(prefix_sql("n", self.percent)) - F.count("*").over(mine)  # keys that no other document has
        # the least that a partner of any size shares is T of the smaller one
        last = F.expr(f"{prefix_sql('n', self.percent)} - 1 - ({self.percent} * n + 99) div 100 div {SHARED_PART}")
        return cut_lineage(live.join(key, "key").join(own, "doc")
                           .withColumn("pos", others + F.row_number().over(mine.orderBy("df", "key")) - 1)
                           .filter(F.col("pos") <= last).select("key", "doc", "n", "center", "pos"), "postings")

    def _texts(self, need: DataFrame) -> DataFrame:
        """Documents that may be in ``need.doc``, by a fixed-size bitmap that
        spares the shuffle of the others where candidates are few."""
        bit = F.pmod(F.xxhash64("doc"), F.lit(FILTER_WORDS * 64))
        words = (need.groupBy((bit / 64).cast("int").alias("w"))
                 .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")).collect())
        table = [0] * FILTER_WORDS
        for r in words:
            table[r.w] = r.bits
        one = F.broadcast(self.spark.createDataFrame([(1, table)], "one int, bits array<long>"))
        mine = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_WORDS * 64))
        hit = F.call_function("shiftright", F.get("bits", (mine / 64).cast("int")), (mine % 64).cast("int")).bitwiseAND(1) == 1
        return (self.docs.withColumn("one", F.lit(1)).join(one, "one").filter(hit)
                .select(F.col("doc_id").alias("doc"), "text"))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with similarity of at least ``percent``."""
        pairs = cut_lineage(pairs, "pairs")
        salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
        member = (pairs.join(salts, "a")
                  .select(F.col("a").alias("center"), F.pmod(F.xxhash64("b"), "salts").cast("long").alias("salt"),
                          F.lit(1).alias("role"), F.col("b").alias("doc")))
        center = salts.select(F.col("a").alias("center"),
                              F.explode(F.sequence(F.lit(0), F.col("salts") - 1).cast("array<long>")).alias("salt"),
                              F.lit(0).alias("role"), F.col("a").alias("doc"))
        need = member.unionByName(center)
        rows = need.join(self._texts(need), "doc")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return (rows.repartition(parts, "center", "salt").sortWithinPartitions("center", "salt", "role", "doc")
                .select("center", "salt", "role", "doc", "text")
                .mapInArrow(_verify(self.size, self.percent), "a long, b long"))

    def _spanning(self, rows: DataFrame, comp: DataFrame) -> DataFrame:
        """(key, doc, n, pos, comp) of the keys that span several components:
        some document of such a key is not in the component of its centre."""
        of = {c: comp.select(F.col("id").alias(c), F.col("component_id").alias(f"{c}_comp")) for c in ("doc", "center")}
        rows = cut_lineage(rows.join(of["doc"], "doc", "left").join(of["center"], "center", "left")
                           .select("key", "doc", "n", "pos", F.coalesce("doc_comp", "doc").alias("comp"),
                                   F.coalesce("center_comp", "center").alias("center_comp")), "labelled")
        span = rows.filter("comp <> center_comp").select("key").distinct()
        return rows.join(span, "key", "left_semi").drop("center_comp")

    def _alike(self, n: str, m: str) -> str:
        return f"100 * least({n}, {m}) >= {self.percent} * greatest({n}, {m})"

    def star_pairs(self, rows: DataFrame) -> DataFrame:
        """For each document at most one pair with the centre of most of its
        keys, under both orders."""
        shared = (rows.filter("center <> doc").groupBy("doc", "center", "n")
                  .agg(*[F.count_if(F.col("key").bitwiseAND(1) == o).alias(f"k{o}") for o in range(ORDERS)]))
        total = sum(F.col(f"k{o}") for o in range(ORDERS))
        best = (shared.filter(" and ".join(f"k{o} > 0" for o in range(ORDERS)))
                .groupBy("doc", "n").agg(F.max(F.struct(total.alias("k"), (-F.col("center")).alias("c"))).alias("m"))
                .select((-F.col("m.c")).alias("a"), F.col("doc").alias("b"), F.col("n").alias("b_n")))
        size = self.classes.filter("cls = doc_id").select(F.col("doc_id").alias("a"), F.col("n").alias("a_n")).distinct()
        return best.join(size, "a").filter(self._alike("a_n", "b_n")).select("a", "b")

    def all_pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs of documents of different components that share a key early
        enough in both prefixes, under every order."""
        found = None
        early = [f"{d}_pos <= {prefix_sql(f'{d}_n', self.percent)} - ({shared_sql('a_n', 'b_n', self.percent)})" for d in ("a", "b")]
        for order in range(ORDERS):
            r = rows.filter(F.col("key").bitwiseAND(1) == order)
            x, y = (r.select("key", *[F.col(c).alias(f"{d}_{c}") for c in ("doc", "comp", "n", "pos")]) for d in ("a", "b"))
            on = (x["key"] == y["key"]) & F.expr(" and ".join(["a_comp < b_comp", self._alike("a_n", "b_n"), *early]))
            pairs = x.join(y, on).select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b")).distinct()
            found = pairs if found is None else found.join(pairs, ["a", "b"])
        return found

    def links(self) -> DataFrame:
        """Verified pairs (a, b) of representatives whose components are those
        of all pairs with similarity of at least ``percent``."""
        rows = self.postings()
        star = cut_lineage(self.verify(self.star_pairs(rows)), "links")
        rows = self._spanning(rows, components(star, "a", "b"))
        return star.unionByName(cut_lineage(self.verify(self.all_pairs(rows)), "links"))

    def members(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every document."""
        comp = components(self.links(), "a", "b")
        return (self.classes.join(comp.withColumnRenamed("id", "cls"), "cls", "left")
                .select("doc_id", F.col("n").alias("n_shingles"),
                        F.coalesce("component_id", "cls", "doc_id").alias("component_id")))


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate groups of ``docs`` (needs ``doc_id`` long and ``text``;
    other columns are ignored whatever their names).

    Returns one row per input row with a doc_id: doc_id, n_shingles (0 for a
    null text or one without words), component_id (smallest doc_id reachable by
    links; itself when alone). Rows that repeat a doc_id keep a row each and
    share that id's links, also where their texts differ. A row with a null
    doc_id is left out. An empty table gives no rows. A tie of the smallest id
    cannot occur; a text of any length is one set, held by one task."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    join = JaccardJoin(docs, size, percent)
    return _id_groups(docs, size, percent) if join.ambiguous() else join.members()


def _id_groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``jaccard_groups`` where a doc_id has several texts: each text is a
    document of its own, and the components that share an id are united."""
    keyed, _, numbered = _row_keys(docs)
    rows = JaccardJoin(keyed.select(F.col("_row_key").alias("doc_id"), "text"), size, percent).members()
    rows = cut_lineage(rows.join(numbered.withColumnRenamed("_row_key", "doc_id"), "doc_id", "left")
                       .select(F.coalesce("_row_id", "doc_id").alias("id"), "n_shingles", "component_id"), "members")
    low = rows.groupBy("id").agg(F.min("component_id").alias("low"))
    united = components(rows.join(low, "id"), "component_id", "low").select(F.col("id").alias("part"), F.col("component_id").alias("whole"))
    rows = (rows.join(united, F.col("component_id") == F.col("part"), "left")
            .select("id", "n_shingles", F.coalesce("whole", "component_id").alias("whole")))
    first = rows.groupBy("whole").agg(F.min("id").alias("component_id"))
    return rows.join(first, "whole").select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def _row_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``docs`` with ``_row_key`` (long, never null), one for each pair of doc_id
    and text: the doc_id, or a number that no doc_id has where the doc_id is
    null or has several texts. Also the keys of several rows, and (_row_key,
    _row_id) of the pairs that took a number; None if there are none."""
    text = F.coalesce(F.concat(F.lit("1"), F.col("text")), F.lit("0"))
    digest = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), text), 256)
    pair = cut_lineage(docs.groupBy(F.col("doc_id").cast("long").alias("_row_id"), digest.alias("_row_digest"))
                       .agg(F.count("*").alias("copies")), "rows")
    several = pair.filter("_row_id is not null").groupBy("_row_id").agg(F.count("*").alias("texts")).filter("texts > 1").select("_row_id")
    odd = cut_lineage(pair.filter("_row_id is null").unionByName(pair.join(several, "_row_id", "left_semi")).drop("copies"), "odd")
    n, (low, high) = odd.count(), pair.agg(F.min("_row_id"), F.max("_row_id")).first()
    if not n:
        return (docs.withColumn("_row_key", F.col("doc_id").cast("long")),
                pair.filter("copies > 1").select(F.col("_row_id").alias("_row_key")), None)
    if high is None or high + n < 1 << 63:
        start = 0 if high is None else high + 1
    elif low - n >= -(1 << 63):
        start = low - n
    else:  # no room beside the ids: every pair takes a number
        odd, start = pair.drop("copies"), 0
        n = odd.count()
    keys = cut_lineage(dense_index(odd, ["_row_digest"], name="at", bucket=hex_bucket("_row_digest", buckets_for(n)))
                       .select("_row_digest", "_row_id", (F.col("at") + F.lit(start)).alias("_row_at")), "keys")
    keyed = (docs.withColumn("_row_digest", digest).join(keys.drop("_row_id"), "_row_digest", "left").drop("_row_digest")
             .withColumn("_row_key", F.coalesce("_row_at", F.col("doc_id").cast("long"))).drop("_row_at"))
    many = (pair.filter("copies > 1").join(keys.drop("_row_id"), "_row_digest", "left")
            .select(F.coalesce("_row_at", "_row_id").alias("_row_key")))
    return keyed, many, keys.select(F.col("_row_at").alias("_row_key"), "_row_id")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate group of the rows of ``docs``, of the
    smallest doc_id (a null one comes last).

    Rows that repeat a doc_id and its text are one document; rows of one doc_id
    with different texts are different ones, and so are rows without doc_id,
    which only their text tells apart. Texts without words are like no other.
    All columns are kept, whatever their names."""
    docs, back = set_aside(docs, "_row_key", "_row_digest", "_row_at", "_row_id")
    keyed, many, numbered = _row_keys(docs)
    member = (JaccardJoin(keyed.select(F.col("_row_key").alias("doc_id"), "text"), size, percent).members()
              .select(F.col("doc_id").alias("_row_key"), "component_id").distinct())
    if numbered is None:
        gone = member.filter("_row_key <> component_id").select("_row_key")
    else:
        member = cut_lineage(member.join(numbered.withColumn("numbered", F.lit(True)), "_row_key", "left")
                             .withColumn("id", F.when(F.col("numbered"), F.col("_row_id")).otherwise(F.col("_row_key"))), "members")
        first = member.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row_key")).alias("first"))
        gone = member.join(first, "component_id").filter("_row_key <> first._row_key").select("_row_key")
    gone = cut_lineage(gone, "dropped")
    if many.isEmpty():
        return back(keyed.join(gone, "_row_key", "left_anti").select(*docs.columns))
    once = keyed.join(gone.unionByName(many), "_row_key", "left_anti")
    one_of_many = keyed.join(many.join(gone, "_row_key", "left_anti"), "_row_key", "left_semi").dropDuplicates(["_row_key"])
    return back(once.unionByName(one_of_many).select(*docs.columns))


def brute_force(texts: dict[int, str | None], size: int = 5, percent: int = 80) -> dict[int, tuple[int, int]]:
    """Definition by all pairs, for tests: doc_id -> (n_shingles, component_id)."""
    import re
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j:j + size]) for j in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}
