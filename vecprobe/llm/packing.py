"""Best-fit packing by a grouping genetic algorithm on islands (operator 2).

Texts are cut into pieces of at most ``capacity`` tokens in one pass; what
follows works on the small table of pieces. A hash deals the pieces to shards
of about ``SHARD`` pieces, so memory does not grow with the input. Each shard
is evolved by ``ISLANDS`` islands, tasks of their own, for ``EPOCHS`` epochs;
between epochs each island's elite migrates to the next island of its shard.

An individual is a grouping of pieces into bins. Crossover injects the other
parent's well-filled bins whole, drops the child's bins that held any of their
pieces, and puts the displaced pieces back by best fit, largest first. At the
end the badly filled bins of up to ``POOL`` shards are packed anew together."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import worker_encoder
from .textbuf import text_batches, trim

SHARD, ISLANDS, EPOCHS, POOL = 4096, 2, 2, 64
POPULATION, CHILDREN = 4, 12
WELL_FILLED, BADLY_FILLED = 0.995, 0.97
#: Texts are encoded in slices of so many bytes.
ENCODED_BYTES = 1 << 19


class Bins:
    """Open bins of one individual with best fit in constant time: a bit mask
    tells which amounts of free room occur."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free = capacity, [], []
        self.room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def _file(self, b: int) -> None:
        f = self.free[b]
        self.room[f].append(b)
        self.mask |= 1 << f

    def open(self, items: list[int], free: int) -> None:
        self.items.append(items)
        self.free.append(free)
        self._file(len(self.items) - 1)

    def best_fit(self, item: int, size: int) -> None:
        m = self.mask >> size
        if not m:
            self.open([item], self.capacity - size)
            return
        f = size + (m & -m).bit_length() - 1
        b = self.room[f].pop()
        if not self.room[f]:
            self.mask ^= 1 << f
        self.items[b].append(item)
        self.free[b] = f - size
        self._file(b)


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def packed(order, sizes: list[int], capacity: int) -> list[list[int]]:
    out = Bins(capacity)
    for i in order:
        out.best_fit(i, sizes[i])
    return out.items


def crossover(mine: list[list[int]], other: list[list[int]], sizes: list[int], capacity: int, rnd) -> list[list[int]]:
    full = [b for b in other if sum(sizes[i] for i in b) >= WELL_FILLED * capacity]
    injected = rnd.sample(full, max(1, len(full) // 2)) if full else []
    taken = {i for b in injected for i in b}
    child, displaced = Bins(capacity), []
    for b in injected:
        child.open(list(b), capacity - sum(sizes[i] for i in b))
    rest = [b for b in mine if taken.isdisjoint(b)]
    worst = sorted(rest, key=lambda b: sum(sizes[i] for i in b))[:max(1, len(rest) // 10)]
    loose = {id(b) for b in worst}  # mutation: the emptiest bins are dealt out too
    for b in mine:
        if not taken.isdisjoint(b) or id(b) in loose:
            displaced += [i for i in b if i not in taken]
        else:
            child.open(list(b), capacity - sum(sizes[i] for i in b))
    for i in sorted(displaced, key=lambda i: -sizes[i]):
        child.best_fit(i, sizes[i])
    return child.items


def evolve(sizes: list[int], capacity: int, seed: str, elites: list[list[list[int]]]) -> list[list[int]]:
    """The best grouping of pieces (sizes in descending order) of one epoch."""
    rnd = random.Random(seed)
    n, least = len(sizes), -(-sum(sizes) // capacity)
    score = lambda bins: fitness(bins, sizes, capacity)
    people = [(score(e), e) for e in elites]
    while len(people) < POPULATION:
        noise = 0.0 if not people else 0.02 * len(people)
        order = sorted(range(n), key=lambda i: -sizes[i] * (1 + noise * (rnd.random() - 0.5)))
        bins = packed(order, sizes, capacity)
        people.append((score(bins), bins))
    people.sort(key=lambda p: p[0], reverse=True)
    for _ in range(CHILDREN):
        if len(people[0][1]) <= least:
            break
        a, b = rnd.sample(people, 2)
        child = crossover(a[1], b[1], sizes, capacity, rnd)
        people.append((score(child), child))
        people.sort(key=lambda p: p[0], reverse=True)
        people = people[:POPULATION]
    return people[0][1]


def _ordered(p: pd.DataFrame) -> pd.DataFrame:
    """A shard's rows in the order that all its islands share."""
    return p.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)


def _groups(packed_bins: bytes) -> list[list[int]]:
    number = np.frombuffer(packed_bins, np.int32)
    by = np.argsort(number, kind="stable")
    return [x.tolist() for x in np.split(by, np.flatnonzero(np.diff(number[by])) + 1) if len(x)]


def _island(capacity: int, epoch: int):
    def run(key, pieces: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        if not len(pieces):
            return pd.DataFrame({"shard": [], "island": [], "bins": []})
        sizes = sorted(pieces["length"].tolist(), reverse=True)
        known = [_groups(e) for e in sorted(map(bytes, elites["bins"]))]
        best = evolve(sizes, capacity, f"{key}-{epoch}", known)
        number = np.empty(len(sizes), np.int32)
        for k, b in enumerate(best):
            number[b] = k
        return pd.DataFrame({"shard": [key[0]], "island": [key[1]], "bins": [number.tobytes()]})

    return run


def _placed(p: pd.DataFrame, bins: list[list[int]], first: int, capacity: int) -> pd.DataFrame:
    sizes = p["length"].tolist()
    seq, off, fill = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.zeros(len(p))
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            seq[i], off[i] = first + k, at
            at += sizes[i]
        fill[b] = at / capacity
    return p.assign(sequence_id=seq, offset=off, loose=fill < BADLY_FILLED)


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (of little-endian
    unsigned 32-bit ids). Every document ends with ``end_id``; only longer ones are cut."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = worker_encoder(path)
        for b, s in text_batches(batches, ENCODED_BYTES):
            ids, at = enc.encode(s)
            rows, piece, start, length, crc = [], [], [], [], []
            for i in range(len(s)):
                own = np.append(ids[at[i]:at[i + 1]], end_id).astype("<u4")
                for k, a in enumerate(range(0, len(own), capacity)):
                    part = own[a:a + capacity]
                    rows.append(s.start + i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows)), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, shard: int = SHARD) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (gapless from 0). A null or empty text is the end token
    alone. Rows that repeat a doc_id, and null doc_ids, are documents of their
    own; columns other than doc_id and text are ignored; an empty table gives
    no rows. The same rows give the same packing."""
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = cut_lineage(pieces_of(docs, path, capacity, end_id), "pieces")
    n_shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_shards)))
    many = dealt.select("shard", "length", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"))
    kind = "shard long, island int, bins binary"
    elites = docs.sparkSession.createDataFrame([], kind)
    for epoch in range(EPOCHS):
        found = (many.groupBy("shard", "island").cogroup(elites.groupBy("shard", "island"))
                 .applyInPandas(_island(capacity, epoch), kind))
        found = cut_lineage(found, "elites")
        moved = found.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
        elites = found.unionByName(moved)

    def choose(key, p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        p = _ordered(p)
        sizes = p["length"].tolist()
        best = max((_groups(x) for x in sorted(map(bytes, e["bins"]))), key=lambda b: fitness(b, sizes, capacity))
        return _placed(p, best, int(key[0]) << 32, capacity)

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    full = f"{head}, shard long, sequence_id long, offset long, loose boolean"
    placed = dealt.groupBy("shard").cogroup(found.groupBy("shard")).applyInPandas(choose, full)
    placed = cut_lineage(placed, "packed")

    def again(key, p: pd.DataFrame) -> pd.DataFrame:
        p = _ordered(p)
        sizes = p["length"].tolist()
        was = [x.tolist() for x in p.groupby("sequence_id").indices.values()]
        best = evolve(sizes, capacity, f"pool-{key}", [was])
        return _placed(p, best, -((int(key[0]) + 1) << 40), capacity)

    pooled = (placed.filter("loose").withColumn("pool", F.floor(F.col("shard") / POOL))
              .groupBy("pool").applyInPandas(again, f"{full}, pool long"))
    out = [*cols, "sequence_id", "offset"]
    return placed.filter("not loose").select(*out).unionByName(pooled.select(*out))
