"""Minimal acyclic transducer of frequent words with id outputs (operator 9).

States of the trie of all words whose sets of remaining suffixes agree are one
state, found by summed suffix hashes, without building the trie. A transition
carries how many words come before it in byte order, so the sum along a path
numbers the words, and the number finds the word's ids. The arrays are files
that each executor maps into memory; all lookups of a batch walk together."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .bpe import Encoder, split_words, vocabulary
from .textbuf import SpanHash, U, text_batches

#: Words of the lexicon; the driver builds it, in a few seconds.
LEXICON_WORDS = 1 << 17
#: Longer words stay out of the lexicon and are merged each time.
LEXICON_BYTES = 64
PARTS = ("key", "target", "skip", "final", "id", "offset")


class Lexicon:
    """``key``: sorted state << 8 | byte of the transitions, with ``target`` and
    ``skip``; ``final`` by state; ``id`` and ``offset`` of the outputs."""

    def __init__(self, **arrays: np.ndarray):
        for k in PARTS:
            setattr(self, k, arrays[k])

    @classmethod
    def build(cls, words: list[bytes], path: str) -> Lexicon:
        words = sorted(set(w for w in words if w))
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.r_[0, np.cumsum(size)]
        ids, offset = vocabulary(path).merge(data, start[:-1], start[1:])
        if not words:
            none = np.empty(0, np.int64)
            return cls(key=none, target=none, skip=none, final=np.zeros(1, bool), id=none, offset=np.zeros(1, np.int64))
        n, m = len(words), int(size.max())
        grid = np.full((n, m + 1), -1, np.int16)  # bytes by word and depth; -1 past the end
        col = np.arange(m)
        inside = col[None, :] < size[:, None]
        grid[:, :m][inside] = data
        suffix = SpanHash(data)
        # same[i]: depth that word i shares with the word before it
        differ = np.r_[np.zeros((1, m + 1), bool), grid[1:] != grid[:-1]]
        shared = np.where(differ.any(1), differ.argmax(1), 0)
        shared[0] = 0
        column = []
        for d in range(m + 1):
            alive = np.flatnonzero(size >= d)
            h = suffix(start[alive] + d, start[alive] + size[alive])
            # a node of depth d: consecutive words of at least d bytes that share d
            gap = np.r_[0, alive[:-1] + 1]
            low = np.minimum.reduceat(shared[:alive[-1] + 1], gap)
            head = np.flatnonzero(np.r_[True, low[1:] < d])
            node_hash = np.add.reduceat(h, head) + np.diff(np.r_[head, len(alive)]).astype(U)
            node = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(alive)]))
            full = np.full(n, -1, np.int64)
            full[alive] = node
            column.append((full, node_hash, head, alive))
        all_hash, number = np.unique(np.concatenate([c[1] for c in column]), return_inverse=True)
        base = np.r_[0, np.cumsum([len(c[1]) for c in column])]
        state = [number[base[d]:base[d + 1]] for d in range(m + 1)]
        root = state[0][0]
        swap = np.arange(len(all_hash))
        swap[root], swap[0] = 0, root
        final = np.zeros(len(all_hash), bool)
        keys, targets, skips = [], [], []
        for d in range(m):
            full, _, head, alive = column[d]
            down = column[d + 1][0]
            rows = np.flatnonzero(size > d)
            child_head = rows[np.r_[True, down[rows][1:] != down[rows][:-1]]]
            s = swap[state[d][full[child_head]]]
            keys.append(s << 8 | grid[child_head, d])
            targets.append(swap[state[d + 1][down[child_head]]])
            first_word = alive[head][full[child_head]]
            skips.append(child_head - first_word)
        for d in range(m + 1):
            ends = np.flatnonzero(size == d)
            final[swap[state[d][column[d][0][ends]]]] = True
        key, at = np.unique(np.concatenate(keys), return_index=True)
        return cls(key=key, target=np.concatenate(targets)[at], skip=np.concatenate(skips)[at], final=final, id=ids, offset=offset)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Word numbers of byte spans; -1 where the lexicon lacks the word."""
        n = len(start)
        out = np.full(n, -1, np.int64)
        if not len(self.key):
            return out
        live, state, number, size = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), end - start
        for d in range(int(size.max()) + 1 if n else 0):
            done = size[live] == d
            if done.any():
                ok = done & self.final[state]
                out[live[ok]] = number[ok]
                live, state, number = live[~done], state[~done], number[~done]
            if not len(live):
                break
            k = state << 8 | data[start[live] + d]
            at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            hit = self.key[at] == k
            live, at = live[hit], at[hit]
            state, number = self.target[at], number[hit] + self.skip[at]
        return out

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from .bpe import ragged
        where, ends = ragged(self.offset, number)
        return self.id[where], ends

    def publish(self, spark: SparkSession) -> str:
        """Write the arrays to the shared folder and have every executor fetch
        them; returns the name for ``mapped``."""
        name, sc = f"lexicon-{uuid.uuid4().hex}", spark.sparkContext
        for part in PARTS:
            raw = io.BytesIO()
            np.save(raw, getattr(self, part))
            path = scratch_path(spark, f"{name}-{part}.npy")
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p)
            out.write(bytearray(raw.getvalue()))
            out.close()
            sc.addFile(path)
        return name

    @classmethod
    def mapped(cls, name: str) -> Lexicon:
        return cls(**{k: np.load(SparkFiles.get(f"{name}-{k}.npy"), mmap_mode="r") for k in PARTS})


def frequent_words(docs: DataFrame, limit: int = LEXICON_WORDS) -> list[bytes]:
    """The ``limit`` words most frequent in the batches where they repeat."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        for _, s in text_batches(batches, 8 << 20):
            start, end = split_words(s, True)
            if not len(start):
                continue
            _, example, n = np.unique(SpanHash(s.data)(start, end), return_index=True, return_counts=True)
            keep = (n > 1) & (end - start <= LEXICON_BYTES)[example]
            e, raw = example[keep], s.data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([raw[a:b] for a, b in zip(start[e].tolist(), end[e].tolist(), strict=True)], pa.binary()), pa.array(n[keep])],
                schema=schema)

    top = (docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "word").limit(limit))
    return [bytes(r.word) for r in top.select("word").toLocalIterator()]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(path: str, name: str) -> Encoder:
    if (path, name) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, name] = Encoder(path, Lexicon.mapped(name))
    return _ENCODERS[path, name]


def bpe_roundtrip(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """Encode and decode each ``text`` with the byte-level vocabulary file
    ``path``: adds ``ids`` array<int> and ``decoded`` string to ``doc_id``.

    A null or empty text has no ids and decodes to the empty string. Rows are
    independent: repeated and null doc_ids stay; other columns are ignored; an
    empty table gives no rows. Words are told apart by 64-bit hashes."""
    return _codec(docs, path, words, "ids array<int>, decoded string", _full)


def _full(ids, at, raw, ends, n):
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
    text = pa.array([raw[ends[at[i]]:ends[at[i + 1]]].tobytes().decode("utf-8", "replace") for i in range(n)], pa.string())
    return [lists, text]


def _digest(ids, at, raw, ends, n):
    import hashlib
    flat = ids.astype("<u4")
    sha = lambda x: hashlib.sha256(x.tobytes()).hexdigest()
    decoded = [hashlib.sha256(raw[ends[at[i]]:ends[at[i + 1]]].tobytes().decode("utf-8", "replace").encode()).hexdigest() for i in range(n)]
    return [pa.array(np.diff(at)), pa.array([sha(flat[at[i]:at[i + 1]]) for i in range(n)]), pa.array(decoded)]


def bpe_digests(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """``bpe_roundtrip`` reduced in the same tasks to doc_id, n_tokens,
    ids_sha256 and decoded_sha256."""
    return _codec(docs, path, words, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def _codec(docs, path, words, columns, make) -> DataFrame:
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    name = Lexicon.build(frequent_words(docs, words), path).publish(docs.sparkSession)

    def run(batches):
        enc = _encoder(path, name)
        for b, s in text_batches(batches):
            ids, at = enc.encode(s)
            raw, ends = enc.token_bytes(ids)
            cols = [b.column("doc_id").slice(s.start, len(s)), *make(ids, at, raw, ends, len(s))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *[c.split(" ")[0] for c in columns.split(", ")]])

    return docs.mapInArrow(run, f"doc_id {kind}, {columns}")
