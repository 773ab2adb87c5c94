"""Token ids as Arrow files of equal-length sequences (operator 13).

A token file is an Arrow stream with a footer (the IPC file format). Its record
batches hold ``rows`` sequences, the last one fewer, in three fixed-size-list
columns of ``length`` entries: ``tokens`` (unsigned, 16 bits where the
vocabulary allows, else 32), ``mask`` (bits: a token, not the padding that only
ends a file) and ``ends`` (bits: a document's last token). So sequence i lies at
a computed place, and a memory-mapped file hands out sequences and masks as
views, without a copy. Beside it a second Arrow file lists the documents:
doc_id, first token, tokens.

Texts are dealt to files by ranges of doc_id and encoded in the task that
writes the file. Each attempt of a task writes files of its own name, and only
those that the finished task reports are in the manifest, so a task that runs
twice leaves one file in use. A file's place in the corpus is the sum of the
tokens of the files before it."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .bpe import vocabulary, worker_encoder
from .textbuf import text_batches, trim

LENGTH, ROWS = 2048, 256
#: Bytes of text of a file: the most, and the least where more files would
#: exceed the shuffle partitions.
FILE_TEXT, LEAST_TEXT = 256 << 20, 4 << 20
#: Documents of a batch of the list of documents.
DOC_ROWS = 1 << 14


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class TokenWriter:
    """Writes documents, one after another, as one token file and its list."""

    def __init__(self, path: str, id_type: pa.DataType, dtype: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.length, self.rows, self.dtype = length, rows, dtype
        told = {"length": str(length), "rows": str(rows)}
        width = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([pa.field("tokens", pa.list_(width, length)), *(pa.field(c, pa.list_(pa.bool_(), length)) for c in ("mask", "ends"))], metadata=told)
        self.doc_schema = pa.schema([("doc_id", id_type), ("first", pa.int64()), ("n_tokens", pa.int64())])
        self.path, (system, at) = path, _open(path)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.sinks = [system.open_output_stream(p) for p in (at, at + ".docs")]
        self.out, self.docs = (pa.ipc.new_file(s, k) for s, k in zip(self.sinks, (self.schema, self.doc_schema), strict=True))
        self.tokens = np.empty(rows * length, dtype)
        self.mask, self.ends = np.ones(rows * length, bool), np.zeros(rows * length, bool)
        self.used, self.n_docs, self.n_tokens, self.n_sequences = 0, 0, 0, 0
        self.listed: tuple[list, list, list] = ([], [], [])

    def add(self, doc_id, ids: np.ndarray) -> None:
        if not len(ids):
            raise ValueError("a document has at least its end token")
        for store, x in zip(self.listed, (doc_id, self.n_tokens, len(ids)), strict=True):
            store.append(x)
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + len(ids)
        at = 0
        while at < len(ids):
            some = min(len(ids) - at, len(self.tokens) - self.used)
            self.tokens[self.used:self.used + some] = ids[at:at + some]
            at, self.used = at + some, self.used + some
            if at == len(ids):
                self.ends[self.used - 1] = True
            if self.used == len(self.tokens):
                self._write(self.rows)
        if len(self.listed[0]) == DOC_ROWS:
            self._list()

    def _write(self, rows: int) -> None:
        n = rows * self.length
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[:n]), self.length) for x in (self.tokens, self.mask, self.ends)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.used, self.n_sequences = 0, self.n_sequences + rows
        self.ends[:] = False

    def _list(self) -> None:
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(self.listed, self.doc_schema, strict=True)], schema=self.doc_schema))
        self.listed = ([], [], [])

    def close(self) -> None:
        if self.used:
            rows = -(-self.used // self.length)
            self.tokens[self.used:rows * self.length] = 0
            self.mask[self.used:rows * self.length] = False
            self._write(rows)
        if self.listed[0]:
            self._list()
        for x in (self.out, self.docs, *self.sinks):
            x.close()


class TokenFile:
    """Random access to a token file. On a local path sequences and masks are
    read-only views of the mapped file; elsewhere one batch is read at a time."""

    def __init__(self, path: str):
        self._batch: tuple[int, pa.RecordBatch] | None = None
        self._readers = [pa.ipc.open_file(self._source(p)) for p in (path, path + ".docs")]
        told = self._readers[0].schema.metadata
        self.length, self.rows = int(told[b"length"]), int(told[b"rows"])
        n = self._readers[0].num_record_batches
        self._size = (n - 1) * self.rows + self.batch(n - 1).num_rows if n else 0

    @staticmethod
    def _source(path: str):
        system, at = _open(path)
        return pa.memory_map(at) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(at)

    def batch(self, k: int) -> pa.RecordBatch:
        if self._batch is None or self._batch[0] != k:
            self._batch = (k, self._readers[0].get_batch(k))
        return self._batch[1]

    def __len__(self) -> int:
        return self._size

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray, pa.BooleanArray]:
        """Tokens, mask and ends of sequence ``i``."""
        if not 0 <= i < self._size:
            raise IndexError(i)
        b, at = self.batch(i // self.rows), i % self.rows * self.length
        tokens, mask, ends = (c.values.slice(at, self.length) for c in b.columns)
        return tokens.to_numpy(), mask, ends

    def tokens(self, first: int, n: int) -> Iterator[tuple[np.ndarray, pa.BooleanArray]]:
        """Tokens ``first`` to ``first + n`` and their ends, as views of batches."""
        size = self.rows * self.length
        while n:
            b, at = self.batch(first // size), first % size
            t, ends = b.column("tokens").values.slice(at, n), b.column("ends").values.slice(at, n)
            if not len(t):
                raise ValueError("the file ends before its documents do")
            yield t.to_numpy(), ends
            first, n = first + len(t), n - len(t)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for k in range(self._readers[1].num_record_batches):
            yield self._readers[1].get_batch(k)


def _width(vocab: str, end_id: int) -> np.dtype:
    return np.dtype("<u2" if max(len(vocabulary(vocab).text_offsets) - 2, end_id) < 1 << 16 else "<u4")


def write_token_files(docs: DataFrame, vocab: str, folder: str | None = None, end_id: int = 1, length: int = LENGTH,
                      rows: int = ROWS, file_text: int = FILE_TEXT) -> DataFrame:
    """Encode every ``text`` of ``docs`` and write it, with ``end_id`` behind it,
    to token files in ``folder`` (default: a new folder of the shared folder),
    which every executor must reach. Returns the manifest, one row per file in
    corpus order: part, path, start (tokens in the files before), n_docs,
    n_tokens, n_sequences.

    Documents follow one another by ascending doc_id, rows of one doc_id by a
    hash of their text; null doc_ids come first. A null or empty text is the end
    token alone; a long one goes on in as many sequences as it takes. Columns
    other than doc_id and text are ignored; an empty table gives an empty
    manifest."""
    spark = docs.sparkSession
    folder = (folder or scratch_path(spark, f"tokens-{uuid.uuid4().hex}")).rstrip("/")
    rows_in = docs.select("doc_id", "text")
    size = rows_in.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, -(-size // file_text), min(parts, size // LEAST_TEXT))
    # a row's place spreads a text that one doc_id repeats very often
    order = [F.col("doc_id").asc_nulls_first(), "digest", "place"]

    def write(batches):
        enc, dtype = worker_encoder(vocab), _width(vocab, end_id)
        part, out = TaskContext.get().partitionId(), None
        for b, s in text_batches(batches):
            ids, at = enc.encode(s)
            for i, doc_id in enumerate(b.column("doc_id").slice(s.start, len(s)).to_pylist()):
                out = out or TokenWriter(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow", b.schema.field("doc_id").type, dtype, length, rows)
                out.add(doc_id, np.append(ids[at[i]:at[i + 1]], end_id))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [out.path], "n_docs": [out.n_docs], "n_tokens": [out.n_tokens],
                                              "n_sequences": [out.n_sequences]})
        trim()

    written = (rows_in.select("*", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("place"))
               .repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
               .mapInArrow(write, "part long, path string, n_docs long, n_tokens long, n_sequences long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(written, "manifest").select(
        "part", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "n_docs", "n_tokens", "n_sequences")


def read_documents(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Per document of the manifest's files: doc_id, start (tokens of all
    documents before it), n_tokens and ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers), from the files alone. A file whose bits do not
    end a document where its list does is an error."""

    def read(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                f = TokenFile(path)
                for d in f.documents():
                    first, n = (d.column(c).to_pylist() for c in ("first", "n_tokens"))
                    crcs = []
                    for a, m in zip(first, n, strict=True):
                        crc, ends = 0, 0
                        for tokens, last in f.tokens(a, m):
                            crc = zlib.crc32(tokens.astype("<u4"), crc)
                            ends += last.true_count
                        if ends != 1 or not last[-1].as_py():
                            raise ValueError(f"{path}: ends and list of documents differ")
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [d.column("doc_id"), pa.array([start + a for a in first], pa.int64()), d.column("n_tokens"), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return (manifest.select("part", "path", "start").repartition(files, "part")
            .mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"))


def token_digests(docs: DataFrame, vocab: str, end_id: int = 1) -> DataFrame:
    """``write_token_files`` and ``read_documents`` in turn: one row per row of
    ``docs``, read back from the files."""
    return read_documents(write_token_files(docs, vocab, end_id=end_id), docs.schema["doc_id"].dataType.simpleString())
