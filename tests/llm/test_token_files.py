"""Token files against the tokenizers library, and their random access."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecprobe.llm.parameters import WORD_BPE
from vecprobe.llm.token_files import TokenFile, TokenWriter, read_documents, token_digests, write_token_files

from .texts import awkward


def _ids(texts):
    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation()
    t.no_padding()
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_documents_come_back_in_order(spark, tmp_path):
    texts = awkward()
    rows = [((i * 37) % len(texts), t, "x", 1) for i, t in enumerate(texts)]
    rows += [(None, "no id", "x", 1), *[(5, "again", "x", 1)] * 40]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, place int").repartition(4)
    ids = _ids([r[1] for r in rows])
    manifest = write_token_files(df, WORD_BPE, str(tmp_path / "t"), length=64, rows=4, file_text=8000).collect()
    got = sorted(read_documents(spark.createDataFrame(manifest)).collect(), key=lambda r: r.start)
    assert len(manifest) > 3 and len(got) == len(rows)
    assert sum(r.n_docs for r in manifest) == len(rows) and all(r.n_sequences == -(-r.n_tokens // 64) for r in manifest)
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (r[0] is None, r[0] or 0, len(x), crc(x)) for r, x in zip(rows, ids, strict=True))
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    default = token_digests(df, WORD_BPE)
    assert sorted(map(tuple, default.filter("doc_id is not null").collect())) == sorted(map(tuple, [r for r in got if r.doc_id is not None]))
    assert token_digests(df.filter("false"), WORD_BPE).count() == 0
    assert {(r.n_tokens, r.ids_crc32) for r in token_digests(df.withColumn("text", F.lit(None).cast("string")), WORD_BPE).collect()} == {(1, crc([1]))}


def test_sequences_are_views_of_the_mapped_file(tmp_path):
    import pyarrow as pa
    path = str(tmp_path / "one.arrow")
    w = TokenWriter(path, pa.int64(), np.dtype("<u2"), length=8, rows=3)
    docs = [np.arange(1, 6), np.arange(50), np.array([1]), np.arange(7)]
    for i, d in enumerate(docs):
        w.add(i, d)
    with pytest.raises(ValueError):
        w.add(9, np.empty(0))
    w.close()
    f, flat = TokenFile(path), np.concatenate(docs)
    assert len(f) == -(-len(flat) // 8)
    ends = np.cumsum([len(d) for d in docs]) - 1
    place = np.arange(len(f) * 8)
    flat, used = np.r_[flat, np.zeros(len(place) - len(flat))], place < len(flat)
    for i in [*range(len(f)), 0, len(f) - 1]:
        tokens, mask, last = f[i]
        own = slice(8 * i, 8 * i + 8)
        assert not tokens.flags.owndata and not tokens.flags.writeable and len(tokens) == 8 and tokens.dtype == np.uint16
        assert (tokens == flat[own]).all() and mask.to_pylist() == used[own].tolist() and last.to_pylist() == np.isin(place, ends)[own].tolist()
    with pytest.raises(IndexError):
        f[len(f)]
    assert np.shares_memory(f[0][0], f.batch(0).column("tokens").values.to_numpy())
    assert f[1][1].buffers()[1].address == f.batch(0).column("mask").values.buffers()[1].address


def test_wide_vocabularies_and_damaged_lists(spark, tmp_path):
    import pyarrow as pa
    bad = TokenWriter(str(tmp_path / "bad.arrow"), pa.int64(), np.dtype("<u2"), length=4, rows=2)
    bad.add(1, np.array([5, 6]))
    bad.listed[2][0] = 1
    bad.close()
    with pytest.raises(Exception, match="ends and list"):
        read_documents(spark.createDataFrame([(0, bad.path, 0)], "part long, path string, start long")).collect()
    path = str(tmp_path / "wide.arrow")
    w = TokenWriter(path, pa.string(), np.dtype("<u4"), length=4, rows=2)
    w.add("a", np.array([70_000, 5]))
    w.add(None, np.array([1]))
    w.close()
    assert TokenFile(path)[0][0].tolist() == [70_000, 5, 1, 0]
    manifest = spark.createDataFrame([(0, path, 10)], "part long, path string, start long")
    assert [tuple(r)[:3] for r in read_documents(manifest, "string").collect()] == [("a", 10, 2), (None, 12, 1)]
