"""What a worker holds beside its texts does not grow with the batch."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from vecprobe.llm import jaccard_join, language_id, quality_ranker

NONE = SimpleNamespace(value=np.empty(0, np.uint64))


class Docs:
    """Stands for a table: gives the function that mapInArrow would run."""

    def __init__(self, schema):
        self.schema = schema

    def mapInArrow(self, run, schema):
        return run


def batch(n):
    rnd = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(30000)])
    text = [" ".join(words[rnd.integers(len(words), size=300)]) for _ in range(n)]
    return pa.record_batch({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(text)})


def peak(run, b):
    for _ in run([b.slice(0, 50)]):
        pass  # tables that every worker has
    tracemalloc.start()
    for _ in run([b]):
        pass
    high = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return high / 1e6


@pytest.mark.parametrize("name, limit", [("measures", 30), ("scan", 70), ("post", 40)])
def test_memory_beside_a_batch_of_ten_thousand_texts(name, limit):
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    kind = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    run = {"measures": lambda: quality_ranker.with_measures(Docs(kind)), "scan": lambda: jaccard_join._scan(5),
           "post": lambda: jaccard_join._post(5, 80, NONE, SimpleNamespace(value=np.empty(0, np.uint32)))}[name]()
    high = peak(run, batch(10_000))
    print(f"{name}: {high:.0f} MB")
    assert high < limit


def driver_peak(work) -> float:
    tracemalloc.start()
    work()
    high = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return high / 1e6


def test_frequent_shingles_reach_the_driver_as_columns(spark):
    b = batch(400)
    docs = spark.createDataFrame(pa.Table.from_batches([b, b.set_column(0, "doc_id", pa.array(range(400, 800), pa.int64()))])).coalesce(1)
    jaccard_join.JaccardJoin(docs.limit(10))  # what any join loads
    high = driver_peak(lambda: jaccard_join.JaccardJoin(docs))
    print(f"shingles: {high:.0f} MB")
    assert high < 12


def test_language_sample_reaches_the_driver_as_columns(spark):
    rnd = np.random.default_rng(5)
    text = ["".join(map(chr, rnd.integers(0x4E00, 0x9F00, size=1000))) for _ in range(400)]
    docs = spark.createDataFrame(pa.table({"doc_id": pa.array(range(400), pa.int64()), "text": text, "lang": ["en", "de"] * 200})).coalesce(2)
    train = lambda d: language_id.Model.train(d, F.lit(True), F.col("doc_id") % 4 == 3)
    train(docs.limit(10))
    got = []
    high = driver_peak(lambda: got.append(train(docs)))
    print(f"language: {high:.0f} MB")
    assert got[0].langs == ["de", "en"] and high < 30
