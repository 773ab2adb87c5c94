"""A training corpus from ``documents``: quality, language, near-duplicates,
personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame that is written as Parquet before the next one
reads it. All stages but the last return the columns of ``documents``. Nulls,
empty texts, repeated rows, empty tables and extra columns are treated as the
stage's operator states; a document without text fails the first two stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecprobe.llm import parameters as P
from vecprobe.llm.jaccard_join import drop_near_duplicates
from vecprobe.llm.language_id import UNKNOWN, Model, predict, remainder
from vecprobe.llm.packing import pack
from vecprobe.llm.pii_surrogates import replace_pii
from vecprobe.llm.quality_ranker import keep_good
from vecprobe.operators.extraction import free_name
from vecprobe.session import cut_lineage
from vecprobe.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the ranker, fitted on the labels, does not reject."""
    learn = ~F.coalesce(remainder(5) == 0, F.lit(True))
    return keep_good(docs, read_table(spark, sf_dir, "labels"), learn)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts of a known language; fills a missing ``lang``. Where no row to
    learn from has a ``lang``, keeps every text with a letter as it is."""
    held = F.coalesce(remainder(4) == 2, F.lit(True))
    model = Model.train(docs, ~held, remainder(4) == 3)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    columns, named = docs.columns, docs
    kept = {c: free_name(columns, c) for c in ("lang_pred", "score")}  # the documents' own columns of these names stay
    for own, other in kept.items():
        named = named.withColumnRenamed(own, other)
    known = predict(named, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= P.LANGUAGE_SCORE))
    known = known.withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "score")
    for own, other in kept.items():
        known = known.withColumnRenamed(other, own)
    return known.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each near-duplicate group."""
    return drop_near_duplicates(docs, P.SHINGLE_WORDS, P.SIMILARITY_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; ``n_chars`` follows the new text."""
    out = replace_pii(docs, P.PII_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a sequence."""
    return pack(docs, P.WORD_BPE, P.SEQUENCE_TOKENS)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates),
          ("personal_data", personal_data), ("packing", packing)]

#: The stages fit models and pack; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
