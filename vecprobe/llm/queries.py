"""Registered queries: each operator with production parameters over its whole
table. None has oracle SQL unless listed in ``LLM_ORACLE``."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import chat_format
from . import parameters as P
from . import prefix_trie as trie
from .embedding_graph import near_duplicates
from .fingerprints import fingerprint_versions
from .jaccard_join import jaccard_groups
from .language_id import identify_languages, remainder
from .packing import pack
from .pii_surrogates import replace_pii
from .quality_ranker import score_documents
from .token_counts import section_tokens
from .token_files import token_digests
from .transducer import bpe_digests
from .whitening import whitened_components


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), P.WORD_BPE, P.SEQUENCE_TOKENS)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, P.PII_KEY, count_as="n_entities")


def op4_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(remainder(5) == 0, F.lit(True))
    out = score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(read_table(spark, sf_dir, "documents"), P.BYTE_BPE)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts consist of control strings."""
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), "
                      "(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.conversation_digests(chat_format.format_conversations(turns))


def op7_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"), P.COSINE)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(read_table(spark, sf_dir, "documents"))


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"), P.BYTE_BPE)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents"), P.SHINGLE_WORDS, P.SIMILARITY_PERCENT)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector, whitened on the list of distinct ones."""
    return whitened_components(read_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with their family's first turns."""
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token files and read back from them."""
    return token_digests(read_table(spark, sf_dir, "documents"), P.WORD_BPE)


LLM_QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_best_fit_packing, op3_pii_surrogates, op4_quality_ranker, op5_token_counts, op6_chat_format, op7_embedding_graph, op8_fingerprints,
    op9_bpe_transducer, op10_ngram_jaccard, op11_embedding_whitening, op12_prefix_trie, op13_token_files)} | {"pipeline": corpus_pipeline.run}
LLM_ORACLE: dict[str, str] = {"op6_chat_format": chat_format.ORACLE_SQL, "op12_prefix_trie": trie.ORACLE_SQL}
