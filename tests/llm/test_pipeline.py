"""The corpus pipeline on the smallest tables, stage by stage."""

import corpus_pipeline
import pytest
from vecprobe.llm.jaccard_join import brute_force
from vecprobe.session import cut_lineage

SF = "/root/testdata/sf0.001"
CLASHING = ("_found", "_moved", "_text", "_measures", "_row_key", "_row_digest", "_row_at", "_row_id", "score", "lang_pred", "own_found")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_take_awkward_rows_and_keep_columns_named_like_their_own(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None), (None, ""), (None, "Write to eve@site.org or +1 202 555 0143 today. " * 3), (3, ""), (3, None),
                                 (3, "Write to eve@site.org or +1 202 555 0143 today. " * 3), (10 ** 15, "plain words and more of them " * 20000)],
                                "doc_id long, text string")
    docs = docs.unionByName(odd.unionByName(odd), allowMissingColumns=True)
    plain = cut_lineage(stage(spark, docs, SF), "plain")
    wide = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in CLASHING])
    out = cut_lineage(stage(spark, wide, SF), "wide")
    assert out.columns == wide.columns
    assert out.filter(" or ".join(f"{c} <> concat('{c}', doc_id)" for c in CLASHING)).isEmpty()
    key = lambda df: sorted(map(repr, df.select("doc_id", "text", "lang").collect()))
    assert key(out) == key(plain)
    empty = stage(spark, wide.filter("false"), SF)
    assert empty.columns == wide.columns and empty.isEmpty()


def test_run_on_an_empty_table(spark, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{table}.parquet").filter("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut_lineage(stage(spark, docs, SF), name)
        assert out.columns == before
        if name == "near_duplicates":
            groups = brute_force({r.doc_id: r.text for r in docs.collect()})
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in groups.items() if i == c}
        if name == "personal_data":
            assert out.count() == docs.count()
            assert out.filter("n_chars <> char_length(text)").count() == 0
            assert out.filter("text rlike '@mail[0-9]+[.]example'").count() == 0
        docs = out
    kept = docs.count()
    assert 0.5 * n < kept < n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len({r.doc_id for r in packed}) == kept


def test_without_any_lang_texts_with_a_letter_stay(spark):
    texts = ["plain words", "слово", "中文", "12 ...", "", None, "plain words"]
    docs = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n int")
    out = corpus_pipeline.language(spark, docs, SF)
    assert out.columns == docs.columns
    assert [(r.doc_id, r.lang) for r in out.orderBy("doc_id").collect()] == [(0, None), (1, None), (2, None), (6, None)]


def test_language_keeps_columns_named_like_its_own(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = corpus_pipeline.language(spark, docs, SF)
    out = corpus_pipeline.language(spark, docs.selectExpr("*", "-7.0D AS score", "'x' AS lang_pred", "1 AS _score"), SF)
    assert out.columns == [*docs.columns, "score", "lang_pred", "_score"] and out.count() == plain.count()
    assert {(r.score, r.lang_pred, r._score) for r in out.select("score", "lang_pred", "_score").distinct().collect()} == {(-7.0, "x", 1)}
