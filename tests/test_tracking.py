"""P1-P4 and G2 from texts, and G4, on small rows."""

from vecprobe.operators.checkpoints import checkpoint_report
from vecprobe.operators.tracking import source_texts, track_domains


def test_report_counts_texts_not_predictions(spark):
    words = {"birds": "wing feather nest beak", "ships": "hull mast sail anchor"}
    rows = [(10 * k + i, d, f" {w} {w} number{i} ") for k, (d, w) in enumerate(words.items()) for i in range(4)]
    rows += [(90, "rare", "only one text of this domain here"), (91, "birds", "short"), (92, "birds", None), (93, None, "a text without any domain at all")]
    df = spark.createDataFrame(rows, "doc_id long, domain string, text string")
    source = source_texts(df, "doc_id", "domain", "text")
    assert sorted(r.id for r in source.collect()) == [*range(4), *range(10, 14), 90]
    gens = [(0, "birds", "feather and beak"), (1, "ships", "sail to the anchor"), (2, "ships", "sail to the anchor"), (3, "ships", None),
            (4, "birds", "mast mast hull"), (5, "rare", "mast"), (6, None, "mast")]
    r = track_domains(source, spark.createDataFrame(gens, "id long, domain string, text string"), n_perm=50).collect()[0]
    assert (r.n, r.hits, r.n_unique, r.n_total, r.domain_lock) == (5, 3, 4, 5, True)  # the empty text goes to the first domain
    assert r.covered_domains == ["birds", "ships"] and r.excluded_domains == ["rare"] and r.chance == 0.5
    assert {d: (x.hits, x.n) for d, x in r.per_domain_acc.items()} == {"birds": (1, 2), "ships": (2, 3)}
    assert [(x.id, x.truth) for x in r.generations_sample] == [(0, "birds"), (1, "ships"), (2, "ships"), (3, "ships"), (4, "birds")]
    assert 0 < r.wilson_ci_95.lo < r.accuracy < r.wilson_ci_95.hi < 1


def test_checkpoints_are_told_apart(spark):
    good = [("good", i, i // 2, f"topic{i // 2} about thing{i // 2}") for i in range(12)]
    bad = [("flat", i, i // 2, "the same text") for i in range(12)]
    df = spark.createDataFrame([*good, *bad, ("lone", 1, 1, None)], "ckpt string, id long, doc long, text string")
    got = {r.ckpt: r for r in checkpoint_report(df, n_perm=100).collect()}
    assert got["good"].tfidf.doc_top1 == got["good"].semantic.doc_top1 == 1.0 and got["good"].tfidf.p_value < 0.05
    assert (got["good"].n_unique, got["flat"].n_unique, got["flat"].n_total) == (6, 1, 12)
    assert got["flat"].tfidf.doc_top1 == got["flat"].semantic.doc_top1 == 2 / 12  # all tie: the first document
    assert got["lone"].n == 1 and got["lone"].semantic.doc_top1 == 0.0 and got["lone"].generations_sample == [""]
    assert got["flat"].generations_sample == ["the same text"] * 5
