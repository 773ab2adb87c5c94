"""F1, F2 and T9 on rows that the tables lack: missing texts, label markers."""

from vecprobe.operators.corpus import contamination_filter, min_length_filter, text_presence

ROWS = [(1, "a", "12: KEEP this"), (2, "a", "plain 12 : KEEP"), (3, "a", None), (4, "b", ""), (5, "b", "x 7: KEEP"),
        (6, "b", "KEEP: 7"), (7, None, "  " + "y" * 20 + " \n"), (8, None, " " + "z" * 21)]


def test_text_presence_counts_null_and_empty_texts(spark):
    df = spark.createDataFrame(ROWS, "id long, dom string, text string")
    got = {r.dom: (r.n_total, r.n_missing, r.n_usable) for r in text_presence(df, "text", ["dom"]).collect()}
    assert got == {"a": (3, 1, 2), "b": (3, 1, 2), None: (2, 0, 2)}
    assert tuple(text_presence(df.filter("false"), "text").first()) == (0, 0, 0)


def test_contamination_filter_drops_marked_rows_and_keeps_rows_without_text(spark):
    df = spark.createDataFrame(ROWS, "id long, dom string, text string")
    assert sorted(r.id for r in contamination_filter(df, "text").collect()) == [2, 3, 4, 6, 7, 8]


def test_min_length_counts_the_stripped_text(spark):
    df = spark.createDataFrame(ROWS, "id long, dom string, text string")
    assert [r.id for r in min_length_filter(df, "text").collect()] == [8]
