"""Hand goldens of FIXTURES.md section 3.1 (reviews, recoding, balancing, cleaning, sums)."""

from pyspark.sql import functions as F

from revforge.functions.text import clean_ascii, drop_stop_words, word_tokens
from revforge.operators import aggregates, balance, columns
from revforge.operators.setops import union_sources


def coded(reviews):
    return columns.with_label_code(columns.recode_labels(reviews))


def test_recode_labels(reviews):
    got = {r.row_id: r.label for r in columns.recode_labels(reviews).collect()}
    assert got[1] == "bug report" and got[2] == "feature request" and got[3] == "rating"
    assert got[4] == "user experience" and got[11] == "XX" and got[8] is None


def test_label_codes(reviews):
    got = {r.row_id: r.new_label for r in coded(reviews).collect()}
    assert [got[i] for i in range(1, 13)] == [0, 1, 2, 3, 0, 3, 3, 3, 0, 2, 3, 0]


def test_class_counts_with_absent_class(reviews):
    c = coded(reviews)
    got = {r.new_label: r.n for r in aggregates.class_counts(c).collect()}
    assert got == {0: 4, 1: 1, 2: 2, 3: 5}
    got = {r.new_label: r.n for r in aggregates.class_counts(c.filter(F.col("new_label") != 1)).collect()}
    assert got == {0: 4, 1: 0, 2: 2, 3: 5}


def test_filter_present(reviews):
    ids = sorted(r.row_id for r in columns.filter_present(reviews).collect())
    assert ids == [1, 2, 3, 6, 7, 8, 9, 10, 11, 12]


def test_clean_text_keeps_emptied_rows(reviews):
    cleaned = {r.row_id: r.review for r in columns.clean_column_in_place(columns.filter_present(reviews)).collect()}
    assert cleaned[6] == "" and cleaned[7] == "Don't like the newlayout" and len(cleaned[7]) == 24
    in_place = {r.row_id: r.review for r in columns.clean_column_in_place(reviews).collect()}
    assert in_place[4] is None and len(in_place) == 12


def _by_class(df):
    out = {}
    for r in df.orderBy("new_label", "class_rank").collect():
        out.setdefault(r.new_label, []).append(r.row_id)
    return out


def test_balance_longest(reviews):
    got = _by_class(balance.balance_longest(coded(reviews), {0: 2, 1: 2, 2: 2, 3: 2}))
    assert got == {0: [1, 9], 1: [2], 2: [10, 3], 3: [7, 8]}


def test_balance_shortest_null_last(reviews):
    got = _by_class(balance.balance_shortest(coded(reviews), {0: 2, 1: 2, 2: 2, 3: 2}))
    assert got == {0: [5, 9], 1: [2], 2: [3, 10], 3: [6, 11]}


def test_top_longest(reviews):
    assert [r.row_id for r in balance.top_longest(reviews, 3).collect()] == [7, 2, 1]


def test_nested_cuts_are_subsets(reviews):
    cuts = balance.nested_cuts(reviews, [2, 5, 8]).collect()
    assert len(cuts) == 8
    by_cut = {}
    for r in cuts:
        by_cut.setdefault(r.cut, set()).add(r.row_id)
    assert by_cut[2] == {7, 2}


def test_numeric_sums(reviews):
    df = coded(reviews).withColumn("empty", F.lit(None).cast("int"))
    got = {r.column: r.total for r in aggregates.numeric_sums(df).collect()}
    assert got == {"row_id": 78.0, "new_label": 20.0, "empty": 0.0}


def test_add_row_ids_after_balancing(reviews):
    b = balance.balance_longest(coded(reviews), {0: 2, 1: 2, 2: 2, 3: 2})
    ided = columns.add_row_ids(b, [F.col("new_label"), F.col("class_rank")], name="ID")
    got = [r.row_id for r in ided.orderBy("ID").collect()]
    assert got == [1, 9, 2, 10, 3, 7, 8]
    assert sorted(r.ID for r in ided.collect()) == list(range(1, 8))


def test_union_sources(spark, reviews):
    other = spark.createDataFrame([("hi", "user", 0), ("hi", "user", 0)], "review string, label string, turn long")
    u = union_sources(reviews, other).collect()
    assert len(u) == 14
    assert all(r.turn is None for r in u if r.row_id is not None)
    assert sum(1 for r in u if r.row_id is None) == 2


def test_remove_stopwords(spark):
    df = spark.createDataFrame([("Great app",), ("The app is not good",)], "t string")
    got = [r.k for r in df.select(F.array_join(drop_stop_words(word_tokens(clean_ascii("t"))), " ").alias("k"))
           .collect()]
    assert got == ["Great app", "app good"]


def test_tokenizer_splits_contractions(spark):
    df = spark.createDataFrame([("I don't like it, can't stop!",)], "t string")
    toks = df.select(word_tokens("t").alias("x")).first().x
    assert toks == ["I", "do", "n't", "like", "it", ",", "ca", "n't", "stop", "!"]


def test_tokenizer_keeps_raw_text(spark):
    cases = {
        "DON'T wait, I cannot": ["DO", "N'T", "wait", ",", "I", "can", "not"],
        "well-known v3.5 costs 12.50... abc123": ["well-known", "v3.5", "costs", "12.50", "...", "abc123"],
        "über\ncafé it's 1,250 wide -- ok.": ["über", "café", "it", "'s", "1,250", "wide", "--", "ok", "."],
        "we'LL 'quote' Gonna": ["we", "'LL", "'", "quote", "'", "Gon", "na"],
        "": [],
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    got = {r.t: r.x for r in df.select("t", word_tokens("t").alias("x")).collect()}
    assert got == {**cases, None: None}


def test_rename_and_drop_errors(reviews):
    import pytest
    with pytest.raises(KeyError):
        columns.drop_column(reviews, "nope")
    with pytest.raises(ValueError):
        columns.rename_contains(reviews.withColumn("label_id", F.lit(1)), "label_id", "label")
    assert columns.rename_contains(reviews, "row_", "").columns[0] == "id"
