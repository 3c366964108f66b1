import random

import pytest

from tablespec.functions import text as X

WORDS = ["The", "of", "cat", "CAT", "well-known", "a-a", "see-a", "12", "1.5", "http://x.y/z", "a@b.cd", "été", "house", "_"]


@pytest.fixture
def docs(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(30)))) for i in range(60)]
    return spark.createDataFrame([*rows, (60, None), (61, ""), (62, "the"), (None, "the of the")], "k long, text string")


@pytest.mark.parametrize("classes", [("word",), ("word", "number", "hyphen"), ("hyphen",), ("word", "url", "email")])
def test_a_row_lists_what_grouping_lists(docs, classes):
    want = {(x.k, x.term, tuple(x.positions), x.n) for x in X.text_vector(docs, "k", "text", classes=classes).collect()}
    got = [(x.k, x.term, tuple(x.positions), x.n) for x in X.text_listed(docs, "k", "text", classes).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    short = X.text_listed(docs, "k", "text", classes, positions=False)
    assert sorted(map(repr, short.collect())) == sorted(repr(x) for x in X.text_listed(docs, "k", "text", classes).drop("positions").collect())
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("often", [(), ("the", "nowhere"), ("the", "of", "cat", "a")])
def test_any_terms_may_be_dealt(docs, often):
    """The same postings and counts from single tokens and from lists, with and without positions, over any dealing."""
    shown = lambda df, *cols: sorted(repr(tuple(x[c] for c in cols)) for x in df.collect())
    want = shown(X.text_index(X.text_terms(docs, "k", "text"), "k"), "term", "k", "n", "positions", "df")
    listed = X.text_listed(docs, "k", "text")
    assert shown(X.text_index(X.text_terms(docs, "k", "text"), "k", often=often), "term", "k", "n", "positions", "df") == want
    assert shown(X.text_index(listed, "k", often=often, parts=5), "term", "k", "n", "positions", "df") == want
    bare = X.text_index(listed, "k", False, 5, often)
    assert bare.columns == ["term", "k", "n", "df"]
    assert shown(bare, "term", "k", "n", "df") == shown(X.text_index(X.text_terms(docs, "k", "text"), "k"), "term", "k", "n", "df")


def test_terms_are_shuffled_once_and_as_one_row_a_document(spark):
    """Two hundred equal words of a document are one row of the only shuffle of its terms."""
    docs = spark.range(50).selectExpr("id AS k", "repeat('the end ', 100) AS text")
    out = X.text_index(X.text_listed(docs, "k", "text", ("word",), positions=False), "k", False, 4, ["the"])
    assert {(x.term, x.n, x.df) for x in out.collect()} == {("the", 100, 50), ("end", 100, 50)} and out.count() == 100
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = X.text_index(X.text_listed(docs, "k", "text", ("word",), positions=False), "k", False, 4, ["the"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # a reused exchange shows the one that it reuses
    assert plan.count("ReusedExchange") == 1 and plan.count("REPARTITION_BY_NUM") == 2 and "SortMergeJoin" not in plan


def test_shape_follows_the_texts(spark, monkeypatch):
    monkeypatch.setattr(X, "INDEXED", 100)
    docs = spark.range(300).selectExpr("id AS k", "concat('the w', id) AS text")
    parts, often = X.index_shape(docs, "k", "text", ("word", "number"))
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions")) and often[0] == "the" and "w1" not in often
    assert X.index_shape(docs.where("k < 0"), "k", "text", ("word",)) == (None, [])
