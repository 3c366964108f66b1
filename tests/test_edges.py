"""Empty tables, nulls and odd shapes that once raised or gave wrong rows."""

import os

import pytest
from pyspark.sql import functions as F

from tablespec.functions import text as X
from tablespec.operators import diffs as D
from tablespec.operators import graphs as G
from tablespec.operators import lattice as L
from tablespec.operators import stats as S
from tablespec.operators import windows as W
from tablespec.plans.apply import rebuild_partitions
from tablespec.sources import scan as C
from tablespec.spec import Column, Partition, PartitionBy, TableSpec


def test_labels_in_a_null_scope(spark):
    rows = spark.createDataFrame([(1, None, "ab"), (2, None, "ab"), (3, "x", "ab"), (None, None, "ab")], "id int, s string, name string")
    got = sorted(((r.s or "", r.label) for r in W.dedupe_names(rows, ["s"], "name", 5, ["id"]).collect()))
    assert len(got) == 4 and len(set(got)) == 4 and ("x", "ab") in got


def test_tables_without_rows_are_written_and_rebuilt(spark, tmp_path):
    spec = TableSpec("t", (Column("k", "int"), Column("v", "string")), partition_by=PartitionBy("range", ("k",), (Partition("low", upper=(5,)), Partition("high", lower=(5,)))))
    empty = spark.createDataFrame([], "k int, v string")
    assert C.write_partitioned(empty, spec, f"{tmp_path}/a").columns == ["k", "v", "partition"]
    rebuilt, report = rebuild_partitions(empty, spec, f"{tmp_path}/b")
    assert rebuilt.count() == 0 and report.first()["same"]


def test_tables_of_keys_only_have_no_cells(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert D.cell_diff(df, df, ["k"]).count() == 0


def test_a_view_deeper_than_its_bound_is_an_error(spark):
    edges = spark.range(30).selectExpr("id AS parent", "id + 1 AS node")
    base = spark.range(1).selectExpr("id AS node")
    assert G.recursive_view(base, edges.where("node <= 5"), max_depth=5).count() == 6
    with pytest.raises(ValueError):
        G.recursive_view(base, edges, max_depth=5)


def test_accents_of_all_latin_letters_and_marks(spark):
    df = spark.createDataFrame([("Việt", "Nguyễn", "été", "Ærø й")], "a string, b string, c string, d string")
    assert tuple(df.select(*(X.unaccent(F.col(c)) for c in "abcd")).first()) == ("Viet", "Nguyen", "ete", "Ærø й")


def test_profiles_of_no_rows(spark):
    empty = spark.createDataFrame([], "k int, s string")
    assert S.candidate_keys(empty, ["k", "s"]).count() == 0
    assert {(r.column_name, r.inferred_type, r.unique_values, r.serial) for r in S.infer_spec(empty).collect()} == {("k", "int", False, False), ("s", "string", False, False)}
    assert L.functional_dependencies(empty, ["k", "s"]).count() == 0 and L.pair_degrees(empty, ["k", "s"]).count() == 0
    assert L.inclusion_dependencies({"t": empty}).count() == 0
    assert S.column_stats(empty, {"k": 3, "s": 2}, exact=True).count() == 2


def test_dependencies_with_nulls_and_constants(spark):
    df = spark.createDataFrame([(None, 1, "x", 1), (None, 1, "x", 2), (3, 2, "x", 3), (4, 2, "x", None)], "a int, b int, c string, d int")
    got = {(r.determinant, r.dependent) for r in L.functional_dependencies(df, ["a", "b", "c", "d"], 2).collect()}
    assert got == {("a", "b"), ("d", "b"), ("", "c"), ("d", "a")}
    assert [r.key for r in S.candidate_keys(df.fillna(0), ["a", "b", "c", "d"], 2).collect()] == ["d"]
    degrees = {(r.determinant, r.dependent): r.degree for r in L.pair_degrees(df, ["a", "b", "d"]).collect()}
    assert degrees["a", "b"] == 1.0 and degrees["b", "a"] == 0.5 and degrees["d", "a"] == 1.0 and degrees["a", "d"] == 0.5
    other = spark.createDataFrame([("x", 1), ("y", 2)], "name string, n long")
    inc = {(r.dependent, r.referenced): (r.n_values, r.n_missing) for r in L.inclusion_dependencies({"t": df, "u": other}).collect()}
    assert inc["t.b", "u.n"] == (2, 0) and inc["t.c", "u.name"] == (1, 0) and inc["u.name", "t.c"] == (2, 1) and inc["t.d", "u.n"] == (3, 1) and ("t.c", "u.n") not in inc


def test_written_rows_go_when_asked(spark):
    from tablespec import paths

    out = paths.written(spark.range(5).toDF("k"))
    assert out.count() == 5 and out.inputFiles()
    folder = out.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    paths.drop_written(spark)
    assert not os.path.exists(folder)
    assert paths.written(spark.range(2).toDF("k")).count() == 2


def test_an_index_shuffles_its_terms_once(spark):
    from tablespec.functions import text as X

    docs = spark.createDataFrame([(i, "the cat of the house" if i % 2 else "of the") for i in range(40)] + [(None, "The end")], "k int, text string")
    out = X.text_index(X.text_terms(docs, "k", "text"), "k")
    rows = {(r.term, r.k): (r.n, r.positions, r.df) for r in out.collect()}
    assert rows["the", 1] == (2, [0, 3], 41) and rows["the", None] == (1, [0], 41) and rows["cat", 3] == (1, [1], 20) and len(rows) == 20 * 4 + 20 * 2 + 2
    found = X.text_match(X.text_vector(docs, "k", "text"), "k", phrase=["of", "the", "house"])
    assert sorted(tuple(r) for r in found.collect()) == [(i, 4) for i in range(1, 40, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def test_keys_are_found_without_rows_for_each_set(spark, monkeypatch):
    """Equal rows count wherever they lie: beside each other, in a slice of the values, or a single pair far apart; sets are
    never joined row by row."""
    from itertools import combinations

    from tablespec.operators import lattice as L

    monkeypatch.setattr(L, "STRETCH", 50)
    monkeypatch.setattr(L, "refined", None)
    rows = [(i, i // 2, i % 7, i % 500, float("nan") if i % 3 else -0.0 if i % 2 else 0.0, None if i % 5 else str(i)) for i in range(2000)]
    rows[1999] = (3, *rows[1999][1:])
    cols = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e double, f string").repartition(3)
    same = [tuple("nan" if x != x else x for x in r) for r in rows]
    want = []
    for width in (1, 2, 3):
        for s in combinations(range(6), width):
            if not any(set(k) <= set(s) for k in want) and len({tuple(r[i] for i in s) for r in same}) == 2000:
                want.append(s)
    assert L.key_lattice(df, cols, 3) == [tuple(cols[i] for i in s) for s in want] and ("a", "b") in L.key_lattice(df, cols, 3)
    assert L.repeated_sets(df.select("c"), [("c",)]) == {("c",)}
