import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablespec.sources import hashtree as H
from tablespec.sources import scan as S


def files_met(path, column, low, high):
    """(files whose statistics admit a value in the range, all files)."""
    met, files = 0, glob.glob(f"{path}/*.parquet")
    for f in files:
        groups = pq.ParquetFile(f).metadata
        names = [groups.schema.column(i).name for i in range(groups.num_columns)]
        stats = [groups.row_group(g).column(names.index(column)).statistics for g in range(groups.num_row_groups)]
        met += any(s.min <= high and s.max >= low for s in stats)
    return met, len(files)


def test_filters_on_the_second_key_skip_files(spark, tmp_path):
    df = spark.range(100_000).selectExpr("(id * 7919) % 10007 AS a", "(id * 104729) % 9973 AS b", "cast(id AS string) AS c")
    S.clustered_write(df, ["a", "b"], f"{tmp_path}/line", files=64)
    S.interleaved_write(df, ["a", "b"], f"{tmp_path}/curve", files=64)
    before, all_before = files_met(f"{tmp_path}/line", "b", 100, 200)
    after, all_after = files_met(f"{tmp_path}/curve", "b", 100, 200)
    assert before == all_before and after <= all_after / 4
    first, _ = files_met(f"{tmp_path}/curve", "a", 100, 200)
    assert first <= all_after / 4
    kept = spark.read.parquet(f"{tmp_path}/curve")
    assert kept.columns == df.columns and kept.exceptAll(df).isEmpty() and kept.count() == 100_000


def test_curves_over_nulls_strings_and_no_rows(spark, tmp_path):
    rows = [(None, "x", None), (1, None, 2.5), (2, "é", float("nan")), (None, None, None)] * 30
    df = spark.createDataFrame(rows, "a int, b string, c double")
    assert S.interleaved_write(df, ["a", "b", "c"], f"{tmp_path}/a").exceptAll(df).isEmpty()
    assert S.interleaved_write(df.limit(0), ["a", "b"], f"{tmp_path}/b").count() == 0
    with pytest.raises(ValueError):
        S.interleaved_write(df, ["a"] * 8, f"{tmp_path}/c")


def saved(df, path, **more):
    H.tree_save(df, ["k"], path, **more)
    return path


def test_drift_reads_only_the_buckets_that_differ(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id AS k", "id * 3 AS v")
    old, same = saved(df, f"{tmp_path}/old", leaves=256), saved(df.repartition(3), f"{tmp_path}/same", leaves=256)
    new = saved(df.withColumn("v", F.expr("CASE WHEN k = 777 THEN 0 ELSE v END")), f"{tmp_path}/new", leaves=256)
    assert H.differing_leaves(spark, old, same, leaves=256) == []
    leaves = H.differing_leaves(spark, old, new, leaves=256)
    assert len(leaves) == 1
    rows = H.tree_rows(spark, new, df.schema, leaves)
    assert 0 < rows.count() < 200
    scanned = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scanned and len(rows.select(F.input_file_name()).distinct().collect()) == len(glob.glob(f"{new}/rows/_leaf={leaves[0]}/*.parquet"))
    got = H.tree_drift(spark, old, new, df.schema, ["k"], leaves=256).collect()
    assert [(r.k, r.op, r.changed_cols) for r in got] == [(777, "alter", "v")]
    assert H.tree_drift(spark, old, same, df.schema, ["k"], leaves=256).count() == 0


def test_drift_of_empty_new_and_null_keys(spark, tmp_path):
    schema = "k long, v long"
    none = saved(spark.createDataFrame([], schema), f"{tmp_path}/none", leaves=8, fan=2)
    some = saved(spark.createDataFrame([(None, 1), (1, None), (2, 2)], schema), f"{tmp_path}/some", leaves=8, fan=2)
    more = saved(spark.createDataFrame([(None, 2), (1, None), (2, 2), (9, 9)], schema), f"{tmp_path}/more", leaves=8, fan=2)
    kind = spark.createDataFrame([], schema).schema
    drift = lambda a, b: {(r.k, r.op) for r in H.tree_drift(spark, a, b, kind, ["k"], leaves=8, fan=2).collect()}
    assert drift(none, some) == {(None, "create"), (1, "create"), (2, "create")} and drift(some, none) == {(None, "drop"), (1, "drop"), (2, "drop")}
    assert drift(some, more) == {(None, "alter"), (9, "create")} and drift(none, none) == set()
