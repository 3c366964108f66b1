"""Set operations: deltas of members, bag comparison, managed subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_delta(desired: DataFrame, current: DataFrame) -> DataFrame:
    """Members to add and to remove, with multiplicity."""
    cols = desired.columns
    return desired.exceptAll(current.select(*cols)).withColumn("change", F.lit("add")).unionByName(current.select(*cols).exceptAll(desired).withColumn("change", F.lit("remove")))


def array_delta(df: DataFrame, desired: str, current: str) -> DataFrame:
    """Per row the members of an array column to add and to remove, sorted."""
    return df.withColumns({"added": F.array_sort(F.array_except(desired, current)), "removed": F.array_sort(F.array_except(current, desired))})


def bag_equal_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows held more often on one side, with the surplus; empty if the bags are equal."""
    cols = a.columns
    counted = a.withColumn("_n", F.lit(1)).unionByName(b.select(*cols).withColumn("_n", F.lit(-1))).groupBy(*cols).agg(F.sum("_n").alias("_n"))
    return counted.where("_n <> 0").select(*cols, F.when(F.col("_n") > 0, "a").otherwise("b").alias("only_in"), F.abs("_n").alias("surplus"))


def managed_only(live: DataFrame, declared_keys: DataFrame, keys: list[str]) -> DataFrame:
    """Live rows whose key is declared."""
    return live.join(declared_keys.select(*keys).distinct(), keys, "left_semi")
