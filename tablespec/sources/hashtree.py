"""Snapshots in key buckets with a tree of fingerprints, so that drift reads only the buckets that differ.

Rows fall into LEAVES buckets by the hash of their key and are written by bucket. A
leaf's fingerprint is its number of rows and an exclusive or and a sum of its rows'
64-bit hashes; FAN leaves make the node above them, up to one root. Two snapshots are compared
from the root down: only below nodes that differ are the next level's read, and only
leaves that differ give rows to compare. Values are then compared themselves, so an
equal fingerprint of unequal rows is the only thing that could hide a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablespec.operators.diffs import table_diff

LEAVES, FAN = 4096, 16
_NODE = "level int, node long, rows long, both long, total decimal(38,0)"


def leaf_of(keys: list[str], leaves: int = LEAVES) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(leaves))


def _combined(rows: DataFrame, node: Column, level: int) -> DataFrame:
    return rows.groupBy(node.alias("node")).agg(F.sum("rows").alias("rows"), F.bit_xor("both").alias("both"), F.sum("total").cast("decimal(38,0)").alias("total")).select(F.lit(level).alias("level"), "node", "rows", "both", "total")


def tree_save(df: DataFrame, keys: list[str], path: str, leaves: int = LEAVES, fan: int = FAN) -> None:
    """Writes the rows by bucket under path/rows and their fingerprints, level by level, under path/tree."""
    cols = sorted(df.columns)
    placed = df.withColumn("_leaf", leaf_of(keys, leaves))
    placed.hint("rebalance", "_leaf").write.partitionBy("_leaf").parquet(f"{path}/rows")
    one = placed.withColumn("both", F.xxhash64(*cols)).select("_leaf", F.lit(1).cast("long").alias("rows"), "both", F.col("both").cast("decimal(38,0)").alias("total"))
    level, width = 0, leaves
    _combined(one, F.col("_leaf"), 0).coalesce(1).write.partitionBy("level").parquet(f"{path}/tree")
    while width > 1:
        below = tree_level(df.sparkSession, path, level)
        level, width = level + 1, -(-width // fan)
        _combined(below, F.floor(F.col("node") / fan), level).coalesce(1).write.mode("append").partitionBy("level").parquet(f"{path}/tree")


def tree_level(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema(_NODE).parquet(f"{path}/tree").where(F.col("level") == level)


def differing_leaves(spark: SparkSession, old: str, new: str, leaves: int = LEAVES, fan: int = FAN) -> list[int]:
    """The buckets in which two snapshots of the same layout differ, found from the root down; at most as many as there are leaves."""
    level, width = 0, leaves
    while width > 1:
        level, width = level + 1, -(-width // fan)
    open_nodes: list[int] | None = None
    while True:
        sides = []
        for s, path in (("a", old), ("b", new)):
            nodes = tree_level(spark, path, level)
            nodes = nodes if open_nodes is None else nodes.where(F.floor(F.col("node") / fan).isin(open_nodes))
            sides.append(nodes.select("node", F.struct("rows", "both", "total").alias(s)))
        unlike = sides[0].join(sides[1], "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        open_nodes = sorted(r.node for r in unlike.select("node").collect())
        if not open_nodes or level == 0:
            return open_nodes
        level -= 1


def tree_rows(spark: SparkSession, path: str, schema: T.StructType, leaves: list[int] | None = None) -> DataFrame:
    """The rows of a snapshot, or of some of its buckets only, whose folders are the only ones read."""
    rows = spark.read.schema(T.StructType(list(schema.fields)).add("_leaf", "long")).parquet(f"{path}/rows")
    return (rows if leaves is None else rows.where(F.col("_leaf").isin(leaves))).drop("_leaf")


def tree_drift(spark: SparkSession, old: str, new: str, schema: T.StructType, keys: list[str], leaves: int = LEAVES, fan: int = FAN) -> DataFrame:
    """The keyed difference (J01) of two snapshots, new against old, read from the buckets that differ."""
    unlike = differing_leaves(spark, old, new, leaves, fan)
    now, before = (tree_rows(spark, p, schema, unlike) for p in (new, old))
    return table_diff(now, before, keys)
