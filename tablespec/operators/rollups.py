"""Rollups, stored aggregates and their refresh, and audits of access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablespec.operators.graphs import reach
from tablespec.operators.constraints import all_of, union_all


def summary_view(parent: DataFrame, child: DataFrame, key: str, fk: str, measures: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Parents, childless ones too, with child measures name -> (aggregate, filter); sums default to 0.

    Children are aggregated before the join, so parents are never multiplied."""
    rolled = child.groupBy(F.col(fk).alias("_fk")).agg(F.count("*").alias("children"), *(F.expr(a if not w else f"{a} FILTER (WHERE {w})").alias(n) for n, (a, w) in measures.items()))
    joined = parent.join(rolled, parent[key] == F.col("_fk"), "left").drop("_fk")
    return joined.withColumn("children", F.coalesce("children", F.lit(0)))


def filtered_aggregate(df: DataFrame, by: list[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """Aggregates with FILTER clauses; groups without a matching row give 0."""
    out = df.groupBy(*by).agg(*(F.expr(f"{a} FILTER (WHERE {w})").alias(n) for n, (a, w) in measures.items()))
    return out.withColumns({n: F.coalesce(n, F.lit(0).cast(out.schema[n].dataType)) for n in measures})


def materialize(view: DataFrame, path: str, with_data: bool = True, mode: str = "errorifexists") -> DataFrame:
    """Stores a view's rows, or only its schema."""
    (view if with_data else view.limit(0)).write.mode(mode).parquet(path)
    return view.sparkSession.read.schema(view.schema).parquet(path)


def refresh_incremental(stored: DataFrame, delta_plus: DataFrame, delta_minus: DataFrame, by: list[str], sums: list[str], count: str = "n") -> DataFrame:
    """Stored sums and counts with only changed rows folded in; groups that become empty go.

    Sums and counts are invertible. For min and max use refresh_extremes, which reads the rows of
    groups that lost a row."""
    part = lambda df, sign: df.groupBy(*by).agg(F.count("*").cast("long").alias(count), *(F.sum(s).alias(s) for s in sums)).select(*by, *((F.col(c) * sign).alias(c) for c in (count, *sums)))
    base = stored.select(*by, count, *sums)
    folded = union_all([base, part(delta_plus, 1).select(*base.columns), part(delta_minus, -1).select(*base.columns)]).groupBy(*by)
    return folded.agg(F.sum(count).cast("long").alias(count), *(F.sum(s).cast(stored.schema[s].dataType).alias(s) for s in sums)).where(F.col(count) > 0)


def refresh_extremes(stored: DataFrame, rows_now: DataFrame, delta_plus: DataFrame, delta_minus: DataFrame, by: list[str], col: str) -> DataFrame:
    """Stored min and max per group after a change: insertions fold in, groups with deletions are read anew."""
    hit = delta_minus.select(*(F.col(b).alias(f"_h{i}") for i, b in enumerate(by))).distinct()
    same = all_of([F.col(b).eqNullSafe(F.col(f"_h{i}")) for i, b in enumerate(by)])  # a null group is a group
    agg = lambda df: df.groupBy(*by).agg(F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"))
    kept = union_all([stored, agg(delta_plus)]).join(hit, same, "left_anti").groupBy(*by).agg(F.min(f"min_{col}").alias(f"min_{col}"), F.max(f"max_{col}").alias(f"max_{col}"))
    return kept.unionByName(agg(rows_now.join(hit, same, "left_semi")))


def access_audit(events: DataFrame, grants: DataFrame, memberships: DataFrame, revocations: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Events (role, object, action, …) that no privilege covers.

    Roles inherit along memberships (member, role); PUBLIC grants reach every role; defaults
    (role, action) cover every object; revocations (role, object, action) take direct grants away."""
    direct = grants.join(revocations, ["role", "object", "action"], "left_anti")
    closure = reach(memberships.select(F.col("member").alias("src"), F.col("role").alias("dst"))).select(F.col("src").alias("member"), F.col("dst").alias("role"))
    inherited = direct.join(closure, "role").select(F.col("member").alias("role"), "object", "action")
    held = direct.unionByName(inherited).distinct()
    out = events.join(held, ["role", "object", "action"], "left_anti")
    out = out.join(held.where("role = 'public'").select("object", "action"), ["object", "action"], "left_anti")
    if defaults is not None:
        wide = defaults.unionByName(defaults.join(closure, "role").select(F.col("member").alias("role"), "action")).distinct()
        out = out.join(wide, ["role", "action"], "left_anti")
    return out
