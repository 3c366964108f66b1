"""Keyed differences between a desired and a current table.

Null equals null. Both sides are reduced to their key and the compared columns before
the one full outer join; values are compared themselves, never by a hash. Tables that
hold only their keys differ by keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablespec.operators.constraints import all_of


def _sides(desired: DataFrame, current: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    side = lambda df, s: df.select(*(F.col(k).alias(f"{s}{i}") for i, k in enumerate(keys)), F.struct(*cols, F.lit(True).alias("_in")).alias(f"{s}row"))
    d, c = side(desired, "_d"), side(current, "_c")
    both = d.join(c, all_of([F.col(f"_d{i}").eqNullSafe(F.col(f"_c{i}")) for i in range(len(keys))]), "full_outer")
    return both.select(*(F.coalesce(f"_d{i}", f"_c{i}").alias(k) for i, k in enumerate(keys)), "_drow", "_crow")


def _compared(desired: DataFrame, current: DataFrame, keys: list[str], cols: list[str] | None) -> list[str]:
    return cols or [c for c in desired.columns if c not in keys and c in current.columns]


def _changed(cols: list[str]) -> Column:
    """Sorted names of the columns whose values differ."""
    names = F.array(*(F.when(~F.col(f"_drow.{c}").eqNullSafe(F.col(f"_crow.{c}")), F.lit(c)) for c in sorted(cols)))
    return F.filter(names, lambda x: x.isNotNull())


def table_diff(desired: DataFrame, current: DataFrame, keys: list[str], cols: list[str] | None = None) -> DataFrame:
    """(keys, op, changed_cols) for keys that are to be created, dropped or altered."""
    cols = _compared(desired, current, keys, cols)
    both = _sides(desired, current, keys, cols)
    different = both.where(~F.col("_drow").eqNullSafe(F.col("_crow")))
    op = F.when(F.col("_crow").isNull(), "create").when(F.col("_drow").isNull(), "drop").otherwise("alter")
    changed = F.when(op == "alter", F.array_join(_changed(cols), ",")).otherwise(F.lit("")) if cols else F.lit("")
    return different.select(*keys, op.alias("op"), changed.alias("changed_cols"))


def cell_diff(desired: DataFrame, current: DataFrame, keys: list[str], cols: list[str] | None = None) -> DataFrame:
    """(keys, column_name, old_value, new_value) for each changed cell of a key on both sides."""
    cols = _compared(desired, current, keys, cols)
    both = _sides(desired, current, keys, cols).where(F.col("_drow").isNotNull() & F.col("_crow").isNotNull() & ~F.col("_drow").eqNullSafe(F.col("_crow")))
    if not cols:  # tables that hold only their keys have no cells
        return both.select(*keys, *(F.lit("").alias(c) for c in ("column_name", "old_value", "new_value"))).where(F.lit(False))
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"_crow.{c}").cast("string").alias("old_value"), F.col(f"_drow.{c}").cast("string").alias("new_value"), (~F.col(f"_drow.{c}").eqNullSafe(F.col(f"_crow.{c}"))).alias("differs")) for c in cols))
    return both.select(*keys, F.explode(F.filter(cells, lambda x: x["differs"])).alias("x")).select(*keys, "x.column_name", "x.old_value", "x.new_value")


def table_diff_renamed(desired: DataFrame, current: DataFrame, key: str, key_renames: DataFrame) -> DataFrame:
    """Diff after current keys move by (old_key, new_key); a rename whose old and new key are both
    unknown in current is stale and gives an error row."""
    moved = current.join(key_renames, current[key] == F.col("old_key"), "left")
    moved = moved.withColumn("_was", F.col("old_key")).withColumn(key, F.coalesce("new_key", key)).drop("old_key", "new_key")
    diff = table_diff(desired, moved.drop("_was"), [key])
    renamed = moved.where(F.col("_was").isNotNull()).select(key, F.col("_was").alias("renamed_from"))
    out = diff.join(renamed, key, "left").unionByName(renamed.join(diff, key, "left_anti").withColumns({"op": F.lit("alter"), "changed_cols": F.lit("")}))
    known = current.select(F.col(key).alias("_k"))
    stale = key_renames.join(known, F.col("old_key") == F.col("_k"), "left_anti").join(known, F.col("new_key") == F.col("_k"), "left_anti")
    return out.unionByName(stale.select(F.col("new_key").alias(key), F.lit("error").alias("op"), F.lit("").alias("changed_cols"), F.col("old_key").alias("renamed_from")))


def drift(declared: DataFrame, live: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Declared rows that are missing (create) or different (alter) in live; strict adds extras (drop)."""
    found = table_diff(declared, live, keys)
    return found if strict else found.where("op <> 'drop'")


def protected_guard(removed: DataFrame, protected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to be removed that are protected; a safe plan gives none."""
    return removed.join(protected.select(*keys).distinct(), keys, "left_semi")


def map_delta(df: DataFrame, old: str, new: str) -> DataFrame:
    """(…, key, action, old_value, new_value) per entry of an option map that is added, set or dropped."""
    keys = F.array_union(F.map_keys(F.coalesce(F.col(old), F.create_map().cast(df.schema[old].dataType))), F.map_keys(F.coalesce(F.col(new), F.create_map().cast(df.schema[new].dataType))))
    rest = [c for c in df.columns if c not in (old, new)]
    rows = df.select(*rest, old, new, F.explode(keys).alias("key"))
    rows = rows.select(*rest, "key", F.coalesce(F.map_contains_key(old, F.col("key")), F.lit(False)).alias("_o"), F.coalesce(F.map_contains_key(new, F.col("key")), F.lit(False)).alias("_n"), F.try_element_at(old, F.col("key")).alias("old_value"), F.try_element_at(new, F.col("key")).alias("new_value"))
    action = F.when(~F.col("_o"), "ADD").when(~F.col("_n"), "DROP").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "SET")
    return rows.withColumn("action", action).where("action IS NOT NULL").select(*rest, "key", "action", "old_value", "new_value")


def content_fingerprint(df: DataFrame, cols: list[str], normalise: bool = True) -> DataFrame:
    """Adds <col>_sha of text with white space runs as one space and trimmed, and row_hash of all columns."""
    text = lambda c: F.trim(F.regexp_replace(F.col(c), r"[ \t\n\x0B\f\r]+", " ")) if normalise else F.col(c)
    return df.withColumns({**{f"{c}_sha": F.sha2(text(c), 256) for c in cols}, "row_hash": F.xxhash64(*df.columns)})


def plan_summary(plan: DataFrame) -> DataFrame:
    """Changes by operation, one column for each safety class."""
    classes = ["SAFE", "CAUTION", "DESTRUCTIVE", "MANUAL"]
    return plan.groupBy("op").pivot("safety", classes).count().na.fill(0, classes)
