"""Merging by source order, numbering without one partition, names and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablespec.operators.constraints import all_of, any_of, union_all
from tablespec.paths import written


def merge_last_wins(contributions: DataFrame, key: list[str], attributes: list[str], order: list[str], sticky: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per key: each attribute takes its last non-null value by order; sticky flags stay true."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v"))))["_v"]
    return contributions.groupBy(*key).agg(*(last(a).alias(a) for a in attributes), *(F.coalesce(F.bool_or(s), F.lit(False)).alias(s) for s in sticky))


def merge_conflicts(contributions: DataFrame, key: list[str], attributes: list[str], order: list[str], source: str) -> DataFrame:
    """Overrides: key, attribute, old and new value and the sources that set them."""
    parts = []
    for a in attributes:
        w = Window.partitionBy(*key).orderBy(*order)
        rows = contributions.where(F.col(a).isNotNull()).withColumns({"_ov": F.lag(a).over(w), "_os": F.lag(source).over(w)})
        hit = rows.where(F.col("_os").isNotNull() & (F.col("_ov") != F.col(a)))
        parts.append(hit.select(*key, F.lit(a).alias("attribute"), F.col("_ov").cast("string").alias("old_value"), F.col("_os").alias("old_source"), F.col(a).cast("string").alias("new_value"), F.col(source).alias("new_source")))
    return union_all(parts)


def merge_sets(contributions: DataFrame, key: list[str], name: str, definition: str) -> tuple[DataFrame, DataFrame]:
    """(members, conflicts): members united over sources; one name with several definitions conflicts."""
    per = contributions.groupBy(*key, name).agg(F.count_distinct(definition).alias("_n"), F.min(definition).alias(definition), F.count("*").alias("sources"))
    return per.where("_n = 1").drop("_n"), per.where("_n > 1").select(*key, name, F.col("_n").alias("definitions"))


def number_rows(df: DataFrame, order: list[Column | str], column: str = "rank") -> DataFrame:
    """Dense numbers from 1 in a global order, without one partition for all rows.

    Rows are range partitioned and written once; each partition's count gives the offset of the
    next, and rows are numbered inside their own partition."""
    placed = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_o", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_o", F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.withColumn("_r", inside).join(offsets, "_p").withColumn(column, F.col("_o") + F.col("_r")).drop("_p", "_r", "_o")


def assign_identity(df: DataFrame, order: list[Column | str], column: str, start: int = 1, increment: int = 1, always: bool = False) -> DataFrame:
    """Identity numbers for rows without one. BY DEFAULT keeps supplied values; ALWAYS rejects them."""
    if column in df.columns:
        supplied = F.col(column).isNotNull()
        if always:
            df = df.withColumn(column, F.when(supplied, F.raise_error(F.lit(f"{column} is always generated")).cast("long")))
        kept, open_rows = df.where(supplied), df.where(~supplied).drop(column)
    else:
        kept, open_rows = None, df
    made = number_rows(open_rows, order, "_k").withColumn(column, (F.lit(start) + (F.col("_k") - 1) * F.lit(increment)).cast("long")).drop("_k")
    return made if kept is None or always else made.unionByName(kept)


def assign_sequence(df: DataFrame, order: list[Column | str], column: str, start: int, increment: int = 1, low: int = 1, high: int = 2**62, cycle: bool = False) -> DataFrame:
    """Sequence values in order; past its end a sequence starts over at the other end, or fails."""
    step = abs(increment)
    first = (high - start) // step + 1 if increment > 0 else (start - low) // step + 1
    again = (high - low) // step + 1
    k = F.col("_k") - 1
    restart = F.lit(low if increment > 0 else high)
    wrapped = restart + F.pmod(k - first, F.lit(again)) * increment
    late = wrapped if cycle else F.raise_error(F.lit("sequence exhausted")).cast("long")
    value = F.when(k < first, F.lit(start) + k * increment).otherwise(late)
    return number_rows(df, order, "_k").withColumn(column, value.cast("long")).drop("_k")


def clip_bytes(text: Column, limit: Column | int) -> Column:
    """The longest prefix of whole characters within a number of bytes, by bisection; null stays null."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    start = F.struct(F.lit(0).alias("lo"), F.greatest(F.least(F.length(text), limit), F.lit(0)).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")
        fits = F.octet_length(F.substring(text, F.lit(1), mid)) <= limit
        return F.struct(F.when(fits, mid).otherwise(acc["lo"]).alias("lo"), F.when(fits, acc["hi"]).otherwise(mid - 1).alias("hi"))

    most = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(start["hi"] + 1)).cast("int") + 1), start, halve, lambda acc: acc["lo"])
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(text, F.lit(1), most))


def _numbered(left: DataFrame, done: DataFrame, scope: list[str], name: str, max_bytes: int, order: list[str], out: str, digits: int) -> DataFrame:
    """Rows without a label with the numbers of so many digits appended, as far as these reach; _left marks the others.

    The n-th row of a stem gets its n-th number that no settled label holds: a held number lies behind as many free
    ones as _at says, and a row skips those at or before its own place."""
    low, stem, number = 10 ** (digits - 1), [*scope, "_stem"], F.right(out, F.lit(digits)).cast("long")
    rows = left.withColumn("_stem", clip_bytes(F.col(name), max_bytes - digits))
    rows = rows.withColumns({"_at": F.row_number().over(Window.partitionBy(*stem).orderBy(*order)).cast("long") - 1, "_row": F.lit(True)})
    held = done.where(F.col(out).rlike(f"[1-9][0-9]{{{digits - 1}}}\\z")).select(*scope, F.expr(f"left(`{out}`, length(`{out}`) - {digits})").alias("_stem"), number.alias("_n"))
    before = F.row_number().over(Window.partitionBy(*stem).orderBy("_n")) - 1
    held = held.select(*stem, (F.col("_n") - low - before).alias("_at"), F.lit(False).alias("_row"))
    skipped = F.count_if(~F.col("_row")).over(Window.partitionBy(*stem).orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, 0))
    both = rows.unionByName(held, allowMissingColumns=True).withColumn("_n", F.col("_at") + skipped + low).where("_row")
    fits = F.col("_n") < 10 * low
    return both.withColumns({out: F.when(fits, F.concat("_stem", F.col("_n").cast("string"))), "_left": ~fits}).select(left.columns)


def dedupe_names(df: DataFrame, scope: list[str], name: str, max_bytes: int, order: list[str], out: str = "label") -> DataFrame:
    """A label unique in its scope: the name clipped to fit, or clipped further with 1, 2, … appended.

    The first claimant of a clipped name keeps it; a round for each number of digits deals the free numbers of a
    stem to the others in order, so rounds grow with the digits of the largest group's size. A null name has a null
    label; a null scope is a scope. More names than labels that fit are an error."""
    unnamed = df.where(F.col(name).isNull()).withColumn(out, F.lit(None).cast("string"))
    named = df.where(F.col(name).isNotNull()).withColumn(out, clip_bytes(F.col(name), max_bytes))
    rows = written(named.withColumn("_left", F.row_number().over(Window.partitionBy(*scope, out).orderBy(*order)) > 1))
    done = rows.where("NOT _left")
    for digits in range(1, max_bytes + 1):
        if rows.where("_left").isEmpty():
            break
        rows = written(_numbered(rows.where("_left"), done, scope, name, max_bytes, order, out, digits))
        done = done.unionByName(rows.where("NOT _left"))
    if not rows.where("_left").isEmpty():
        raise ValueError(f"more names than labels of {max_bytes} bytes")
    return done.drop("_left").unionByName(unnamed)


def change_events(history: DataFrame, key: list[str], ts: list[str], cols: list[str], when: str | None = None) -> DataFrame:
    """AFTER UPDATE OF cols: rows whose listed columns differ from the key's row before, with the old
    values as old_<col>; when is a condition over both."""
    w = Window.partitionBy(*key).orderBy(*ts)
    rows = history.withColumns({f"old_{c}": F.lag(c).over(w) for c in cols}).withColumn("_n", F.row_number().over(w))
    changed = rows.where((F.col("_n") > 1) & any_of([~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in cols])).drop("_n")
    return changed.where(when) if when else changed


def index_order(df: DataFrame, keys: list[tuple[str, str] | tuple[str, str, str]], collation: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Global sort by (expression, asc or desc[, first or last for nulls]); by default nulls are last
    when ascending and first when descending."""
    order = []
    for expr, way, *nulls in keys:
        col = F.collate(F.expr(expr), collation[expr]) if expr in collation else F.expr(expr)
        place = nulls[0] if nulls else ("last" if way == "asc" else "first")
        order.append(getattr(col, f"{way}_nulls_{place}")())
    return df.orderBy(*order)


def enum_ordinal(col: str, labels: tuple[str, ...]) -> Column:
    """The place of a label in its declared order, from 1; null for other values."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), F.col(col)), F.lit(0))


def enum_order(df: DataFrame, col: str, labels: tuple[str, ...], at_least: str | None = None) -> DataFrame:
    """Rows sorted by label order, from a label on if given; adds <col>_ordinal."""
    out = df.withColumn(f"{col}_ordinal", enum_ordinal(col, labels))
    if at_least:
        out = out.where(F.col(f"{col}_ordinal") >= labels.index(at_least) + 1)
    return out.orderBy(F.col(f"{col}_ordinal").asc_nulls_last())


def resolve_reference(df: DataFrame, lookups: list[tuple[DataFrame, list[tuple[str, str]]]], target: str) -> DataFrame:
    """The target of the first lookup that matches; each is (table, [(own column, its column)])."""
    out = df
    for i, (table, on) in enumerate(lookups):
        few = table.select(*(F.col(b).alias(f"_{i}_{j}") for j, (_, b) in enumerate(on)), F.col(target).alias(f"_t{i}")).dropDuplicates([f"_{i}_{j}" for j in range(len(on))])
        out = out.join(few, all_of([F.col(a) == F.col(f"_{i}_{j}") for j, (a, _) in enumerate(on)]), "left").drop(*(f"_{i}_{j}" for j in range(len(on))))
    found = F.coalesce(*(F.col(f"_t{i}") for i in range(len(lookups))))
    step = F.coalesce(*(F.when(F.col(f"_t{i}").isNotNull(), F.lit(i + 1)) for i in range(len(lookups))))
    return out.withColumns({"resolved": found, "resolved_by": step}).drop(*(f"_t{i}" for i in range(len(lookups))))


def deprecated_references(child: DataFrame, parent: DataFrame, fk: str, key: str, child_deprecated: str, parent_deprecated: str) -> DataFrame:
    """Live child rows that point at deprecated parents; a deprecated referrer is silent."""
    old = parent.where(parent_deprecated).select(F.col(key).alias("_k"))
    return child.where(~F.coalesce(F.expr(child_deprecated), F.lit(False))).join(old, F.col(fk) == F.col("_k"), "left_semi")
