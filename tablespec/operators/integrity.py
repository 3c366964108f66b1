"""Referential actions, exclusion, partition routing and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablespec.operators.constraints import all_of
from tablespec.operators.windows import number_rows
from tablespec.paths import written
from tablespec.spec import Partition, PartitionBy


def fk_apply(child: DataFrame, col: str, deleted: DataFrame, updates: DataFrame | None, on_delete: str = "no action", on_update: str = "no action", default=None) -> tuple[DataFrame, DataFrame]:
    """(child after the action, child rows that forbid it) for deleted parent keys (key) and changed
    ones (old_key, new_key). Actions: cascade, set null, set default, restrict, no action."""
    gone = deleted.select(F.col("key").alias("_gone")).distinct()
    rows = child.join(gone, F.col(col) == F.col("_gone"), "left")
    hit = F.col("_gone").isNotNull()
    kept, blocked = {
        "cascade": lambda: (rows.where(~hit), rows.where(F.lit(False))),
        "set null": lambda: (rows.withColumn(col, F.when(~hit, F.col(col))), rows.where(F.lit(False))),
        "set default": lambda: (rows.withColumn(col, F.when(hit, F.lit(default)).otherwise(F.col(col))), rows.where(F.lit(False))),
        "restrict": lambda: (rows, rows.where(hit)),
        "no action": lambda: (rows, rows.where(hit)),
    }[on_delete]()
    kept, blocked = kept.drop("_gone"), blocked.drop("_gone")
    if updates is None:
        return kept, blocked
    moved = kept.join(updates.select(F.col("old_key").alias("_old"), F.col("new_key").alias("_new")), F.col(col) == F.col("_old"), "left")
    move = F.col("_old").isNotNull()
    value = {"cascade": F.col("_new"), "set null": F.lit(None), "set default": F.lit(default)}.get(on_update)
    if value is None:
        return moved.drop("_old", "_new"), blocked.unionByName(moved.where(move).drop("_old", "_new"))
    return moved.withColumn(col, F.when(move, value).otherwise(F.col(col))).drop("_old", "_new"), blocked


def fk_cascade(chain: list[tuple[DataFrame, str, str]], deleted: DataFrame) -> list[DataFrame]:
    """Deletes along a chain of (child, its key, its reference to the table before); each child's
    deleted keys are the next one's deleted parents."""
    out, gone = [], deleted
    for child, key, ref in chain:
        lost = child.join(gone.select(F.col("key").alias("_gone")).distinct(), F.col(ref) == F.col("_gone"), "left_semi")
        out.append(child.join(gone.select(F.col("key").alias("_gone")).distinct(), F.col(ref) == F.col("_gone"), "left_anti"))
        gone = lost.select(F.col(key).alias("key"))
    return out


LEVEL_BITS, TOP = 6, 63  # levels of placed ranges, their level for endless ones
JOIN_BITS = 2  # finer levels of placed ranges
SIDE, SIDE_LEAST, TASK_PAIRS = 1 << 14, 16, 50_000_000  # beginnings of a stretch of an interval join, pairs that ask for another task
_FAR = 1 << 61


def ordinal(df: DataFrame, col: str) -> Column:
    """A long that never falls where the column's values rise, in small units; beyond 2**61 it stays there."""
    kind, value = df.schema[col].dataType, F.col(f"`{col}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    if isinstance(kind, T.IntegralType):
        return F.when(value > _FAR, F.lit(_FAR)).when(value < -_FAR, F.lit(-_FAR)).otherwise(value.cast("long"))
    if isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= 18:
        return value.cast("long")
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"ranges of {kind.simpleString()} have no order by numbers: {col}")
    # a float's exponent and mantissa: as even over all magnitudes as its own digits
    x = F.abs(value.cast("double"))
    power = F.floor(F.log2(x)).cast("double")
    size = ((power + 1075) * F.lit(2.0**49) + (x / F.pow(F.lit(2.0), power) - 1) * F.lit(2.0**49)).cast("long")
    return F.when(x < 2.0**-1022, 0).when(x > 1e308, F.lit(_FAR)).otherwise(size) * F.when(value < 0, -1).otherwise(1)


def placed_ranges(df: DataFrame, lo: str, hi: str, bits: int = LEVEL_BITS) -> DataFrame:
    """Adds _l and _h, the bounds as numbers, and _level: a range lies in one or two cells of 2**_level. A null bound is endless."""
    lower = F.coalesce(ordinal(df, lo), F.lit(-2 * _FAR))
    upper = F.coalesce(ordinal(df, hi), F.lit(2 * _FAR - 1))
    length = F.when(F.col("_h") <= F.col("_l"), 0).otherwise(F.length(F.bin(F.col("_h") - F.col("_l"))))
    level = (F.ceil(length / bits) * bits).cast("int")
    return df.withColumns({"_l": lower, "_h": upper}).withColumn("_level", F.when(level > 54, TOP).otherwise(level))


def exclude_violations(df: DataFrame, equal: list[str], lo: str, hi: str, key: str, differ: list[str] = [], where: str | None = None, name: str = "exclude") -> DataFrame:  # noqa: B006
    """Pairs of rows with equal columns, overlapping [lo, hi) and differing columns, each pair once.

    Bounds are numbers, dates or timestamps; a null bound is unbounded, empty ranges overlap nothing.
    Of two overlapping ranges the one that begins first holds the other one's beginning. All bounds are numbered in one
    order, so a range holds the beginnings numbered between its own two bounds. The numbers are cut into stretches about
    a quarter as wide as a range reaches on average: a beginning lies in one, a range in those it reaches, and they meet by
    an equi join without a typical width, which compares less than three pairs for each one that overlaps. A stretch with
    many ranges becomes several blocks. Copies of rows follow the rows, until stretches are SIDE beginnings wide; from there
    on they are one for each SIDE pairs or so. A task holds the beginnings of a stretch only and streams its ranges. The pairs
    themselves may grow as the square of the rows."""
    for c in (lo, hi):
        ordinal(df, c)  # raises for what has no order by numbers
    rows = df.where(all_of([F.expr(where) if where else F.lit(True), *(F.col(c).isNotNull() for c in equal), F.coalesce(F.col(hi) > F.col(lo), F.lit(True))]))
    named, same = [key, *differ], [f"_same{i}" for i in range(len(equal))]
    bounds = [F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), *(F.col(c).alias(s) for c, s in zip(equal, same))]
    held = written(rows.select(F.monotonically_increasing_id().alias("_row"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(named)), *bounds))
    marks = held.select("_row", *same, F.posexplode(F.array("_lo", "_hi")).alias("_end", "_bound"))
    # a null beginning lies before all others, a null end behind them; an end lies before the beginnings at its place
    endless = F.when(F.col("_bound").isNull(), 2 * F.col("_end") - 1).otherwise(0)
    numbered = number_rows(marks, [*same, endless, "_bound", F.col("_end").desc(), "_row"], "_at")
    reach = numbered.groupBy("_row").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    ranges = written(reach.join(held, "_row").select("_from", "_to", *(f"_{i}" for i in range(len(named)))))
    n, between = ranges.agg(F.count("*"), F.sum(F.col("_to") - F.col("_from") - 1)).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    side = int(min(SIDE, max(SIDE_LEAST, min((between or 0) // max(8 * n, 1), ((between or 0) / (128 * cores)) ** 0.5))))

    stretch = lambda c: F.floor(c / (2 * side))
    homes = ranges.where("_to > _from + 1").withColumn("_cell", F.explode(F.sequence(stretch(F.col("_from") + 1), stretch(F.col("_to") - 1))))
    starts = ranges.drop("_to").withColumn("_cell", stretch(F.col("_from")))
    both = homes.groupBy("_cell").agg(F.count("*").alias("_as")).join(starts.groupBy("_cell").agg(F.count("*").alias("_bs")), "_cell")
    pairs = F.col("_as") * F.col("_bs")
    cells = written(both.select("_cell", pairs.alias("_pairs"), F.ceil(pairs / (8 * side * side)).cast("int").alias("_blocks")))
    compared, blocks = cells.agg(F.coalesce(F.sum("_pairs"), F.lit(0)), F.coalesce(F.sum("_blocks"), F.lit(0))).first()
    # rows are small beside their pairs: left to their bytes, partitions would be joined into a few long tasks; twice as many, as a hash deals blocks unevenly
    tasks = min(max(compared * 2 // TASK_PAIRS + 1, min(compared * 16 // TASK_PAIRS, 4 * cores)), 4 * blocks + 1)

    def dealt(df: DataFrame, s: str, block: Column) -> DataFrame:
        """Rows of stretches where both sides are, in one block or in all."""
        of = df.join(cells, "_cell").withColumn("_block", block).drop("_pairs", "_blocks")
        return of.select(*(F.col(c).alias(f"{c}{s}") for c in of.columns))

    a, b = dealt(homes, "a", F.pmod(F.xxhash64("_from"), "_blocks").cast("int")), dealt(starts, "b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    if tasks > 1:
        a, b = a.repartition(tasks, "_cella", "_blocka"), b.repartition(tasks, "_cellb", "_blockb")
    met = [F.col(f"{c}a") == F.col(f"{c}b") for c in ("_cell", "_block")] + [F.col(f"_{i}a") != F.col(f"_{i}b") for i in range(len(named))]
    met += [F.col("_froma") < F.col("_fromb"), F.col("_fromb") < F.col("_toa")]
    return a.join(b, all_of(met)).select(F.least("_0a", "_0b").alias(f"{key}_a"), F.greatest("_0a", "_0b").alias(f"{key}_b"), F.lit(name).alias("constraint_name"))


def overlaps_by_running_max(df: DataFrame, by: list[str], lo: str, hi: str, key: str) -> DataFrame:
    """Rows whose [lo, hi) overlaps an earlier row of the same group; a null bound is unbounded."""
    order = Window.partitionBy(*by).orderBy(F.col(lo).asc_nulls_first(), F.col(hi).asc_nulls_last(), key)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    held = {"_reach": F.max(hi).over(earlier), "_endless": F.coalesce(F.bool_or(F.col(hi).isNull()).over(earlier), F.lit(False)), "_some": F.count("*").over(earlier) > 0}
    full = df.where(F.coalesce(F.col(hi) > F.col(lo), F.lit(True))).withColumns(held)
    return full.where(F.col("_endless") | F.col("_some") & F.col(lo).isNull() | F.coalesce(F.col("_reach") > F.col(lo), F.lit(False))).drop(*held)


def _bound(cols: tuple[str, ...], bound: tuple, upper: bool) -> Column:
    """Tuple comparison with a range bound: at or above the lower, below the upper."""
    out = F.lit(False) if upper else F.lit(True)
    for c, v in reversed(list(zip(cols, bound))):
        col, lit = F.col(c), F.lit(v)
        beyond = col < lit if upper else col > lit
        out = beyond | ((col == lit) & out)
    return out


def _leaf(by: PartitionBy, prefix: str = "") -> Column:
    """The leaf partition of a row, or null where none takes it."""
    fallback = F.lit(None).cast("string")
    when: Column | None = None
    for p in by.parts:
        inner = _leaf(p.by, f"{prefix}{p.name}/") if p.by else F.lit(prefix + p.name)
        if p.default:
            fallback = inner
            continue
        when = (F.when if when is None else when.when)(_holds(by, p), inner)
    return fallback if when is None else when.otherwise(fallback)


def hash_value(by: PartitionBy) -> Column:
    """The declared hash of the key columns; md5 takes the first 32 bits over the values as text."""
    if by.hash == "md5":
        text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by.columns))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.xxhash64(*by.columns)


def _holds(by: PartitionBy, p: Partition) -> Column:
    if by.strategy == "list":
        plain = [v for v in p.values if v is not None]
        null = F.col(by.columns[0]).isNull() if None in p.values else F.lit(False)
        return F.coalesce(F.col(by.columns[0]).isin(*plain), F.lit(False)) | null
    if by.strategy == "hash":
        return F.pmod(hash_value(by), F.lit(by.modulus)) == p.remainder
    known = all_of([F.col(c).isNotNull() for c in by.columns])
    low = F.lit(True) if p.lower is None else _bound(by.columns, p.lower, upper=False)
    high = F.lit(True) if p.upper is None else _bound(by.columns, p.upper, upper=True)
    return F.coalesce(known & low & high, F.lit(False))


def route_partitions(df: DataFrame, by: PartitionBy, column: str = "partition") -> DataFrame:
    """Each row with the path of its leaf partition; null where no partition and no default takes it.

    Bounds are a declared list, so routing is one projection and shuffles nothing."""
    return df.withColumn(column, _leaf(by))


def partition_changes(df: DataFrame, old: PartitionBy, new: PartitionBy) -> DataFrame:
    """(partition, change, rows affected) between two partition trees, counted on the rows."""
    flat = lambda by, prefix="": {x: y for p in by.parts for x, y in ({f"{prefix}{p.name}": (p.values, p.lower, p.upper, p.remainder, p.default)} if not p.by else flat(p.by, f"{prefix}{p.name}/")).items()}
    a, b = flat(old), flat(new)
    both = route_partitions(route_partitions(df, old, "_old"), new, "_new")
    counts = both.groupBy("_old", "_new").agg(F.count("*").alias("n"))
    parts = []
    for name in sorted({*a, *b}):
        change = "added" if name not in a else "removed" if name not in b else "bounds changed" if a[name] != b[name] else "same"
        moved = (F.col("_old").eqNullSafe(F.lit(name)) | F.col("_new").eqNullSafe(F.lit(name))) & ~F.col("_old").eqNullSafe(F.col("_new"))
        parts.append(F.struct(F.lit(name).alias("partition"), F.lit(change).alias("change"), F.coalesce(F.sum(F.when(moved, F.col("n"))), F.lit(0)).alias("rows_moved")))
    return counts.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def range_ops(df: DataFrame, lo: str, hi: str, other_lo: str, other_hi: str) -> DataFrame:
    """overlaps, contains, adjacent and the intersection of two half-open ranges of a row; a null bound is unbounded."""
    a, b, c, d = (F.col(x) for x in (lo, hi, other_lo, other_hi))
    sure = lambda x, otherwise: F.coalesce(x, F.lit(otherwise))
    overlaps = sure(a < d, True) & sure(c < b, True)
    contains = (a.isNull() | sure(a <= c, False)) & (b.isNull() | sure(d <= b, False))
    return df.withColumns({"overlaps": overlaps, "contains": contains, "adjacent": sure(b == c, False) | sure(d == a, False), "common_lo": F.when(overlaps, F.greatest(a, c)), "common_hi": F.when(overlaps, F.least(b, d))})


def merge_ranges(df: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Touching or overlapping ranges of a group merged into islands, with the gap before each; a null bound is unbounded."""
    order = Window.partitionBy(*by).orderBy(F.col(lo).asc_nulls_first(), F.col(hi).asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce(F.bool_or(F.col(hi).isNull()).over(earlier), F.lit(False)) | (F.count("*").over(earlier) > 0) & F.col(lo).isNull() | F.coalesce(F.max(hi).over(earlier) >= F.col(lo), F.lit(False))
    island = df.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.when(~F.bool_or(F.col(c).isNull()), f(c)).alias(c) for c, f in ((lo, F.min), (hi, F.max))]
    merged = island.groupBy(*by, "_i").agg(*ends, F.count("*").alias("ranges"))
    return merged.withColumn("gap_before", F.col(lo) - F.lag(hi).over(Window.partitionBy(*by).orderBy(F.col(lo).asc_nulls_first()))).drop("_i")
