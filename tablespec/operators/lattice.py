"""Keys, functional dependencies and inclusions of columns, from partitions of row numbers.

The partition of a column set puts rows with equal values into one class; a class is named
by its least row number, and classes of one row are dropped, so a set is a key when nothing is
left. A wider set's partition is met row by row from those of two narrower ones, all
sets of a level in one join and one grouping, and only rows that still share a class go on.
Rows less classes is the same for X and for X with A exactly where X determines A. Nulls are
equal to each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablespec.operators.constraints import union_all
from tablespec.paths import written

_CLASSES = "set array<int>, row long, class long, size long"
STRETCH = 500_000  # rows of a task among which equal ones are looked for without a shuffle
SLICES = 16  # of a set's values, of which one is grouped before all are
_PLAIN = (T.IntegralType, T.DecimalType, T.FloatType, T.DoubleType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.BinaryType)


def single_partitions(df: DataFrame, cols: list[str]) -> DataFrame:
    """(set, row, class, size) of each column: the rows that share their value with another one. Columns are numbered."""
    rows = written(df.select(*cols).withColumn("_row", F.monotonically_increasing_id()))
    parts = []
    for i, c in enumerate(cols):
        shared = rows.groupBy(F.col(c).alias("_v")).agg(F.min("_row").alias("class"), F.count("*").alias("size")).where("size > 1")
        parts.append(rows.select(F.col(c).alias("_w"), F.col("_row").alias("row")).join(shared, F.col("_w").eqNullSafe(F.col("_v"))).select(F.array(F.lit(i)).alias("set"), "row", "class", "size"))
    return written(union_all(parts)) if parts else df.sparkSession.createDataFrame([], _CLASSES)


def refined(now: DataFrame, single: DataFrame, wanted: list[tuple[int, ...]]) -> DataFrame:
    """The partitions of the wanted sets, each the one of all its columns but the last met with that of the last."""
    if not wanted:
        return now.limit(0)
    pairs = now.sparkSession.createDataFrame([(list(s[:-1]), s[-1]) for s in wanted], "set array<int>, more int")
    right = single.select(F.col("set")[0].alias("more"), "row", F.col("class").alias("_other"))
    met = now.select("set", "row", "class").join(F.broadcast(pairs), "set").join(right, ["more", "row"]).withColumn("set", F.concat("set", F.array("more")))
    shared = met.groupBy("set", "class", "_other").agg(F.min("row").alias("_least"), F.count("*").alias("size")).where("size > 1")
    return written(met.join(shared, ["set", "class", "_other"]).select("set", "row", F.col("_least").alias("class"), "size"))


def set_facts(partition: DataFrame) -> dict[tuple[int, ...], tuple[int, int]]:
    """(rows, classes) left of each set; a set that is not there has none."""
    found = partition.groupBy("set").agg(F.count("*").alias("rows"), F.count_if(F.col("row") == F.col("class")).alias("classes")).collect()
    return {tuple(r["set"]): (r["rows"], r["classes"]) for r in found}


def repeated_sets(rows: DataFrame, wanted: list[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """Of sets of plain columns, those in which two rows of one stretch of a task's rows are alike. No set found is a key; one
    that is not found may still repeat across stretches."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, held, size = list(range(len(wanted))), [], 0

        def found() -> list[int]:
            table, out = pa.Table.from_batches(held), []
            for i in left:
                # of a set that repeats all smaller ones do
                if not any(set(wanted[i]) <= set(wanted[j]) for j in out) and table.group_by(list(wanted[i]), use_threads=False).aggregate([]).num_rows < table.num_rows:
                    out.append(i)
            return out

        for batch in batches:
            if not left:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= STRETCH:
                out, held, size = found(), [], 0
                # where a stretch tells nothing new, the rest of the task is left to the groupings
                left = [i for i in left if out and not any(set(wanted[i]) <= set(wanted[j]) for j in out)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["i"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(found(), pa.int32())], names=["i"])

    return {wanted[r.i] for r in rows.mapInArrow(seen, "i int").distinct().collect()} if wanted else set()


def _repeats(rows: DataFrame, s: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*s).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))


def key_lattice(df: DataFrame, cols: list[str], max_width: int) -> list[tuple[str, ...]]:
    """Minimal column sets up to a width in which no two rows are alike; none of a table without rows.

    Two equal rows tell that a set is no key: they are looked for among rows that lie close together, then among those whose
    values fall in one slice of a hash. The few sets still open are grouped in full, one shuffle of their own columns each,
    from the narrowest on."""
    if not cols or df.isEmpty():
        return []
    names = [f"c{i}" for i in range(len(cols))]
    rows = written(df.select(*(F.col(c).alias(n) for c, n in zip(cols, names))))
    plain = [n for n in names if isinstance(rows.schema[n].dataType, _PLAIN)]
    wanted = [s for width in range(min(max_width, len(plain)), 0, -1) for s in combinations(plain, width)]
    repeated, keys = [set(s) for s in repeated_sets(rows.select(*plain), wanted)], []
    near = [s for s in wanted if not any(set(s) <= r for r in repeated)]
    if near:
        slices = [_repeats(rows.where(F.pmod(F.xxhash64(*s), F.lit(SLICES)) == 0), s).select(F.lit(i).alias("i"), "n") for i, s in enumerate(near)]
        repeated += [set(near[r.i]) for r in union_all(slices).where("n > 1").collect()]
    for width in range(1, max_width + 1):
        for s in combinations(names, width):
            if any(set(k) <= set(s) for k in keys) or any(set(s) <= r for r in repeated):
                continue
            if _repeats(rows, s).first().n == 1:
                keys.append(s)
            else:
                repeated.append(set(s))
    return [tuple(cols[names.index(n)] for n in k) for k in keys]


def functional_dependencies(df: DataFrame, cols: list[str], max_width: int = 2) -> DataFrame:
    """(determinant, dependent): minimal sets of up to max_width columns, comma-joined, whose values determine another
    column in every row; the empty set determines a constant. Of a table without rows nothing is said."""
    out, n = [], df.count()
    if n:
        single = single_partitions(df, cols)
        now, facts = single, set_facts(single)
        for width in range(2, max_width + 2):
            wanted = list(combinations(range(len(cols)), width))
            now = refined(now, single, wanted)
            facts |= set_facts(now)
        loss = lambda s: (lambda x: x[0] - x[1])(facts.get(s, (0, 0))) if s else n - 1
        for a in range(len(cols)):
            found: list[tuple[int, ...]] = []
            for width in range(max_width + 1):
                for x in combinations([i for i in range(len(cols)) if i != a], width):
                    if not any(set(f) <= set(x) for f in found) and loss(x) == loss(tuple(sorted((*x, a)))):
                        found.append(x)
            out += [(",".join(cols[i] for i in x), cols[a]) for x in found]
    return df.sparkSession.createDataFrame(out, "determinant string, dependent string")


def pair_degrees(df: DataFrame, cols: list[str]) -> DataFrame:
    """(determinant, dependent, degree): share of rows in groups of A that hold a single B, from the partitions of pairs; none of a
    table without rows."""
    names = F.array(*map(F.lit, cols))
    n = df.agg(F.count("*").alias("n"))
    single = single_partitions(df, cols)
    pairs = refined(single, single, list(combinations(range(len(cols)), 2)))
    sizes = single.select(F.col("set")[0].alias("a"), "row", F.col("size").alias("own"))
    # a group of A with a single B is a class of A that the pair leaves whole
    both = pairs.select("row", "size", F.explode(F.array(*(F.struct(F.col("set")[i].alias("a"), F.col("set")[1 - i].alias("b")) for i in (0, 1)))).alias("x")).select("row", "size", "x.*")
    whole = both.join(sizes, ["a", "row"]).groupBy("a", "b").agg(F.count_if(F.col("size") == F.col("own")).alias("whole"))
    grouped = single.groupBy(F.col("set")[0].alias("a")).agg(F.count("*").alias("shared"))
    every = df.sparkSession.createDataFrame([(a, b) for a in range(len(cols)) for b in range(len(cols)) if a != b], "a int, b int")
    out = every.join(grouped, "a", "left").join(whole, ["a", "b"], "left").join(n).where("n > 0")
    degree = (F.col("n") - F.coalesce("shared", F.lit(0)) + F.coalesce("whole", F.lit(0))) / F.col("n")
    return out.select(F.element_at(names, F.col("a") + 1).alias("determinant"), F.element_at(names, F.col("b") + 1).alias("dependent"), degree.alias("degree"))


def _family(kind: T.DataType) -> str | None:
    """Types whose values can be the same one share a family; None for those that no key has."""
    if isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0:
        return "number"
    return kind.typeName() if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.BinaryType)) else None


def inclusion_dependencies(tables: dict[str, DataFrame]) -> DataFrame:
    """(dependent, referenced, n_values, n_missing) of all pairs of columns (table.column) of like types, dependent ones with
    at least one value: how many distinct values there are, and how many of them the other column lacks.

    All columns meet in one shuffle of distinct values, each with the set of columns that hold it; what
    follows counts these sets, of which there are few. Zero missing is an inclusion, a candidate for a foreign key."""
    columns = [(f"{t}.{f.name}", t, f.name, _family(f.dataType)) for t, df in tables.items() for f in df.schema.fields]
    columns = [c for c in columns if c[3]]
    parts = []
    for t, df in tables.items():
        mine = [(i, name, family) for i, (_, owner, name, family) in enumerate(columns) if owner == t]
        if mine:
            cells = F.array(*(F.struct(F.lit(i).alias("c"), F.lit(family).alias("family"), (F.hex(name) if family == "binary" else F.col(f"`{name}`").cast("string")).alias("v")) for i, name, family in mine))
            parts.append(df.select(F.explode(cells).alias("x")).select("x.*").where("v IS NOT NULL"))
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "dependent string, referenced string, n_values long, n_missing long")
    held = union_all(parts).groupBy("family", "v").agg(F.array_sort(F.collect_set("c")).alias("s"))
    sets = written(held.groupBy("family", "s").agg(F.count("*").alias("n")))
    values = sets.select(F.explode("s").alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n_values"))
    shared = sets.select(F.explode("s").alias("c"), "s", "n").select("c", F.explode("s").alias("d"), "n").where("c != d").groupBy("c", "d").agg(F.sum("n").alias("n_shared"))
    label = tables[columns[0][1]].sparkSession.createDataFrame([(i, name, family) for i, (name, _, _, family) in enumerate(columns)], "c int, name string, family string")
    other = label.select(F.col("c").alias("d"), F.col("name").alias("referenced"), F.col("family").alias("_family"))
    pairs = label.join(other, (F.col("family") == F.col("_family")) & (F.col("c") != F.col("d"))).join(values, "c").join(shared, ["c", "d"], "left")
    return pairs.select(F.col("name").alias("dependent"), "referenced", "n_values", (F.col("n_values") - F.coalesce("n_shared", F.lit(0))).alias("n_missing"))
