"""Statistics of columns and column groups, candidate keys and user-defined aggregates."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablespec.operators.constraints import all_of, union_all
from tablespec.operators.lattice import key_lattice, pair_degrees
from tablespec.paths import written

STATES_MOST = 100_000


def candidate_keys(df: DataFrame, cols: list[str], max_width: int = 2) -> DataFrame:
    """(key): minimal sets of non-null columns that are unique, comma-joined; a table without rows has none.

    Most sets fall by two equal rows of a part of the table; what is left is grouped in full, level by level."""
    facts = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in cols)).first()
    full = [c for c in cols if facts[c] == facts["n"]]
    return df.sparkSession.createDataFrame([(",".join(k),) for k in key_lattice(df, full, max_width)], "key string")


def column_stats(df: DataFrame, targets: dict[str, int], exact: bool = False) -> DataFrame:
    """column_name, null_share, n_distinct, avg_width, mcv and histogram of each column.

    A target is the number of most common values and of histogram bounds (-1: 100). Most common
    values are value:count by falling count; bounds are equi-depth percentiles. Whatever the columns,
    one pass counts the values of every column, another takes distinct counts and percentiles."""
    names, many = list(targets), {c: 100 if t < 0 else t for c, t in targets.items()}
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(names)))
    counts = df.select(F.explode(cells).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n"))
    values = written(counts.select(F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("column_name"), "v", "n"))
    held = F.when(F.col("v").isNotNull(), F.col("n"))
    base = values.groupBy("column_name").agg((F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("null_share"), F.count("v").alias("exact"), (F.sum(F.octet_length("v") * F.col("n")) / F.sum(held)).alias("avg_width"))
    numeric = [c for c in names if df.schema[c].dataType.typeName() in ("integer", "long", "double", "float", "short")]
    points = {c: [i / max(1, many[c]) for i in range(many[c] + 1)] for c in names}
    bounds = lambda c: (F.percentile(c, points[c]) if exact else F.percentile_approx(c, points[c], 10000)).cast("array<string>") if c in numeric else F.lit(None).cast("array<string>")
    one = df.agg(F.count("*").alias("_all"), *(bounds(c).alias(f"h{i}") for i, c in enumerate(names) if c in numeric), *(F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(names) if not exact))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), (F.col(f"h{i}") if c in numeric else F.lit(None).cast("array<string>")).alias("histogram"), (F.lit(0) if exact else F.col(f"d{i}")).cast("long").alias("near"), F.lit(many[c]).alias("most")) for i, c in enumerate(names)))
    facts = one.select(F.inline(rows))
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "v"))
    top = values.where("v IS NOT NULL").withColumn("_r", rank).where(F.col("_r") <= max(many.values(), default=0)).join(facts.select("column_name", "most"), "column_name").where("_r <= most")
    mcv = top.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "v"))).alias("m"))
    common = F.coalesce(F.transform("m", lambda x: F.concat(x["v"], F.lit(":"), (-x["n"]).cast("string"))), F.array().cast("array<string>"))
    out = facts.join(base, "column_name", "left").join(mcv, "column_name", "left")
    return out.select("column_name", "null_share", (F.coalesce("exact", F.lit(0)) if exact else F.col("near")).alias("n_distinct"), "avg_width", common.alias("mcv"), "histogram")


def ext_ndistinct(df: DataFrame, cols: list[str]) -> DataFrame:
    """(columns, n_distinct) for every combination of two or more columns, by grouping sets."""
    sets = [s for w in range(2, len(cols) + 1) for s in combinations(cols, w)]
    few = df.groupBy(*cols).agg(F.lit(1).alias("_one"))
    grouped = few.groupingSets([list(s) for s in sets], *cols).agg(F.grouping_id().alias("_g"))
    name = {sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s): ",".join(s) for s in sets}
    label = F.element_at(F.create_map(*(F.lit(x) for kv in name.items() for x in kv)), F.col("_g").cast("int"))
    return grouped.groupBy(label.alias("columns")).agg(F.count("*").alias("n_distinct"))


def ext_dependencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """(determinant, dependent, degree): share of rows in groups of A that hold a single B."""
    return pair_degrees(df, cols)


def ext_mcv(df: DataFrame, cols: list[str], target: int) -> DataFrame:
    """Most common value combinations with their frequency and the one independence would give."""
    combos = df.groupBy(*cols).agg(F.count("*").alias("rows"))
    top = combos.orderBy(F.desc("rows"), *cols).limit(target)
    total = combos.agg(F.sum("rows").alias("_all"))
    out = top.join(total)
    for c in cols:
        single = combos.groupBy(F.col(c).alias(f"_{c}")).agg(F.sum("rows").alias(f"_n_{c}"))
        out = out.join(single, F.col(c).eqNullSafe(F.col(f"_{c}")))
    base = F.lit(1.0)
    for c in cols:
        base = base * (F.col(f"_n_{c}") / F.col("_all"))
    return out.select(*cols, "rows", (F.col("rows") / F.col("_all")).alias("frequency"), base.alias("base_frequency"))


def custom_aggregate(df: DataFrame, by: list[str], cols: list[str], initial: Callable[[], object], step: Callable, combine: Callable, final: Callable, out: str, out_type: str) -> DataFrame:
    """A user aggregate in two steps: partial states per partition and key, combined per key.

    step takes a state and arrays: the columns of a key's rows in one batch. States must pickle; the
    shuffle moves a state per key and partition, more where a partition has over STATES_MOST keys."""
    import pickle

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def packed(states: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=[*by, "_state"])

    def partial(frames):
        states: dict = {}
        for f in frames:
            for key, rows in f.groupby(by, sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                states[key] = step(states[key] if key in states else initial(), *(rows[c].to_numpy() for c in cols))
            if len(states) > STATES_MOST:
                yield packed(states)
                states = {}
        if states:
            yield packed(states)

    def finish(f: pd.DataFrame) -> pd.DataFrame:
        state = initial()
        for s in f["_state"]:
            state = combine(state, pickle.loads(s))
        return pd.DataFrame([(*f[by].iloc[0], final(state))], columns=[*by, out])

    states = df.select(*by, *cols).mapInPandas(partial, f"{kinds}, _state binary")
    return states.groupBy(*by).applyInPandas(finish, f"{kinds}, `{out}` {out_type}")


def ordered_set_aggregate(df: DataFrame, by: list[str], col: str, points: list[float]) -> DataFrame:
    """percentile_disc and percentile_cont at each point, mode, and the values in order."""
    cols = []
    for p in points:
        tag = f"{round(p * 100)}"
        cols += [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{col}`)").alias(f"disc_{tag}"), F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY `{col}`)").alias(f"cont_{tag}")]
    top = df.where(F.col(col).isNotNull()).groupBy(*by, col).count()
    mode = top.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), col))).where("_r = 1").select(*by, F.col(col).alias("mode"))
    return df.groupBy(*by).agg(*cols).join(mode, by, "left")


def infer_spec(df: DataFrame, enum_most: int = 20) -> DataFrame:
    """(column_name, inferred_type, nullable, unique_values, serial, labels) from one profile pass; of a table without
    rows the types stay and nothing is unique."""
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    kinds = ["boolean", "bigint", "double", "date", "timestamp"]
    aggs = [F.count("*").alias("_n")]
    for f in df.schema.fields:
        c = F.col(f.name)
        aggs += [F.count(c).alias(f"{f.name}|held"), F.approx_count_distinct(c, 0.02).alias(f"{f.name}|distinct")]
        if f.name in text:
            aggs += [F.count_if(c.isNotNull() & c.try_cast(k).isNull()).alias(f"{f.name}|{k}") for k in kinds]
            aggs += [F.count_if(c.isNotNull() & F.try_parse_json(c).isNull()).alias(f"{f.name}|json"), F.count_if(~c.rlike(r"^\s*[\[{]")).alias(f"{f.name}|plain"), F.max(F.length(c)).alias(f"{f.name}|width")]
        elif f.dataType.typeName() in ("integer", "long"):
            aggs += [F.min(c).alias(f"{f.name}|min"), F.max(c).alias(f"{f.name}|max")]
    p = df.agg(*aggs).first().asDict()
    few = [f.name for f in df.schema.fields if f.name in text and 0 < p[f"{f.name}|distinct"] <= enum_most < p["_n"]]
    close = [f.name for f in df.schema.fields if p[f"{f.name}|held"] == p["_n"] and p[f"{f.name}|distinct"] >= 0.85 * p["_n"]]
    unique_columns = {c for (c,) in key_lattice(df, close, 1)}
    exact = df.agg(F.lit(1).alias("_"), *(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}|labels") for c in few)).first().asDict()
    rows = []
    for f in df.schema.fields:
        n, held = f.name, p[f"{f.name}|held"]
        kind = f.dataType.simpleString()
        if n in text and held:
            kind = next((k for k in kinds if p[f"{n}|{k}"] == 0), None) or ("json" if p[f"{n}|json"] == 0 and p[f"{n}|plain"] == 0 else f"varchar({p[f'{n}|width']})")
        unique = n in unique_columns
        serial = unique and f"{n}|min" in p and p[f"{n}|max"] - p[f"{n}|min"] + 1 == p["_n"]
        rows.append((n, kind, held < p["_n"], unique, serial, exact.get(f"{n}|labels")))
    return df.sparkSession.createDataFrame(rows, "column_name string, inferred_type string, nullable boolean, unique_values boolean, serial boolean, labels string")


def fk_candidates(child: DataFrame, cols: list[str], parent: DataFrame, key: str) -> DataFrame:
    """(column_name, orphans) for columns whose values are tested for inclusion in a parent key."""
    keys = parent.select(F.col(key).alias("_k")).distinct()
    return union_all([child.where(F.col(c).isNotNull()).join(keys, all_of([F.col(c) == F.col("_k")]), "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(c).alias("column_name"), "orphans") for c in cols])
