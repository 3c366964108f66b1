"""Constraint audits: what is checked, how many rows break it, and which."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablespec.spec import Check, Domain, ForeignKey, TableSpec, Unique

REPORT = ["table_name", "constraint_name", "constraint_type", "checked_rows", "violations"]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def check_passes(expr: str | Column) -> Column:
    """A check holds where it is true or null."""
    return F.coalesce(F.expr(expr) if isinstance(expr, str) else expr, F.lit(True))


def unique_violations(df: DataFrame, cols: list[str], nulls_distinct: bool = True, where: str | None = None) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    rows = df.where(where) if where else df
    if nulls_distinct:
        rows = rows.where(all_of([F.col(c).isNotNull() for c in cols]))
    return rows.groupBy(*cols).agg(F.count("*").alias("rows")).where("rows > 1")


def unique_report(df: DataFrame, table: str, u: Unique) -> DataFrame:
    """One report row; rows beyond the first of a key violate, and for a primary key also nulls."""
    rows = df.where(u.where) if u.where else df
    null_key = any_of([F.col(c).isNull() for c in u.columns])
    per_key = rows.groupBy(*u.columns).agg(F.count("*").alias("n"))
    extra = F.when(null_key, F.col("n") if u.primary else F.lit(0) if u.nulls_distinct else F.col("n") - 1).otherwise(F.col("n") - 1)
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked_rows"), F.coalesce(F.sum(extra), F.lit(0)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(u.name).alias("constraint_name"), F.lit("primary key" if u.primary else "unique").alias("constraint_type"), "checked_rows", "violations"
    )


def row_rules(df: DataFrame, table: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Report rows for (name, type, violated) rules, all counted in one pass over the table."""
    if not rules:
        return df.sparkSession.createDataFrame([], "table_name string, constraint_name string, constraint_type string, checked_rows long, violations long")
    one = df.agg(F.count("*").alias("checked_rows"), *(F.count_if(bad).alias(f"v{i}") for i, (_, _, bad) in enumerate(rules)))
    entries = F.array(*(F.struct(F.lit(n).alias("constraint_name"), F.lit(k).alias("constraint_type"), F.col(f"v{i}").alias("violations")) for i, (n, k, _) in enumerate(rules)))
    return one.select("checked_rows", F.explode(entries).alias("e")).select(F.lit(table).alias("table_name"), "e.constraint_name", "e.constraint_type", "checked_rows", "e.violations")


def not_null_rules(spec: TableSpec) -> list[tuple[str, str, Column]]:
    return [(f"{c.name}_not_null", "not null", F.col(c.name).isNull()) for c in spec.columns if not c.nullable]


def check_rules(checks: tuple[Check, ...]) -> list[tuple[str, str, Column]]:
    return [(c.name, "check", ~check_passes(c.expr)) for c in checks]


def domain_rules(col_domains: dict[str, Domain]) -> list[tuple[str, str, Column]]:
    """A domain's rules for each column that uses it; VALUE stands for the column."""
    out = []
    for col, d in col_domains.items():
        if not d.nullable:
            out.append((f"{col}_{d.name}_not_null", "domain", F.col(col).isNull()))
        out += [(f"{col}_{c.name}", "domain", ~check_passes(c.expr.replace("VALUE", f"`{col}`"))) for c in d.checks]
    return out


def enum_rules(df: DataFrame, col_enums: dict[str, tuple[str, ...]]) -> list[tuple[str, str, Column]]:
    """Values outside the labels; for arrays, rows with any such element."""
    out = []
    for col, labels in col_enums.items():
        allowed = F.array(*map(F.lit, labels))
        if df.schema[col].dataType.typeName() == "array":
            bad = F.size(F.array_except(F.filter(F.col(col), lambda x: x.isNotNull()), allowed)) > 0
        else:
            bad = ~F.col(col).isin(*labels)
        out.append((f"{col}_enum", "enum", F.coalesce(bad, F.lit(False))))
    return out


def not_null_audit(df: DataFrame, spec: TableSpec) -> DataFrame:
    return row_rules(df, spec.name, not_null_rules(spec))


def check_audit(df: DataFrame, table: str, checks: tuple[Check, ...], child_rows: str | None = None) -> DataFrame:
    """Named counts; child_rows marks inherited rows, which a no-inherit check skips."""
    rules = [(c.name, "check", ~check_passes(c.expr) & (~F.expr(child_rows) if c.no_inherit and child_rows else F.lit(True))) for c in checks]
    return row_rules(df, table, rules)


def check_offenders(df: DataFrame, checks: tuple[Check, ...]) -> DataFrame:
    """Rows that break any check, with the names of those broken."""
    broken = F.filter(F.array(*(F.when(~check_passes(c.expr), F.lit(c.name)) for c in checks)), lambda x: x.isNotNull())
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def domain_audit(df: DataFrame, table: str, col_domains: dict[str, Domain]) -> DataFrame:
    return row_rules(df, table, domain_rules(col_domains))


def enum_audit(df: DataFrame, table: str, col_enums: dict[str, tuple[str, ...]]) -> DataFrame:
    return row_rules(df, table, enum_rules(df, col_enums))


def fk_violations(child: DataFrame, parent: DataFrame, cols: list[str], ref_cols: list[str], match: str = "simple") -> DataFrame:
    """Child rows without a parent. SIMPLE passes any null; FULL passes only all nulls and
    rejects mixed ones; PARTIAL compares the parts that are not null."""
    keys = parent.select(*(F.col(r).alias(f"_p{i}") for i, r in enumerate(ref_cols))).distinct()
    none_null = all_of([F.col(c).isNotNull() for c in cols])
    all_null = all_of([F.col(c).isNull() for c in cols])
    equal = all_of([F.col(c) == F.col(f"_p{i}") for i, c in enumerate(cols)])
    orphans = child.where(none_null).join(keys, equal, "left_anti")
    if match == "simple":
        return orphans
    mixed = child.where(~none_null & ~all_null)
    if match == "full":
        return orphans.unionByName(mixed)
    if len(cols) == 1:
        return orphans
    # one anti join for each shape of nulls keeps every join an equi join
    parts = [orphans]
    for shape in range(1, 2 ** len(cols) - 1):
        held = [i for i in range(len(cols)) if shape >> i & 1]
        here = all_of([F.col(c).isNotNull() if i in held else F.col(c).isNull() for i, c in enumerate(cols)])
        few = keys.select(*(f"_p{i}" for i in held)).distinct()
        parts.append(child.where(here).join(few, all_of([F.col(cols[i]) == F.col(f"_p{i}") for i in held]), "left_anti"))
    return union_all(parts)


def fk_report(child: DataFrame, parent: DataFrame, table: str, fk: ForeignKey) -> DataFrame:
    bad = fk_violations(child, parent, list(fk.columns), list(fk.ref_columns), fk.match)
    return child.agg(F.count("*").alias("checked_rows")).join(bad.agg(F.count("*").alias("violations"))).select(
        F.lit(table).alias("table_name"), F.lit(fk.name).alias("constraint_name"), F.lit("foreign key").alias("constraint_type"), "checked_rows", "violations"
    )


def constraint_report(tables: dict[str, DataFrame], specs: list[TableSpec]) -> DataFrame:
    """All constraints of many tables; row rules of a table share one scan."""
    parts = []
    for s in specs:
        df = tables[s.name]
        rules = not_null_rules(s) + check_rules(s.checks) + domain_rules(s.domains) + enum_rules(df, s.enums)
        if rules:
            parts.append(row_rules(df, s.name, rules))
        parts += [unique_report(df, s.name, u) for u in s.uniques]
        parts += [fk_report(df, tables[f.parent], s.name, f) for f in s.foreign_keys]
    return union_all(parts).select(*REPORT)


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """Row counts and order-free content hashes of two versions, side by side."""
    cols = sorted(old.columns)
    half = lambda df, side: df.agg(F.count("*").alias(f"{side}_rows"), F.coalesce(F.bit_xor(F.xxhash64(*cols)), F.lit(0)).alias(f"{side}_hash"), F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(20,0)")), F.lit(0)).alias(f"{side}_sum"))
    both = half(old, "old").join(half(new, "new"))
    return both.select("old_rows", "new_rows", ((F.col("old_rows") == F.col("new_rows")) & (F.col("old_hash") == F.col("new_hash")) & (F.col("old_sum") == F.col("new_sum"))).alias("same"))


def validate_constraint(df: DataFrame, state: DataFrame, table: str, check: Check) -> DataFrame:
    """NOT VALID to valid: a constraint already trusted in the state table is not scanned again."""
    trusted = state.where((F.col("table_name") == table) & (F.col("constraint_name") == check.name) & F.col("validated"))
    if not trusted.isEmpty():
        return trusted.select("table_name", "constraint_name", F.lit(0).cast("long").alias("checked_rows"), F.lit(0).cast("long").alias("violations"), "validated")
    return check_audit(df, table, (check,)).select("table_name", "constraint_name", "checked_rows", "violations", (F.col("violations") == 0).alias("validated"))


def sample_violations(violations: DataFrame, k: int, rule: str = "rule", order: list[str] | None = None) -> DataFrame:
    """At most k offending rows of each rule, the first by the given order."""
    rank = F.row_number().over(Window.partitionBy(rule).orderBy(*(order or ["key"])))
    return violations.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def rule_chain(df: DataFrame, *rules, severities: dict[str, str] | None = None) -> DataFrame:
    """Violations (rule, severity, key, message) of all rules in order; severities overrides
    error, warning or off by rule name."""
    found = union_all([r(df).select("rule", "severity", "key", "message") for r in rules])
    for name, level in (severities or {}).items():
        is_rule = F.col("rule") == name
        found = found.where(~is_rule) if level == "off" else found.withColumn("severity", F.when(is_rule, F.lit(level)).otherwise(F.col("severity")))
    return found
