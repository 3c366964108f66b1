"""Projections: views, renames, added and dropped columns, conversions, policies and privileges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablespec.operators.constraints import all_of, any_of, union_all
from tablespec.spec import Policy, TableSpec


def define_view(df: DataFrame, cols: list[str], predicate: str | None = None, names: list[str] | None = None, view: str | None = None) -> DataFrame:
    """Selected expressions of the rows that satisfy the predicate; names are the output columns."""
    out = (df.where(predicate) if predicate else df).selectExpr(*cols)
    out = out.toDF(*names) if names else out
    if view:
        out.createOrReplaceTempView(view)
    return out


def view_check_option(incoming: DataFrame, view_pred: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a row written through a view must make its predicate true, not null."""
    holds = F.coalesce(F.expr(view_pred), F.lit(False))
    return incoming.where(holds), incoming.where(~holds)


def split_words(name: str) -> list[str]:
    return [w for w in re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).replace("-", "_").split("_") if w]


NAME_RULES = {
    "snake": lambda w: "_".join(w).lower(),
    "SNAKE": lambda w: "_".join(w).upper(),
    "camelCase": lambda w: w[0].lower() + "".join(x.capitalize() for x in w[1:]),
    "PascalCase": lambda w: "".join(x.capitalize() for x in w),
    "kebab": lambda w: "-".join(w).lower(),
    "KEBAB": lambda w: "-".join(w).upper(),
    "Train-Case": lambda w: "-".join(x.capitalize() for x in w),
    "lower": lambda w: "".join(w).lower(),
    "UPPER": lambda w: "".join(w).upper(),
    "Pascal_Snake": lambda w: "_".join(x.capitalize() for x in w),
}


def rename_columns(df: DataFrame, renames: dict[str, str], rule: str | None = None, overrides: dict[str, str] | None = None, wanted: set[str] = frozenset()) -> DataFrame:
    """Renames old to new. A new name already there is a no-op; neither name, or an old name that
    is still wanted, is an error. A rule then renames the other columns, overrides by name first."""
    have, todo = set(df.columns), {}
    for old, new in renames.items():
        if old in wanted:
            raise ValueError(f"{old} is renamed and still wanted")
        if old in have and new in have:
            raise ValueError(f"both {old} and {new} exist")
        if old in have:
            todo[old] = new
        elif new not in have:
            raise ValueError(f"neither {old} nor {new} exists")
    if rule or overrides:
        for c in df.columns:
            if c not in todo and c not in renames.values():
                target = (overrides or {}).get(c) or (NAME_RULES[rule](split_words(c)) if rule else c)
                if target != c:
                    todo[c] = target
    return df.withColumnsRenamed(todo)


def add_columns(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Declared columns that are absent, filled by their default or null; unfilled_not_null names
    those that are declared not null and have nothing to fill them."""
    missing = [c for c in spec.columns if c.name not in df.columns and not c.generated]
    out = df.withColumns({c.name: (F.expr(c.default) if c.default else F.lit(None)).cast(c.type) for c in missing})
    unfilled = [c.name for c in missing if not c.nullable and not c.default and not c.identity]
    return out.withColumn("unfilled_not_null", F.array(*map(F.lit, unfilled)).cast("array<string>"))


def drop_columns(df: DataFrame, names: list[str], allow_destructive: bool = False) -> DataFrame:
    """Drops columns; without leave to lose data, fails if any holds a value."""
    present = [n for n in names if n in df.columns]
    if present and not allow_destructive and not df.where(any_of([F.col(n).isNotNull() for n in present])).isEmpty():
        raise ValueError(f"dropping {', '.join(present)} loses values")
    return df.drop(*present)


def dropped_values(df: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, lost) values that dropping each column would lose."""
    one = df.agg(*(F.count(n).alias(n) for n in names))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(n).alias("lost")) for n in names))).alias("x")).select("x.*")


def change_type(df: DataFrame, col: str, to: str, using: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(converted, quarantined): rows whose value does not convert keep it in the quarantine."""
    source = F.expr(using) if using else F.col(col)
    both = df.withColumn("_new", source.try_cast(to))
    failed = source.isNotNull() & F.col("_new").isNull()
    good = both.where(~failed).withColumn(col, F.col("_new")).drop("_new")
    return good, both.where(failed).drop("_new")


def generated_columns(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Stored generated columns computed anew."""
    return df.withColumns({c.name: F.expr(c.generated).cast(c.type) for c in spec.columns if c.generated})


def generated_audit(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(column_name, stale): stored generated values that differ from their expression."""
    made = [c for c in spec.columns if c.generated and c.name in df.columns]
    one = df.agg(*(F.count_if(~F.col(c.name).eqNullSafe(F.expr(c.generated).cast(c.type))).alias(c.name) for c in made))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c.name).alias("column_name"), F.col(c.name).alias("stale")) for c in made))).alias("x")).select("x.*")


def apply_defaults(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Defaults fill absent columns only; an explicit null stays."""
    return df.withColumns({c.name: F.expr(c.default).cast(c.type) for c in spec.columns if c.default and c.name not in df.columns})


def covering_subset(df: DataFrame, keys: list[str], include: list[str], where: str | None, order: list[Column] | None = None) -> DataFrame:
    """The rows and columns of a partial covering index, sorted inside partitions by its keys."""
    rows = df.where(where) if where else df
    out = rows.selectExpr(*keys, *include)
    return out.sortWithinPartitions(*(order or out.columns[: len(keys)]))


def _policy_predicate(policies: list[Policy], role: str, command: str, part: str) -> Column:
    mine = [p for p in policies if p.command in ("all", command) and ("public" in p.roles or role in p.roles)]
    text = lambda p: (p.check or p.using) if part == "check" else p.using
    allow, limit = [p for p in mine if p.permissive], [p for p in mine if not p.permissive]
    true = lambda p: F.coalesce(F.expr(text(p)), F.lit(False))
    return any_of([true(p) for p in allow]) & all_of([true(p) for p in limit])


def row_policy_read(df: DataFrame, policies: list[Policy], role: str, command: str = "select", bypass: bool = False, owner: bool = False, force: bool = False) -> DataFrame:
    """Rows a role may see; without a permissive policy none. Owners bypass unless forced."""
    if bypass or owner and not force:
        return df
    return df.where(_policy_predicate(policies, role, command, "using"))


def row_policy_write(incoming: DataFrame, policies: list[Policy], role: str, command: str = "insert") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by WITH CHECK, which falls back to USING."""
    good = _policy_predicate(policies, role, command, "check")
    return incoming.where(good), incoming.where(~good)


def column_privileges(df: DataFrame, grants: list[tuple[str, tuple[str, ...] | None]], role: str, revoked: list[tuple[str, tuple[str, ...] | None]] = ()) -> DataFrame:
    """The columns that the role may read; a grant or revocation without columns covers the table."""
    allowed: set[str] = set()
    for to, cols in grants:
        if to in (role, "public"):
            allowed |= set(df.columns if cols is None else cols)
    for of, cols in revoked:
        if of in (role, "public"):
            allowed -= set(df.columns if cols is None else cols)
    return df.select(*(c for c in df.columns if c in allowed))


def label_mask(df: DataFrame, labels: dict[str, str], clearance: set[str], hashed: set[str] = frozenset()) -> DataFrame:
    """Columns by tag: cleared tags are kept, hashed ones become a digest, others null."""
    out = {}
    for c, tag in labels.items():
        if tag not in clearance:
            out[c] = F.sha2(F.col(c).cast("string"), 256) if tag in hashed else F.lit(None).cast(df.schema[c].dataType)
    return df.withColumns(out)


def _cast(value: Column, to: T.DataType) -> Column:
    return value.cast(to)


def converted(value: Column, have: T.DataType, want: T.DataType, renames: dict[str, str], path: str, cast=_cast) -> Column:
    """The value as another type: attributes of structs, also inside arrays, go by name and by the renames of their path."""
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType) and have != want:
        return F.transform(value, lambda x: converted(x, have.elementType, want.elementType, renames, path, cast))
    if not (isinstance(have, T.StructType) and isinstance(want, T.StructType)) or have == want:
        return cast(value, want)
    source = attribute_sources(path, have.names, want.names, renames)
    made = []
    for f in want.fields:
        at = source.get(f.name)
        part = F.lit(None).cast(f.dataType) if at is None else converted(value[at], have[at].dataType, f.dataType, renames, f"{path}.{f.name}", cast)
        made.append(part.alias(f.name))
    return F.when(value.isNotNull(), F.struct(*made))


def attribute_sources(path: str, have: list[str], want: list[str], renames: dict[str, str]) -> dict[str, str]:
    """Each wanted attribute's name before; renames are written with the owner's path in front."""
    out = {n: n for n in want if n in have}
    for a, b in renames.items():
        (_, old), (owner, new) = (("", *x.rsplit(".", 1))[-2:] for x in (a, b))
        if owner == path and old in have and old not in want and new in want and new not in have:
            out[new] = old
    return out


def sources(columns: list[str], spec: TableSpec) -> dict[str, str]:
    """Each declared column's name among the given ones; a rename counts where its new name is not there."""
    back = {b: a for a, b in spec.renames.items() if "." not in b and a in columns and b not in columns}
    return {n: back.get(n, n) for n in spec.names() if back.get(n, n) in columns}


def conformed_columns(df: DataFrame, spec: TableSpec, cast=_cast) -> list[Column]:
    """The declared columns but the generated ones, from the columns of df."""
    have, out = sources(df.columns, spec), []
    for c in spec.columns:
        if c.generated:
            continue
        want = T.DataType.fromDDL(c.type)
        if c.using:
            value = cast(F.expr(c.using), want)
        elif c.name in have:
            value = converted(F.col(f"`{have[c.name]}`"), df.schema[have[c.name]].dataType, want, spec.renames, c.name, cast)
        else:
            value = (F.expr(c.default) if c.default else F.lit(None)).cast(want)
        out.append(value.alias(c.name))
    return out


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rename, add, default, convert, generate, drop and order, as one projection; struct attributes go by name."""
    base = df.select(*conformed_columns(df, spec))
    return base.withColumns({c.name: F.expr(c.generated).cast(c.type) for c in spec.columns if c.generated}).select(*spec.names())


def union_conformed(frames: list[DataFrame], spec: TableSpec) -> DataFrame:
    """Rows of differently evolved versions of one table."""
    return union_all([conform(f, spec) for f in frames])


