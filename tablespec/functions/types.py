"""Type changes with evidence: what a conversion would lose, counted from the rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablespec.operators.constraints import union_all

AUDIT = ["column_name", "from_type", "to_type", "rows", "cast_failures", "truncated", "rounded", "overflowed"]

#: fixed values: conversions that lose nothing, beside integers to decimals that are wide enough
LOSSLESS = {
    ("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("tinyint", "float"), ("tinyint", "real"), ("tinyint", "double"),
    ("smallint", "int"), ("smallint", "bigint"), ("smallint", "float"), ("smallint", "real"), ("smallint", "double"),
    ("int", "bigint"), ("int", "double"), ("float", "double"), ("real", "double"),
    ("date", "timestamp"), ("date", "timestamp_ntz"), ("timestamp_ntz", "timestamp"), ("varchar", "string"), ("char", "string"), ("string", "varchar"),
}


#: fixed values: decimal digits that hold every value of an integer type, and the decimal without modifiers
INTEGER_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
PLAIN_DECIMAL = (10, 0)


@dataclass(frozen=True)
class TypeMod:
    base: str
    args: tuple[int, ...]
    array: bool = False


def parse_type(text: str) -> TypeMod:
    """The base name, the modifiers and whether it is an array."""
    m = re.fullmatch(r"\s*([a-z_ ]+?)\s*(?:\(([\d, ]+)\))?\s*((?:\[\])*)\s*", text.lower())
    if not m:
        try:
            kind = T.DataType.fromDDL(text)
        except (ParseException, AnalysisException) as e:
            raise ValueError(f"not a type: {text}") from e
        return TypeMod(kind.simpleString(), (), isinstance(kind, T.ArrayType))
    return TypeMod(m[1], tuple(int(x) for x in m[2].split(",")) if m[2] else (), bool(m[3]))


def is_widening(old: str, new: str) -> bool:
    """Whether a change of modifiers of one base type can never lose a value."""
    a, b = parse_type(old), parse_type(new)
    if a.base != b.base or a.array or b.array or a == b:
        return False
    if a.base in ("varchar", "varbit"):
        return bool(a.args) and (not b.args or b.args[0] > a.args[0])
    if a.base == "char":
        return bool(a.args and b.args) and b.args[0] > a.args[0]
    if a.base in ("numeric", "decimal"):
        if not a.args or not b.args:
            return bool(a.args)
        (p1, s1), (p2, s2) = ((*x.args, 0)[:2] for x in (a, b))
        return p2 >= p1 and s2 >= s1 and p2 - s2 >= p1 - s1
    if a.base in ("time", "timestamp", "timestamptz", "interval"):
        return bool(a.args) and (not b.args or b.args[0] > a.args[0])
    return False


def is_lossless(old: str, new: str) -> bool:
    a, b = parse_type(old), parse_type(new)
    if a == b:
        return True
    if a.array or b.array:
        return False
    if a.base in INTEGER_DIGITS and b.base in ("decimal", "numeric"):
        precision, scale = (*(b.args or PLAIN_DECIMAL), 0)[:2]
        return precision - scale >= INTEGER_DIGITS[a.base]
    return is_widening(old, new) or (a.base, b.base) in LOSSLESS and not b.args


def _audit_row(df: DataFrame, col: str, old: str, new: str, **bad: Column) -> DataFrame:
    counts = {k: F.count_if(F.coalesce(v, F.lit(False))) for k, v in bad.items()}
    kinds = ["cast_failures", "truncated", "rounded", "overflowed"]
    return df.agg(F.count("*").alias("rows"), *(counts.get(k, F.lit(0).cast("long")).alias(k) for k in kinds)).select(F.lit(col).alias("column_name"), F.lit(old).alias("from_type"), F.lit(new).alias("to_type"), "rows", *kinds)


def cast_audit(df: DataFrame, col: str, to: str) -> DataFrame:
    """Counts of values that would fail, be truncated, rounded or overflow under a new type.

    Lossless pairs are not scanned for losses. A failing text is a cast failure; a failing number
    is an overflow. Rounding is half up; truncation is a lost time of day."""
    old = df.schema[col].dataType.simpleString()
    if is_lossless(old, to):
        return _audit_row(df, col, old, to)
    value, new = F.col(col), F.col(col).try_cast(to)
    failed = value.isNotNull() & new.isNull()
    if old == "string":
        return _audit_row(df, col, old, to, cast_failures=failed)
    if old.startswith("timestamp") or old == "date":
        return _audit_row(df, col, old, to, cast_failures=failed, truncated=~failed & (new.cast(old) != value))
    target = parse_type(to).base
    if old in ("float", "double", "decimal") or old.startswith("decimal"):
        if target in ("tinyint", "smallint", "int", "bigint"):
            whole = F.round(value)
            fits = whole.try_cast(to).isNotNull()
            return _audit_row(df, col, old, to, overflowed=value.isNotNull() & ~fits, rounded=fits & (whole != value))
        return _audit_row(df, col, old, to, overflowed=failed, rounded=~failed & (new.cast(old) != value))
    return _audit_row(df, col, old, to, overflowed=failed, rounded=~failed & (new.try_cast(old) != value))


def typmod_audit(df: DataFrame, col: str, old: str, new: str) -> DataFrame:
    """Rows hurt by narrower modifiers: text length, decimal digits, fractional seconds.

    Widenings are not scanned; fixed bit strings must keep their length; arrays count element rows."""
    a, b = parse_type(old), parse_type(new)
    if is_widening(old, new) or a == b:
        return _audit_row(df, col, old, new)
    value = F.col(col)
    bad: dict[str, Column] = {}
    if b.base in ("varchar", "char", "varbit") and b.args:
        bad["truncated"] = F.exists(value, lambda x: F.length(x) > b.args[0]) if b.array else F.length(value) > b.args[0]
    elif b.base == "bit":
        bad["truncated"] = F.length(value) != (b.args or (1,))[0]
    elif b.base in ("numeric", "decimal") and b.args:
        p, s = (*b.args, 0)[:2]
        exact = value if isinstance(df.schema[col].dataType, T.DecimalType) else value.try_cast("decimal(38,12)")
        kept = exact.try_cast(f"decimal({p},{s})")
        bad = {"overflowed": value.isNotNull() & kept.isNull(), "rounded": kept.isNotNull() & (kept != exact)}
    elif b.base in ("time", "timestamp", "timestamptz") and b.args:
        bad["truncated"] = F.pmod(F.unix_micros(value.cast("timestamp")), F.lit(10 ** max(0, 6 - b.args[0]))) != 0
    return _audit_row(df, col, old, new, **bad)


def array_cast(df: DataFrame, col: str, elem_type: str) -> DataFrame:
    """The column cast element by element, with the elements that fail."""
    failing = F.filter(F.col(col), lambda x: x.isNotNull() & x.try_cast(elem_type).isNull())
    return df.withColumns({"failing": failing, col: F.transform(F.col(col), lambda x: x.try_cast(elem_type))})


def array_cast_audit(df: DataFrame, col: str, elem_type: str) -> DataFrame:
    old = df.schema[col].dataType.simpleString()
    return _audit_row(df, col, old, f"array<{elem_type}>", cast_failures=F.exists(col, lambda x: x.isNotNull() & x.try_cast(elem_type).isNull()))


def evolve_struct(df: DataFrame, col: str, add: dict[str, str] = {}, drop: tuple[str, ...] = (), rename: dict[str, str] = {}, retype: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Attributes added (by SQL expression over the struct's table), dropped, renamed and retyped.

    A rename whose new name exists is a no-op; neither name present is an error."""
    fields = [f.name for f in df.schema[col].dataType.fields]
    todo = {}
    for old, new in rename.items():
        if old in fields and new not in fields:
            todo[old] = new
        elif new not in fields:
            raise ValueError(f"neither {old} nor {new} in {col}")
    out = []
    for f in fields:
        if f in drop:
            continue
        value = F.col(f"{col}.{f}")
        out.append((value.try_cast(retype[f]) if f in retype else value).alias(todo.get(f, f)))
    out += [F.expr(e).alias(n) for n, e in add.items() if n not in fields]
    return df.withColumn(col, F.when(F.col(col).isNotNull(), F.struct(*out)))


def enum_remap(df: DataFrame, cols: list[str], mapping: dict[str, str]) -> DataFrame:
    """Retired labels rewritten in every given column; other values stay."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return df.withColumns({c: F.coalesce(F.try_element_at(table, F.col(c)), F.col(c)) for c in cols})


def audits(df: DataFrame, changes: list[tuple[str, str]]) -> DataFrame:
    return union_all([cast_audit(df, c, to) for c, to in changes]).select(*AUDIT)
