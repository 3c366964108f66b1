"""Jobs over tables: planning changes with evidence, retiring labels, applying plans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column as SqlColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablespec.functions import types as X
from tablespec.operators.constraints import any_of, check_passes, check_rules, enum_rules, fk_report, row_rules, union_all, unique_report
from tablespec.operators.integrity import route_partitions
from tablespec.operators.project import attribute_sources, conformed_columns, sources
from tablespec.spec import Check, Domain, PartitionBy, Sequence, TableSpec, Unique

PLAN = "seq int, op string, column_name string, old_def string, new_def string, static_class string, evidence_rows bigint, safety string"


def _inner(kind: T.DataType) -> tuple[int, T.StructType | None]:
    """How many arrays lie around a type, and the struct inside, None for other types."""
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    return depth, kind if isinstance(kind, T.StructType) else None


def _attributes(path: str, old: T.DataType, new: T.DataType, renames: dict[str, str]) -> list[tuple]:
    """Changes of the attributes of a struct, or of the structs of an array, and of those inside them."""
    out, (_, mine), (_, theirs) = [], _inner(old), _inner(new)
    source = attribute_sources(path, mine.names, theirs.names, renames)
    out += [("rename attribute", f"{path}.{n}", a, n, "SAFE") for n, a in source.items() if n != a]
    out += [("drop attribute", f"{path}.{n}", mine[n].dataType.simpleString(), "", "DESTRUCTIVE") for n in mine.names if n not in source.values()]
    for f in theirs.fields:
        if f.name not in source:
            out.append(("add attribute", f"{path}.{f.name}", "", f.dataType.simpleString(), "SAFE"))
        elif (before := mine[source[f.name]].dataType) != f.dataType:
            if _comparable(before, f.dataType):
                out += _attributes(f"{path}.{f.name}", before, f.dataType, renames)
            else:
                out.append(("change attribute", f"{path}.{f.name}", before.simpleString(), f.dataType.simpleString(), "DESTRUCTIVE"))
    return out


def _comparable(old: T.DataType, new: T.DataType) -> bool:
    (depth, mine), (deep, theirs) = _inner(old), _inner(new)
    return mine is not None and theirs is not None and depth == deep


def _domain(column: str, old: Domain | None, new: Domain | None) -> list[tuple]:
    if new is None or old is None:
        return [("drop domain", column, old.name, "", "SAFE")] if old else [("add domain", column, "", new.name, "CAUTION")]
    if old.type != new.type:
        return [("change domain type", column, old.type, new.type, "DESTRUCTIVE")]
    out = []
    if old.default != new.default:
        out.append(("set domain default" if new.default else "drop domain default", column, old.default or "", new.default or "", "SAFE"))
    if old.nullable != new.nullable:
        out.append(("drop domain not null" if new.nullable else "set domain not null", column, "", "", "SAFE" if new.nullable else "CAUTION"))
    mine, theirs = ({c.name: c.expr for c in d.checks} for d in (old, new))
    out += [("drop domain check", column, n, "", "SAFE") for n in mine if theirs.get(n) != mine[n]]
    return out + [("add domain check", column, "", n, "CAUTION") for n in theirs if mine.get(n) != theirs[n]]


def _partitions(old: PartitionBy | None, new: PartitionBy | None, prefix: str = "") -> list[tuple]:
    """Changes of a partition tree; a branch that goes or moves its bounds takes its rows along."""
    name = prefix.rstrip("/")
    key = lambda by: f"{by.strategy} ({', '.join(by.columns)})" + (f" modulus {by.modulus}" if by.strategy == "hash" else "") if by else ""
    if key(old) != key(new):
        return [("change partition strategy", name, key(old), key(new), "MANUAL")]
    if old is None:
        return []
    bounds = lambda p: "default" if p.default else f"values {p.values}" if p.values else f"remainder {p.remainder}" if p.remainder is not None else f"from {p.lower} to {p.upper}"
    mine, theirs, out = {p.name: p for p in old.parts}, {p.name: p for p in new.parts}, []
    for n, p in theirs.items():
        if n not in mine:
            out.append(("add partition", prefix + n, "", bounds(p), "SAFE"))
        elif bounds(mine[n]) != bounds(p):
            out.append(("change partition bounds", prefix + n, bounds(mine[n]), bounds(p), "DESTRUCTIVE"))
        else:
            out += _partitions(mine[n].by, p.by, f"{prefix}{n}/")
    return out + [("drop partition", prefix + n, bounds(p), "", "DESTRUCTIVE") for n, p in mine.items() if n not in theirs]


def _sequence(column: str, old: Sequence | None, new: Sequence | None) -> list[tuple]:
    if new is None or old is None:
        return [("drop sequence", column, "", "", "DESTRUCTIVE")] if old else [("add sequence", column, "", "", "SAFE")]
    if old.type != new.type:
        return [("change sequence type", column, old.type, new.type, "DESTRUCTIVE")]
    return [("alter sequence", column, "", "", "SAFE")] if old != new else []


def _cast_class(old: str, new: str, using: str | None) -> str:
    return "CAUTION" if using or X.is_lossless(old, new) or X.is_widening(old, new) else "DESTRUCTIVE"


def static_plan(old: TableSpec, new: TableSpec) -> list[tuple]:
    """(op, column, old definition, new definition, class) of every change, renames first."""
    out, before, after = [], {c.name: c for c in old.columns}, {c.name: c for c in new.columns}
    for a, b in new.renames.items():
        if "." not in b and b not in before and a in before:
            before[b] = before.pop(a)
            out.append(("rename column", b, a, b, "CAUTION"))
    out += [("drop column", n, c.type, "", "DESTRUCTIVE") for n, c in before.items() if n not in after]
    for n, c in after.items():
        b = before.get(n)
        if b is None:
            filled = c.nullable or c.default or c.identity or c.generated
            out.append(("add column", n, "", c.type, "SAFE" if filled else "CAUTION"))
            continue
        if b.type != c.type and not c.using and _comparable(mine := T.DataType.fromDDL(b.type), theirs := T.DataType.fromDDL(c.type)):
            out += _attributes(n, mine, theirs, new.renames)
        elif b.type != c.type:
            out.append(("change type", n, b.type, c.type, _cast_class(b.type, c.type, c.using)))
        if b.nullable != c.nullable:
            out.append(("drop not null" if c.nullable else "set not null", n, "", "", "SAFE" if c.nullable else "CAUTION"))
        if b.default != c.default:
            out.append(("set default" if c.default else "drop default", n, b.default or "", c.default or "", "SAFE"))
        if b.generated != c.generated:  # a new expression replaces what is stored; without one the values stay
            out.append(("set generated" if c.generated else "drop generated", n, b.generated or "", c.generated or "", "DESTRUCTIVE" if c.generated else "CAUTION"))
        if b.identity != c.identity:
            out.append(("add identity" if c.identity else "drop identity", n, "", "", "CAUTION"))
    for kind in ("checks", "uniques", "foreign_keys"):
        mine, theirs = ({x.name: x for x in getattr(s, kind)} for s in (old, new))
        out += [("drop constraint", n, n, "", "DESTRUCTIVE") for n in mine if theirs.get(n) != mine[n]]
        out += [("add constraint", n, "", n, "CAUTION") for n in theirs if mine.get(n) != theirs[n]]
    for col in {**old.enums, **new.enums}:
        a, b = old.enums.get(col, ()), new.enums.get(col, ())
        out += [("add label", col, "", x, "MANUAL") for x in b if a and x not in a]
        out += [("remove label", col, x, "", "DESTRUCTIVE") for x in a if b and x not in b]
        if sorted(a) == sorted(b) and a != b:
            out.append(("reorder labels", col, ",".join(a), ",".join(b), "DESTRUCTIVE"))
    for kind, changes in ((("domains", _domain), ("sequences", _sequence))):
        mine, theirs = getattr(old, kind), getattr(new, kind)
        for col in {**mine, **theirs}:
            if mine.get(col) != theirs.get(col):
                out += changes(col, mine.get(col), theirs.get(col))
    out += _partitions(old.partition_by, new.partition_by)
    if old.query != new.query or old.stored != new.stored:
        stored = old.stored or new.stored
        out.append(("change stored query" if stored else "replace query", new.name, old.query or "", new.query or "", "DESTRUCTIVE" if stored else "SAFE"))
    return out


def plan_table(df: DataFrame, old: TableSpec, new: TableSpec, parents: dict[str, DataFrame] = {}) -> DataFrame:  # noqa: B006
    """seq, op, column_name, old_def, new_def, static_class, evidence_rows and safety of each change.

    What goes is counted on the rows as they are; what is demanded (checks, not null, domains,
    generated values) on their projection to the new spec, where values that do not convert are
    null. Both are one pass over the data. New unique keys count the rows beyond a key's first (for
    a primary key those with nulls too), new foreign keys the rows without a parent in ``parents``
    (by table name; the table itself is its own parent as projected), each as a keyed stage beside
    the pass; a parent that is not given leaves evidence_rows null. A destructive cast that hurts no
    row is lowered to CAUTION; a rule that rows break stays CAUTION with its count. Equal specs give
    no rows, and the data is not read."""
    plan = static_plan(old, new)
    if not plan:
        return df.sparkSession.createDataFrame([], PLAN)
    if old.partition_by and any("partition" in p[0] for p in plan):
        df = route_partitions(df, old.partition_by, "_leaf")
    after = _projected(df, new)
    place = sources([c for c in df.columns if c != _OLD], new)
    was = lambda n: F.col(f"{_OLD}.`{place.get(n, n)}`")
    held = lambda n: place.get(n, n) in df.columns
    is_list = lambda n: df.schema[place.get(n, n)].dataType.typeName() == "array"
    count, keyed = {}, {}
    rules = {c.name: c for kind in (new.checks, new.uniques, new.foreign_keys) for c in kind}
    for i, (op, name, a, b, _) in enumerate(plan):
        if op == "drop column" and name in df.columns:
            count[i] = F.count(F.col(f"{_OLD}.`{name}`"))
        elif op == "change type" and held(name):
            have = df.schema[place[name]].dataType
            using = new.column(name).using
            # an expression is over the columns before
            value = was(name) if not using else F.col(f"{_USING}.`{name}`")
            if not _castable(after, value, b):
                count[i] = F.count(was(name))
                continue
            cast = value.try_cast(b)
            unlike = F.lit(False) if using else ~cast.try_cast(have).eqNullSafe(value)
            count[i] = F.count_if(value.isNotNull() & (cast.isNull() | unlike))
        elif op in ("set not null", "set domain not null") and name in after.columns:
            count[i] = F.count_if(F.col(f"`{name}`").isNull())
        elif op == "add constraint" and isinstance(rules[name], Check):
            count[i] = F.count_if(check_rules((rules[name],))[0][2])
        elif op == "add constraint" and isinstance(rules[name], Unique):
            keyed[i] = unique_report(after, new.name, rules[name])
        elif op == "add constraint":
            parent = parents.get(rules[name].parent, after if rules[name].parent == new.name else None)
            keyed[i] = None if parent is None else fk_report(after, parent, new.name, rules[name])
        elif op == "remove label" and held(name):
            count[i] = F.count_if(F.array_contains(was(name), a) if is_list(name) else was(name) == a)
        elif op in ("drop attribute", "change attribute"):
            count[i] = F.count_if(_loses(df, old, new, name, b if op == "change attribute" else None))
        elif op in ("add domain", "add domain check") and name in after.columns:
            domain = new.domains[name]
            tests = [check_passes(c.expr.replace("VALUE", f"`{name}`")) for c in domain.checks if op == "add domain" or c.name == b]
            count[i] = F.count_if(any_of([~t for t in tests] + ([F.col(f"`{name}`").isNull()] if op == "add domain" and not domain.nullable else [])))
        elif op == "change domain type" and held(name):
            count[i] = F.count_if(was(name).isNotNull() & was(name).try_cast(b).isNull()) if _castable(after, was(name), b) else F.count(was(name))
        elif op == "set generated" and held(name):
            count[i] = F.count_if(~was(name).try_cast(new.column(name).type).eqNullSafe(F.col(f"`{name}`")))
        elif op in ("drop partition", "change partition bounds"):
            count[i] = F.count_if((was("_leaf") == name) | F.startswith(was("_leaf"), F.lit(f"{name}/")))
        elif op == "change partition strategy" and old.partition_by:
            count[i] = F.count_if((was("_leaf") == name) | F.startswith(was("_leaf"), F.lit(f"{name}/"))) if name else F.count("*")
    one = after.agg(F.count("*").alias("_all"), *(c.alias(f"_{i}") for i, c in count.items()))
    known = lambda i: F.col(f"_{i}") if i in count else F.lit(None if i in keyed else 0).cast("long")
    rows = [F.struct(F.lit(i + 1).alias("seq"), *(F.lit(v).alias(n) for n, v in zip(("op", "column_name", "old_def", "new_def", "static_class"), p)), known(i).alias("evidence_rows")) for i, p in enumerate(plan)]
    out = one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    if stages := [f.select(F.lit(i + 1).alias("seq"), "violations") for i, f in keyed.items() if f is not None]:
        out = out.join(union_all(stages), "seq", "left").withColumn("evidence_rows", F.coalesce("violations", "evidence_rows")).drop("violations")
    lowered = (F.col("static_class") == "DESTRUCTIVE") & (F.col("op") == "change type") & (F.col("evidence_rows") == 0)
    return out.withColumn("safety", F.when(lowered, "CAUTION").otherwise(F.col("static_class")))


_OLD, _USING = "_old", "_using"


def _projected(df: DataFrame, new: TableSpec) -> DataFrame:
    """The rows as the new spec has them, with the columns before in one struct and the values of using-expressions in
    another; columns that no spec declares stay."""

    def cast(value: SqlColumn, to: T.DataType) -> SqlColumn:
        return value.try_cast(to) if _castable(df, value, to) else F.lit(None).cast(to)

    declared = conformed_columns(df, new, cast)
    gone = set(sources(df.columns, new).values()) | set(new.names())
    used = [F.expr(c.using).alias(c.name) for c in new.columns if c.using]
    base = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(_OLD), F.struct(*used or [F.lit(0)]).alias(_USING), *declared, *(F.col(f"`{c}`") for c in df.columns if c not in gone))
    # a generated column may read others in any order of declaration, but not generated ones
    return base.withColumns({c.name: F.expr(c.generated).try_cast(c.type) for c in new.columns if c.generated})


def _loses(df: DataFrame, old: TableSpec, new: TableSpec, path: str, to: str | None) -> SqlColumn:
    """Whether a row holds a value at the path of an attribute that goes, or that does not convert; names on the way are new ones."""
    column, *names = path.split(".")
    place = sources(df.columns, new)[column]

    def at(value: SqlColumn, have: T.DataType, owner: str, names: list[str]) -> SqlColumn:
        if isinstance(have, T.ArrayType):
            return F.coalesce(F.exists(value, lambda x: at(x, have.elementType, owner, names)), F.lit(False))
        if names:
            back = {b.rsplit(".", 1)[1]: a.rsplit(".", 1)[1] for a, b in new.renames.items() if "." in a and "." in b and b.rsplit(".", 1)[0] == owner}
            name = names[0] if names[0] in have.names else back[names[0]]
            return at(value[name], have[name].dataType, f"{owner}.{names[0]}", names[1:])
        fits = value.try_cast(to).isNotNull() if to and _casts(df, have, to) else F.lit(False)
        return value.isNotNull() & ~fits

    return at(F.col(f"{_OLD}.`{place}`"), df.schema[place].dataType, column, names)


def _casts(df: DataFrame, have: T.DataType, to: str) -> bool:
    return _castable(df, F.lit(None).cast(have), to)


def _castable(df: DataFrame, value: SqlColumn, to: str | T.DataType) -> bool:
    try:
        df.select(value.try_cast(to))
    except AnalysisException:
        return False
    return True


def blocked(plan: DataFrame, allow_destructive: bool = False, allow_manual: bool = False) -> DataFrame:
    """Changes that a gate stops."""
    return plan.where(any_of([(F.col("safety") == "DESTRUCTIVE") & (not allow_destructive), (F.col("safety") == "MANUAL") & (not allow_manual)]))


def retire_enum_values(tables: dict[str, tuple[DataFrame, str]], labels: tuple[str, ...], mapping: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(converted tables, residue per table). Every retired label must be mapped into the new ones;
    the caller applies the tables only if every residue is zero."""
    out, report = {}, []
    for name, (df, col) in tables.items():
        out[name] = X.enum_remap(df, [col], mapping)
        report.append(row_rules(out[name], name, enum_rules(out[name], {col: labels})))
    return out, union_all(report)
