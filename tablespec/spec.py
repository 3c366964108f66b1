"""What a table should be: plain dataclasses that the operators read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None  # SQL expression, used where the column is absent
    generated: str | None = None  # SQL expression over other columns
    identity: bool = False
    using: str | None = None  # SQL expression that converts an existing value
    labels: dict[str, str] = field(default_factory=dict)  # provider -> tag


@dataclass(frozen=True)
class Check:
    name: str
    expr: str
    no_inherit: bool = False


@dataclass(frozen=True)
class Unique:
    name: str
    columns: tuple[str, ...]
    primary: bool = False
    nulls_distinct: bool = True
    where: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    parent: str
    ref_columns: tuple[str, ...]
    match: str = "simple"  # simple, full or partial


@dataclass(frozen=True)
class Domain:
    """A base type with a default, not-null flag and checks written over VALUE."""

    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    checks: tuple[Check, ...] = ()


@dataclass(frozen=True)
class Sequence:
    """What numbers a column takes by default."""

    type: str = "bigint"
    start: int = 1
    increment: int = 1
    low: int = 1
    high: int = 2**62
    cycle: bool = False


@dataclass(frozen=True)
class Partition:
    """One branch of a partition tree; leaves have no children."""

    name: str
    values: tuple = ()  # list strategy
    lower: tuple | None = None  # range strategy, inclusive; None is MINVALUE
    upper: tuple | None = None  # exclusive; None is MAXVALUE
    remainder: int | None = None  # hash strategy
    default: bool = False
    by: PartitionBy | None = None


@dataclass(frozen=True)
class PartitionBy:
    strategy: str  # range, list or hash
    columns: tuple[str, ...]
    parts: tuple[Partition, ...]
    modulus: int = 0
    hash: str = "xxhash64"  # or md5, which other engines have too


@dataclass(frozen=True)
class Policy:
    """A row policy; permissive ones are OR-ed, restrictive ones AND-ed."""

    name: str
    using: str
    check: str | None = None
    command: str = "all"
    roles: tuple[str, ...] = ("public",)
    permissive: bool = True


@dataclass(frozen=True)
class Publication:
    name: str
    tables: tuple[str, ...] = ()  # empty: all tables
    where: str | None = None
    columns: tuple[str, ...] = ()  # empty: all columns
    actions: tuple[str, ...] = ("insert", "update", "delete", "truncate")


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[Column, ...]
    uniques: tuple[Unique, ...] = ()
    checks: tuple[Check, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    domains: dict[str, Domain] = field(default_factory=dict)  # column -> domain
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)  # column -> ordered labels
    renames: dict[str, str] = field(default_factory=dict)  # old -> new
    partition_by: PartitionBy | None = None
    sequences: dict[str, Sequence] = field(default_factory=dict)  # column -> sequence
    query: str | None = None  # of a view
    stored: bool = False  # whether a view's rows are stored

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def schema(self) -> T.StructType:
        """The declared Spark schema, with not-null flags and labels as metadata."""
        out = T.StructType()
        for c in self.columns:
            out.add(c.name, T.DataType.fromDDL(c.type), c.nullable, {"labels": dict(c.labels)} if c.labels else None)
        return out
