"""A keyed table as a base and the changes since: writing costs what a batch changes, reading merges.

A version is written as a delta, the last change of each key in it (rows with ``_op``
upsert or delete, and whether the table was emptied before). A reader takes the last
change of each key from the deltas after a base, and the base's rows of other keys. Eight
neighbouring deltas of the same number of versions become one, so a change is rewritten
once for each power of eight; once the deltas together outgrow a share of their base, the
next version is written as a base of its own. What the manifest names never changes, so a
version that was read once reads the same until ``expire`` drops it, and a version that is
saved twice counts once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablespec.operators.constraints import all_of, union_all

FAN = 8
BASE_SHARE = 0.5  # of a base's bytes that deltas may reach before a new base is written

_ENTRIES = "name string, since long, version long, versions long, emptied boolean, bytes long, folder string, saved_at timestamp"


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    root: str
    name: str
    schema: T.StructType
    keys: tuple[str, ...]

    @property
    def delta_schema(self) -> T.StructType:
        return T.StructType(list(self.schema.fields)).add("_op", "string")


def _hadoop(t: KeyedTable, path: str):
    at = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()), at


def _entries(t: KeyedTable) -> list:
    """The manifest's rows of this table, bases (since is null) and deltas, the first of each kind and range."""
    fs, at = _hadoop(t, f"{t.root}/_keyed")
    if not fs.exists(at):
        return []
    rows = t.spark.read.schema(_ENTRIES).parquet(f"{t.root}/_keyed").where(F.col("name") == t.name).orderBy("saved_at", "folder").collect()
    gone = {r.folder for r in rows if r.bytes < 0}
    return list({(r.since, r.version): r for r in reversed(rows) if r.folder not in gone}.values())


def _bytes(t: KeyedTable, folder: str) -> int:
    fs, at = _hadoop(t, f"{t.root}/{folder}")
    return fs.getContentSummary(at).getLength()


def _save(t: KeyedTable, rows: DataFrame, kind: str, since: int | None, version: int, versions: int, emptied: bool) -> None:
    folder = f"{t.name}/{kind}-v{version}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{t.root}/{folder}")
    entry = t.spark.range(1).select(
        F.lit(t.name).alias("name"), F.lit(since).cast("long").alias("since"), F.lit(version).cast("long").alias("version"), F.lit(versions).cast("long").alias("versions"),
        F.lit(emptied).alias("emptied"), F.lit(_bytes(t, folder)).cast("long").alias("bytes"), F.lit(folder).alias("folder"), F.current_timestamp().alias("saved_at"),
    )
    entry.coalesce(1).write.mode("append").parquet(f"{t.root}/_keyed")


def save_base(t: KeyedTable, rows: DataFrame, version: int) -> None:
    _save(t, rows.select(*t.schema.names), "base", None, version, 0, False)


def versions(t: KeyedTable) -> list[int]:
    return sorted({r.version for r in _entries(t)})


def _cover(found: list, version: int | None) -> tuple[object | None, list]:
    """The base and the deltas that make a version, in order; a delta after which the table was empty makes older ones void."""
    bases = [r for r in found if r.since is None and (version is None or r.version <= version)]
    base = max(bases, key=lambda r: r.version, default=None)
    at, chain = base.version if base else min((r.since for r in found if r.since is not None), default=0), []
    while step := max((r for r in found if r.since == at and (version is None or r.version <= version)), key=lambda r: r.version, default=None):
        chain.append(step)
        at = step.version
    if any(r.emptied for r in chain):
        last = max(i for i, r in enumerate(chain) if r.emptied)
        return None, chain[last:]
    return base, chain


def _last_changes(t: KeyedTable, chain: list) -> DataFrame:
    """The last change of each key in these deltas, as delta rows; a null key is a key."""
    rows = union_all([t.spark.read.schema(t.delta_schema).parquet(f"{t.root}/{r.folder}").withColumn("_v", F.lit(r.version)) for r in chain])
    if len(chain) == 1:
        return rows.drop("_v")
    last = rows.groupBy(*t.keys).agg(F.max_by(F.struct(*t.delta_schema.names), "_v").alias("_last"))
    return last.select("_last.*")


def same_key(keys: tuple[str, ...] | list[str], other: str):
    return all_of([F.col(k).eqNullSafe(F.col(f"{other}{i}")) for i, k in enumerate(keys)])


def renamed_keys(df: DataFrame, keys: tuple[str, ...] | list[str], prefix: str) -> DataFrame:
    return df.select(*(F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)))


def load(t: KeyedTable, version: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """The rows of a version, the latest by default; a table without versions is empty. ``among`` limits
    them to the keys of a frame before anything is merged."""
    base, chain = _cover(_entries(t), version)
    parts = []
    limited = lambda df: df if among is None else df.join(renamed_keys(among, t.keys, "_a").distinct(), same_key(t.keys, "_a"), "left_semi")
    last = limited(_last_changes(t, chain)) if chain else None
    if base is not None:
        rows = limited(t.spark.read.schema(t.schema).parquet(f"{t.root}/{base.folder}"))
        parts.append(rows if last is None else rows.join(renamed_keys(last, t.keys, "_h"), same_key(t.keys, "_h"), "left_anti"))
    if last is not None:
        parts.append(last.where("_op <> 'delete'").select(*t.schema.names))
    return union_all(parts) if parts else t.spark.createDataFrame([], t.schema)


def save_changes(t: KeyedTable, last: DataFrame, emptied: bool, version: int) -> None:
    """Writes a version by the last changes of its keys: columns of the table and ``op``; a version that is there stays."""
    found = _entries(t)
    if any(r.version == version for r in found):
        return
    since = max((r.version for r in found), default=version - 1)
    rows = last.select(*t.schema.names, F.when(F.col("op") == "delete", "delete").otherwise("upsert").alias("_op"))
    _save(t, rows, "delta", since, version, 1, emptied)
    compact(t)


def delta(t: KeyedTable, version: int) -> tuple[DataFrame, bool]:
    """(the rows of the delta that a version was first written as, whether it emptied the table)."""
    entry = next(r for r in _entries(t) if r.version == version and r.versions == 1)
    return t.spark.read.schema(t.delta_schema).parquet(f"{t.root}/{entry.folder}"), entry.emptied


def compact(t: KeyedTable) -> None:
    """Joins the last deltas while FAN of them hold the same number of versions, and writes a new base when they outgrow theirs."""
    while True:
        base, chain = _cover(_entries(t), None)
        run = chain[-FAN:]
        if len(run) < FAN or len({r.versions for r in run}) > 1:
            break
        _save(t, _last_changes(t, run[next((i for i in range(FAN - 1, -1, -1) if run[i].emptied), 0) :]), "delta", run[0].since, run[-1].version, sum(r.versions for r in run), any(r.emptied for r in run))
    if chain and sum(r.bytes for r in chain) > BASE_SHARE * (base.bytes if base else 0) and (base is not None or len(chain) > 1 or chain[0].emptied):
        save_base(t, load(t), chain[-1].version)


def expire(t: KeyedTable, keep_from: int) -> int:
    """Deletes the folders that no version from ``keep_from`` on needs, and forgets them; returns how many."""
    found = _entries(t)
    needed = set()
    for v in {r.version for r in found if r.version >= keep_from}:
        base, chain = _cover(found, v)
        needed |= {r.folder for r in [base, *chain] if r is not None}
    gone = [r for r in found if r.folder not in needed]
    if gone:
        # forgotten first, so that a reader never meets a name without its folder
        t.spark.createDataFrame([(*r[:5], -1, *r[6:]) for r in gone], _ENTRIES).coalesce(1).write.mode("append").parquet(f"{t.root}/_keyed")
    for r in gone:
        fs, at = _hadoop(t, f"{t.root}/{r.folder}")
        fs.delete(at, True)
    return len(gone)
