"""Scans, sources, sinks and versioned snapshots on plain files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablespec.operators.constraints import union_all
from tablespec.operators.integrity import route_partitions
from tablespec.spec import TableSpec


def scan_declared(spark: SparkSession, path: str, spec: TableSpec, fmt: str = "parquet", **options: str) -> DataFrame:
    """Reads only the declared columns under the declared schema."""
    return spark.read.format(fmt).schema(spec.schema()).options(**options).load(path).select(*spec.names())


def scan_foreign(spark: SparkSession, server_opts: dict[str, str], table_opts: dict[str, str], spec: TableSpec | None = None) -> DataFrame:
    """An external table: table options overlay the server's; the option ``format`` names the source.

    For jdbc pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    options = {**server_opts, **table_opts}
    reader = spark.read.format(options.pop("format"))
    if spec:
        reader = reader.schema(spec.schema())
    path = options.pop("path", None)
    reader = reader.options(**options)
    return reader.load(path) if path else reader.load()


def scan_union(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """Several files that contribute rows to one table; file_order is their lexicographic rank."""
    frames = [spark.read.format(fmt).load(p).withColumn("file_order", F.lit(i)) for i, p in enumerate(sorted(paths))]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scan_inherited(parent: DataFrame, children: list[DataFrame], only: bool = False) -> DataFrame:
    """Parent rows and, unless only, child rows cut to the parent's columns."""
    return parent if only else union_all([parent, *(c.select(*parent.columns) for c in children)])


def write_partitioned(df: DataFrame, spec: TableSpec, path: str, mode: str = "errorifexists") -> DataFrame:
    """Writes rows by the declared partition tree; fails if any row has no partition."""
    routed = route_partitions(df, spec.partition_by)
    checked = routed.withColumn("partition", F.coalesce("partition", F.raise_error(F.lit(f"no partition of {spec.name} takes this row"))))
    # adaptive execution splits a hot leaf over several writers and joins small ones
    checked.hint("rebalance", "partition").write.mode(mode).partitionBy("partition").parquet(path)
    return df.sparkSession.read.schema(checked.schema).parquet(path)


def clustered_write(df: DataFrame, keys: list[str], path: str, where: str | None = None, files: int | None = None, mode: str = "errorifexists") -> DataFrame:
    """Range-partitioned and sorted files, so that key filters skip files by their statistics; their
    number follows the rows' bytes, unless given."""
    rows = df.where(where) if where else df
    ranged = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


RANK_BITS, RANK_SAMPLE = 8, 20_000


def _rank(col: str, bounds: list) -> Column:
    """How many of at most 2**RANK_BITS - 1 sorted bounds a value exceeds, by bisection; null is before all."""
    if not bounds:
        return F.lit(0)
    held = F.array(*map(F.lit, bounds))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        beyond = F.col(col) > F.element_at(held, middle + 1)
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.struct(F.when(beyond, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(beyond, acc["hi"]).otherwise(middle).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda acc: acc["lo"])
    return F.when(F.col(col).isNull(), 0).otherwise(found)


def interleaved_rank(df: DataFrame, keys: list[str]) -> Column:
    """A number whose bits are those of each key's rank in turn, highest first: rows near in it are near in every key.

    Ranks are among bounds that split a bounded sample of RANK_SAMPLE rows evenly; they order files and change no result."""
    count = df.count()
    sample = df.select(*keys).sample(min(1.0, RANK_SAMPLE / max(count, 1)), seed=7).limit(2 * RANK_SAMPLE).toPandas() if count else None
    ranks = []
    for k in keys:
        values = sorted(sample[k].dropna().tolist()) if sample is not None else []
        step = max(1, len(values) >> RANK_BITS)
        ranks.append(_rank(k, sorted(set(values[step::step]))[: (1 << RANK_BITS) - 1]))
    out = F.lit(0).cast("long")
    for bit in range(RANK_BITS - 1, -1, -1):
        for r in ranks:
            out = out * 2 + F.shiftright(r, bit).bitwiseAND(F.lit(1))
    return out


def interleaved_write(df: DataFrame, keys: list[str], path: str, files: int | None = None, mode: str = "errorifexists") -> DataFrame:
    """Files along a curve through all keys (up to seven), so that a filter on any of them skips files, not only one on the first."""
    if len(keys) > 7:
        raise ValueError("at most seven keys share a curve")
    placed = df.withColumn("_z", interleaved_rank(df, keys))
    ranged = placed.repartitionByRange(files, "_z") if files else placed.repartitionByRange("_z")
    ranged.sortWithinPartitions("_z", *keys).drop("_z").write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MANIFEST = T.StructType().add("name", "string").add("version", "long").add("rows", "long").add("saved_at", "timestamp").add("revision", "string").add("folder", "string")


def _entries(spark: SparkSession, root: str) -> DataFrame:
    """The manifest rows under a root; without any, an empty frame."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest")


def snapshot_save(df: DataFrame, root: str, name: str, version: int, revision: str = "") -> None:
    """Writes a version's rows to a folder of their own, then its manifest row; readers only see what the
    manifest names, so two writers of one version never touch each other's files."""
    folder = f"{name}/v{version}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    publish_folder(df.sparkSession, root, name, version, folder, df.sparkSession.read.parquet(f"{root}/{folder}").count(), revision)


def publish_folder(spark: SparkSession, root: str, name: str, version: int, folder: str, count: int, revision: str = "") -> None:
    """Names a written folder as a version in the manifest."""
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(version).cast("long").alias("version"), F.lit(count).cast("long").alias("rows"), F.current_timestamp().alias("saved_at"), F.lit(revision).alias("revision"), F.lit(folder).alias("folder"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/_manifest")


def snapshot_versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _entries(spark, root).where(F.col("name") == name)


def snapshot_load(spark: SparkSession, root: str, name: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """A saved version, the latest by default; a missing snapshot reads as empty.

    Where a version was saved twice, the later save counts."""
    found = snapshot_versions(spark, root, name)
    last = (found.where(F.col("version") == version) if version is not None else found).agg(F.max_by("folder", F.struct("version", "saved_at", "folder"))).first()[0]
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{last}")


def changelog_append(plan: DataFrame, path: str, run_id: str) -> DataFrame:
    """Archives an applied change set under its run."""
    plan.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
    return plan.sparkSession.read.parquet(path)


def stream_scan(spark: SparkSession, directory: str, spec: TableSpec | T.StructType, fmt: str = "parquet", max_files: int = 100, event_time: str | None = None) -> DataFrame:
    """A folder as a stream; event_time is cast to timestamp, which watermarks need."""
    schema = spec if isinstance(spec, T.StructType) else spec.schema()
    out = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(directory)
    return out.withColumn(event_time, F.col(event_time).cast("timestamp")) if event_time else out
