"""Where operators put tables that cut lineage: the folder named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow batch size to this many rows, so that batches of long texts stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def written(df: DataFrame, shuffles_go: bool = False) -> DataFrame:
    """The same rows, read back from Parquet files in the shared folder; shuffles_go deletes the shuffle files of the write."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    try:
        if shuffles_go:
            spark.conf.set(name, "true")
        df.write.parquet(path)
    finally:
        if shuffles_go:
            spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-llm"


def drop_written(spark: SparkSession) -> None:
    """Deletes all that this application has written; call it once its results are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def count_floor(counts: DataFrame, col: str, most: int) -> int:
    """A count that at most this many rows have or exceed, from a histogram of the counts in steps of a sixteenth of a power
    of two; if the highest step alone holds more rows, the least such count. One above all counts if no row may stay."""
    by_count = counts.groupBy(col).agg(F.count("*").alias("_rows")).select(F.col(col).alias("c"), "_rows")

    def steps(rows: DataFrame, step) -> list:
        return rows.groupBy(step.alias("step")).agg(F.min("c").alias("low"), F.max("c").alias("high"), F.sum("_rows").alias("n")).orderBy(F.desc("step")).collect()

    def taken(found: list) -> tuple[int | None, object]:
        """The least count of the steps that fit, and the one that doesn't."""
        floor, held = None, 0
        for r in found:
            held += r.n
            if held > most:
                return floor, r
            floor = r.low
        return floor, None

    floor, over = taken(steps(by_count, F.ceil(F.log2("c") * 16)))
    while floor is None and over is not None:
        if over.low == over.high:
            return over.high + 1
        width = -(-(over.high - over.low + 1) // 1024)
        floor, inner = taken(steps(by_count.where(F.col("c").between(over.low, over.high)), F.floor((F.col("c") - over.low) / width)))
        over = inner
    return floor if floor is not None else 0


def crc_fold(col: str, folds: int):
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
