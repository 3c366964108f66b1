"""Folders for what jobs write: under spark.checkpoint.dir, which a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # the folder of an application in local mode


def _root(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def work_dir(spark: SparkSession) -> str:
    """A new folder's path under this application's own folder; a temporary folder of this machine only in local mode."""
    return f"{_root(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def drop_written(spark: SparkSession) -> None:
    """Deletes all that this application has written into work folders; call it once its results are stored elsewhere."""
    jvm, conf, app = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext.applicationId
    for root in {_root(spark), *(r for a, r in _LOCAL.items() if a == app)}:
        fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
        for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{app}*")) or []:
            fs.delete(found.getPath(), True)


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from files, without their lineage."""
    path = f"{work_dir(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
