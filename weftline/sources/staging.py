"""Tables written to the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode where it is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _fallback[app] = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(_fallback[app])
    return _fallback[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read from there from now on."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
