"""Session and checkpoint helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", memory: str = "8g", shuffle: int = 8, app: str = "termloom") -> SparkSession:
    """A local session with the settings that the library expects; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only a session without that setting gets a folder of its own, and only if it runs in local mode.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.gettempdir()}/termloom-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def keep_until_exit(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again; this cuts its lineage.

    The files go when the application ends, or earlier with release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep_until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            files, where = _file_system(df.sparkSession, path)
            files.delete(where, True)
