"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "duelframe") -> SparkSession:
    """A session for tests and benches; on a cluster the submitter configures it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="duelframe-")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may go without that setting and uses a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/duelframe-{uuid.uuid4().hex}"


def materialised(df: DataFrame, folder: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage so that iterative jobs (fits, cross validation) reread a
    table instead of recomputing features; a lost executor loses nothing.
    """
    path = folder or shared_folder(df.sparkSession)
    writer = df.write.mode("overwrite")
    (writer if codec is None else writer.option("compression", codec)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``shared_folder`` named; nothing may read its files afterwards."""
    if folder.rstrip("/").rsplit("/", 1)[1].startswith("duelframe-"):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialised`` wrote; nothing may read them afterwards."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove_folder(df.sparkSession, folder)
