"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "tideframe") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(master: str, configured: str | None) -> str:
    """The folder for staged data: the configured one, or on a local master a fresh folder that goes
    when the process ends. Another master without a configured folder is an error, since executors
    would write to their own disks."""
    if configured:
        return configured
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"master {master}: set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="tideframe-staged-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir`` at first use."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(sc.master, spark.conf.get("spark.checkpoint.dir", None)))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the session."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through the file system it lives in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back.

    Cheaper than a checkpoint where several branches read few columns; survives lost executors.
    The folder goes when the process ends."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not STAGED:
        atexit.register(drop_staged)
    STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


STAGED: list[tuple[SparkSession, str]] = []


def drop_staged() -> None:
    """Delete all folders of ``staged``; those of a stopped session are left to its cluster."""
    while STAGED:
        spark, path = STAGED.pop()
        if spark.sparkContext._jsc is not None:
            drop_folder(spark, path)
