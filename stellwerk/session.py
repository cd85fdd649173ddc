"""Session settings, the shared checkpoint folder and guarded small-table reads."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import Row


def local_session(cores: int | str = 8, app: str = "stellwerk", shuffle: int = 8) -> SparkSession:
    """A session for tests and the benchmark. A cluster brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STELLWERK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A folder of this machine is used only where the setting is missing."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="stellwerk-")
    return folder


def collect_bounded(df: DataFrame, most: int, what: str) -> list[Row]:
    """Rows of a table that must stay small, such as a dimension. More than `most` rows is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; it can't be sent to every executor")
    return rows


_WRITTEN: list[str] = []


def written_table(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder, and read from there: compact, column-pruned, and safe when executors are lost.

    Results are lazy and read it later, so it stays until `drop_written`, or the end of this process.
    """
    if not _WRITTEN:
        atexit.register(drop_written)
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written() -> int:
    """Delete the tables that this process has written, once the results that read them are done; how many there were."""
    spark, n = SparkSession.getActiveSession(), len(_WRITTEN)
    while spark is not None and _WRITTEN:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone
            break
    return n
