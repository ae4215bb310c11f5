"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of its files, up to which a table is broadcast, after it was counted.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Rows of a task that puts much work into each.
TASK_ROWS = 20_000
#: Sessions by the scratch folders that saved() made in them and nothing has removed yet.
MADE: dict[str, SparkSession] = {}


@functools.cache
def own_dir() -> str:
    """A temporary folder of this process, for a local session without spark.checkpoint.dir."""
    path = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, path, True)
    return path


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir, which a cluster shares; a temporary one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{own_dir()}"
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return f"{root.rstrip('/')}/quire-{uuid.uuid4().hex}"


def saved(df: DataFrame, codec: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage is cut, and lost executors cost no data.

    codec: the files' compression, the session's own where it is None.

    Lazy results read such tables later; what forget() hasn't removed by then goes when the driver's process ends.
    """
    path = scratch_dir(df.sparkSession)
    if not MADE:
        atexit.register(forget_all)
    MADE[path] = df.sparkSession
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for made in [m for m in MADE if m.rpartition("/")[2] == folder.rstrip("/").rpartition("/")[2]]:
        del MADE[made]


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that saved() made and nothing reads any more."""
    for df in tables:
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            remove(df.sparkSession, folder)


def forget_all() -> None:
    for folder, spark in list(MADE.items()):
        try:
            remove(spark, folder)
        except Exception:  # the session's JVM has ended before; nothing can be removed through it
            MADE.clear()


def dealt(df: DataFrame, key: str, most: int = TASK_ROWS) -> DataFrame:
    """df dealt by a key to so many tasks that each has about `most` rows, for work that costs much more than a row's bytes tell."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most)), key)


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table made by saved() has."""
    spark, total = df.sparkSession, 0
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, saved, and marked for broadcast only if it has no more than some rows and its files no more than some bytes."""
    kept = saved(df)
    few = file_bytes(kept) <= size and kept.limit(rows + 1).count() <= rows
    return F.broadcast(kept) if few else kept
