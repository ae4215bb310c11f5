"""Work on files that arrive, item by item and again after a failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def drain(spark: SparkSession, landing: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, key: str, checkpoint: str) -> StreamingQuery:
    """Applies work to the rows of new files in a folder and appends the results, each key once, then ends.

    Results that are already in `out` are left out by an anti-join, so a batch that is done again after a failure adds nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        fresh = rows.dropDuplicates([key])
        path = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(rows.sparkSession.read.parquet(out).select(key), key, "left_anti")
        work(fresh).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).json(landing)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
