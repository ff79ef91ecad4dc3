"""Process logs as a stream: each micro-batch of events is appended once, however often it is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.operators import process


def logs(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The entries under a path, of the micro-batches before one if given; empty where nothing has been written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/entries")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"{process.ENTRY}, batch long")
    found = spark.read.schema(f"{process.ENTRY}, batch long").parquet(f"{path}/entries")
    return found if before is None else found.where(F.col("batch") < before)


def append(events: DataFrame, number: int, path: str) -> None:
    """Appends a micro-batch. Its entries and its refused events are written under its number, over what an earlier attempt left there, and only batches before it are read, so a replay changes nothing."""
    spark = events.sparkSession
    outcome = process.appended(logs(spark, path, number).select(*process.COLUMNS), events).persist()
    try:
        outcome.where("problem is null").drop("problem").write.mode("overwrite").parquet(f"{path}/entries/batch={number}")
        outcome.where("problem is not null").write.mode("overwrite").parquet(f"{path}/refused/batch={number}")
    finally:
        outcome.unpersist()


def writer(events: DataFrame, path: str):
    """A stream writer of ``log_id, event_id, at, kind, day, body, builds_on`` into the logs under a path that driver and executors share."""
    return events.writeStream.foreachBatch(lambda batch, number: append(batch, number, path))
