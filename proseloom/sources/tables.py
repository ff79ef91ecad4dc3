"""Tables by folder, and intermediate tables that cut a plan's lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` in a folder that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``: a folder that driver and executors share. Without it a local session uses a temporary folder; a cluster has no such folder, so there it is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="proseloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


#: Paths written since each enclosing ``scratch`` began, for each thread of control by itself.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratches", default=())


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read back: a lost executor costs a re-read, not the plan before it."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/proseloom/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    if held := _open.get():
        held[-1].append(path)
    return spark.read.schema(frame.schema).parquet(path)


def exchanged(frame: DataFrame) -> DataFrame:
    """The frame for a join in which neither side is broadcast. Spark takes rows that were exploded from a file to be as large as the file, compressed, and would carry all of them through the driver."""
    return frame.hint("merge")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes, at its end, the tables that ``written`` made inside, but for those whose paths are taken out of the list it gives."""
    made: list[str] = []
    token = _open.set((*_open.get(), made))
    try:
        yield made
    finally:
        _open.reset(token)
        for path in made:
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
