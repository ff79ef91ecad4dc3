"""Documents as the training-data operators read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.sources.tables import scratch, table, written

__all__ = ["fresh", "scratch", "table", "texts", "written"]


def texts(documents: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null: empty) and the named columns, whatever else the table has."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more
    )


def fresh(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as keep it apart from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
