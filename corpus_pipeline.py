"""A corpus pipeline of five stages; each reads what its predecessor wrote.

``run`` applies them to ``documents``; every stage but the last returns that table's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.llm import decontaminate, packing, pii, simhash, toxicity
from proseloom.llm._tables import fresh, scratch, table, written
from proseloom.llm.queries import SMOOTHING, tokenizer_path


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, written so that every read sees the same keys (doc_ids may be null or repeat), and the key's name, which no column has."""
    row = fresh("stage_row", docs.columns)
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "stage-rows"), row


def _by_row(keyed: DataFrame, row: str) -> DataFrame:
    """What the operators read: the rows' keys as doc_id."""
    return keyed.select(F.col(row).alias("doc_id"), "text")


def _with(keyed: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows of keyed whose key is a doc_id in kept, without the key."""
    return keyed.join(kept.select(F.col("doc_id").alias(row)), row, "left_semi").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier rejects go, with or without a doc_id."""
    keyed, row = _keyed(docs)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _with(keyed, row, toxicity.scored(_by_row(keyed, row), model).where(F.col("score") < toxicity.THRESHOLD))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the smallest doc_id, one without a doc_id only where no other is there."""
    keyed, row = _keyed(docs)
    found = simhash.near_duplicates(_by_row(keyed, row)).select(F.col("doc_id").alias("found_row"), "component_id")
    own = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("own_row"))
    first = found.join(own, F.col("found_row") == F.col("own_row")).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "own_row")).alias("first"))
    return _with(keyed, row, first.select(F.col("first.own_row").alias("doc_id")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark window go, with or without a doc_id."""
    keyed, row = _keyed(docs)
    return _with(keyed, row, decontaminate.contamination(_by_row(keyed, row), table(spark, sf_dir, "benchmark")).where("not contaminated"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced in the text; n_chars follows. Each row carries its other columns along."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    found = pii.sanitised(docs.select("doc_id", "text", F.struct(own.alias("own"), F.col("text").isNull().alias("no_text")).alias("_rest")), more=("_rest",))
    changed = F.col("clean") != F.col("text")
    text = F.when(~F.col("_rest.no_text"), F.when(changed, F.col("clean")).otherwise(F.col("text")))
    size = F.when(changed, F.length("clean"))

    def column(name: str, kind: str):
        if name == "text":
            return text.alias(name)
        value = F.col("_rest.own").getField(name)
        return (F.coalesce(size, value).cast(kind) if name == "n_chars" else value).alias(name)

    return found.select(*(column(*c) for c in docs.dtypes))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens with every source at its target share."""
    return packing.packed(docs, tokenizer_path(), smoothing=SMOOTHING)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", redact), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, in a table of the shared folder; all other tables written on the way are removed."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as stages:
        for name, stage in STAGES:
            with scratch(spark) as made:
                docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
                stages.append(made.pop())
        stages.pop()
    return docs
