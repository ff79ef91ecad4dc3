"""The training-data operators as queries over a folder of tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.llm import conversation_repair, decontaminate, html_extract, packing, periodic_runs, pii, quality, sharding, simhash, substring_dedup, token_counts, toxicity, transport_stream
from proseloom.llm._tables import table

#: Target mixture of op8: a source's share is its tokens to this power, so that small sources are seen more often than in the natural mixture.
SMOOTHING = 0.7
#: Placement of op10: names of the shards.
SHARDS = [f"shard-{i:02d}" for i in range(64)]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the tokenizers installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature errors pts random_access sizes".split()
    return transport_stream.parsed(transport_stream.media(table(spark, sf_dir, "documents"))).select(*digests)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))

    def listed(kind: str):
        return F.transform(F.array_sort(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    base = F.concat(*map(listed, pii.PATTERNS))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.PATTERNS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed("term")), ",").alias("spans"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), smoothing=SMOOTHING)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("text_chars"))
    return sharding.placed(documents, "doc_id", SHARDS)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = conversation_repair.repaired(_damaged(turns)).withColumnRenamed("conv_id", "_conv_id")
    every = turns.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in "gaps blank duplicate truncated illegal cost".split()]
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _damaged(turns: DataFrame) -> DataFrame:
    """The turns, five in twenty of them damaged, by a checksum of their conversation and number."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat_ws(":", *told[:2]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", *(c.alias(n) for c, n in zip(told[2:], ("role", "text"), strict=True)), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.repeats(_with_periods(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    higher = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n")))
    return found.withColumn("best", F.aggregate("runs", none, higher)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def _with_periods(documents: DataFrame) -> DataFrame:
    """The documents; in every tenth, by a checksum of its id, the words from some place on repeat with a period. A null id has no checksum."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = documents.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    n, g = F.size("words").cast("int"), F.floor(F.col("h") / 10)
    at = hit.select("doc_id", "text", "words", n.alias("n"), g.alias("g"), F.when(n > 0, g % n).cast("int").alias("a"))
    times = (F.lit(3) + F.col("g") % 8).cast("int")
    period = (F.floor((F.col("n") - F.col("a")) / times) + 1).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, period), times)), F.lit(1), F.col("n") - F.col("a"))
    return at.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_transport_stream": op2_transport_stream,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_html_extract": op7_html_extract,
    "op8_packing": op8_packing,
    "op9_decontaminate": op9_decontaminate,
    "op10_sharding": op10_sharding,
    "op11_token_counts": op11_token_counts,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM d, unnest(range(1, greatest(len(w) - 48, 1))) AS t(i)),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN low USING (k), unnest(range(0, 50)) AS s(j) WHERE doc_id > m),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM
  (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op9_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
pat AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
win AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM pat) AS sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
hit AS (SELECT doc_id, i, win.n, item_id FROM win JOIN pat ON win.k = pat.k AND win.n = pat.n),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) AS s(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_sharding": f"""
WITH t AS (SELECT string_split('{",".join(map(str, sharding.filled(SHARDS)))}', ',') AS shards),
d AS (SELECT doc_id, length(text)::BIGINT AS text_chars, coalesce(('0x' || substring(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {sharding.TABLE_SIZE}, 0) AS slot FROM documents)
SELECT doc_id, text_chars, slot::BIGINT AS slot, 'shard-' || lpad(shards[slot + 1], 2, '0') AS shard FROM d, t
""",
}
