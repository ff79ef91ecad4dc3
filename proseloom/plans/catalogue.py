"""Queries by name over a folder of tables, with equivalent DuckDB SQL where SQL can express them.

Ratios are rounded to six places on both sides, as engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.functions import campaign_values as CV
from proseloom.functions import rules, text, values
from proseloom.operators import calibrate, campaign, check, compare, desk, devices, dialogue, edits, evaluate, lines, markdown, metrics, negation, packs, receipts, scan, series, structure, terms, voice
from proseloom.plans import fixtures
from proseloom.sources import readers, sinks
from proseloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def six(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def _re2(pattern: str) -> str:
    """A rule's pattern with Unicode word characters, quoted for SQL."""
    wide = pattern.replace(r"[\w", r"[\p{L}\p{N}_").replace(r"\w", r"[\p{L}\p{N}_]").replace("(?U)", "").replace("(?iU)", "(?i)")
    return "'" + wide.replace("'", "''") + "'"


WORD_CLASS = r"\p{L}\p{N}_"
W = r"'[\p{L}\p{N}_]+'"
#: SQL: lines of documents and, of each, the text with markup blanked.
_LINES = rf"""
l AS (SELECT doc_id, unnest(x) AS raw, unnest(range(1, len(x) + 1)) AS line FROM
  (SELECT doc_id, string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', ''), chr(10)) AS x FROM documents WHERE text <> '')),
m AS (SELECT doc_id, line, raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '`[^`]*`', ' ', 'g'),
  'https?://\S+|[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.-]*@[\p{{L}}\p{{N}}_.-]+\.[\p{{L}}\p{{N}}_]+', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\[a-zA-Z]+\*?\{{?|[{{}}]', ' ', 'g') AS t FROM l)"""
_STOP = "(" + ", ".join(f"'{w}'" for w in rules.OPENER_STOP) + ")"
_GRAM_STOP = "[" + ", ".join(f"'{w}'" for w in rules.NGRAM_STOP) + "]"


@query(
    "document_cadence",
    rf"""
WITH {_LINES},
d AS (SELECT doc_id, sum(len(regexp_extract_all(t, {W}))) AS words, sum(len(list_filter(regexp_extract_all(t, {W}), lambda w: regexp_matches(w, '(?i)^[\p{{L}}\p{{N}}_]{{3,}}ly$')))) AS adverbs,
  coalesce(string_agg(t, ' ' ORDER BY line) FILTER (trim(raw) <> '' AND NOT regexp_matches(trim(raw), '^[#|>*+-]')), '') AS prose FROM m WHERE NOT regexp_matches(raw, '^\s*-{{3,}}\s*$') GROUP BY doc_id),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(prose, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: regexp_extract_all(p, {W})), lambda w: len(w) > 0) AS w FROM d),
f AS (SELECT doc_id, list_transform(w, lambda x: len(x)::DOUBLE) AS n, list_filter(list_transform(w, lambda x: lower(x[1])), lambda o: o NOT IN {_STOP}) AS o FROM s),
c AS (SELECT doc_id, len(n) AS k, list_avg(n) AS mean, list_stddev_pop(n) AS sd, len(o) AS no, CASE WHEN len(o) > 0 THEN len(list_distinct(o)) / len(o) ELSE 1.0 END AS ratio FROM f)
SELECT documents.doc_id, coalesce(words, 0)::BIGINT AS words, coalesce(k, 0)::BIGINT AS sentences, CASE WHEN k >= 8 THEN round(mean, 6) END AS mean_len, CASE WHEN k >= 8 THEN round(sd / mean, 6) END AS cv,
  CASE WHEN k >= 8 THEN round(ratio, 6) END AS opener_ratio, coalesce(k >= 8 AND sd / mean < 0.45 AND mean >= 12, false) AS uniform, coalesce(k >= 8 AND no >= 12 AND ratio < 0.6, false) AS repetitive_openers,
  round(CASE WHEN words > 0 THEN adverbs * 100.0 / words ELSE 0.0 END, 6)::DOUBLE AS adverb_rate
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN c USING (doc_id)""",
)
def document_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.cadence(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "words", "sentences", *(six(c).alias(c) for c in ("mean_len", "cv", "opener_ratio")), "uniform", "repetitive_openers", six("adverb_rate").alias("adverb_rate"))


@query("document_check")
def document_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.check(table(spark, sf_dir, "documents")).drop("mean_len", "cv", "opener_ratio", "adverb_rate", "passive_rate")


@query("document_words", rf"SELECT doc_id, length(text)::BIGINT AS chars, len(string_split(text, chr(10)))::BIGINT AS lines, len(regexp_extract_all(text, {W}))::BIGINT AS words FROM documents")
def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.size(F.split(t, "\n", -1)).cast("long").alias("lines"), text.count(t, text.WORD).alias("words"))


@query(
    "line_offsets",
    f"WITH {_LINES} SELECT doc_id, line::BIGINT AS line, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(raw)::BIGINT AS chars FROM l",
)
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines(table(spark, sf_dir, "documents")).select("doc_id", "line", "start", F.length("raw").cast("long").alias("chars"))


@query(
    "repeated_trigrams",
    rf"""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[a-zA-Z'']+'), lambda w: lower(w)) AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM t, unnest(range(1, len(w) - 1)) AS x(i) WHERE len(w) >= 9),
c AS (SELECT doc_id, array_to_string(g, ' ') AS gram, count(*) AS times, min(i) AS first FROM g WHERE len(list_filter(g, lambda w: NOT list_contains({_GRAM_STOP}, w))) >= 2 GROUP BY ALL HAVING count(*) >= 3)
SELECT doc_id, gram, times::BIGINT AS times FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, first) AS r FROM c) q WHERE r = 1""",
)
def repeated_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.repeated_grams(table(spark, sf_dir, "documents"))


@query(
    "readability",
    r"""
WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n', chr(10), 'g'), chr(10))) AS s FROM documents),
w AS (SELECT doc_id, regexp_extract_all(s, '[A-Za-z0-9]+(?:[''’\-][A-Za-z0-9]+)*') AS w FROM p),
x AS (SELECT doc_id, len(w) AS n, list_sum(list_transform(list_transform(w, lambda v: regexp_replace(lower(v), '[^a-z]', '', 'g')), lambda v:
  CASE WHEN v = '' THEN 0 WHEN length(v) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(
    CASE WHEN regexp_matches(v, '[^aeiouy]le$') THEN v WHEN v LIKE '%ed' THEN CASE WHEN regexp_matches(v, '[td]ed$') THEN v ELSE v[:-3] END
      WHEN v LIKE '%es' THEN CASE WHEN regexp_matches(v, '(?:[sxzcg]|ch|sh)es$') THEN v ELSE v[:-3] END WHEN v LIKE '%e' AND NOT regexp_matches(v, '(?:ee|ye)$') THEN v[:-2] ELSE v END, '^y', ''), '[aeiouy]+'))) END)) AS y FROM w WHERE len(w) >= 3),
a AS (SELECT doc_id, count(*)::BIGINT AS n_sentences, sum(n)::BIGINT AS n_words, sum(y)::BIGINT AS n_syllables FROM x GROUP BY doc_id)
SELECT *, CASE WHEN n_words >= 100 THEN round(0.39 * n_words / n_sentences + 11.8 * n_syllables / n_words - 15.59, 9)::DOUBLE END AS grade,
  CASE WHEN n_words >= 100 THEN round(206.835 - 1.015 * n_words / n_sentences - 84.6 * n_syllables / n_words, 9)::DOUBLE END AS ease FROM a""",
)
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.readability(table(spark, sf_dir, "documents")).withColumns({"grade": F.round("grade", 9), "ease": F.round("ease", 9)})


_RATES = {"adverbs": r"^[\p{L}\p{N}_]{3,}ly$", "nominalizations": r"^[\p{L}\p{N}_]{4,}(?:tion|ment|ance|ence|ancy|ency)$"}


def _rates_sql(columns: str) -> str:
    """SQL: the columns, ``words`` and a rate for each voice feature. RE2 can't look ahead, so passives followed by "by" are counted apart."""
    passive = voice.FEATURES["passives"].split("(?!")[0]
    found = lambda p: f"len(regexp_extract_all(text, {_re2(p)}))"
    counts = {k: found(p) for k, p in voice.FEATURES.items()} | {"passives": f"({found(passive)} - {found(passive + r'\s+by\b')})"}
    # Words are matched whole, as \b of RE2 knows ASCII only.
    counts |= {k: f"len(list_filter(w, lambda x: regexp_matches(x, '(?i){p}')))" for k, p in _RATES.items()}
    counts["first_person"] = f"len(list_filter(w, lambda x: regexp_full_match(x, {_re2(voice.FEATURES['first_person'])})))"
    rates = ", ".join(f"CASE WHEN len(w) >= {voice.LEAST_WORDS} THEN {c} * 100.0 / len(w) END AS {k}" for k, c in counts.items())
    return f"SELECT {columns}, len(w)::BIGINT AS words, {rates} FROM (SELECT * REPLACE (coalesce(text, '') AS text), regexp_extract_all(coalesce(text, ''), {W}) AS w FROM documents)"


@query("structural_rates", f"SELECT doc_id, words, {', '.join(f'round({k}, 6)::DOUBLE AS {k}' for k in voice.FEATURES)} FROM ({_rates_sql('doc_id')})")
def structural_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = voice.features(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "words", *(six(c).alias(c) for c in voice.FEATURES))


@query("exact_duplicates", "SELECT sha256(text) AS text_sha256, count(*)::BIGINT AS copies, min(doc_id)::BIGINT AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return hashed.groupBy("text_sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


_BODIES = r"""
n AS (SELECT min(conv_id * 1000 + turn) AS id, body FROM (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+', '<url>', 'g'), '@\w+', '<@>', 'g'), '\s+', ' ', 'g'))) AS body FROM conversations) c WHERE body <> '' GROUP BY body),
s AS (SELECT id, list_distinct(CASE WHEN length(body) < 5 THEN [body] ELSE list_transform(range(1, length(body) - 3), lambda i: substring(body, i, 5)) END) AS sh FROM n)"""


#: SQL: the turns and, under ids of their own, each third one without its first word.
_EDITED = "(SELECT conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT 500000000000 + conv_id * 1000 + turn, regexp_replace(text, '^\\S+\\s+', '') FROM conversations WHERE (conv_id * 1000 + turn) % 3 = 0)"
_TURN_PAIRS = f"""{_BODIES.replace("conv_id * 1000 + turn", "id").replace("FROM conversations", "FROM " + _EDITED + " t")}, e AS (SELECT id, unnest(sh) AS x FROM s), z AS (SELECT id, len(sh) AS k FROM s),
p AS (SELECT e.id AS a, f.id AS b, count(*) AS shared FROM e JOIN e AS f ON e.x = f.x AND e.id < f.id GROUP BY ALL),
q AS (SELECT a, b, shared / (za.k + zb.k - shared) AS similarity FROM p JOIN z AS za ON za.id = a JOIN z AS zb ON zb.id = b WHERE shared / (za.k + zb.k - shared) >= 0.8)"""


def _edited_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    edited = turns.where("id % 3 = 0").select((F.col("id") + 500_000_000_000).alias("id"), F.regexp_replace("text", r"^\S+\s+", "").alias("text"))
    return turns.unionByName(edited)


@query("near_duplicate_turns", f"WITH {_TURN_PAIRS.replace('>= 0.8', '>= 0.4')} SELECT a::BIGINT AS a, b::BIGINT AS b, round(similarity, 6) AS similarity FROM q")
def near_duplicate_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and edited copies of a third of them: pairs that differ little."""
    return campaign.similar_pairs(_edited_turns(spark, sf_dir), 0.4).withColumn("similarity", six("similarity"))


@query(
    "near_duplicate_documents",
    f"""WITH {_BODIES.replace("conv_id * 1000 + turn", "doc_id").replace("FROM conversations", "FROM documents")}, e AS (SELECT id, unnest(sh) AS x FROM s), z AS (SELECT id, len(sh) AS k FROM s),
p AS (SELECT e.id AS a, f.id AS b, count(*) AS shared FROM e JOIN e AS f ON e.x = f.x AND e.id < f.id GROUP BY ALL)
SELECT a::BIGINT AS a, b::BIGINT AS b, round(shared / (za.k + zb.k - shared), 6) AS similarity FROM p JOIN z AS za ON za.id = a JOIN z AS zb ON zb.id = b WHERE shared / (za.k + zb.k - shared) >= 0.8""",
)
def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return campaign.similar_pairs(documents, 0.8).withColumn("similarity", six("similarity"))


@query(
    "turn_clusters",
    f"""WITH RECURSIVE {_TURN_PAIRS},
body AS (SELECT id, lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\\S+', '<url>', 'g'), '@\\w+', '<@>', 'g'), '\\s+', ' ', 'g'))) AS body FROM {_EDITED} t),
l AS (SELECT a, b, similarity FROM q UNION ALL SELECT n.id, body.id, 1.0 FROM body JOIN n USING (body) WHERE body.id <> n.id),
g AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r(id, root) AS (SELECT u, u FROM g UNION SELECT g.v, r.root FROM r JOIN g ON g.u = r.id),
c AS (SELECT id, min(root) AS cluster FROM r GROUP BY id),
m AS (SELECT cluster, min(similarity) AS lo, max(similarity) AS hi FROM l JOIN c ON c.id = l.a GROUP BY cluster)
SELECT id::BIGINT AS id, cluster::BIGINT AS cluster, count(*) OVER (PARTITION BY cluster)::BIGINT AS size, CASE WHEN lo >= 0.9 THEN 'near_duplicate' ELSE 'template' END AS kind, round(lo, 6)::DOUBLE AS similarity_min, round(hi, 6)::DOUBLE AS similarity_max FROM c JOIN m USING (cluster)""",
)
def turn_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = campaign.clusters(_edited_turns(spark, sf_dir), 0.8)
    return found.withColumns({c: six(c) for c in ("similarity_min", "similarity_max")})


@query(
    "shared_ngrams",
    rf"""
WITH t AS (SELECT conv_id, list_transform(regexp_extract_all(coalesce(text, ''), {W}), lambda w: lower(w)) AS w FROM conversations),
g AS (SELECT DISTINCT conv_id, w[i:i + 3] AS g FROM t, unnest(range(1, greatest(len(w) - 2, 1))) AS x(i))
SELECT array_to_string(g, ' ') AS gram, count(DISTINCT conv_id)::BIGINT AS docs FROM g WHERE len(list_filter(g, lambda w: NOT list_contains({_GRAM_STOP}, w))) >= 2 GROUP BY g HAVING count(DISTINCT conv_id) >= 3""",
)
def shared_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.shared_ngrams(table(spark, sf_dir, "conversations"), key="conv_id")


@query("maximal_passages")
def maximal_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return series.maximal_ngrams(turns)


@query(
    "role_summary",
    r"""
WITH t AS (SELECT role, coalesce(text, '') AS t FROM conversations),
c AS (SELECT role, len(regexp_extract_all(t, '[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*')) AS w, len(list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS s, contains(t, '?')::BIGINT AS q FROM t)
SELECT role AS speaker, count(*)::BIGINT AS lines, sum(w)::BIGINT AS words, sum(q)::BIGINT AS questions, round(sum(w) / count(*), 6) AS mean_words, round(sum(w) / nullif(sum(s), 0), 6) AS words_per_sentence FROM c GROUP BY role""",
)
def role_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dialogue.summary(table(spark, sf_dir, "conversations").withColumnRenamed("role", "speaker"))
    return found.withColumns({"mean_words": six("mean_words"), "words_per_sentence": six("words_per_sentence")})


@query(
    "role_word_counts",
    r"""SELECT role AS speaker, lower(w) AS word, count(*)::BIGINT AS times FROM (SELECT role, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*')) AS w FROM conversations) x GROUP BY ALL""",
)
def role_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "conversations").select(F.col("role").alias("speaker"), F.explode(text.matches(F.coalesce("text", F.lit("")), dialogue.WORD)).alias("w"))
    return each.groupBy("speaker", F.lower("w").alias("word")).agg(F.count("*").alias("times"))


@query("role_attribution")
def role_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_id"), F.col("role").alias("speaker"), "text")
    return dialogue.accuracy(dialogue.attribution(turns))


@query("page_entries")
def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.html_entries(table(spark, sf_dir, "pages"))


def _rule_sql(tiers: tuple[str, ...], source: str, column: str = "text") -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, '{r.rule_id}' AS rule_id, '{r.tier}' AS tier, regexp_extract({column}, {_re2(r.pattern)}) AS \"match\" FROM {source} WHERE regexp_matches({column}, {_re2(r.pattern)})"
        for r in rules.rules(*tiers)
        if not r.looks_around
    )


def _without_looking_around() -> list[str]:
    return [r.rule_id for r in rules.rules("HIGH", "MEDIUM", "LOW") if not r.looks_around]


#: SQL: lines of the documents, each document followed by a line of the fixed ones.
_RULE_LINES = _LINES.replace("FROM documents WHERE text <> ''", "FROM (SELECT doc_id, coalesce(text, '') || chr(10) || " + fixtures.dealt_sql(fixtures.RULE_LINES, "doc_id") + " AS text FROM documents) y WHERE text <> ''")


def _with_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, each followed by a line of the fixed ones, dealt in turn."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), fixtures.dealt(fixtures.RULE_LINES, "doc_id")).alias("text"))


@query("rule_hits", f"WITH {_RULE_LINES}, d AS (SELECT * FROM m WHERE NOT regexp_matches(raw, '^\\s*-{{3,}}\\s*$')) SELECT doc_id, rule_id, tier, \"match\" FROM ({_rule_sql(('HIGH', 'MEDIUM'), 'd', 't')} UNION ALL {_rule_sql(('LOW',), 'm', 'raw')}) x")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.line_findings(_with_line(spark, sf_dir), only=tuple(_without_looking_around()))
    return found.select("doc_id", "rule_id", "tier", "match")


@query("low_rule_counts", f"WITH {_LINES}, h AS ({_rule_sql(('LOW',), 'l', 'raw')}) SELECT rule_id, count(*)::BIGINT AS findings, count(DISTINCT doc_id)::BIGINT AS docs FROM h GROUP BY rule_id")
def low_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = scan.line_findings(table(spark, sf_dir, "documents"), only=tuple(r.rule_id for r in rules.rules("LOW") if not r.looks_around))
    return low.groupBy("rule_id").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("docs"))


@query("gate_by_profile")
def gate_by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = check.checks(_with_line(spark, sf_dir), [check.Profile(name=s, slop=s) for s in check.GATE_TIERS])
    return found.select("doc_id", "profile", "gate", "verdict", "n_high", "n_medium", "n_low", "blocking")


@query("all_findings")
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.findings(_with_line(spark, sf_dir))


@query("pack_findings")
def pack_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, part in packs.runs(list(packs.PACKS), _with_line(spark, sf_dir)).items():
        part = part.withColumn("pack", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_TOLD = [r for r in rules.rules("INJECTION")]
_DIRECTED = f"SELECT conv_id * 1000 + turn AS doc_id, coalesce(text, '') || chr(10) || {fixtures.dealt_sql(fixtures.DIRECTIONS, 'turn')} AS text FROM conversations"


@query(
    "injection_findings",
    f"""WITH t AS ({_DIRECTED}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM t),
r AS (SELECT *, {' '.join(['CASE', *(f"WHEN regexp_matches(raw, {_re2(r.pattern)}) THEN {k}" for k, r in enumerate(_TOLD)), 'END'])} AS k FROM l)
SELECT doc_id, line::BIGINT AS line, [{', '.join("'" + r.rule_id + "'" for r in _TOLD)}][k + 1] AS rule_id, CASE k {' '.join(f"WHEN {k} THEN regexp_extract(raw, {_re2(r.pattern)})" for k, r in enumerate(_TOLD))} END AS \"match\" FROM r WHERE k IS NOT NULL""".replace('\\"', '"'),
)
def injection_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, each followed by a line that may speak to an assistant: the first rule that a line meets."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat_ws("\n", F.coalesce("text", F.lit("")), fixtures.dealt(fixtures.DIRECTIONS, "turn")).alias("text"))
    return scan.injection_findings(turns).select("doc_id", "line", "rule_id", "match")


_PROMO_SUM = " + ".join(f"{w} * len(regexp_extract_all(t, {_re2(p)}))" for _, p, w in CV.PROMO)
_VOICES = " OR ".join(f"regexp_matches(t, {_re2(p)})" for label, p, _ in CV.PROMO if label.startswith(("launch formula: introducing", "launch formula: X launches")))
_ACRONYMS = ", ".join(f"'{a}'" for a in CV.ACRONYMS)


_POSTS = [t for _, t in fixtures.POSTS if t]
_BIOS = [t or "" for _, t, _ in fixtures.BIOS]
_PLATFORMS = [p for _, _, p in fixtures.BIOS]


@query(
    "promo_templates",
    rf"""
WITH f AS (SELECT id, coalesce(text, '') || ' ' || {fixtures.dealt_sql(_POSTS, 'id')} AS t FROM (SELECT conv_id * 8 + turn AS id, text FROM conversations) x),
c AS (SELECT id, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(t, '[^.!?\n]+[.!?\n]?')) AS s FROM f) x WHERE regexp_matches(s, {_re2(CV.SPEC)}) AND len(list_filter(regexp_extract_all(s, '\b[A-Z]{{4,}}\b'), lambda w: w NOT IN ({_ACRONYMS}))) > 0 GROUP BY id),
z AS (SELECT f.id, {_PROMO_SUM} + 2 * coalesce(c.n, 0) + CASE WHEN (regexp_matches(t, {_re2(CV.ENDORSE)}) OR {_VOICES}) AND NOT regexp_matches(t, {_re2(CV.DISCLOSURE)}) THEN 2 ELSE 0 END AS score FROM f LEFT JOIN c USING (id))
SELECT id, score::BIGINT AS score, score >= 3 AS template FROM z""",
)
def promo_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 8 + F.col("turn")).alias("id"), "text")
    return campaign.promo_scores(turns.select("id", F.concat_ws(" ", F.coalesce("text", F.lit("")), fixtures.dealt(_POSTS, "id")).alias("text")))


_SLOT_SQL = ", ".join(f"CASE WHEN regexp_matches(t, {_re2(p).replace('(?<![' + WORD_CLASS + '$])', '(?:^|[^' + WORD_CLASS + '$])')}) THEN '{s}' END" for s, _, p in CV.SLOTS)
_MIN = "CASE platform " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CV.MIN_SLOTS.items()) + " ELSE 3 END"


@query(
    "persona_slots",
    f"""
WITH f AS (SELECT c_custkey::BIGINT AS id, {fixtures.dealt_sql(_BIOS, 'c_custkey')} || ' ' || c_name AS t, {fixtures.dealt_sql(_PLATFORMS, 'c_custkey')} AS platform FROM customer),
s AS (SELECT id, platform, list_sort(list_distinct(list_filter([{_SLOT_SQL}], lambda x: x IS NOT NULL))) AS k FROM f)
SELECT id, platform, array_to_string(k, ',') AS slot_types, len(k)::BIGINT AS score, len(k) >= {_MIN} AS template FROM s""",
)
def persona_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    bios = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.concat_ws(" ", fixtures.dealt(_BIOS, "c_custkey"), "c_name").alias("text"), fixtures.dealt(_PLATFORMS, "c_custkey").alias("platform"))
    return campaign.personas(bios).select("id", "platform", F.array_join("slot_types", ",").alias("slot_types"), "score", "template")


@query("negation_load")
def negation_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.concat_ws(" ", F.coalesce("text", F.lit("")), fixtures.dealt([t for _, t in fixtures.ENTRIES], "doc_id"))
    return negation.load(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), told.alias("text")))


@query("page_negation")
def page_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.html_entries(table(spark, sf_dir, "pages"))
    return negation.summary(negation.load(found.select(F.concat_ws("-", "page_id", "n").alias("entry_id"), "text")))


@query(
    "receipt_audit",
    f"""SELECT gate, verdict, count(*)::BIGINT AS receipts, sum((coalesce(ruleset_version, '') <> 'a')::BIGINT)::BIGINT AS stale
FROM (SELECT coalesce(gate, '?') AS gate, coalesce(verdict, '?') AS verdict, ruleset_version FROM (SELECT {', '.join(fixtures.dealt_sql([r[k] for r in fixtures.RECEIPTS], 'doc_id') + ' AS ' + c for k, c in enumerate(('gate', 'verdict', 'ruleset_version')))} FROM documents) d) r GROUP BY GROUPING SETS ((gate), (verdict), ())""",
)
def receipt_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = (fixtures.dealt([r[k] for r in fixtures.RECEIPTS], "doc_id").alias(c) for k, c in enumerate(("gate", "verdict", "ruleset_version")))
    return receipts.audit(table(spark, sf_dir, "documents").select(*made), "a")


@query(
    "ledger_problems",
    r"""
WITH e AS (SELECT conv_id AS log_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS seq FROM conversations)
SELECT log_id, seq, unnest(CASE WHEN seq % 5 = 4 THEN ['does not link to the entry before it', 'content does not match its hash'] WHEN seq % 4 = 3 THEN ['content does not match its hash'] ELSE [] END) AS problem FROM e""",
)
def ledger_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each conversation, chained as it should be; then the content of every fourth entry (3, 7, ...) and the link of every fifth (4, 9, ...) is changed. All problems found."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))  # one conversation's
    kind = "array<struct<seq:bigint,kind:string,body:string,prev:string,hash:string>>"

    def chained(entries, turn):
        seq = (F.size(entries) + 1).cast("long")
        prev = F.coalesce(F.element_at(entries, F.when(F.size(entries) > 0, -1).otherwise(F.lit(None).cast("int")))["hash"], F.lit(receipts.GENESIS))
        own = receipts.entry_hash(seq, turn["role"], F.lit("2026-01-01").cast("date"), turn["text"], prev)
        return F.concat(entries, F.array(F.struct(seq.alias("seq"), turn["role"].alias("kind"), turn["text"].alias("body"), prev.alias("prev"), own.alias("hash"))))

    logs = turns.select(F.col("conv_id").alias("log_id"), F.explode(F.aggregate("turns", F.array().cast(kind), chained)).alias("e")).select("log_id", "e.*", F.lit("2026-01-01").cast("date").alias("day"))
    broken = logs.withColumns({
        "body": F.when((F.col("seq") % 4 == 3) & (F.col("seq") % 5 != 4), F.concat("body", F.lit("!"))).otherwise(F.col("body")),
        "prev": F.when(F.col("seq") % 5 == 4, F.lit("elsewhere")).otherwise(F.col("prev")),
    })
    return receipts.chain_problems(broken)


@query(
    "words_by_label",
    rf"SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*)::BIGINT AS docs, sum(len(regexp_extract_all(text, {W})))::BIGINT AS words FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
)
def words_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", text.count(F.col("text"), text.WORD).alias("w")).join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy(F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")).agg(F.count("*").alias("docs"), F.sum("w").alias("words"))


@query(
    "email_spans",
    r"""
WITH e AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS v, regexp_split_to_array(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS p FROM documents),
x AS (SELECT doc_id, i, v[i] AS value, list_sum(list_transform(p[:i], lambda s: length(s))) + coalesce(list_sum(list_transform(v[:i - 1], lambda s: length(s))), 0) AS start FROM e, unnest(range(1, len(v) + 1)) AS t(i))
SELECT doc_id, start::BIGINT AS start, (start + length(value))::BIGINT AS "end", value FROM x""",
)
def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    return found.select("doc_id", F.explode(text.all_matches(F.col("text"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")).alias("m")).select("doc_id", "m.start", "m.end", "m.value")


@query(
    "rhythm",
    rf"""
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
n AS (SELECT doc_id, len(regexp_extract_all(s, {W})) AS n FROM s), a AS (SELECT doc_id, count(*) AS k, stddev_pop(n) / avg(n) AS cv FROM n WHERE n > 0 GROUP BY doc_id)
SELECT doc_id, k::BIGINT AS sentences, CASE WHEN k >= 2 THEN round(cv, 6) END AS cv, coalesce(k >= 20 AND cv < 0.45, false) AS flat FROM a""",
)
def rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rhythm(table(spark, sf_dir, "documents")).withColumn("cv", six("cv"))


@query(
    "writer_profile",
    f"""
WITH v AS (UNPIVOT (SELECT writer, {', '.join(f'{k}::DOUBLE AS {k}' for k in voice.FEATURES)} FROM ({_rates_sql('lang AS writer')})) ON {', '.join(voice.FEATURES)} INTO NAME feature VALUE value),
g AS (SELECT writer, feature, list_sort(list(value)) AS v FROM v GROUP BY writer, feature)
SELECT writer, feature, len(v)::BIGINT AS samples, {', '.join(f'round(v[round_even((len(v) - 1) * {p}, 0)::INT + 1], 6)::DOUBLE AS {n}' for n, p in (('low', 0.1), ('median', 0.5), ('high', 0.9)))} FROM g""",
)
def writer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = voice.features(table(spark, sf_dir, "documents"), keep=(F.col("lang").alias("writer"),))
    return voice.profile(measured).withColumns({c: six(c) for c in ("low", "median", "high")})


@query(
    "voice_fit",
    f"""
WITH m AS (SELECT doc_id, writer, {', '.join(f'{k}::DOUBLE AS {k}' for k in voice.FEATURES)} FROM ({_rates_sql('doc_id, lang AS writer')})),
v AS (UNPIVOT m ON {', '.join(voice.FEATURES)} INTO NAME feature VALUE value),
g AS (SELECT writer, feature, list_sort(list(value)) AS v FROM v GROUP BY writer, feature),
p AS (SELECT writer, feature, v[round_even((len(v) - 1) * 0.1, 0)::INT + 1] AS low, v[round_even((len(v) - 1) * 0.9, 0)::INT + 1] AS high FROM g)
SELECT doc_id, p.writer, round(avg((value >= low AND value <= high)::INT), 6)::DOUBLE AS share FROM v JOIN p USING (feature) GROUP BY ALL""",
)
def voice_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = voice.features(table(spark, sf_dir, "documents"), keep=(F.col("lang").alias("writer"),))
    return voice.fit(measured.drop("writer"), voice.profile(measured)).withColumn("share", six("share"))


@query(
    "moving_ttr",
    rf"""
WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(coalesce(text, ''), {W}), lambda w: lower(w)) AS w FROM conversations)
SELECT (conv_id * 1000 + turn)::BIGINT AS doc_id, CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < 20 THEN round(len(list_distinct(w)) / len(w), 6) ELSE round(list_avg(list_transform(range(1, len(w) - 18), lambda i: len(list_distinct(w[i:i + 19])) / 20)), 6) END AS mattr FROM t""",
)
def moving_ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return voice.moving_ttr(turns).withColumn("mattr", six("mattr"))


@query(
    "length_auroc",
    r"""
WITH x AS (SELECT quality AS y, n_chars AS s FROM documents JOIN labels USING (doc_id)), r AS (SELECT y, (rank() OVER (ORDER BY s)) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM x)
SELECT count(*) FILTER (y = 1)::BIGINT AS positives, count(*) FILTER (y = 0)::BIGINT AS negatives,
  round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auroc FROM r""",
)
def length_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.auroc(joined, "quality", "n_chars").withColumn("auroc", six("auroc"))


@query(
    "length_shift",
    r"""
WITH x AS (SELECT quality AS y, n_chars AS v FROM documents JOIN labels USING (doc_id)), g AS (SELECT DISTINCT v FROM x)
SELECT count(*) FILTER (y = 1)::BIGINT AS ones, count(*) FILTER (y = 0)::BIGINT AS others,
  round((SELECT max(abs((SELECT count(*) FILTER (y = 1 AND x.v <= g.v) / count(*) FILTER (y = 1) - count(*) FILTER (y = 0 AND x.v <= g.v) / count(*) FILTER (y = 0) FROM x))) FROM g), 6) AS distance FROM x""",
)
def length_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.ks_distance(joined, "quality", "n_chars").withColumn("distance", six("distance"))


@query(
    "toxic_rate_difference",
    r"""
WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS k1, count(*) FILTER (quality = 0)::DOUBLE AS n1, count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS k2, count(*) FILTER (quality = 1)::DOUBLE AS n2 FROM labels),
w AS (SELECT *, k1 / n1 AS p1, k2 / n2 AS p2, 1.96 * 1.96 AS z FROM c),
i AS (SELECT *, (p1 + z / (2 * n1)) / (1 + z / n1) AS m1, sqrt(z) * sqrt(p1 * (1 - p1) / n1 + z / (4 * n1 * n1)) / (1 + z / n1) AS h1, (p2 + z / (2 * n2)) / (1 + z / n2) AS m2, sqrt(z) * sqrt(p2 * (1 - p2) / n2 + z / (4 * n2 * n2)) / (1 + z / n2) AS h2 FROM w),
e AS (SELECT *, greatest(0, m1 - h1) AS l1, least(1, m1 + h1) AS u1, greatest(0, m2 - h2) AS l2, least(1, m2 + h2) AS u2 FROM i)
SELECT round(p1 - p2, 6) AS difference, round(p1 - p2 - sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2), 6) AS low, round(p1 - p2 + sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2), 6) AS high FROM e""",
)
def toxic_rate_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad, good, toxic = F.col("quality") == 0, F.col("quality") == 1, F.col("toxic") == 1
    counts = table(spark, sf_dir, "labels").agg(F.count_if(bad & toxic).alias("k1"), F.count_if(bad).alias("n1"), F.count_if(good & toxic).alias("k2"), F.count_if(good).alias("n2"))
    found = evaluate.newcombe(*(F.col(k) for k in ("k1", "n1", "k2", "n2")))
    return counts.select(*(six(x).alias(k) for x, k in zip(found, ("difference", "low", "high"), strict=True)))


@query(
    "length_placement",
    r"""
WITH b AS (SELECT lang, quantile_cont(n_chars, 0.1) AS lo, quantile_cont(n_chars, 0.9) AS hi, count(n_chars) AS n FROM documents GROUP BY lang HAVING count(n_chars) >= 5),
m AS (SELECT lang, round(greatest(0.0, lo - greatest((hi - lo) * 0.1, (0.05 + 0.2 / n) * abs(lo + hi) / 2)), 3) AS low, round(hi + greatest((hi - lo) * 0.1, (0.05 + 0.2 / n) * abs(lo + hi) / 2), 3) AS high FROM b)
SELECT doc_id, CASE WHEN n_chars IS NULL OR low IS NULL THEN 'unknown' WHEN n_chars > high THEN 'above' WHEN n_chars < low THEN 'below' ELSE 'inside' END AS verdict,
  round(CASE WHEN n_chars > high THEN n_chars - high WHEN n_chars < low THEN low - n_chars END / coalesce(nullif(high - low, 0), greatest(abs(high), 1)), 2) AS excess FROM documents LEFT JOIN m USING (lang)""",
)
def length_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return evaluate.placed(documents, evaluate.bands(documents, "lang", "n_chars", 5), "lang", "n_chars").select("doc_id", "verdict", "excess")


@query(
    "label_confusion",
    r"""
WITH c AS (SELECT lang, quality = 1 AS y, n_chars >= 400 AS p FROM documents JOIN labels USING (doc_id)),
a AS (SELECT lang, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM c GROUP BY lang)
SELECT lang, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM a""",
)
def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") >= 400).cast("int").alias("p")).join(table(spark, sf_dir, "labels"), "doc_id")
    found = evaluate.confusion(joined, "quality", "p", "lang")
    return found.withColumns({c: six(c) for c in ("precision", "recall", "fpr")})


@query(
    "rewrite_facts",
    """SELECT doc_id, kind, 'changed' AS status, before, after, (length(coalesce(text, '')) + 2 + strpos('It costs $5 million and must run in two and a half hours', before) - 1)::BIGINT AS before_start,
  (length(coalesce(text, '')) + 2 + strpos('It costs $6M and should run in 2.5 hours', after) - 1)::BIGINT AS after_start FROM documents, (VALUES ('number', '$5 million', '$6M'), ('modal', 'must', 'should')) v(kind, before, after)""",
)
def rewrite_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rewrite of each document's last paragraph changes: all other facts are kept, an amount spelled otherwise among them."""
    body = F.coalesce("text", F.lit(""))
    said = lambda what: F.concat(body, F.lit("\n\n"), F.lit(what))
    pairs = table(spark, sf_dir, "documents").select("doc_id", said("It costs $5 million and must run in two and a half hours").alias("original"), said("It costs $6M and should run in 2.5 hours").alias("rewrite"))
    return compare.compare(pairs).where("status != 'kept'")


_PLAIN = r"[\"`“<]|https?:|—|[ \t]–|[ \t]{2}|\|"


@query("house_edits", f"SELECT doc_id, ((length(text) - length(replace(text, ', ', ''))) / 2)::BIGINT AS edits, sha256(text) AS output_sha256, sha256(replace(text, ', ', ' — ')) AS input_sha256, text FROM documents WHERE NOT regexp_matches(text, '{_PLAIN}')")
def house_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose commas have become dashes: the edits make commas of them again. Texts with protected spans, or changes of their own, are told apart first."""
    dashed = table(spark, sf_dir, "documents").where(~F.col("text").rlike(_PLAIN)).select("doc_id", F.replace("text", F.lit(", "), F.lit(" — ")).alias("text"))
    return edits.transformed(dashed).select("doc_id", F.size("edits").cast("long").alias("edits"), "output_sha256", "input_sha256", "text")


@query("device_rates")
def device_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.rates(table(spark, sf_dir, "documents"))


@query("sarif_logs")
def sarif_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sarif(scan.line_findings(_with_line(spark, sf_dir)))


@query(
    "perspective",
    rf"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), {W})) AS words, len(list_filter(regexp_extract_all(regexp_replace(coalesce(text, ''), '\"[^\"\n]*\"|“[^”\n]*”|‘[^’\n]*’', ' ', 'g'), {W}), lambda x: regexp_full_match(x, {_re2(series.FIRST_PERSON)}))) AS hits FROM documents)
SELECT doc_id, words::BIGINT AS words, hits::BIGINT AS first_person, CASE WHEN words > 0 THEN round(hits * 1000.0 / words, 6) ELSE 0 END::DOUBLE AS per_1k, words >= {series.PERSPECTIVE_WORDS} AND words > 0 AND hits * 1000.0 / greatest(words, 1) < {series.PERSPECTIVE_RATE} AS low FROM c""",
)
def perspective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.perspective(table(spark, sf_dir, "documents")).withColumn("per_1k", six("per_1k"))


def _with_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, each followed by a paragraph of Markdown structure, and the number of its own lines."""
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(body, F.lit("\n\n"), fixtures.dealt(fixtures.STRUCTURED, "doc_id")).alias("text"), F.size(F.split(body, "\n", -1)).alias("own"))


_OWN_LINES = "len(string_split(coalesce(text, ''), chr(10)))"


@query(
    "line_kinds",
    rf"""WITH o AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
k AS (SELECT doc_id, CASE WHEN regexp_matches(raw, '^\s*$') THEN 'blank' ELSE 'text' END AS kind, 1 AS n FROM o UNION ALL SELECT doc_id, 'blank', 1 FROM documents UNION ALL SELECT doc_id, kind, n FROM documents JOIN {fixtures.values(fixtures.STRUCTURED_KINDS, 'k', 'kind', 'n')} ON doc_id % {len(fixtures.STRUCTURED)} = k)
SELECT doc_id, kind, sum(n)::BIGINT AS lines FROM k GROUP BY doc_id, kind""",
)
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.kinds(_with_structure(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count("*").alias("lines"))


@query(
    "math_masks",
    f"SELECT doc_id, ({_OWN_LINES} + 1 + i)::BIGINT AS line, kind, masked FROM documents JOIN {fixtures.values(fixtures.STRUCTURED_MASKS, 'k', 'i', 'kind', 'masked')} ON doc_id % {len(fixtures.STRUCTURED)} = k",
)
def math_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the masks of structure change, in the paragraph after each document."""
    documents = _with_structure(spark, sf_dir)
    found = markdown.masked(documents).join(documents.select("doc_id", "own"), "doc_id")
    return found.where("masked != raw and line > own").select("doc_id", "line", "kind", "masked")


@query("desk_claims")
def desk_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.claims(table(spark, sf_dir, "documents")).groupBy("doc_id", "check", "match").agg(F.count("*").alias("places"))


@query("hidden_text")
def hidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(fixtures.hidden(spark))
    return desk.hidden(documents)


@query(
    "missing_sections",
    r"""
SELECT doc_id, s AS section FROM (SELECT doc_id, lower(array_to_string(regexp_extract_all(coalesce(text, ''), '(?m)^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$', 1), ' ')) AS heads FROM documents),
  (SELECT unnest(['limitations', 'methods']) AS s) WHERE NOT contains(heads, s)""",
)
def missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.missing_sections(table(spark, sf_dir, "documents"), ("limitations", "methods"))


#: Terms for the query: words of the tables' texts.
TERMS = (terms.Term("stupid", reason="insult"), terms.Term("worthless"), terms.Term("ing", use="ings"), terms.Term("Is", use="Are", match_case=True))


@query(
    "terminology",
    rf"""
WITH {_LINES},
w AS (SELECT doc_id, unnest(string_split_regex(t, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}-]+')) AS w FROM m)
SELECT doc_id, CASE WHEN w = 'Is' THEN 'terminology/preferred/are' WHEN lower(w) = 'ing' THEN 'terminology/preferred/ings' ELSE 'terminology/banned/' || lower(w) END AS rule_id, count(*)::BIGINT AS hits
FROM w WHERE w = 'Is' OR lower(w) IN ('stupid', 'worthless', 'ing') GROUP BY ALL""",
)
def terminology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.findings(table(spark, sf_dir, "documents"), list(TERMS)).groupBy("doc_id", "rule_id").agg(F.count("*").alias("hits"))


@query("calibrated_findings")
def calibrated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(fixtures.quoted(spark))
    return calibrate.calibrated(scan.line_findings(documents), documents).select("doc_id", "line", "start", "end", "tier", "category", "label")


@query("author_stretches")
def author_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.author_stretches(table(spark, sf_dir, "documents"))


@query("abstract_runs")
def abstract_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.abstract_runs(table(spark, sf_dir, "documents"), 1)


@query("band_runs")
def band_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.band_runs(table(spark, sf_dir, "documents"))


@query("paragraph_moves")
def paragraph_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.moves(table(spark, sf_dir, "documents"))


@query(
    "label_flips",
    r"""
SELECT lang, count(*) AS pairs, count(*) FILTER (NOT a AND b) AS gained, count(*) FILTER (a AND NOT b) AS lost, count(*) FILTER (a AND b) AS kept
FROM (SELECT lang, coalesce(quality = 0, false) AS a, coalesce(toxic = 1, false) AS b FROM labels JOIN documents USING (doc_id)) GROUP BY lang""",
)
def label_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    before = labels.select("doc_id", "lang", (F.col("quality") == 0).cast("int").alias("v"))
    return evaluate.pair_flips(before, labels.select("doc_id", F.col("toxic").cast("int").alias("v")), "doc_id", "v", "lang")


@query("toxic_rate_bootstrap")
def toxic_rate_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.bootstrap_rate(labels, "doc_id", "toxic", "lang").select("lang", "n", six("rate").alias("rate"), six("low").alias("low"), six("high").alias("high"))


@query(
    "commitments",
    r"""
SELECT doc_id, 'sha256:' || sha256(unhex(sha256(doc_id::VARCHAR)) || encode(coalesce(text, ''))) AS commitment,
  rtrim(translate(to_base64(encode(coalesce(lang, ''))), '+/=', '-_'), '=') || '.' || sha256('secret' || chr(10) || coalesce(lang, '')) AS token FROM documents""",
)
def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    salt = F.sha2(F.col("doc_id").cast("string"), 256)
    body, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", values.commitment(salt, body).alias("commitment"), values.token(lang, F.lit("secret")).alias("token"))


@query(
    "structure_findings",
    f"SELECT doc_id, (s + length(coalesce(text, '')) + 2)::BIGINT AS start, (e + length(coalesce(text, '')) + 2)::BIGINT AS \"end\", tier, rule_id FROM documents JOIN {fixtures.values(fixtures.STRUCTURE_FOUND, 'k', 's', 'e', 'tier', 'rule_id')} ON doc_id % {len(fixtures.STRUCTURE)} = k",
)
def structure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, each followed by a text of known structure: what is found in that."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("own"))
    whole = documents.select("doc_id", F.concat("own", F.lit("\n\n"), fixtures.dealt(fixtures.STRUCTURE, "doc_id")).alias("text"))
    found = structure.structure(whole, {}).join(documents.select("doc_id", (F.length("own") + 2).alias("from")), "doc_id")
    return found.where(F.col("start") >= F.col("from")).select("doc_id", "start", "end", "tier", "rule_id")


@query("structure_documents")
def structure_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.run("structure", table(spark, sf_dir, "documents")).select("doc_id", "line", "start", "end", "tier", "rule_id")
