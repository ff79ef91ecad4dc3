"""Queries over rewrites and their records: masks, skeletons of near-copies, process logs, plans of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.functions import rules
from proseloom.operators import campaign, editplan, masks, process, restructure, sheets, skeletons
from proseloom.plans import fixtures
from proseloom.plans.catalogue import _EDITED, _LINES, _TURN_PAIRS, _edited_turns, _re2, query
from proseloom.sources.tables import table, written

_TAGS = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<pre\b[^>]*>.*?</pre\s*>|<!--.*?-->|</?[a-z!][^<>]*>".replace("'", "''")


@query("mask_round_trip", f"SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '{_TAGS}'))::BIGINT AS n_masks, sha256(coalesce(html, '')) AS text_sha256, 0::BIGINT AS refused, length(regexp_replace(coalesce(html, ''), '{_TAGS}', '', 'g'))::BIGINT AS free_chars FROM pages")
def mask_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their markup masked, and back: what lies between tokens has the length of the page without markup."""
    pages = table(spark, sf_dir, "pages")
    kept = masks.masked(pages, ("html",), "page_id", "html")
    back = masks.restored(kept, kept.select("page_id", F.col("masked").alias("text")), "page_id")
    free = F.length(F.regexp_replace("masked", masks.OPEN + "[^" + masks.CLOSE + "]*" + masks.CLOSE, "")).cast("long")
    return kept.join(back, "page_id").select("page_id", F.size("spans").cast("long").alias("n_masks"), F.sha2("text", 256).alias("text_sha256"), F.size("refused").cast("long").alias("refused"), free.alias("free_chars"))


@query(
    "mask_faults",
    f"""WITH n AS (SELECT page_id, len(regexp_extract_all(replace(html, chr(10), ' '), '{_TAGS}')) AS n FROM pages WHERE html IS NOT NULL),
v AS (SELECT page_id, n, page_id % 4 AS fault FROM n WHERE n >= 2),
x AS (SELECT page_id, CASE fault WHEN 1 THEN 'lost' WHEN 2 THEN 'doubled' WHEN 3 THEN 'reordered' ELSE 'kept' END AS verdict, CASE fault WHEN 3 THEN 2 WHEN 0 THEN n ELSE 1 END AS masks FROM v UNION ALL SELECT page_id, 'kept', CASE fault WHEN 3 THEN n - 2 ELSE n - 1 END FROM v WHERE fault > 0)
SELECT page_id, verdict, masks::BIGINT AS masks FROM x WHERE masks > 0""",
)
def mask_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one paragraph whose rewrite loses the first token, doubles it, swaps it with the second or none of these, in turn."""
    pages = table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.replace("html", F.lit("\n"), F.lit(" ")).alias("html"))
    kept = masks.masked(pages, ("html",), "page_id", "html").where(F.size("spans") >= 2)
    token = lambda n: F.concat(F.lit(masks.OPEN), "prefix", F.lit(f"_{n}{masks.CLOSE}"))
    one, two, fault = token(0), token(1), F.col("page_id") % 4
    swapped = F.replace(F.replace(F.replace("masked", one, F.lit("\u0001")), two, one), F.lit("\u0001"), two)
    text = F.when(fault == 1, F.replace("masked", one, F.lit(""))).when(fault == 2, F.concat("masked", one)).when(fault == 3, swapped).otherwise(F.col("masked"))
    told = masks.verdicts(kept, kept.select("page_id", text.alias("text")), "page_id")
    return told.groupBy("page_id", "verdict").agg(F.count("*").alias("masks"))


@query(
    "turn_skeletons",
    f"""WITH RECURSIVE {_TURN_PAIRS},
body AS (SELECT id, lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\\S+', '<url>', 'g'), '@\\w+', '<@>', 'g'), '\\s+', ' ', 'g'))) AS body FROM {_EDITED} t),
l AS (SELECT a, b FROM q UNION ALL SELECT n.id, body.id FROM body JOIN n USING (body) WHERE body.id <> n.id),
g AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r(id, root) AS (SELECT u, u FROM g UNION SELECT g.v, r.root FROM r JOIN g ON g.u = r.id),
c AS (SELECT id, min(root) AS cluster FROM r GROUP BY id)
SELECT cluster::BIGINT AS cluster, c.id::BIGINT AS id, body AS words, true AS shares_words FROM c JOIN body USING (id)""",
)
def turn_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each turn of a cluster, rebuilt from the cluster's skeleton and the turn's own fillers."""
    turns = _edited_turns(spark, sf_dir)
    clusters = campaign.clusters(turns, 0.8)
    found = skeletons.skeletons(turns, clusters)
    back = skeletons.rebuilt(found, skeletons.filled(turns, clusters, found))
    return back.join(found.select("cluster", (F.col("shared") > 0).alias("shares_words")), "cluster").select("cluster", "id", "words", "shares_words")


@query(
    "process_chain",
    f"""WITH RECURSIVE e AS (SELECT 'user ' || user_id AS log_id, event_id::VARCHAR AS event_id, event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, coalesce(props, '') AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
c AS (SELECT log_id, seq, event_id, '{process.GENESIS}' AS prev, 'sha256:' || sha256(concat_ws(chr(9), seq::VARCHAR, kind, day, body, '{process.GENESIS}')) AS hash FROM e WHERE seq = 1
  UNION ALL SELECT e.log_id, e.seq, e.event_id, c.hash, 'sha256:' || sha256(concat_ws(chr(9), e.seq::VARCHAR, kind, day, body, c.hash)) FROM c JOIN e ON e.log_id = c.log_id AND e.seq = c.seq + 1)
SELECT log_id, seq::BIGINT AS seq, event_id, prev, hash FROM c""",
)
def process_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each user: the first half of the events is appended, then all of them, of which the first half is known."""
    events = _log_events(spark, sf_dir)
    half = events.agg((F.max("at") / 2).cast("long")).first()[0] or 0
    first = written(process.appended(events.sparkSession.createDataFrame([], process.ENTRY), events.where(F.col("at") <= half)), "process-entries").select(*process.COLUMNS)
    rest = process.appended(first, events).where("problem is null").select(*process.COLUMNS)
    return first.unionByName(rest).select("log_id", "seq", "event_id", "prev", "hash")


def _log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "events")
    return told.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("log_id"), F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("at"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.coalesce("props", F.lit("")).alias("body"), F.lit(None).cast("string").alias("builds_on"))


@query(
    "process_heads",
    """WITH e AS (SELECT 'user ' || user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, user_id % 4 AS f FROM events),
c AS (SELECT log_id, f, count(*) AS n FROM e GROUP BY ALL)
SELECT log_id, CASE WHEN f = 1 AND n >= 3 THEN n - 1 ELSE n END::BIGINT AS entries, CASE WHEN f = 1 AND n >= 4 THEN 4 WHEN f = 2 AND n >= 2 THEN 2 END::BIGINT AS first_fault,
  CASE WHEN f = 1 AND n >= 3 THEN 2 WHEN f = 2 AND n >= 2 THEN 1 ELSE n END::BIGINT AS good FROM c""",
)
def process_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of users, of which some lost their third entry and some had their second changed: how far each is sound."""
    entries = process.appended(spark.createDataFrame([], process.ENTRY), _log_events(spark, sf_dir)).select(*process.COLUMNS)
    fault = F.substring_index("log_id", " ", -1).cast("long") % 4
    broken = entries.where((fault != 1) | (F.col("seq") != 3)).withColumn("body", F.when((fault == 2) & (F.col("seq") == 2), "changed").otherwise(F.col("body")))
    return process.heads(written(broken, "process-broken")).select("log_id", "entries", "first_fault", "good")


_TALLIED = [r.rule_id for r in rules.rules("HIGH", "MEDIUM") if not r.looks_around]
_LINE_RULES = " UNION ALL ".join(f"SELECT doc_id, side, '{r.rule_id}' AS rule_id FROM s WHERE regexp_matches(t, {_re2(r.pattern)})" for r in rules.rules("HIGH", "MEDIUM") if not r.looks_around)


@query(
    "edit_tally",
    f"""WITH {_LINES}, s AS (SELECT doc_id, 'same' AS side, t FROM m WHERE NOT regexp_matches(raw, '^\\s*-{{3,}}\\s*$') UNION ALL SELECT doc_id, 'b', {fixtures.dealt_sql(fixtures.RULE_LINES, 'doc_id')} FROM documents UNION ALL SELECT doc_id, 'a', {fixtures.dealt_sql(fixtures.RULE_LINES, '(doc_id + 1)')} FROM documents),
h AS ({_LINE_RULES}),
c AS (SELECT doc_id, rule_id, count(*) FILTER (side = 'same') AS k, count(*) FILTER (side = 'b') AS b, count(*) FILTER (side = 'a') AS a FROM h GROUP BY ALL)
SELECT doc_id, rule_id, (b - least(a, b))::BIGINT AS gone, (k + least(a, b))::BIGINT AS remaining, (a - least(a, b))::BIGINT AS added FROM c""",
)
def edit_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents followed by a paragraph of one fixed line, and by the next line in its stead: findings gone, remaining and added."""
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"))
    lines = lambda key: F.concat(body, fixtures.dealt(fixtures.RULE_LINES, key))
    pairs = table(spark, sf_dir, "documents").withColumn("next", F.col("doc_id") + 1).select("doc_id", lines("doc_id").alias("original"), lines("next").alias("rewrite"))
    found = editplan.tally(pairs).where(F.col("rule_id").isin(*_TALLIED))
    return found.groupBy("doc_id", "rule_id").agg(*(F.sum(c).alias(c) for c in ("gone", "remaining", "added")))


_SCAFFOLD = "The gate was found shut. According to the almanac, it rained. Confidence: high. The mill stood empty."
_MOVING = r"https?://|\]\(|\[\d+\]|\[\^|(?i)\baccording to\b|\breport(?:ed|s)\b|\bsources?:|\bper the\b|\bconfidence\b|[(\[:]\s*(?:high|moderate|low|unknown)\b|^\W*(?:high|moderate|low|unknown)\W*$|\bdoes(?: not|n't) (?:prove|show|establish)\b"


@query(
    "restructured",
    f"""WITH d AS (SELECT doc_id, text, substring(sha256('According to the almanac, it rained. Confidence: high.@' || (length(text) + 26)), 1, 8) AS id FROM documents WHERE text <> '' AND NOT regexp_matches(text, '{_MOVING.replace("'", "''")}'))
SELECT doc_id, text || chr(10) || chr(10) || 'The gate was found shut.[^m-' || id || '] The mill stood empty.' || chr(10) || chr(10) || '## Sources and method' || chr(10) || chr(10) || '[^m-' || id || ']: According to the almanac, it rained. Confidence: high.' || chr(10) AS proposal,
  1::BIGINT AS moved, true AS ok, false AS ok_changed FROM d""",
)
def restructured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name no source themselves, followed by a paragraph that does: the proposal, its check, and the check of a proposal that lost a word."""
    begins = r"(?:(?=[hHaArRsSpPcCdD(\[:\]])|^)(?:" + _MOVING + ")"  # one look at a character instead of one for each alternative
    documents = table(spark, sf_dir, "documents").where((F.col("text") != "") & ~F.col("text").rlike(begins))
    texts = documents.select("doc_id", F.concat("text", F.lit("\n\n" + _SCAFFOLD)).alias("text"))
    found = written(restructure.proposed(texts, ("text",)), "proposals").select("doc_id", F.col("text").alias("original"), "proposal", F.size("moved").cast("long").alias("moved"))
    judged = restructure.verified(found, ("original", "proposal", "moved")).withColumnsRenamed({"proposal": "_proposal", "ok": "_ok"})
    lost = judged.drop("reasons").withColumn("proposal", F.replace("_proposal", F.lit("almanac"), F.lit("book")))
    return restructure.verified(lost, ("_proposal", "moved", "_ok")).select("doc_id", F.col("_proposal").alias("proposal"), "moved", F.col("_ok").alias("ok"), F.col("ok").alias("ok_changed"))


_SHEETS = [
    ("User", None, ["the", "der", "la"], [("(?i)que[aeiou]", "too fine a word")], None, ["und"], ["in", "de"], 1, 12, None, None),
    ("Bot", ["Assistant"], None, None, [(["and", "est"], None, None)], None, None, None, None, False, "only"),
]


@query(
    "sheet_findings",
    r"""WITH l AS (SELECT conv_id * 1000 + turn AS line_id, role AS speaker, coalesce(text, '') AS t FROM conversations),
o AS (SELECT *, regexp_replace(t, '"[^"]*"|“[^”]*”', ' ', 'g') AS own, regexp_replace(t, '[\s\p{Z}]+$', '') AS w FROM l),
s AS (SELECT *, list_filter(list_transform(list_filter(string_split(regexp_replace(own, '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''), lambda x: len(regexp_extract_all(x, '[A-Za-z]+([''’][A-Za-z]+)*'))), lambda n: n < 1 OR n > 12) AS z FROM o),
k AS (SELECT *, list_filter(['and', 'est'], lambda p: regexp_matches(t, '(?i)(^|[^A-Za-z])' || p || '($|[^A-Za-z])')) AS hit FROM o)
SELECT line_id, 'User' AS name, 'never' AS "check", p AS excerpt FROM o, (VALUES ('the'), ('der'), ('la')) v(p) WHERE speaker = 'user' AND regexp_matches(own, '(?i)(^|[^A-Za-z])' || p || '($|[^A-Za-z])')
UNION ALL SELECT line_id, 'User', 'never-pattern', '(?i)que[aeiou]' FROM o WHERE speaker = 'user' AND regexp_matches(own, '(?i)que[aeiou]')
UNION ALL SELECT line_id, 'User', 'sentence-length', array_to_string(z, ', ') FROM s WHERE speaker = 'user' AND len(z) > 0
UNION ALL SELECT line_id, 'Bot', 'questions', w[-40:] FROM o WHERE speaker = 'assistant' AND NOT regexp_matches(w, '\?["''”]*$')
UNION ALL SELECT line_id, 'Bot', 'contractions', '' FROM o WHERE false
UNION ALL SELECT line_id, 'Bot', 'knowledge-leak', array_to_string(hit, ', ') FROM k WHERE speaker = 'assistant' AND len(hit) > 0""",
)
def sheet_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against the sheets of two of the three roles."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_id"), F.col("role").alias("speaker"), "text")
    return sheets.findings(turns, spark.createDataFrame(_SHEETS, sheets.SCHEMA)).select("line_id", "name", "check", "excerpt")


_USES = r"(?i)(^|[^A-Za-z])(%s)($|[^A-Za-z])"


@query(
    "sheet_usage",
    f"""SELECT role AS speaker, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Bot' END AS name, count(*)::BIGINT AS lines,
  round(CASE role WHEN 'user' THEN avg(regexp_matches(coalesce(text, ''), '{_USES % 'in|de'}')::INT) WHEN 'assistant' THEN 0.0 END, 6)::DOUBLE AS tic_lines,
  round(CASE role WHEN 'user' THEN avg(regexp_matches(coalesce(text, ''), '{_USES % 'und'}')::INT) WHEN 'assistant' THEN 0.0 END, 6)::DOUBLE AS marker_lines FROM conversations GROUP BY role""",
)
def sheet_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("role").alias("speaker"), "text")
    found = sheets.usage(turns, spark.createDataFrame(_SHEETS, sheets.SCHEMA))
    return found.withColumns({c: F.round(c, 6) for c in ("tic_lines", "marker_lines")})
