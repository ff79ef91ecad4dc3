"""Dialogue: summaries by speaker, and how well lines tell their speakers apart.

Attribution is a cross-validated complement naive Bayes, run as joins and aggregates: counts
of features by fold and speaker, log odds by line and candidate, ranks by window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import text
from proseloom.operators.order import numbered
from proseloom.sources.tables import exchanged, written

ALPHA = 0.5
WORD = r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)*"
# Marks that count as features.
MARKS = (("?", "q"), ("!", "x"), (";", "s"), ("...", "e"), ("…", "e"), (",", "k"))


def summary(lines: DataFrame) -> DataFrame:
    """Per speaker: lines, words, questions, mean words a line and words a sentence. lines: ``speaker, text``."""
    body = F.coalesce(F.col("text"), F.lit(""))
    told = lines.select("speaker", text.count(body, WORD).alias("words"), F.size(text.sentences(body)).cast("long").alias("sentences"), body.contains("?").cast("long").alias("asks"))
    agg = told.groupBy("speaker").agg(F.count("*").alias("lines"), F.sum("words").alias("words"), F.sum("sentences").alias("sentences"), F.sum("asks").alias("questions"))
    return agg.select("speaker", "lines", "words", "questions", (F.col("words") / F.col("lines")).alias("mean_words"), (F.col("words") / F.nullif("sentences", F.lit(0))).alias("words_per_sentence"))


def features(body: Column) -> Column:
    """Words, word pairs, character trigrams and marks, each as often as it comes. The words are cut once, so a long line stays linear."""
    named = lambda tag, values: F.transform(values, lambda x: F.concat(F.lit(tag), x))

    def of_words(ws: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
        trigrams = F.regexp_extract_all(joined, F.lit("(?s)(?=(.{3}))"), F.lit(1))  # one begins at each character
        return F.concat(named("w:", ws), named("b:", F.transform(text.grams(ws, 2), lambda g: F.array_join(g, "_"))), named("c:", trigrams))

    marks = [F.array_repeat(F.lit("p:" + tag), F.floor((F.length(body) - F.length(F.replace(body, F.lit(mark), F.lit("")))) / len(mark)).cast("int")) for mark, tag in MARKS]
    return F.concat(text.let(F.transform(text.matches(body, WORD), lambda w: F.lower(w)), of_words), *marks)


def folds(lines: DataFrame, n: int = 5, min_lines: int = 20) -> DataFrame:
    """Lines of speakers with ``min_lines`` or more, with ``fold``: each speaker's lines cut into contiguous runs in script order. lines: ``line_id, speaker, text``.

    Places are counted by ranges of the sorted lines, so one speaker may hold most of them. Lines without a speaker are left out.
    """
    named = lines.select("line_id", "speaker", "text").where("speaker is not null")
    totals = named.groupBy("speaker").agg(F.count("*").alias("total")).where(F.col("total") >= min_lines)
    placed = numbered(named, ["speaker"], [F.col("line_id")], "seen").join(totals, "speaker")
    return placed.select("line_id", "speaker", "text", F.floor(F.col("seen") * n / F.col("total")).cast("long").alias("fold"))


def attribution(lines: DataFrame, n: int = 5, min_lines: int = 20) -> DataFrame:
    """``line_id, speaker, rank, p_true, top``: for each line, from the other folds, the rank and posterior of its true speaker and the likeliest one.

    What the other folds hold is what all hold less the line's own fold, so no fold is joined
    with the rest. Ties go to the speaker first by name. Fewer than two speakers give no rows.
    Each line is scored for each speaker who has enough lines.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as features are many times their text, its size does not tell how many tasks they need
    cut = written(folds(lines, n, min_lines).repartition(parts, "line_id"), "dialogue-folds")
    each = cut.select("line_id", "speaker", "fold", F.explode(features(F.coalesce(F.col("text"), F.lit("")))).alias("f"))
    every = range(n)
    counts = written(each.groupBy("f", "speaker").agg(F.array(*(F.count_if(F.col("fold") == k) for k in every)).alias("c")), "dialogue-counts")
    summed = F.array(*(F.sum(F.get("c", F.lit(k))) for k in every))
    # Logs are taken once a feature and held fold, in one table that the lines meet once. What every speaker shares (the feature's
    # total in the other folds) stands under no speaker; a line's terms are sums, so a feature that comes twice is two rows.
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    told = counts.groupBy("f").agg(summed.alias("all"), F.collect_list(F.struct("speaker", "c")).alias("own"))
    told = told.select("f", "all", "own", total(F.col("all")).alias("all_total"), F.explode(F.array(*(F.lit(k).cast("long") for k in every))).alias("held"))
    told = told.withColumn("held_total", F.get("all", F.col("held").cast("int"))).where("held_total > 0").withColumn("total", F.col("all_total") - F.col("held_total"))
    common = F.log(F.col("total") + ALPHA)
    own = F.transform("own", lambda x: F.struct(x["speaker"].alias("speaker"), (total(x["c"]) - F.get(x["c"], F.col("held").cast("int"))).alias("own")))
    terms = F.transform(F.filter(own, lambda x: x["own"] > 0), lambda x: F.struct(x["speaker"].alias("speaker"), (F.log(F.col("total") - x["own"] + ALPHA) - common).alias("v")))
    nobody = F.struct(F.lit(None).cast(lines.schema["speaker"].dataType).alias("speaker"), common.alias("v"))
    first = F.array_position(F.transform("all", lambda x: x > 0), True) == F.col("held") + 1
    logs = written(told.select("held", "f", "held_total", "total", first.alias("first"), F.concat(F.array(nobody), terms).alias("terms")), "dialogue-logs")
    # a feature that only the held fold has is none of the others'
    by_fold = logs.groupBy("held").agg(F.sum("held_total").alias("held_grand"), F.count_if(F.col("total") == 0).alias("lone"), F.count_if("first").alias("new"))
    size = by_fold.agg(F.sum("held_grand").alias("all_grand"), F.sum("new").alias("features"))
    grand = by_fold.join(F.broadcast(size)).select("held", (F.col("all_grand") - F.col("held_grand")).alias("grand"), (F.col("features") - F.col("lone")).alias("vocab"))  # one row
    of_speaker = counts.groupBy("speaker").agg(summed.alias("c")).select("speaker", total(F.col("c")).alias("all_mine"), F.posexplode("c").alias("held", "held_mine"))
    of_speaker = of_speaker.select("speaker", F.col("held").cast("long").alias("held"), (F.col("all_mine") - F.col("held_mine")).alias("mine"))
    base = of_speaker.join(grand, "held").select("held", "speaker", F.log(F.col("grand") - F.col("mine") + ALPHA * F.col("vocab")).alias("den"))
    met = each.select("line_id", F.col("fold").alias("held"), "f").join(exchanged(logs.select("held", "f", "terms")), ["held", "f"]).select("line_id", "held", F.explode("terms").alias("t"))
    sums = written(met.groupBy("line_id", "held", F.col("t.speaker").alias("speaker")).agg(F.sum("t.v").alias("v"), F.count("*").alias("n")), "dialogue-sums")
    common = sums.where("speaker is null").select("line_id", "held", F.col("v").alias("all_log"), "n")
    less = sums.where("speaker is not null").groupBy("line_id", "speaker").agg(F.sum("v").alias("d"))
    of_line = cut.select("line_id", F.col("fold").alias("held")).join(exchanged(common), ["line_id", "held"], "left").na.fill(0, ["all_log", "n"])  # lines without features too
    candidates = of_line.join(base, "held").withColumnRenamed("speaker", "candidate")
    scored = candidates.join(exchanged(less.withColumnRenamed("speaker", "candidate")), ["line_id", "candidate"], "left")
    score = -(F.col("all_log") + F.coalesce("d", F.lit(0.0)) - F.col("n") * F.col("den"))
    by_line = Window.partitionBy("line_id")
    told = scored.select("line_id", "candidate", score.alias("score")).withColumn("e", F.exp(F.col("score") - F.max("score").over(by_line)))
    ranked = told.withColumns({"p": F.col("e") / F.sum("e").over(by_line), "rank": F.row_number().over(by_line.orderBy(F.desc("score"), "candidate")).cast("long"), "top": F.first("candidate").over(by_line.orderBy(F.desc("score"), "candidate"))})
    truth = cut.select("line_id", F.col("speaker").alias("candidate"))
    return ranked.join(exchanged(truth), ["line_id", "candidate"]).select("line_id", F.col("candidate").alias("speaker"), "rank", F.col("p").alias("p_true"), "top")


def accuracy(attributed: DataFrame) -> DataFrame:
    """Per speaker: lines, correct ones, accuracy and its Wilson interval."""
    from proseloom.operators.evaluate import wilson

    agg = attributed.groupBy("speaker").agg(F.count("*").alias("lines"), F.count_if(F.col("rank") == 1).alias("correct"))
    low, high = wilson(F.col("correct"), F.col("lines"))
    return agg.select("speaker", "lines", "correct", (F.col("correct") / F.col("lines")).alias("accuracy"), low.alias("low"), high.alias("high"))
