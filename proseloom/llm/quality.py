"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Seven labellers each vote good, bad or nothing on a text. Their votes are counted by pattern
over all documents (3**7 patterns at most); expectation-maximisation on these counts estimates
how often each labeller votes what for good and for bad texts, and so the posterior of a
text. A linear model on hashed word shapes is trained on the posteriors and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.llm._linear import chosen, compact, design, fit, logistic
from proseloom.llm._tables import texts
from proseloom.llm._words import NOT_SPACE, Words, mixed, utf8, word_slices

#: Documents to train the scorer on at most: those with the smallest hash of their doc_id. The labellers' accuracies come from all documents.
MAX_TRAIN = 4000
L1 = 2e-4
HASH_BITS = 22
THRESHOLD = 0.5
#: What labellers are believed to vote (bad, nothing, good) on bad and on good texts, and the weight of that belief as a share of the rows.
PRIOR_VOTES, BELIEF = ((0.4, 0.2, 0.4), (0.01, 0.19, 0.8)), 0.05
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = "the of and to in is that it for on was as with der die und das von zu mit den de la le les et des un une que du en el los y por con del se".split()


MEASURES = ("length", "words", "symbols", "capitals", "repeats", "ends", "functions")


def votes() -> dict[str, Column]:
    """What each labeller says of a text, from its measures: 1 good, -1 bad, 0 nothing."""
    length, words = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("length", "words"))
    symbols, capitals = F.col("symbols") / length, F.col("capitals") / length
    repeats, ends, function, size = F.col("repeats") / words, F.col("ends") / words, F.col("functions") / words, length / words
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    return {
        "symbols": vote(symbols > 0.03, symbols < 0.004),
        "capitals": vote(capitals > 0.3, capitals < 0.1),
        "repeats": vote(repeats > 0.1, repeats < 0.02),
        "sentences": vote((ends > 0.6) | ((ends < 0.01) & (words > 60)), ends.between(0.02, 0.3)),
        "word_length": vote((size < 2.5) | (size > 14), size.between(4, 9)),
        "function_words": vote(function < 0.04, function > 0.12),
        "length": vote(words < 4, words > 30),
    }


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Prior of good, and P(vote | class) as an array [labeller, class bad/good, vote -1/0/1].

    patterns: one row of votes for each pattern. Labellers are taken to be better than chance
    and bad votes on good texts to be rare, as a prior worth ``BELIEF`` of all rows; the start
    weighs a bad vote three times a good one.
    """
    m = patterns.shape[1] if patterns.ndim == 2 else 0
    table = np.full((m, 2, 3), 1 / 3)
    if not counts.sum():
        return 0.5, table
    posterior = logistic((patterns > 0).sum(1) - 3.0 * (patterns < 0).sum(1))
    believed = BELIEF * counts.sum() * np.array(PRIOR_VOTES) + 1
    prior = 0.5
    for _ in range(rounds):
        before = posterior
        weight = np.stack((counts * (1 - posterior), counts * posterior))
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        for vote in (-1, 0, 1):
            table[:, :, vote + 1] = (weight @ (patterns == vote)).T + believed[:, vote + 1]
        table /= table.sum(2, keepdims=True)
        odds = np.log(table[:, 1] / table[:, 0])
        posterior = logistic(np.log(prior / (1 - prior)) + odds[np.arange(m), patterns + 1].sum(1))
        if np.abs(posterior - before).max() < 1e-9:
            break
    return prior, table


def _odds(prior: float, table: np.ndarray) -> Column:
    """The posterior of good, from the votes."""
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for k, vote in enumerate(votes().values()):
        bad, none, good = (float(x) for x in np.log(table[k, 1] / table[k, 0]))
        odds = odds + F.when(vote == 1, good).when(vote == -1, bad).otherwise(none)
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(40.0)), F.lit(-40.0))))


_KIND = np.full(256, 5, np.uint64)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 0, 1, 2, 3
_KIND[[0x2E, 0x2C, 0x3B, 0x3A, 0x3F]] = 4


def _features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) pairs and their values: the root of the feature's share of the row's words."""
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, np.zeros(0)
    row, hashes = words.row(), words.hashes()
    kind = _KIND[words.data]
    length = (words.ends - words.starts).astype(np.uint64)
    first, last = kind[words.starts], kind[words.ends - 1]
    before_last = kind[np.maximum(words.ends - 2, words.starts)]
    size = np.minimum(length, 16)
    again = np.zeros(len(words), np.uint64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    shape = mixed(first + np.uint64(8) * last + np.uint64(64) * before_last + np.uint64(512) * size + np.uint64(1))
    ends = mixed(last + np.uint64(8) * before_last + np.uint64(1 << 20))
    follow = mixed(again + np.uint64(1 << 21))
    short = length <= 4
    mask = np.uint64((1 << HASH_BITS) - 1)
    column = np.concatenate([x & mask for x in (shape, ends, follow, hashes[short])]).astype(np.int64)
    pairs, n = np.unique((np.concatenate((row, row, row, row[short])) << HASH_BITS) | column, return_counts=True)
    at = pairs >> HASH_BITS
    return at, pairs & ((1 << HASH_BITS) - 1), np.sqrt(n / np.diff(words.first)[at])


def _flags(is_one: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(is_one[data], out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _bytes(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


_SYMBOLS, _ENDS, _CAPITALS = _bytes("#$%&*|!~^=<>{}[]\\_@"), _bytes(".!?"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_FIRST_BYTES = np.zeros(256, bool)
_FIRST_BYTES[:0x80], _FIRST_BYTES[0xC0:] = True, True


def _known() -> np.ndarray:
    data, offsets = utf8(pa.array([" ".join(FUNCTION_WORDS)]))
    return np.unique(Words(data, offsets, NOT_SPACE).hashes())


def _measured(words: Words, offsets: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    """The MEASURES of each row; offsets: of the rows in the slice's bytes."""
    n = len(offsets) - 1
    counted = lambda flags: np.bincount(words.row()[flags], minlength=n) if len(words) else np.zeros(n, np.int64)
    hashes = words.hashes()
    again = np.zeros(len(words), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[np.minimum(words.first[:-1], len(words) - 1)[np.diff(words.first) > 0]] = False
    lower = Words(words.data, offsets, NOT_SPACE, lower=True).hashes()
    of_bytes = [_flags(x, words.data, offsets) for x in (_FIRST_BYTES, _SYMBOLS, _CAPITALS, _ENDS)]
    return [of_bytes[0], np.diff(words.first), of_bytes[1], of_bytes[2], counted(again), of_bytes[3], counted(np.isin(lower, known))]


def _mapped(frame: DataFrame, model=None) -> DataFrame:
    """``doc_id`` and the measures of each text, with the ``score`` of the model if there is one."""
    names = [*MEASURES, *(["score"] if model else [])]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known()
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in names]
            _, offsets = utf8(batch.column(1))
            for lo, hi, words in word_slices(batch.column(1), NOT_SPACE):
                own = _measured(words, offsets[lo : hi + 1] - offsets[lo], known)
                if model:
                    keep, weights, bias = model.value
                    row, column, value = _features(words)
                    at, there = chosen(column, keep)
                    own.append(logistic(bias + np.bincount(row[there], value[there] * weights[at[there]], hi - lo)) if len(keep) else np.full(hi - lo, float(logistic(np.array(bias)))))
                for part, x in zip(parts, own, strict=True):
                    part.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.concatenate([np.zeros(0), *x]) if k == "score" else np.concatenate([np.zeros(0, np.int64), *x])) for k, x in zip(names, parts, strict=True))],
                ["doc_id", *names],
            )

    return frame.mapInArrow(measure, "doc_id long, " + ", ".join(f"{k} {'double' if k == 'score' else 'long'}" for k in names))


def labellers(documents: DataFrame) -> tuple[float, np.ndarray]:
    """The prior of good and each labeller's P(vote | class), from the votes on all documents."""
    measured = _mapped(texts(documents))
    rows = measured.groupBy(*(v.alias(f"vote_{k}") for k, v in votes().items())).agg(F.count("*").alias("n")).collect()  # at most 3 ** 7
    patterns = np.array([[r[f"vote_{k}"] for k in votes()] for r in rows], np.int64).reshape(len(rows), len(votes()))
    return accuracies(patterns, np.array([r["n"] for r in rows], float))


def scored(documents: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id, posterior`` (of the labellers), ``score`` (0 to 1, of the linear model), ``keep`` (boolean: score is at least ``threshold``).

    Null and empty texts are judged like any other (their votes are those of a text without
    words). Rows that repeat a doc_id are judged one by one, and count one by one in the fit;
    rows without a doc_id are not fitted on. An empty table gives an empty result.
    """
    posterior = _odds(*labellers(documents))
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = texts(documents).join(F.broadcast(ids), "doc_id")  # at most max_train ids

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known()
        for batch in batches:
            columns, values, measures = [], [], [[] for _ in MEASURES]
            _, offsets = utf8(batch.column(1))
            for lo, hi, words in word_slices(batch.column(1), NOT_SPACE):
                row, column, value = _features(words)
                cuts = np.searchsorted(row, np.arange(1, hi - lo))
                columns += np.split(column.astype(np.int32), cuts)
                values += np.split(value.astype(np.float32), cuts)
                for part, x in zip(measures, _measured(words, offsets[lo : hi + 1] - offsets[lo], known), strict=True):
                    part += x.tolist()
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in measures), pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], [*MEASURES, "features", "values"]
            )

    got = sample.mapInArrow(featured, ", ".join(f"{k} long" for k in MEASURES) + ", features array<int>, values array<float>").select(posterior.alias("posterior"), "features", "values").toArrow()
    target = got.column("posterior").to_numpy()
    features, values = (got.column(k).combine_chunks() for k in ("features", "values"))
    column = features.flatten().to_numpy()
    keep = compact(column, 3, 20_000)
    rows = design(np.diff(features.offsets.to_numpy()), column, keep, values.flatten().to_numpy())
    weights, bias = fit(rows, target, len(keep), L1) if len(target) else (np.zeros(0), 0.0)
    model = documents.sparkSession.sparkContext.broadcast((keep, weights, bias))  # at most 20,000 weights
    return _mapped(texts(documents), model).select("doc_id", posterior.alias("posterior"), "score", (F.col("score") >= threshold).alias("keep"))
