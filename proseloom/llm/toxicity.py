"""Toxicity: a hashed linear classifier with a counterfactual penalty.

A text's features are its distinct words and the beginnings of its words, hashed. Training
minimises the logistic loss with an L1 term, so that the many words without any bearing
get no weight and a long text is not judged by the sum of small ones. In each training
sentence that names a group, each group term (pronouns among them) is swapped for the others
of its kind, and the squared change of the sentence's score is penalised: a mention alone then
moves no score. Of a sentence and its counterpart only the features that differ matter: those of
the term that no other word of the sentence has, and those of the other term that none has. So
what a task hands over for a text is a number for each swap, with a bit for each feature that it
changes, and how often that occurs; not copies of its sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.llm._linear import Rows, chosen, compact, design, fit, logistic
from proseloom.llm._tables import texts
from proseloom.llm._words import ALPHANUMERIC, Words, utf8, word_slices

#: Rows to train on at most: the labelled rows with the smallest hash of their doc_id.
MAX_TRAIN = 6000
#: Features are hashed to this many bits; those in fewer training rows than LEAST_ROWS, or in at least the share MOST_SHARE of rows with label 0, have no weight.
HASH_BITS, LEAST_ROWS, MOST_SHARE, MOST_FEATURES = 26, 4, 0.15, 60_000
#: The L1 term is this over the root of the number of training rows; PENALTY weighs the counterfactual term.
L1, PENALTY = 0.03, 4.0
#: Bytes of a word's beginnings that are features besides the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
THRESHOLD = 0.7

#: Group terms that may stand in for each other, by kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind"),
    ("old", "young", "elderly"),
    ("he", "she"),
    ("him", "her"),
    ("his", "hers"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("er", "sie"),
    ("ihm", "ihr"),
    ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("il", "elle"),
    ("ils", "elles"),
    ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("él", "ella"),
    ("ellos", "ellas"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
_KIN = {term: [x for x in kind if x != term] for kind in IDENTITY_TERMS for term in kind}
_TERMS = sorted(_KIN)

def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, as two arrays."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix, row = words.prefix(), words.row()
    found = [prefix.of(words.starts, words.ends)]
    rows = [row]
    length = words.ends - words.starts
    for n in BEGINNINGS:
        keep = length > n
        found.append(prefix.of(words.starts[keep], words.starts[keep] + n) ^ np.uint64(n << 32))
        rows.append(row[keep])
    column = (np.concatenate(found) & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)
    pairs = np.unique((np.concatenate(rows) << HASH_BITS) | column)
    return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)


def _of_texts(many: list[str]) -> Rows:
    data, offsets = utf8(pa.array(many, pa.string()))
    row, column = _features(Words(data, offsets, ALPHANUMERIC, lower=True))
    return Rows(len(many), row, column)


class Swaps:
    """The swaps of each group term for its kin, with the features that they change: ``value`` 1 for those that go, -1 for those that come, in the order of ``row`` (the swap) and ``column``."""

    def __init__(self):
        self.pairs = [(t, kin) for t, term in enumerate(_TERMS) for kin in _KIN[term]]
        out, into = _of_texts([_TERMS[t] for t, _ in self.pairs]), _of_texts([kin for _, kin in self.pairs])
        row, column = np.concatenate((out.row, into.row)), np.concatenate((out.column, into.column))
        pairs, place = np.unique(row << HASH_BITS | column, return_inverse=True)
        summed = np.bincount(place, np.concatenate((np.ones(len(out.row)), -np.ones(len(into.row)))), len(pairs))
        keep = summed != 0  # beginnings that both words share do not change
        self.row, self.column, self.value = pairs[keep] >> HASH_BITS, pairs[keep] & ((1 << HASH_BITS) - 1), summed[keep]
        self.first = np.searchsorted(self.row, np.arange(len(self.pairs) + 1))
        term = np.array([t for t, _ in self.pairs])
        self.of_term = np.searchsorted(term, np.arange(len(_TERMS) + 1))  # pairs are in the order of their terms

    def rows(self, keys: np.ndarray, counts: np.ndarray) -> Rows:
        """What each key changes, scaled so that the mean over keys weighs each as often as it occurs."""
        swap, bits = keys >> BITS, keys & ((1 << BITS) - 1)
        size = np.diff(self.first)[swap]
        row = np.repeat(np.arange(len(keys)), size)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        on = (bits[row] >> place) & 1 == 1
        at = (self.first[swap[row]] + place)[on]
        weight = np.sqrt(counts / max(counts.sum(), 1) * len(keys))
        return Rows(len(keys), row[on], self.column[at], self.value[at] * weight[row[on]])


#: Features of one swap at most: two words with their beginnings.
BITS = 2 * (1 + len(BEGINNINGS))
_SENTENCE_ENDS = np.zeros(256, bool)
_SENTENCE_ENDS[list(b".!?\n")] = True


def offered(words: Words, swaps: Swaps) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every swap that a row's sentences offer, one for each sentence; a key is the swap's number and a bit for each feature that it changes there."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words):
        return none
    hashes = words.hashes()
    known = Words(*utf8(pa.array(_TERMS)), ALPHANUMERIC).hashes()
    order = np.argsort(known)
    at, there = chosen(hashes, known[order])
    where = np.flatnonzero(there)
    spelled = [words.data[a:b].tobytes().decode(errors="replace") for a, b in zip(words.starts[where].tolist(), words.ends[where].tolist(), strict=True)]
    term = order[at[where]]
    same = np.array([w == _TERMS[t] for w, t in zip(spelled, term.tolist(), strict=True)], bool)
    where, term = where[same], term[same]
    if not len(where):
        return none
    row = words.row()
    ended = np.cumsum(_SENTENCE_ENDS[words.data])[words.starts]
    sentence = np.cumsum(np.concatenate(([0], (np.diff(ended) > 0) | (np.diff(row) > 0))))
    named = np.unique(sentence[where] * len(_TERMS) + term)
    own, term = named // len(_TERMS), named % len(_TERMS)
    # how many distinct words of a sentence with a term have each feature
    inside = np.isin(sentence, own)
    pairs, first = np.unique(np.stack((sentence[inside], hashes[inside].astype(np.int64))), axis=1, return_index=True)
    place = np.flatnonzero(inside)[first]
    prefix, start, length = words.prefix(), words.starts[place], (words.ends - words.starts)[place]
    found, of = [prefix.of(start, start + length)], [pairs[0]]
    for n in BEGINNINGS:
        longer = length > n
        found.append(prefix.of(start[longer], start[longer] + n) ^ np.uint64(n << 32))
        of.append(pairs[0][longer])
    features = np.sort(np.concatenate(of) << HASH_BITS | (np.concatenate(found) & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64))
    # each swap of each named term, feature by feature
    n_swaps = np.diff(swaps.of_term)[term]
    swap = np.repeat(swaps.of_term[term], n_swaps) + np.arange(int(n_swaps.sum())) - np.repeat(np.cumsum(n_swaps) - n_swaps, n_swaps)
    sentences = np.repeat(own, n_swaps)
    size = np.diff(swaps.first)[swap]
    each = np.repeat(np.arange(len(swap)), size)
    bit = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    entry = swaps.first[swap[each]] + bit
    looked = sentences[each] << HASH_BITS | swaps.column[entry]
    held = np.searchsorted(features, looked, "right") - np.searchsorted(features, looked, "left")
    changes = held <= (swaps.value[entry] > 0)  # the term's own, or none
    bits = np.bincount(each, np.where(changes, 1 << bit, 0), len(swap)).astype(np.int64)
    row_of = row[np.searchsorted(sentence, sentences)]
    return row_of, swap.astype(np.int64) << BITS | bits


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the doc_id as text, modulo 3, is 1; rows without a doc_id are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


class Model:
    """swaps: counterfactual pairs that the fit saw, one for each sentence and swap."""

    def __init__(self, columns: np.ndarray, weights: np.ndarray, bias: float, swaps: int = 0):
        self.columns, self.weights, self.bias, self.swaps = columns, weights, bias, swaps

    def score(self, rows: Rows) -> np.ndarray:
        at, there = chosen(rows.column, self.columns)
        return logistic(self.bias + np.bincount(rows.row[there], self.weights[at[there]], rows.n)) if len(self.weights) else np.full(rows.n, float(logistic(np.array(self.bias))))


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, l1: float = L1, penalty: float = PENALTY) -> Model:
    """Fits on at most ``max_train`` labelled rows that are not held out, chosen by the hash of their doc_id.

    Rows with a null label, doc_id or text, and labels without a document, are left out. Of
    repeated labels of one document the largest counts; each row that repeats a doc_id counts.
    Without any row, every score is 0.5. A term of several words takes part in no swap.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    there = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    ids = there.join(marked, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = texts(documents.where("text is not null")).join(F.broadcast(ids), "doc_id")  # at most max_train ids

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swaps = Swaps()
        for batch in batches:
            each: list[np.ndarray] = []
            keys: list[np.ndarray] = []
            times: list[np.ndarray] = []
            for lo, hi, words in word_slices(batch.column("text"), ALPHANUMERIC, lower=True):
                row, column = _features(words)
                each += np.split(column.astype(np.int32), np.searchsorted(row, np.arange(1, hi - lo)))
                pairs, n = np.unique(np.stack(offered(words, swaps)), axis=1, return_counts=True)
                cuts = np.searchsorted(pairs[0], np.arange(1, hi - lo))
                keys += np.split(pairs[1], cuts)
                times += np.split(n, cuts)
            lists = [pa.array(each, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *lists], ["toxic", "features", "keys", "times"])

    found = sample.mapInArrow(featured, "toxic int, features array<int>, keys array<long>, times array<long>").toArrow()
    if not found.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    target = found.column("toxic").to_numpy().astype(float)
    features = found.column("features").combine_chunks()
    column = features.flatten().to_numpy()
    counts = np.diff(features.offsets.to_numpy())
    swaps = Swaps()
    keys, place = np.unique(found.column("keys").combine_chunks().flatten().to_numpy(), return_inverse=True)
    seen = np.bincount(place, found.column("times").combine_chunks().flatten().to_numpy(), len(keys))
    changes = swaps.rows(keys, seen)
    own = np.unique(changes.column)  # a few for each of the fixed swaps
    common = compact(column[np.repeat(target == 0, counts)], max(LEAST_ROWS, MOST_SHARE * (target == 0).sum()), len(column))
    keep = np.setdiff1d(compact(column, LEAST_ROWS, MOST_FEATURES - len(own)), common)
    keep = np.union1d(keep, np.intersect1d(column, own))
    rows = design(counts, column, keep)
    change = None
    if len(keys):
        at, there = chosen(changes.column, keep)
        change = Rows(len(keys), changes.row[there], at[there], changes.value[there])
    weights, bias = fit(rows, target, len(keep), l1 / len(target) ** 0.5, change, penalty)
    used = weights != 0
    return Model(keep[used], weights[used], bias, int(seen.sum()))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row; a null text counts as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for lo, hi, words in word_slices(batch.column(1), ALPHANUMERIC, lower=True):
                row, column = _features(words)
                parts.append(shared.value.score(Rows(hi - lo, row, column)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], ["doc_id", "score"])

    return texts(documents).mapInArrow(score, "doc_id long, score double")


def classified(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per document: ``doc_id, held_out`` (boolean), ``score`` (0 to 1), ``predicted`` (int, 1 from ``threshold`` on)."""
    found = scored(documents, train(documents, labels, max_train))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
