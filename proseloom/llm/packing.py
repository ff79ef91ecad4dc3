"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue: the stream of its documents' tokens, cut into slots of 128 tokens. The
round-robin works in virtual time, in which queue s earns its target share of a slot for each
unit that passes and carries what it has earned; a slot of it is served, and paid for, as soon
as its credit reaches one. So slot i of queue s is served at time (i + phase) / share(s), where
the phase in (0, 1), from the source's name, is what it lacks of its first slot. The deficit of
a queue at any time is thus known without running the slots before it: sorting slots by that
time gives the order of the round-robin, in parallel, with deficits carried across windows and
partitions, for any number of queues.

Each document is tokenized once. A task strings the documents of a source together and cuts
them there and then, so nothing but piece lengths and checksums leaves it. What a task has left
of a source, less than a slot, is cut at powers of two; these chunks, largest first, make up
further slots of the queue. What queues have left, less than a slot each, follows the last
slot in the same way, and the last, partial window is cut at powers of two: nothing is padded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.llm._tables import texts, written
from proseloom.llm._words import NOT_SPACE, Words, slices, utf8

WINDOW, UNIT, END = 2048, 128, 1
#: Words' parts whose ids a Python worker remembers at most; pieces of one batch, about; slots of one sorted bucket, about; rows summed up in one step of a running sum, about.
MOST_WORDS, BATCH, SPREAD, STEP = 2_000_000, 20_000, 1 << 13, 512

_known: dict[str, Ids] = {}

#: Symbols that the tokenizer cuts off an ASCII letter or digit before them.
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b",.;:!?&%*$#|")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
#: The splitting of texts that `_parts` follows.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _gathered(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of stretches from each start, one after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + length, length)


def _parts(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words' parts in turn, and each row's first part: symbols at a word's end are a part where the tokenizer cuts."""
    end = words.ends.copy()
    while True:
        drop = _SYMBOLS[words.data[end - 1]] & (end - 1 > words.starts)
        if not drop.any():
            break
        end -= drop
    cut = (end < words.ends) & _ALNUM[words.data[end - 1]]
    n = 1 + cut
    at = np.cumsum(n) - n
    starts, ends = np.empty(int(n.sum()), np.int64), np.empty(int(n.sum()), np.int64)
    starts[at], ends[at] = words.starts, np.where(cut, end, words.ends)
    starts[at[cut] + 1], ends[at[cut] + 1] = end[cut], words.ends[cut]
    return starts, ends, np.append(at, len(starts))[words.first]


def _by_words(path: str) -> bool:
    """Whether the tokenizer lower-cases, drops white space and splits as `_parts` expects."""
    found = json.loads(Path(path).read_text())
    steps = [x.get("type") for x in (found.get("normalizer") or {}).get("normalizers", [])]
    splits = [x.get("pattern", {}).get("Regex") for x in (found.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"]
    return steps == ["NFC", "Replace", "Lowercase"] and splits == [_SPLIT] and not found["model"].get("ignore_merges")


class Ids:
    """Token ids of whole texts, with the ids of words' parts seen before remembered.

    A tokenizer that lower-cases, splits and merges within white-space-separated words only and
    cuts a word where symbols follow a letter gives a text the ids of its parts in turn. Parts
    are looked up by a hash and compared by their bytes. Texts with a part that shares its hash
    with another, texts that may spell a special token and all texts of other tokenizers are
    encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), _by_words(path)
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.hashes, self.start, self.length, self.flat = np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint32)
        self.spelled, self.spelled_at, self.spelled_length = np.zeros(0, np.uint8), none, none

    @staticmethod
    def of(path: str) -> Ids:
        if path not in _known:
            _known[path] = Ids(path)
        return _known[path]

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, encoded as one text, and how many each has."""
        text = [w.decode() for w in words]
        size = np.fromiter(map(len, text), np.int64, len(text))
        encoded = self.tokenizer.encode(" ".join(text), add_special_tokens=False)
        at = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(encoded))
        own = np.searchsorted(np.cumsum(size + 1) - size - 1, at, "right") - 1
        return np.array(encoded.ids, np.uint32), np.bincount(own, minlength=len(words))

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        if len(self.hashes) > MOST_WORDS:
            self._clear()
        for lo in range(0, len(words), 20_000):
            some = words[lo : lo + 20_000]
            ids, length = self._encode(some)
            size = np.fromiter(map(len, some), np.int64, len(some))
            at = np.searchsorted(self.hashes, hashes[lo : lo + 20_000])
            new = {
                "hashes": hashes[lo : lo + 20_000],
                "start": len(self.flat) + np.cumsum(length) - length,
                "length": length,
                "spelled_at": len(self.spelled) + np.cumsum(size) - size,
                "spelled_length": size,
            }
            for name, values in new.items():
                setattr(self, name, np.insert(getattr(self, name), at, values))
            self.flat = np.concatenate((self.flat, ids))
            self.spelled = np.concatenate((self.spelled, np.frombuffer(b"".join(some), np.uint8)))

    def _place(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, found), max(len(self.hashes) - 1, 0))
        return at, self.hashes[at] == found if len(self.hashes) else np.zeros(len(found), bool)

    def _other(self, words: Words, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The parts that are not spelled as what was found for their hash."""
        size = ends - starts
        wrong = size != self.spelled_length[at]
        check = np.flatnonzero(~wrong)
        own, size = starts[check], size[check]
        ahead = np.repeat(self.spelled_at[at[check]] - own, size)
        place = _gathered(own, size)
        same = self.spelled[place + ahead] == words.data[place]
        if not same.all():
            wrong[check[np.searchsorted(np.cumsum(size), np.flatnonzero(~same), "right")]] = True
        return np.flatnonzero(wrong)

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as 32-bit little-endian integers, the end id last."""
        data, offsets = utf8(column)
        for lo, hi in slices(offsets):
            cuts, ids, whole = None, None, np.ones(hi - lo, bool)
            if self.by_words:
                words = Words(data, offsets[lo : hi + 1], NOT_SPACE, lower=True)
                starts, ends, first = _parts(words)
                distinct, where, own = np.unique(words.prefix().of(starts, ends), return_index=True, return_inverse=True)
                at, known = self._place(distinct)
                for _ in range(2):  # again where the store was emptied on the way
                    if known.all():
                        break
                    new = where[~known]
                    self._learn(distinct[~known], [words.data[a:b].tobytes() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
                    at, known = self._place(distinct)
                length = self.length[at][own]
                ids = self.flat[_gathered(self.start[at][own], length)]
                cuts = np.concatenate(([0], np.cumsum(length)))[first].tolist()
                whole[:] = False
                whole[np.searchsorted(first, self._other(words, starts, ends, at[own]), "right") - 1] = True
            for k in range(hi - lo):
                text = data[offsets[lo + k] : offsets[lo + k + 1]].tobytes()
                part = self._whole(text) if whole[k] or b"<|" in text else ids[cuts[k] : cuts[k + 1]]
                one = np.empty(len(part) + 1, "<u4")
                one[:-1], one[-1] = part, END
                yield one


class _Stream:
    """A task's part of one queue: full slots so far, and the pieces that wait for the next to fill."""

    def __init__(self):
        self.slots, self.held, self.waiting = 0, 0, []  # waiting: doc_id, start, ids as bytes, doc_tokens


def _cut(documents: DataFrame, path: str, source: str, unit: int) -> DataFrame:
    """Pieces: ``doc_id, start, length, ids_crc32, doc_tokens, queue, task, size`` (of the slot or chunk), ``slot`` (among the task's of that size), ``inside``."""
    names = "doc_id start length ids_crc32 doc_tokens queue task size slot inside".split()
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task = Ids.of(path), TaskContext.get().partitionId()
        streams: dict[str, _Stream] = {}
        made: list[tuple] = []

        def emitted() -> pa.RecordBatch:
            columns = zip(*made, strict=True) if made else [[] for _ in names]
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)
            made.clear()
            return out

        for batch in batches:
            docs, queues = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc, queue, one in zip(docs, queues, ids(batch.column(1)), strict=True):
                if (own := streams.get(queue)) is None:
                    own = streams[queue] = _Stream()
                data, n, at = memoryview(one).cast("B"), len(one), 0  # four bytes an id
                if own.held:
                    at = min(n, unit - own.held)
                    own.waiting.append((doc, 0, bytes(data[: 4 * at]), n))
                    own.held += at
                    if own.held == unit:
                        inside = 0
                        for d, start, some, tokens in own.waiting:
                            made.append((d, start, len(some) // 4, crc32(some), tokens, queue, task, unit, own.slots, inside))
                            inside += len(some) // 4
                        own.slots, own.held, own.waiting = own.slots + 1, 0, []
                stop = n - (n - at) % unit
                made += [(doc, k, unit, crc32(data[4 * k : 4 * (k + unit)]), n, queue, task, unit, own.slots + i, 0) for i, k in enumerate(range(at, stop, unit))]
                own.slots += (stop - at) // unit
                if stop < n:
                    own.waiting.append((doc, stop, bytes(data[4 * stop :]), n))
                    own.held += n - stop
                if len(made) >= BATCH:
                    yield emitted()
        for queue, own in streams.items():
            size, left = unit // 2, list(own.waiting)
            while size:
                if own.held & size:
                    inside = 0
                    while inside < size:
                        d, start, some, tokens = left[0]
                        take = min(len(some) // 4, size - inside)
                        made.append((d, start, take, crc32(some[: 4 * take]), tokens, queue, task, size, 0, inside))
                        inside += take
                        left[:1] = [(d, start + take, some[4 * take :], tokens)] if 4 * take < len(some) else []
                size //= 2
            if len(made) >= BATCH:
                yield emitted()
        yield emitted()

    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, queue string, task int, size int, slot long, inside int"
    return texts(documents, F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("queue")).mapInArrow(cut, schema)


def _running(frame: DataFrame, by: list[str], coarse: list[Column], order: list[str], value: Column, name: str) -> DataFrame:
    """The frame with the sum of ``value`` over all rows before, within ``by``, in the order of ``coarse`` and then ``order``: first over groups of equal ``coarse``, then inside each."""
    keys = [f"_g{k}" for k in range(len(coarse))]
    grouped = frame.select("*", value.alias("_v"), *(c.alias(k) for c, k in zip(coarse, keys, strict=True)))
    before = (Window.partitionBy(*by) if by else Window).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy(*by, *keys).agg(F.sum("_v").alias("_s")).select(*by, *keys, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy(*by, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = grouped.withColumn("_w", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return own.join(sums, [*by, *keys]).select(*frame.columns, (F.col("_b") + F.col("_w")).alias(name))


def _queues(groups: DataFrame, mixture: dict[str, float] | None, smoothing: float, unit: int) -> DataFrame:
    """Per queue: ``slots``, ``rest`` (tokens), ``weight``, ``phase``."""
    slots = F.floor(F.col("total") / unit).cast("long")
    found = groups.groupBy("queue").agg(F.sum("tokens").alias("total")).select("queue", slots.alias("slots"), (F.col("total") % unit).alias("rest"))
    share = F.pow(F.greatest("slots", F.lit(1)).cast("double"), F.lit(float(smoothing)))
    if mixture:
        if min(mixture.values()) <= 0:
            raise ValueError("mixture weights must be positive: a source of weight 0 would never be packed")
        wanted = groups.sparkSession.createDataFrame(sorted(mixture.items()), "queue string, factor double")
        if missing := [r["queue"] for r in wanted.join(found, "queue", "left_anti").take(5)]:
            raise ValueError(f"the mixture names sources that no document has: {missing}")
        found = found.join(wanted, "queue", "left")
        share = share * F.coalesce("factor", F.lit(1.0))
    phase = (F.pmod(F.xxhash64("queue"), F.lit(1000)) + 0.5) / 1000
    return found.select("queue", "slots", "rest", share.alias("weight"), phase.alias("phase"))


def packed(documents: DataFrame, tokenizer: str, source: str = "source", mixture: dict[str, float] | None = None, smoothing: float = 1.0, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (longs), ``queue`` (string).

    tokenizer: path of the vocabulary, readable on every node. The target share of a source is
    its number of tokens to the power ``smoothing`` (1: the natural mixture, 0: all alike),
    times its weight in ``mixture`` (default 1; a name that no document has is an error). A
    queue that runs dry leaves its share to the others. Each window holds each source's share to
    within two slots of ``unit`` tokens (a power of two), those at the end of the last window
    excepted. Null sources are one queue named "". A null or empty text is its end id alone.
    Every id lies in one piece; windows are filled without gaps; all hold ``window`` tokens but
    the last few, which have power-of-two lengths. The order of documents within a queue is
    that of the table's partitions.
    """
    pieces = written(_cut(documents, tokenizer, source, unit), "pieces")
    groups = written(pieces.groupBy("queue", "task", "size").agg(((F.max("slot") + 1) * F.first("size")).alias("tokens")), "piece-groups")
    placed = _running(groups, ["queue"], [-F.col("size"), F.floor(F.col("task") / STEP)], ["task"], F.col("tokens"), "begin")
    queues = written(_queues(groups, mixture, smoothing, unit), "queues")
    one = queues.agg(F.sum("slots").alias("slots"), F.sum("rest").alias("rest"), F.sum("weight").alias("weight")).first()
    n_slots, n_rest, rate = one["slots"] or 0, one["rest"] or 0, one["weight"] or 1.0
    base, total = n_slots * unit, n_slots * unit + n_rest

    # what a queue has left, in powers of two: where each of them goes
    sizes = [1 << b for b in reversed(range(unit.bit_length() - 1))]
    cut = queues.select("queue", F.explode(F.array(*(F.lit(s) for s in sizes))).alias("bit"), "rest").where(F.col("rest").bitwiseAND(F.col("bit").cast("long")) > 0)
    ends = _running(cut, [], [-F.col("bit"), F.pmod(F.xxhash64("queue"), F.lit(STEP))], ["queue"], F.col("bit").cast("long"), "place")
    last = ends.groupBy("queue").agg(F.map_from_entries(F.collect_list(F.struct("bit", F.col("place") + F.lit(base)))).alias("ends"))  # at most one entry a bit
    starts = placed.join(queues, "queue").join(last, "queue", "left").select("queue", "task", "size", "begin", "slots", "rest", "weight", "phase", "ends")

    at = F.col("begin") + F.col("slot") * F.col("size") + F.col("inside")
    slot, inside, over = F.floor(F.col("at") / unit).cast("long"), F.col("at") % unit, F.col("at") - F.col("slots") * unit
    high = {s: F.col("rest").bitwiseAND(F.lit(-2 * s).cast("long")) for s in sizes}
    fixed = F.coalesce(*(F.when((F.col("rest").bitwiseAND(F.lit(s).cast("long")) > 0) & over.between(high[s], high[s] + s - 1), F.element_at("ends", F.lit(s)) + over - high[s]) for s in sizes))
    due = (slot + F.col("phase")) / F.col("weight")
    timed = (
        pieces.join(starts, ["queue", "task", "size"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "queue", "rest", "slots", "weight", "phase", "ends", at.alias("at"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "queue", F.when(over >= 0, fixed).alias("fixed"), slot.alias("slot"), inside.alias("inside"), due.alias("due"))
        .withColumn("bucket", F.when(F.col("fixed").isNull(), F.floor(F.col("due") * (rate / SPREAD))))
    )
    timed = written(timed, "timed-pieces")
    counts = timed.where("fixed is null and inside = 0").groupBy("bucket").agg(F.count("*").alias("n"))
    earlier = written(_running(counts, [], [F.floor(F.col("bucket") / STEP)], ["bucket"], F.col("n"), "earlier").select("bucket", "earlier"), "slot-buckets")
    order = F.dense_rank().over(Window.partitionBy("bucket").orderBy("due", "queue", "slot")) - 1
    ranked = timed.where("fixed is null").select("*", order.alias("order")).join(earlier, "bucket")
    columns = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "queue"]
    everything = ranked.select(*columns, ((F.col("earlier") + F.col("order")) * unit + F.col("inside")).alias("place")).union(timed.where("fixed is not null").select(*columns, F.col("fixed").alias("place")))

    tail, sequence, begin = total - total % window, total // window, total - total % window
    number, offset = F.floor(F.col("place") / window).cast("long"), F.col("place") % window
    number, offset = F.when(F.col("place") < tail, number), F.when(F.col("place") < tail, offset)
    for size in (1 << b for b in reversed(range(window.bit_length()))):
        if total % window & size:
            here = F.col("place").between(begin, begin + size - 1)
            number, offset = number.when(here, F.lit(sequence).cast("long")), offset.when(here, F.col("place") - begin)
            sequence, begin = sequence + 1, begin + size
    return everything.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), offset.alias("offset"), "queue")
