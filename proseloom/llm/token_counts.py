"""Token counts by a tokenizer compiled to two finite-state transducers.

The first cuts a text into pieces as byte-level tokenizers do. It reads classes of characters
and has thirteen states; each transition tells whether a piece begins at the character before
or at the character itself. A slice of texts is cut into chunks of equal length. Every chunk
maps each state it may be entered in to the state it is left in; a prefix scan composes these
maps, after which all chunks run at once from the states they are really entered in.

The second reads a piece byte by byte. Each transition carries the number of tokens by which
the count of the piece so far changes. Its states are compiled when a text first needs them:
a state holds every beginning of a token that the bytes so far end with, together with the
token before that beginning, which is all that later bytes can depend on. The last token of
a text so far is the one token that ends it and stays apart from the last token before it
(Berglund and van der Merwe, "Formalizing BPE Tokenization"; tokens stay apart if no merge
crosses their border). No merge loop runs over a text.

Special tokens in a text count as one token each and part the text, the library's default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.llm._tables import texts
from proseloom.llm._words import identities, slices, utf8

#: Tokens beyond which a text is over the limit; characters of a chunk; transitions that a worker remembers at most (they are compiled again when needed).
LIMIT, CHUNK, MOST_TRANSITIONS = 1024, 128, 500_000

#: Classes of characters. A text's first character has its class plus FIRST.
LETTER, ENDING, R, V, E, L, NUMBER, OTHER, QUOTE, SPACE, WHITE = range(11)
FIRST = 11
#: States: nothing read; inside letters, numbers, other characters; an apostrophe that begins a piece; it and r, v or l; a contraction; one space or white character; several that end with a space or white character.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CONTRACTED, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE = range(13)
#: What a transition tells: a piece begins here, a piece begins one character before.
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and outputs by class and state."""
    goes, says = np.zeros((2 * FIRST, 13), np.uint8), np.zeros((2 * FIRST, 13), np.uint8)
    letters = (LETTER, ENDING, R, V, E, L)
    fresh = dict.fromkeys(letters, IN_LETTERS) | {NUMBER: IN_NUMBERS, OTHER: IN_OTHER, QUOTE: AFTER_QUOTE, SPACE: ONE_SPACE, WHITE: ONE_WHITE}
    joined = fresh | {QUOTE: IN_OTHER}
    half = {QUOTE_R: R, QUOTE_V: V, QUOTE_L: L}
    more = {SPACE: MORE_SPACE, WHITE: MORE_WHITE}
    for c in range(FIRST):
        white = c in more
        for s in range(13):
            to, out = fresh[c], HERE
            if (s == IN_LETTERS and c in letters) or (s == IN_NUMBERS and c == NUMBER):
                to, out = s, 0
            elif s in (IN_OTHER, AFTER_QUOTE) and c in (OTHER, QUOTE):
                to, out = IN_OTHER, 0
            elif s == AFTER_QUOTE and c in (ENDING, R, V, L):
                to, out = {ENDING: CONTRACTED, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
            elif s in half:
                if c == (L if s == QUOTE_L else E):
                    to, out = CONTRACTED, 0
                else:  # the apostrophe was a piece, and the letter begins the next
                    to, out = (IN_LETTERS, BEFORE) if c in letters else (fresh[c], BEFORE | HERE)
            elif s >= ONE_SPACE and white:
                to, out = more[c], 0
            elif s == ONE_SPACE:
                to, out = joined[c], 0
            elif s == MORE_SPACE:
                to, out = joined[c], BEFORE
            elif s == MORE_WHITE:
                out = BEFORE | HERE
            goes[c, s], says[c, s] = to, out
        goes[c + FIRST] = fresh[c]
        says[c + FIRST] = [HERE | (BEFORE if s in half else 0) for s in range(13)]
    return goes, says


GOES, SAYS = _splitter()


def entered(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The state each chunk of the classes is entered in, by a prefix scan over the chunks' state maps. The last chunk may be short."""
    n = -(-len(classes) // chunk)
    padded = np.zeros(n * chunk, np.uint8)
    padded[: len(classes)] = classes
    columns = np.ascontiguousarray(padded.reshape(n, chunk).T)
    flat = GOES.ravel()
    maps = np.tile(np.arange(13, dtype=np.uint8), (n, 1))
    for column in columns:
        maps = flat[column[:, None] * np.uint16(13) + maps]
    reach = 1
    while reach < n:  # after each round a map covers twice as many chunks
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
        reach *= 2
    return np.concatenate(([START], maps[:-1, START])).astype(np.uint8)


def begins(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Which characters begin a piece."""
    if not len(classes):
        return np.zeros(0, bool)
    state = entered(classes, chunk)
    n = len(state)
    padded = np.zeros(n * chunk, np.uint8)
    padded[: len(classes)] = classes
    columns = np.ascontiguousarray(padded.reshape(n, chunk).T)
    said = np.empty((chunk, n), np.uint8)
    goes, says = GOES.ravel(), SAYS.ravel()
    for k, column in enumerate(columns):
        at = column * np.uint16(13) + state
        said[k], state = says[at], goes[at]
    said = said.T.ravel()
    found = (said & HERE).astype(bool)[: len(classes)]
    found[:-1] |= (said[1 : len(classes)] & BEFORE).astype(bool)
    return found


class Counter:
    """The compiled tokenizer of one file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text())
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if model.get("type", "BPE") != "BPE" or not plain or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens take more than their own characters")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added else None
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.classes = np.full(0x110000, 255, np.uint8)
        for c, kind in (("stmd", ENDING), ("r", R), ("v", V), ("e", E), ("l", L), ("'", QUOTE), (" ", SPACE)):
            self.classes[[ord(x) for x in c]] = kind
        self._read(model)
        self._forget()

    def _read(self, model: dict) -> None:
        """Merges by rank, how each token came about, and the beginnings of tokens as a tree."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        spelled = {t: i for t, i in model["vocab"].items() if all(c in byte for c in t)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        sound = {i for t, i in spelled.items() if len(t) == 1}
        for n, (a, b) in enumerate(pairs):
            pair, whole = (spelled[a], spelled[b]), spelled[a + b]
            self.rank.setdefault(pair, n)
            self.made.setdefault(whole, (*pair, n))
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        for n, (a, b) in enumerate(pairs):  # a token counts only if its own bytes come out as it
            pair, whole = (spelled[a], spelled[b]), spelled[a + b]
            if sound.issuperset(pair) and self.made[whole][2] == n and self._crossing(*pair) == n:
                sound.add(whole)
        self.tree, self.token = {}, [-1]
        for t, i in spelled.items():
            if i not in sound:
                continue
            node = 0
            for c in t:
                step = node << 8 | byte[c]
                node = self.tree.get(step, 0) or self.tree.setdefault(step, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
        self.open = {step >> 8 for step in self.tree}

    def _forget(self) -> None:
        """Only the state that every piece begins in."""
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.go: dict[int, tuple[int, int]] = {}

    def _edge(self, token: int, side: int, known: dict) -> list[tuple[int, float]]:
        """The tokens at an edge of a token while it grows, each with the rank of the merge that ends it there."""
        if token not in known:
            made = self.made.get(token)
            known[token] = [(token, float("inf"))] + ([(t, min(until, made[2])) for t, until in self._edge(made[side], side, known)] if made else [])
        return known[token]

    def _crossing(self, a: int, b: int) -> int:
        """The lowest rank of a merge across the border of two tokens; -1 if they stay apart. Of equal merges the leftmost comes first."""
        found = [r for x, ends in self._edge(a, 1, self._right) for y, until in self._edge(b, 0, self._left) if (r := self.rank.get((x, y), -1)) >= 0 and r < ends and r <= until]
        return min(found, default=-1)

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """Compiles one transition: the next state and the change of the count."""
        ahead, last = [], None
        for node, before, count in self.states[state]:
            child = self.tree.get(node << 8 | byte)
            if child is None:
                continue
            token = self.token[child]
            if token >= 0 and last is None and (before < 0 or self._crossing(before, token) < 0):
                last = (token, count + 1)
            if child in self.open:
                ahead.append((child, before, count))
        if last is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        token, change = last
        key = (*((node, before, count - change) for node, before, count in ahead), (0, token, 0))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        self.go[state << 8 | byte] = found = (self.number[key], change)
        return found

    def piece(self, data: bytes) -> int:
        """Tokens of one piece."""
        state = total = 0
        go = self.go
        for byte in data:
            step = go.get(state << 8 | byte) or self._step(state, byte)
            state = step[0]
            total += step[1]
        return total

    def _class(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points; those not met before are told by the library's own splitter."""
        found = self.classes[points]
        if (found == 255).any():
            for c in np.unique(points[found == 255]).tolist():
                with_it = (kind for kind, sign in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.library.pre_tokenize_str(sign + chr(c))) == 1)
                self.classes[c] = next(with_it, WHITE)
            found = self.classes[points]
        return found

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text: text i is ``data[offsets[i]:offsets[i + 1]]``."""
        base = int(offsets[0])
        data, offsets = data[base : int(offsets[-1])], offsets - base
        total = np.zeros(len(offsets) - 1, np.int64)
        if not len(data):
            return total
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        classes = self._class(_points(data, lead))
        cuts, special = [offsets[:-1][np.diff(offsets) > 0]], []
        if self.added:
            text, at = data.tobytes(), 0
            while found := self.added.search(text, at):
                a, b = found.span()
                row = int(np.searchsorted(offsets, a, "right")) - 1
                inside = b <= offsets[row + 1]
                at = b if inside else a + 1
                if inside:
                    special.append(a)
                    total[row] += 1
                    cuts.append(np.array([a, b] if b < len(data) else [a]))
        first = np.zeros(len(lead), bool)
        first[np.searchsorted(lead, np.concatenate(cuts))] = True
        begin = begins(np.where(first, classes + np.uint8(FIRST), classes))
        starts = lead[begin]
        ends = np.append(starts[1:], len(data))
        if special:  # a special token's pieces count as none
            bounds = np.sort(np.concatenate((*cuts, [len(data)])))
            own = bounds[np.searchsorted(bounds, starts, "right") - 1]
            keep = ~np.isin(own, special)
            starts, ends = starts[keep], ends[keep]
        ids, sample = identities(data, starts, ends)
        if len(self.go) > MOST_TRANSITIONS:
            self._forget()
        text = data.tobytes()
        each = np.fromiter((self.piece(text[a:b]) for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)), np.int64, len(sample))
        sums = np.concatenate(([0], np.cumsum(each[ids])))
        at = np.searchsorted(starts, offsets)
        return total + sums[at[1:]] - sums[at[:-1]]


def _points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 at their first bytes."""
    byte = data[lead]
    points = byte.astype(np.int32)
    for size, low, high, mask in ((2, 0xC0, 0xDF, 0x1F), (3, 0xE0, 0xEF, 0x0F), (4, 0xF0, 0xF7, 0x07)):
        at = np.flatnonzero((byte >= low) & (byte <= high))
        value = points[at] & mask
        for k in range(1, size):
            value = value << 6 | (data[lead[at] + k] & 0x3F)
        points[at] = value
    return points


_compiled: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The compiled tokenizer of a file, once in each worker."""
    if path not in _compiled:
        _compiled[path] = Counter(path)
    return _compiled[path]


def counted(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes`` (of UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens) for each row.

    Texts are whole; a null text is empty and has no tokens. Rows are judged each on its own,
    so repeated doc_ids, ties and other columns make no difference, and an empty table gives no
    rows. Nothing is shuffled. A text of any length takes time linear in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = counter(path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n = [compiled.counts(data, offsets[lo : hi + 1]) for lo, hi in slices(offsets)]
            tokens = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    found = texts(documents).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
