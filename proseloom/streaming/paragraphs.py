"""Streaming: texts that arrive in chunks, released by complete paragraphs; rechecks of changed documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from proseloom.operators import edits

OUT = "stream_id string, n long, text string"
STATE = "buffer string, n long, seq long"


def _boundary(buffer: str) -> int:
    """Just past the last blank line outside a code fence, or 0."""
    best, fenced, at = 0, False, 0
    for line in buffer.splitlines(keepends=True):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and line == "\n" and at and buffer[:at].strip():
            best = at + len(line)
        at += len(line)
    return best


def _release(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    buffer, n, seen = state.get if state.exists else ("", 0, -1)
    ended = False
    rows = pd.concat(list(frames), ignore_index=True) if not state.hasTimedOut else pd.DataFrame({"seq": [], "chunk": [], "last": []})
    for row in rows.sort_values("seq", kind="stable").itertuples():
        if row.seq <= seen:  # a chunk that comes again after a restart
            continue
        buffer, seen, ended = buffer + (row.chunk or ""), int(row.seq), ended or bool(row.last)
    cut = len(buffer) if ended or state.hasTimedOut else _boundary(buffer)
    out, buffer = buffer[:cut], buffer[cut:]
    if ended or state.hasTimedOut:
        state.remove()
    else:
        state.update((buffer, n + bool(out), seen))
        state.setTimeoutDuration(600_000)
    yield pd.DataFrame({"stream_id": [key[0]] * bool(out), "n": [n + 1] * bool(out), "text": [out] * bool(out)})


def paragraphs(chunks: DataFrame) -> DataFrame:
    """``stream_id, n, text``: of a stream of ``stream_id, seq, chunk, last``, whole paragraphs as they end.

    The last paragraph is held back until a chunk with ``last`` or ten minutes without one. A
    blank line within a code fence ends no paragraph. Chunks of one micro-batch are read by
    ``seq``; a chunk not above the last ``seq`` seen is a repeat and is dropped.
    """
    return chunks.groupBy("stream_id").applyInPandasWithState(_release, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def transformed(chunks: DataFrame, dashes: bool = True) -> DataFrame:
    """``paragraphs()`` with the house edits made in each released part."""
    out = paragraphs(chunks).withColumn("edits", edits.edits(F.col("text"), dashes=dashes))
    return out.select("stream_id", "n", edits.applied(F.col("text"), F.col("edits")).alias("text"))


def rechecked(changes: DataFrame, handle: Callable[[DataFrame, int], None]):
    """A writer that hands ``handle`` the newest text of each document (``doc_id, version, text``) of every micro-batch."""

    def newest(batch: DataFrame, number: int) -> None:
        handle(batch.groupBy("doc_id").agg(F.max_by("text", "version").alias("text")), number)

    return changes.writeStream.foreachBatch(newest)


def windowed_events(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An addition of this library: ``window_start, event_type, events, value`` in tumbling windows with a watermark."""
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return agg.select(F.col("window.start").alias("window_start"), "event_type", "events", "value")
