from __future__ import annotations

import time

import pandas as pd

from proseloom.streaming import paragraphs as P


def feed(spark, path, batches, build, name, rows):
    """What the stream has released once there are ``rows`` rows; with a processing-time timeout it would run on for ever."""
    for k, batch in enumerate(batches):
        pd.DataFrame(batch, columns=["stream_id", "seq", "chunk", "last"]).to_parquet(f"{path}/{k:03d}.parquet")
    stream = spark.readStream.schema("stream_id string, seq long, chunk string, last boolean").option("maxFilesPerTrigger", 1).parquet(str(path))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/_state").start()
    until = time.time() + 90
    while time.time() < until and query.isActive and spark.table(name).count() < rows:
        time.sleep(0.5)
    query.stop()
    return spark.table(name).orderBy("stream_id", "n").collect()


def test_paragraphs_are_released_whole(spark, tmp_path):
    batches = [
        [("a", 1, "First para", False), ("b", 1, "```\ncode\n\nmore", False)],
        [("a", 2, "graph.\n\nSecond ", False), ("b", 2, "\n```\n\ntail", False)],
        [("a", 2, "graph.\n\nSecond ", False), ("a", 3, "one.", True), ("b", 3, "", True)],
    ]
    rows = feed(spark, tmp_path, batches, P.paragraphs, "released", 4)
    assert [(r.stream_id, r.text) for r in rows] == [("a", "First paragraph.\n\n"), ("a", "Second one."), ("b", "```\ncode\n\nmore\n```\n\n"), ("b", "tail")]


def test_edits_in_stream(spark, tmp_path):
    rows = feed(spark, tmp_path, [[("a", 1, "A cat — here.\n\n", False)], [("a", 2, "Two  spaces.", True)]], P.transformed, "edited", 2)
    assert "".join(r.text for r in rows) == "A cat, here.\n\nTwo spaces."


def test_newest_text_is_rechecked(spark, tmp_path):
    pd.DataFrame({"doc_id": [1, 1, 2], "version": [1, 2, 1], "text": ["old", "new", "x"]}).to_parquet(tmp_path / "0.parquet")
    seen = []
    stream = spark.readStream.schema("doc_id long, version long, text string").parquet(str(tmp_path))
    query = P.rechecked(stream, lambda frame, n: seen.extend((r.doc_id, r.text) for r in frame.collect())).option("checkpointLocation", str(tmp_path / "_s")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(seen) == [(1, "new"), (2, "x")]
