"""Transport streams, packing and placement: exact round trips."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from proseloom.llm import packing, sharding, transport_stream
from proseloom.llm.queries import tokenizer_path


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_stream_round_trip(data):
    data = data + bytes(-len(data) % 64 if data else 64)
    stream = transport_stream.demux(transport_stream.mux(data))
    assert stream.payload[transport_stream.ES_PID] == data
    assert stream.programs == {1: transport_stream.PMT_PID} and not sum(stream.errors.values())


def test_stream_faults_are_counted():
    whole = transport_stream.mux(bytes(range(256)) * 200)
    assert transport_stream.demux(whole[: 188 * 5] + whole[188 * 6 :]).errors["continuity"] == 1
    assert transport_stream.demux(b"noise" + whole).errors["sync"] >= 1
    broken = bytearray(whole)
    broken[10] ^= 1
    assert transport_stream.demux(bytes(broken)).errors["crc"] == 1
    assert transport_stream.demux(whole[:-10]).errors["sync"] == 1
    stamps = transport_stream.demux(whole).units
    assert [u[1] for u in stamps] == [i * transport_stream.TICKS for i in range(len(stamps))]
    assert [u[3] for u in stamps] == [i % 8 == 0 for i in range(len(stamps))]


def test_stream_faults_that_are_none():
    ts = transport_stream
    whole = ts.mux(bytes(range(256)) * 400)
    packets = [whole[i : i + 188] for i in range(0, len(whole), 188)]
    clean = ts.demux(whole)
    own = [k for k, p in enumerate(packets) if p[1] & 0x1F == ts.ES_PID >> 8 and p[2] == ts.ES_PID & 0xFF and not p[3] & 0x20]
    twice = ts.demux(b"".join([*packets[: own[3] + 1], packets[own[3]], *packets[own[3] + 1 :]]))
    assert not sum(twice.errors.values()) and twice.payload == clean.payload
    assert ts.demux(b"".join([*packets[: own[3] + 1], *[packets[own[3]]] * 2, *packets[own[3] + 1 :]])).errors["continuity"] == 1
    jump = bytes([0x47, 1, 0, 0x30 | packets[own[3]][3] + 5 & 15, 1, 0x80]) + bytes(182)
    assert ts.demux(b"".join([*packets[: own[3] + 1], jump])).errors["continuity"] == 0
    # a program map over two packets, after a table that names the network
    pat = ts._table_packet(0, ts._section(0, 1, bytes([0, 0, 0xE0, 0x10, 0, 1, 0xF0, 0])))
    streams = b"".join(bytes([6]) + (0xE000 | 0x100 + k).to_bytes(2, "big") + b"\xf0\0" for k in range(50))
    section = ts._section(2, 1, (0xE000 | 0x100).to_bytes(2, "big") + b"\xf0\0" + streams)
    head = bytes([0x47, 0x50, 0, 0x10, 0]) + section[:183], bytes([0x47, 0x10, 0, 0x11]) + section[183:].ljust(184, b"\xff")
    found = ts.demux(pat + b"".join(head))
    assert found.programs == {1: 0x1000} and len(found.streams) == 50 and not sum(found.errors.values())
    assert ts.demux(pat + head[0]).errors["crc"] == 1


def test_media_of_documents(documents, empty, rows):
    found = transport_stream.parsed(transport_stream.media(documents)).collect()
    assert all(len(r.pts) == len(r.sizes) == len(r.random_access) and sum(r.sizes) == r.payload_bytes and not r.errors for r in found)
    texts = Counter((i, t or "") for i, t, *_ in rows)
    assert len(found) == len(rows)
    want = Counter()
    for (i, t), n in texts.items():
        size, data = transport_stream.padded(t)
        want[i, size, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])] += n
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == want
    assert transport_stream.parsed(transport_stream.media(empty)).count() == 0


def many_sources(spark):
    return spark.createDataFrame([(i, f"word {i} of many " * (i % 37), f"s{i % 150}" if i % 3 else "hot") for i in range(900)], "doc_id long, text string, source string").repartition(3)


@pytest.mark.parametrize(("mixture", "smoothing", "many"), [(None, 1.0, False), ({"a": 5.0, "": 0.5}, 1.0, False), (None, 0.7, True)])
def test_packing_is_exact(spark, unique, mixture, smoothing, many):
    documents = many_sources(spark) if many else unique
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in documents.collect()}
    rows = packing.packed(documents, tokenizer_path(), mixture=mixture, smoothing=smoothing).collect()
    pieces: dict = {}
    sequences: dict = {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, size in [(pieces[i], len(x)) for i, x in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == size if size is not None else at == 2048 or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))


def test_windows_hold_the_target_shares(spark):
    rows = [(i, "word " * 300, "a" if i % 4 else "b") for i in range(400)]
    found = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), tokenizer_path(), mixture={"b": 2.0})
    by_window = found.groupBy("sequence_id").pivot("queue", ["a", "b"]).sum("length").na.fill(0).orderBy("sequence_id").collect()
    full = [r for r in by_window if r.a + r.b == 2048 and r.b]
    assert len(full) > 30
    assert all(abs(r.b - 0.4 * 2048) <= 256 for r in full[:-1])  # b: a quarter of the tokens, of double weight; it runs dry first
    assert abs(sum(r.b for r in full[:20]) - 0.4 * 2048 * 20) <= 256  # deficits are carried, so they don't add up


def test_order_is_that_of_carried_deficits(spark):
    """Against a plain loop: queues earn their weight, the first to hold a whole slot's credit is served and pays for it."""
    documents = many_sources(spark).where("text != ''")
    rows = packing.packed(documents, tokenizer_path(), smoothing=0.7).collect()
    slots: dict = {}
    for r in rows:
        at = r.sequence_id * 2048 + r.offset
        slots.setdefault(at // packing.UNIT, {}).setdefault(r.queue, 0)
        slots[at // packing.UNIT][r.queue] += r.length
    tokens: dict = {}
    for r in rows:
        tokens[r.queue] = tokens.get(r.queue, 0) + r.length
    left = {q: n // packing.UNIT for q, n in tokens.items()}
    phase = {r.queue: r.p for r in spark.createDataFrame([(q,) for q in tokens], "queue string").selectExpr("queue", "(pmod(xxhash64(queue), 1000) + 0.5D) / 1000 p").collect()}
    weight = {q: max(n, 1) ** 0.7 for q, n in left.items()}
    credit = {q: 1 - phase[q] for q in left}
    want = []
    while live := [q for q in left if left[q]]:
        step, queue = min(((1 - credit[q]) / weight[q], q) for q in live)
        for q in live:
            credit[q] += step * weight[q]
        credit[queue] -= 1
        left[queue] -= 1
        want.append(queue)
    assert len(want) > 100 and [list(slots[k]) for k in range(len(want))] == [[q] for q in want]


def test_mixture_of_no_source(unique):
    with pytest.raises(ValueError, match="nowhere"):
        packing.packed(unique, tokenizer_path(), mixture={"nowhere": 2.0})


def test_ids_of_words_that_collide():
    """Thue-Morse words share every polynomial hash modulo a power of two."""
    import pyarrow as pa

    a, b = "ab", "ba"
    for _ in range(10):
        a, b = a + b, b + a
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for texts in ([a, b], [f"x {a} y", f"x {b} y", "z"], [b], [a]):
        found = list(packing.Ids.of(tokenizer_path())(pa.array(texts, pa.string())))
        assert [x.tolist() for x in found] == [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_ids_of_another_tokenizer():
    import pyarrow as pa

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["Some Words,  and more", "", "grün"]
    assert [x.tolist() for x in packing.Ids.of(path)(pa.array(texts))] == [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB,.!'s-é́İßΣ 1٣<|\n\x85&😀中")), max_size=40), max_size=12))
def test_ids_are_the_tokenizers(texts):
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(tokenizer_path())
    found = list(packing.Ids.of(tokenizer_path())(pa.array(texts, pa.string())))
    assert [x.tolist() for x in found] == [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_packing_empty(empty):
    assert packing.packed(empty, tokenizer_path()).count() == 0


def test_table_is_even_and_stable():
    shards = [f"s{i}" for i in range(20)]
    table = sharding.filled(shards, 5003)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.filled(shards[:-1], 5003)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 19)
    assert moved / 5003 < 0.15
    with pytest.raises(ValueError):
        sharding.filled(shards, 5000)
    with pytest.raises(ValueError):
        sharding.filled([], 7)


def test_placement(documents, empty):
    shards = ["x", "y", "z"]
    found = sharding.placed(documents.withColumnRenamed("label", "shard"), "doc_id", shards, 101)
    assert found.count() == documents.count() and set(found.columns) >= {"slot", "shard", "node"}
    table = sharding.filled(shards, 101)
    for r in found.collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, shards[table[slot]])
    assert sharding.placed(empty, "doc_id", shards, 101).count() == 0


def test_placement_leaves_columns_of_any_name_alone(spark):
    frame = spark.createDataFrame([(1, "a", "b", "c", "d", "e")], "key long, __slot string, __shard string, Slot string, slot_of_table string, `shard of.x` string")
    found = sharding.placed(frame, "key", ["one", "two"], 101)
    assert found.columns == ["key", "__slot", "__shard", "slot_of_table", "shard of.x", "slot", "shard"]
    row = found.first()
    assert tuple(row)[:5] == (1, "a", "b", "d", "e") and row.shard == ["one", "two"][sharding.filled(["one", "two"], 101)[row.slot]]
