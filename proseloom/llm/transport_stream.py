"""MPEG transport streams as media columns: write payloads as one program, parse and check streams.

A stream is 188-byte packets: a program association table, a program map table, then
packetised elementary packets of private data. Each elementary packet ("access unit") has a
presentation timestamp; the first of each group is a random-access point, flagged in the
adaptation field with a program clock reference.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from proseloom.llm._tables import texts
from proseloom.llm._words import slices, utf8

#: Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, PRIVATE_PES, CLOCK = 188, 0x47, 0x0000, 0x1000, 0x0100, 0x06, 90_000
STREAM_ID = 0xBD
#: Payload bytes of one access unit, ticks between units (25 a second), units between random-access points; before each of these the tables are repeated.
UNIT, TICKS, RANDOM_ACCESS_EVERY = 4096, CLOCK // 25, 8
ALIGN = 64
_CRC = np.zeros(256, np.uint64)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if _c & 0x80000000 else (_c << 1) & 0xFFFFFFFF
    _CRC[_i] = _c
_CRC_LIST = _CRC.tolist()


def crc_mpeg(data: bytes) -> int:
    """The CRC-32 of program tables: polynomial 0x04C11DB7, not reflected, all ones first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC_LIST[(crc >> 24) ^ byte]
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0"
    return (head + section).ljust(PACKET, b"\xff")


def _counted(packet: bytes, counter: int) -> bytes:
    return packet[:3] + bytes([packet[3] | counter & 15]) + packet[4:]


_PAT = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0"))


def _stamp(ticks: int) -> bytes:
    t = ticks & ((1 << 33) - 1)
    return bytes([0x21 | (t >> 29) & 0x0E, t >> 22 & 0xFF, (t >> 14 & 0xFE) | 1, t >> 7 & 0xFF, (t << 1 & 0xFE) | 1])


def _unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream with one program of one elementary stream."""
    out = []
    counter = tables = 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        data = b"\0\0\1" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(unit * TICKS) + data
        pcr = b""
        if unit % RANDOM_ACCESS_EVERY == 0:
            out += [_counted(_PAT, tables), _counted(_PMT, tables)]
            tables += 1
            pcr = b"\x07\x50" + (((unit * TICKS) & ((1 << 33) - 1)) << 15 | 0x7E00).to_bytes(6, "big")
        first = PACKET - 4 - len(pcr)
        heads = [data[:first], *(data[i : i + PACKET - 4] for i in range(first, len(data), PACKET - 4))]
        for n, part in enumerate(heads):
            field_ = pcr if n == 0 else b""
            if spare := PACKET - 4 - len(field_) - len(part):
                if field_:
                    field_ = bytes([field_[0] + spare]) + field_[1:] + b"\xff" * spare
                else:
                    field_ = b"\0" if spare == 1 else bytes([spare - 1, 0]) + b"\xff" * (spare - 2)
            out.append(bytes([SYNC, (0x40 if n == 0 else 0) | ES_PID >> 8, ES_PID & 0xFF, (0x30 if field_ else 0x10) | counter]) + field_ + part)
            counter = (counter + 1) & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds. ``errors`` counts lost sync bytes, bad or truncated tables, continuity breaks (of any packets' counter) and truncated units."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    packets: int = 0
    errors: dict[str, int] = field(default_factory=lambda: {"sync": 0, "crc": 0, "continuity": 0, "unit": 0})
    units: list[tuple[int, int, int, bool]] = field(default_factory=list)  # pid, timestamp (-1: none), bytes, random access
    clocks: list[int] = field(default_factory=list)
    payload: dict[int, bytes] = field(default_factory=dict)


def _sections(packets: np.ndarray, body: np.ndarray, begins: np.ndarray, stream: Stream) -> Iterator[bytes]:
    """The sections of one table's packets, in one packet or over several."""
    held = b""

    def whole(last: bool) -> Iterator[bytes]:
        nonlocal held
        while held and held[0] != 0xFF:  # 0xFF: stuffing up to the packet's end
            size = 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF) if len(held) >= 3 else 0
            if not size or len(held) < size:
                if last:
                    stream.errors["crc"] += 1
                    held = b""
                return
            section, held = held[:size], held[size:]
            if size < 12 or crc_mpeg(section):
                stream.errors["crc"] += 1
            else:
                yield section
        held = b""

    for packet, at, first in zip(packets, body.tolist(), begins.tolist(), strict=True):
        payload = packet[at:].tobytes()
        if not payload:
            continue
        if first:
            pointer = payload[0]
            held = held + payload[1 : 1 + pointer] if held else b""
            yield from whole(last=True)
            held = payload[1 + pointer :]
        elif held:
            held += payload
        yield from whole(last=False)
    yield from whole(last=True)


def _continuity(counter: np.ndarray, signalled: np.ndarray, packets: np.ndarray, stream: Stream) -> np.ndarray:
    """Counts the breaks of one elementary stream's counter; which packets to read: one that repeats its predecessor is legal and dropped. A signalled discontinuity is no break."""
    step = np.diff(counter.astype(np.int64)) & 15
    again = np.zeros(len(counter), bool)
    same = np.flatnonzero(step == 0) + 1
    again[same] = (packets[same] == packets[same - 1]).all(1)
    again[1:] &= ~again[:-1]  # once only
    stream.errors["continuity"] += int(((step != 1) & ~again[1:] & ~signalled[1:]).sum())
    return ~again


def demux(data: bytes) -> Stream:
    """Parses a stream: tables, continuity counters, elementary packets with timestamps and random-access points.

    Bytes that don't begin a packet are skipped up to the next sync byte and counted; a
    truncated last packet is dropped and counted.
    """
    stream = Stream()
    tail = len(data) % PACKET
    packets = np.frombuffer(data, np.uint8, len(data) - tail).reshape(-1, PACKET)
    if tail or (packets[:, 0] != SYNC).any():
        at, found = 0, []
        while at + PACKET <= len(data):
            if data[at] == SYNC and (at + PACKET == len(data) or at + PACKET < len(data) and data[at + PACKET] == SYNC):
                found.append(data[at : at + PACKET])
                at += PACKET
            else:
                stream.errors["sync"] += 1
                at = data.find(bytes([SYNC]), at + 1)
                at = len(data) if at < 0 else at
        stream.errors["sync"] += at < len(data)
        packets = np.frombuffer(b"".join(found), np.uint8).reshape(-1, PACKET)
    stream.packets = len(packets)
    pid = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    begins, has_field, has_payload, counter = packets[:, 1] & 0x40 > 0, packets[:, 3] & 0x20 > 0, packets[:, 3] & 0x10 > 0, packets[:, 3] & 15
    body = 4 + np.where(has_field, packets[:, 4].astype(np.int64) + 1, 0)
    signalled = has_field & (packets[:, 4] > 0) & (packets[:, 5] & 0x80 > 0)

    def read(one: int) -> np.ndarray:
        own = np.flatnonzero((pid == one) & has_payload)
        return own[_continuity(counter[own], signalled[own], packets[own], stream)] if len(own) else own

    def sections(one: int, table: int) -> Iterator[bytes]:
        own = read(one)
        return (x for x in _sections(packets[own], np.minimum(body[own], PACKET), begins[own], stream) if x[0] == table)

    for section in sections(PAT_PID, 0):
        for i in range(8, len(section) - 4, 4):
            if number := int.from_bytes(section[i : i + 2], "big"):  # program 0 is the network's table
                stream.programs[number] = int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
    for one in sorted(set(stream.programs.values())):
        for section in sections(one, 2):
            at = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
            while at + 5 <= len(section) - 4:
                stream.streams[int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF] = section[at]
                at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0x0FFF)
    for one in stream.streams:
        own = read(one)
        if not len(own):
            continue
        mask = np.arange(PACKET) >= np.minimum(body[own], PACKET)[:, None]
        flat = packets[own][mask].tobytes()
        ends = np.cumsum(mask.sum(1))
        starts = np.flatnonzero(begins[own])
        offsets = (ends - mask.sum(1))[starts].tolist() + [len(flat)]
        parts = []
        for k, (lo, hi) in enumerate(zip(offsets, offsets[1:], strict=False)):
            unit, packet = flat[lo:hi], packets[own[starts[k]]]
            random_access = bool(packet[3] & 0x20 and packet[4] and packet[5] & 0x40)
            if packet[3] & 0x20 and packet[4] >= 7 and packet[5] & 0x10:
                stream.clocks.append(int.from_bytes(packet[6:12].tobytes(), "big") >> 15)
            if unit[:3] != b"\0\0\1" or len(unit) < 9:
                stream.errors["unit"] += 1
                continue
            length, skip = int.from_bytes(unit[4:6], "big"), 9 + unit[8]
            stop = 6 + length if length else len(unit)
            stream.errors["unit"] += len(unit) < stop
            content = unit[skip:stop]
            stream.units.append((one, _unstamp(unit[9:14]) if unit[7] & 0x80 else -1, len(content), random_access))
            parts.append(content)
        stream.payload[one] = b"".join(parts)
    return stream


def feature(stream: Stream) -> str:
    """Tables, units, timestamps and random-access points, as one string."""
    stamps = [t for _, t, _, _ in stream.units if t >= 0]
    return (
        f"programs={','.join(f'{p}:{m}' for p, m in sorted(stream.programs.items()))};streams={','.join(f'{p}:{k}' for p, k in sorted(stream.streams.items()))};"
        f"packets={stream.packets};units={len(stream.units)};errors={','.join(f'{k}:{v}' for k, v in stream.errors.items())};"
        f"pts={stamps[0] if stamps else -1}-{stamps[-1] if stamps else -1};rap={','.join(str(i) for i, u in enumerate(stream.units) if u[3])};pcr={len(stream.clocks)}"
    )


def padded(text: str) -> tuple[int, bytes]:
    """Bytes of the text in UTF-8, and the text with bytes 0 up to a positive multiple of 64."""
    data = text.encode()
    return len(data), data + bytes(-len(data) % ALIGN if data else ALIGN)


def media(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` (binary): every text stored as a transport stream; null counts as empty."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(utf8(batch.column(1))[1]):  # so many bytes at a time: media are larger than texts
                part = batch.slice(lo, hi - lo)
                made = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([mux(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(documents).mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def parsed(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads a ``media`` column back: the key and ``n_bytes``, digests of payload and media, ``feature``, units as ``pids, pts, sizes, random_access`` arrays, ``errors``.

    A null or empty medium has no packets, an empty payload and no units.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy().astype(np.int64))))
            for lo, hi in slices(sizes):
                part = batch.slice(lo, hi - lo)
                rows = []
                for data in part.column(2).to_pylist():
                    stream = demux(data or b"")
                    payload = b"".join(stream.payload[p] for p in sorted(stream.payload))
                    pids, pts, sizes, random_access = (list(x) for x in zip(*stream.units, strict=True)) if stream.units else ([], [], [], [])
                    rows.append(
                        {
                            "payload_bytes": len(payload),
                            "payload_sha256": hashlib.sha256(payload).hexdigest(),
                            "tail_crc32": zlib.crc32(payload[-ALIGN:]),
                            "media_bytes": len(data or b""),
                            "media_sha256": hashlib.sha256(data or b"").hexdigest(),
                            "feature": feature(stream),
                            "pids": pids,
                            "pts": pts,
                            "sizes": sizes,
                            "random_access": random_access,
                            "errors": sum(stream.errors.values()),
                        }
                    )
                more = pa.RecordBatch.from_pylist(rows, _READ)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *more.columns], [key, "n_bytes", *_READ.names])

    return media.select(key, "n_bytes", "media").mapInArrow(
        read,
        f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "pids array<int>, pts array<long>, sizes array<int>, random_access array<boolean>, errors long",
    )


_READ = pa.schema(
    [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    + [("pids", pa.list_(pa.int32())), ("pts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("random_access", pa.list_(pa.bool_())), ("errors", pa.int64())]
)
