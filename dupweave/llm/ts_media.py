"""Media columns: payloads as MPEG transport streams.

Writing: a payload is cut into access units of UNIT_BYTES, each becomes one packetised elementary
packet with a presentation time, and is carried in 188-byte transport packets with a program association
table, a program map table, continuity counters, a clock reference and the random-access mark on every
RANDOM_ACCESS_EVERY-th unit. Reading parses those bytes again: it puts the tables' sections together, of any number of
packets, follows them to the elementary stream, checks table checksums and the continuity counters of the tables and the
stream, reassembles the packets, and returns the payload with presentation and decoding times and random-access points.
A packet without payload doesn't move the counter, one exact repeat of a packet counts once, and where a
packet announces a discontinuity its counter may jump. Whole texts are stored, of any length; memory follows the
longest one.

Defined results: null text is the empty text, whose payload is 64 zero bytes; equal texts give equal
bytes; repeated rows are each stored; an empty table gives an empty result; only the id and the text are
read, so other columns and clashing names don't matter.
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
from pyspark.sql import functions as F

from .common import ref

PACKET = 188
BODY = PACKET - 4
SYNC = 0x47
PMT_PID, MEDIA_PID = 0x1000, 0x0100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
UNIT_BYTES = 8192
RANDOM_ACCESS_EVERY = 8
CLOCK, UNIT_TICKS = 90_000, 3600
PAD = 64


class MediaError(ValueError):
    """The bytes aren't a transport stream that this module reads."""


def _crc_steps() -> list[int]:
    steps = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        steps.append(crc)
    return steps


CRC_STEPS = _crc_steps()


def table_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ CRC_STEPS[crc >> 24 ^ byte]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + table_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


PAT = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(PMT_PID, _section(2, 1, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, t >> 14 & 255 | 1, t >> 7 & 255, t << 1 & 255 | 1])


def _ticks(stamp: bytes) -> int:
    a, b, c, d, e = stamp
    return (a & 0x0E) << 29 | b << 22 | (c & 0xFE) << 14 | d << 7 | e >> 1


def _clock_field(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return (t << 15 | 0x7E00).to_bytes(6, "big")


def padded(text: bytes) -> bytes:
    """`text` with zero bytes up to a positive multiple of PAD."""
    return text.ljust(max(PAD, -(-len(text) // PAD) * PAD), b"\0")


def write_stream(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter = [PAT, PMT], 0
    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        body = payload[at : at + UNIT_BYTES]
        ticks, access = unit * UNIT_TICKS, unit % RANDOM_ACCESS_EVERY == 0
        packet = b"\0\0\1" + bytes([STREAM_ID]) + (len(body) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(ticks) + body
        flags = b"\x50" + _clock_field(ticks) if access else b""
        counter = _packetise(packet, flags, counter, out)
    return b"".join(out)


def _packetise(data: bytes, flags: bytes, counter: int, out: list[bytes]) -> int:
    """One elementary packet in transport packets; `flags` go to the first one's adaptation field."""
    lead = min(len(data), BODY - (1 + len(flags) if flags else 0))
    rest = len(data) - lead
    middle, tail = divmod(rest, BODY)
    rows = []
    if flags or lead < BODY:
        stuffing = BODY - lead
        field_ = bytes([stuffing - 1]) + ((flags or b"\0").ljust(stuffing - 1, b"\xff") if stuffing > 1 else b"")
        rows.append(bytes([SYNC, 0x40 | MEDIA_PID >> 8, MEDIA_PID & 255, 0x30 | counter]) + field_ + data[:lead])
    else:
        rows.append(bytes([SYNC, 0x40 | MEDIA_PID >> 8, MEDIA_PID & 255, 0x10 | counter]) + data[:lead])
    counter = counter + 1 & 15
    if middle:
        block = np.empty((middle, PACKET), np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255
        block[:, 3] = 0x10 | (counter + np.arange(middle) & 15)
        block[:, 4:] = np.frombuffer(data, np.uint8, middle * BODY, lead).reshape(middle, BODY)
        rows.append(block.tobytes())
        counter = counter + middle & 15
    if tail:
        stuffing = BODY - tail
        field_ = bytes([stuffing - 1]) + (b"\0".ljust(stuffing - 1, b"\xff") if stuffing > 1 else b"")
        rows.append(bytes([SYNC, MEDIA_PID >> 8, MEDIA_PID & 255, 0x30 | counter]) + field_ + data[len(data) - tail :])
        counter = counter + 1 & 15
    out += rows
    return counter


@dataclass
class Media:
    """What a stream holds: times are seconds; random_access holds the indices of such units."""

    payload: bytes = b""
    unit_sizes: list[int] = field(default_factory=list)
    times: list[float] = field(default_factory=list)
    decoding_times: list[float] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    packets: int = 0


def _in_order(rows: np.ndarray) -> np.ndarray:
    """Numbers of the packets of one stream that carry payload, repeats left out; MediaError where the counter jumps."""
    carries = np.flatnonzero(rows[:, 3] & 0x10)
    own = rows[carries]
    counters = own[:, 3].astype(np.int16) & 15
    step = np.diff(counters) % 16
    field_ = (rows[:, 3] & 0x20 != 0) & (rows[:, 4] > 0) & (rows[:, 5] & 0x80 != 0)
    # A packet without payload may announce the discontinuity, too.
    announced = np.concatenate(([0], np.cumsum(field_)))
    jumps = announced[carries[1:] + 1] > announced[carries[:-1] + 1]
    same = _repeats(own) & (step == 0) & ~jumps
    if (same[1:] & same[:-1]).any():
        raise MediaError("a packet comes more than twice")
    if ((step != 1) & ~same & ~jumps).any():
        raise MediaError("a continuity counter jumps: packets are lost or repeated")
    return carries[np.concatenate((np.ones(min(1, len(own)), bool), ~same))]


def _repeats(own: np.ndarray) -> np.ndarray:
    """Whether each packet but the first equals the one before, but for the clock reference, which may differ."""
    differ = own[1:] != own[:-1]
    clock = (own[1:, 3] & 0x20 != 0) & (own[1:, 4] > 0) & (own[1:, 5] & 0x10 != 0)
    differ[:, 6:12] &= ~clock[:, None]
    return ~differ.any(axis=1)


def _payloads(rows: np.ndarray) -> tuple[bytes, np.ndarray]:
    """What packets carry after their adaptation fields, joined, and where each packet's part ends."""
    begins = np.where(rows[:, 3] & 0x20 != 0, 5 + rows[:, 4].astype(np.int64), 4)
    if (begins > PACKET).any():
        raise MediaError("an adaptation field is too long")
    return rows[np.arange(PACKET) >= begins[:, None]].tobytes(), np.cumsum(PACKET - begins)


def _read_section(rows: np.ndarray, what: str) -> bytes:
    """The first section of a table, from the packets of its stream."""
    rows = rows[_in_order(rows)]
    starts = np.flatnonzero(rows[:, 1] & 0x40)
    if not len(starts):
        raise MediaError(f"no {what}")
    data, _ = _payloads(rows[starts[0] :])
    at = 1 + data[0]
    size = 3 + (int.from_bytes(data[at + 1 : at + 3], "big") & 0xFFF)
    # Where a section goes on in a packet that begins another one, a pointer stands before its rest.
    section = data[at : at + size]
    for k in starts[1:]:
        edge = _payloads(rows[starts[0] : k])[1][-1] if k > starts[0] else 0
        if edge >= at + size:
            break
        data = data[:edge] + data[edge + 1 :]
        section = data[at : at + size]
        break
    if len(section) < size or table_crc(section):
        raise MediaError("a table's checksum is wrong")
    return section


def _media_pid(packets: np.ndarray, pids: np.ndarray) -> int:
    programs = _read_section(packets[pids == 0], "program association table")[8:-4]
    maps = [int.from_bytes(programs[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(programs), 4) if programs[i : i + 2] != b"\0\0"]
    streams = _read_section(packets[pids == (maps or _fail("no program"))[0]], "program map table")[:-4]
    at = 12 + (int.from_bytes(streams[10:12], "big") & 0xFFF)
    while at + 5 <= len(streams):
        if streams[at] == STREAM_TYPE:
            return int.from_bytes(streams[at + 1 : at + 3], "big") & 0x1FFF
        at += 5 + (int.from_bytes(streams[at + 3 : at + 5], "big") & 0xFFF)
    return _fail("no private stream in the program")


def _fail(what: str):
    raise MediaError(what)


def read_stream(stream: bytes) -> Media:
    """Demultiplex `stream`; MediaError for a broken sync, table, counter or elementary packet."""
    if not stream or len(stream) % PACKET:
        raise MediaError("not a whole number of packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise MediaError("a sync byte is missing")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    own = packets[pids == _media_pid(packets, pids)]
    own = own[_in_order(own)]
    if not len(own):
        raise MediaError("no elementary packets")
    has_field = own[:, 3] & 0x20 != 0
    body, ends = _payloads(own)
    unit_starts = np.flatnonzero(own[:, 1] & 0x40)
    if not len(unit_starts) or unit_starts[0]:
        raise MediaError("the stream begins inside a packet")
    media, parts = Media(packets=len(packets)), []
    edges = [0, *ends[unit_starts[1:] - 1].tolist(), len(body)]
    for k, row in enumerate(unit_starts):
        data = body[edges[k] : edges[k + 1]]
        if data[:4] != b"\0\0\1" + bytes([STREAM_ID]) or len(data) != 6 + int.from_bytes(data[4:6], "big"):
            raise MediaError("an elementary packet is broken")
        if data[7] & 0x80:
            media.times.append(_ticks(data[9:14]) / CLOCK)
            media.decoding_times.append(_ticks(data[14:19]) / CLOCK if data[7] & 0x40 else media.times[-1])
        if has_field[row] and own[row, 4] and own[row, 5] & 0x40:
            media.random_access.append(k)
        parts.append(data[9 + data[8] :])
        media.unit_sizes.append(len(parts[-1]))
    media.payload = b"".join(parts)
    return media


def feature(media: Media) -> str:
    """Units, packets, duration, random-access points and byte statistics of what was read back."""
    data = np.frombuffer(media.payload, np.uint8)
    counts = np.bincount(data, minlength=256)
    share = counts[counts > 0] / len(data)
    entropy = float(-(share * np.log2(share)).sum())
    ticks = [round(t * CLOCK) for t in media.times]
    return f"units={len(media.unit_sizes)};packets={media.packets};ticks={ticks[0]}-{ticks[-1]};rap={','.join(map(str, media.random_access))};mean={data.mean():.4f};entropy={abs(entropy):.4f}"


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_units long, n_random_access long, last_time double"


def _by_row(batches: Iterator[pa.RecordBatch], schema: pa.Schema, row, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            made = [row(i.as_py(), x.as_buffer()) for i, x in zip(part.column(0), part.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return _by_row(batches, schema, lambda i, x: (i, len(x), write_stream(padded(x.to_pybytes()))))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text, long = pa.string(), pa.int64()
    schema = pa.schema([("doc_id", long), ("n_bytes", long), ("payload_bytes", long), ("payload_sha256", text), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", text), ("feature", text), ("n_units", long), ("n_random_access", long), ("last_time", pa.float64())])

    def row(doc_id, n_bytes, stored):
        media = read_stream(stored)
        data = media.payload
        return doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(media), len(media.unit_sizes), len(media.random_access), media.times[-1]

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            made = [row(i.as_py(), n.as_py(), x.as_py()) for i, n, x in zip(*part.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a transport stream."""
    source = docs.select(ref(id_col).cast("long").alias("doc_id"), F.coalesce(ref(text_col), F.lit("")).cast("binary").alias("text"))
    return source.mapInArrow(_write, MEDIA_SCHEMA)


def media_features(stored: DataFrame) -> DataFrame:
    """Digests and features of stored streams, from their bytes alone."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_digest, DIGEST_SCHEMA)
