import hashlib
import random
import zlib

import pytest
from conftest import odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from dupweave.llm import ts_media as M


@given(st.binary(max_size=700) | st.integers(0, 70_000).map(lambda n: random.Random(n).randbytes(n)))
@settings(max_examples=150, deadline=None)
def test_round_trip(data):
    payload = M.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(data) and not payload[len(data) :].strip(b"\0")
    stream = M.write_stream(payload)
    media = M.read_stream(stream)
    assert media.payload == payload and len(stream) % 188 == 0 and stream == M.write_stream(payload)
    assert media.unit_sizes == [min(M.UNIT_BYTES, len(payload) - at) for at in range(0, len(payload), M.UNIT_BYTES)]
    assert [round(t * M.CLOCK) for t in media.times] == [k * M.UNIT_TICKS for k in range(len(media.times))]
    assert media.random_access == list(range(0, len(media.times), M.RANDOM_ACCESS_EVERY))


def test_tables_and_counters_by_the_standards_layout():
    stream = M.write_stream(M.padded(bytes(range(256)) * 200))
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    pid = lambda p: (p[1] & 0x1F) << 8 | p[2]
    assert all(p[0] == 0x47 for p in packets) and pid(packets[0]) == 0 and pid(packets[1]) == M.PMT_PID
    assert packets[0][5:13] == bytes.fromhex("00b00d0001c10000") and M.table_crc(packets[0][5:21]) == 0
    assert M.table_crc(b"123456789") == 0x0376E6E7
    media = [p for p in packets if pid(p) == M.MEDIA_PID]
    assert [p[3] & 15 for p in media] == [k % 16 for k in range(len(media))]


def broken(change):
    stream = bytearray(M.write_stream(M.padded(b"x" * 5000)))
    changed = change(stream)
    return bytes(stream if changed is None else changed)


@pytest.mark.parametrize(
    "change",
    [
        lambda s: s[:-1], lambda s: b"", lambda s: s[: 188 * 4] + s[188 * 5 :], lambda s: s[: 188 * 4] + s[188 * 3 : 188 * 4] + s[188 * 3 :], lambda s: s.__setitem__(188 * 3, 0), lambda s: s.__setitem__(10, 99),
        lambda s: s[: 188 * 2], lambda s: s[188:], lambda s: s[:188] + s[188 * 2 :], lambda s: s[:-188], lambda s: s.__setitem__(188 * 2 + 4 + 8 + 1, 7),
    ],
)
def test_broken_streams_are_refused(change):
    with pytest.raises(M.MediaError):
        M.read_stream(broken(change))


def check(rows, got):
    assert len(rows) == len(got)
    by = {(r.doc_id, r.payload_sha256): r for r in got}
    for i, text in rows:
        data = (text or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = by[i, hashlib.sha256(payload).hexdigest()]
        stored = M.write_stream(payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(data), len(payload), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())


def test_documents(docs):
    check([(r.doc_id, r.text) for r in docs.collect()], M.media_features(M.store_media(docs)).collect())


def test_odd_rows(odd, none):
    got = M.media_features(M.store_media(odd)).collect()
    check([(r[0], r[1]) for r in odd_rows()], got)
    assert len({r.feature for r in got if r.doc_id in (6, 7)}) == 1
    assert M.media_features(M.store_media(none)).isEmpty()


def packets_of(stream):
    return [stream[i : i + 188] for i in range(0, len(stream), 188)]


def section_packets(pid, section, counter=0):
    """A section over as many packets as it needs."""
    data, out = b"\0" + section, []
    for k in range(0, len(data), 184):
        out.append((bytes([0x47, (0x40 if k == 0 else 0) | pid >> 8, pid & 255, 0x10 | counter + len(out) & 15]) + data[k : k + 184]).ljust(188, b"\xff"))
    return out


def test_valid_streams_of_other_makers():
    """Packets without payload, one repeat, an announced jump, tables over several packets."""
    payload = M.padded(bytes(range(256)) * 90)
    packets = packets_of(M.write_stream(payload))
    bare = bytes([0x47, M.MEDIA_PID >> 8, M.MEDIA_PID & 255, 0x20 | packets[4][3] & 15, 183, 0]).ljust(188, b"\xff")
    assert M.read_stream(b"".join([*packets[:5], bare, *packets[5:]])).payload == payload
    assert M.read_stream(b"".join([*packets[:5], packets[4], *packets[5:]])).payload == payload
    assert M.read_stream(b"".join([packets[0], packets[0], packets[1], *packets[2:]])).payload == payload
    with pytest.raises(M.MediaError):
        M.read_stream(b"".join([*packets[:5], packets[4], packets[4], *packets[5:]]))
    jump = bytes([0x47, M.MEDIA_PID >> 8, M.MEDIA_PID & 255, 0x20 | 9, 183, 0x80]).ljust(188, b"\xff")
    moved = [p if k < 9 else p[:3] + bytes([p[3] & 0xF0 | p[3] + 5 & 15]) + p[4:] for k, p in enumerate(packets)]
    with pytest.raises(M.MediaError):
        M.read_stream(b"".join(moved))
    assert M.read_stream(b"".join([*moved[:9], jump, *moved[9:]])).payload == payload
    note = b"\x05\xfa" + bytes(250)
    body = (0xE000 | M.MEDIA_PID).to_bytes(2, "big") + (0xF000 | len(note)).to_bytes(2, "big") + note + bytes([M.STREAM_TYPE]) + (0xE000 | M.MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"
    long_table = section_packets(M.PMT_PID, M._section(2, 1, body))
    assert len(long_table) == 2 and M.read_stream(b"".join([packets[0], *long_table, *packets[2:]])).payload == payload
    again = [p[:3] + bytes([p[3] & 0xF0 | p[3] + 2 & 15]) + p[4:] for p in long_table]
    assert M.read_stream(b"".join([packets[0], *long_table, *packets[2:6], *again, *packets[6:]])).payload == payload
    with pytest.raises(M.MediaError):
        M.read_stream(b"".join([packets[0], long_table[0], long_table[1][:3] + b"\x17" + long_table[1][4:], *packets[2:]]))


def test_decoding_times():
    payload = M.padded(b"q" * 100)
    pes = b"\0\0\1" + bytes([M.STREAM_ID]) + (len(payload) + 13).to_bytes(2, "big") + b"\x80\xc0\x0a" + M._stamp(7200) + M._stamp(3600) + payload
    out = [M.PAT, M.PMT]
    M._packetise(pes, b"", 0, out)
    media = M.read_stream(b"".join(out))
    assert media.payload == payload and media.times == [0.08] and media.decoding_times == [0.04]


def test_columns_that_sql_can_express(spark):
    """Ids, sizes, digests and tails as plain SQL gives them."""
    import duckdb

    from dupweave.llm import queries

    got = sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) for r in queries.op10_transport_stream(spark, "/root/testdata/sf0.001").collect())
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    n = "octet_length(encode(coalesce(text, '')))"
    expected = con.execute(f"SELECT doc_id, {n}, greatest(64, (({n} + 63) // 64) * 64), sha256(encode(coalesce(text, '')) || unhex(repeat('00', (greatest(64, (({n} + 63) // 64) * 64) - {n})::INT))) FROM documents").fetchall()
    assert got == sorted(tuple(r) for r in expected)
