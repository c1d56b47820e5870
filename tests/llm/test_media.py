import hashlib
import struct
import zlib

import pytest

from flowlake.llm import media

ROWS = [(1, "häus " * 3, 0), (2, None, 0), (3, "", 0), (4, "x" * 576, 0), (5, "lång " * 40000, 0), (None, "y", 0), (1, "häus " * 3, 0)]


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def test_page_crc():
    for data in (b"", b"a", b"OggS", bytes(range(256)) * 3):
        assert media.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 255, 200_001])
def test_mux_round_trip(n):
    payload = media.padded(bytes(i * 31 % 251 for i in range(n)))
    assert len(payload) % 576 == 0 and payload
    streams = media.demux(media.mux(payload, 7))
    assert media.payload_of(streams) == payload
    assert max(max(s["granules"]) for s in streams.values()) == len(payload)
    assert all(s["times"] == sorted(s["times"]) for s in streams.values())


def test_demux_refuses_damage():
    data = bytearray(media.mux(media.padded(b"abc" * 3000), 7))
    data[200] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media.demux(bytes(data))
    whole = media.mux(media.padded(b"abc" * 3000), 7)
    with pytest.raises(ValueError):
        media.demux(whole[: len(whole) - 10])


def test_lacing_continues_over_pages():
    packet = b"z" * (255 * 300)  # longer than a page and a multiple of 255
    pages = media.stream_pages([b"head", packet, b""], [0, 5, 6], 1)
    data = b"".join(p for _, p in pages)
    assert media.demux(data)[1]["packets"] == [b"head", packet, b""] and len(pages) > 2
    assert any(struct.unpack_from("<Q", p, 6)[0] == media.NO_PACKET for _, p in pages)


def test_media_column(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, media int")
    rows = media.media_column(df).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    for doc_id, text, _ in ROWS:
        payload = media.padded((text or "").encode())
        r = by[doc_id]
        assert r["n_bytes"] == len((text or "").encode()) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(media.mux(payload, zlib.crc32(payload))).hexdigest()
    assert tuple(by[2])[2:] == tuple(by[3])[2:]
    assert media.media_column(df.limit(0)).collect() == []
