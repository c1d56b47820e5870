"""Ogg media column: payloads multiplexed into logical streams of checked pages, and read back.

A payload is stored losslessly as packets of 576 unsigned 8-bit samples in two logical streams
(even and odd packets), after a header packet in each. The reader verifies every page's checksum,
reassembles packets from the lacing values, separates the streams by serial number and derives
time stamps from the granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Fixed values of the Ogg page layout: capture pattern, header-type bits, no-packet granule.
CAPTURE, CONTINUED, FIRST, LAST, NO_PACKET = b"OggS", 1, 2, 4, (1 << 64) - 1

PACKET, RATE, STREAMS, MAGIC = 576, 48_000, 2, b"pcm8\x01"
#: Lacing values of a page at most; 255 by the format.
SEGMENTS = 255

_flip = np.array([int(f"{b:08b}"[::-1], 2) for b in range(256)], np.uint8).tobytes()


def page_crc(data: bytes) -> int:
    """Ogg's checksum (polynomial 0x04C11DB7, not reflected, no start or end value).

    It is the reflected crc32 of the bit-reversed bytes, bit-reversed, without the inversions.
    """
    x = zlib.crc32(data.translate(_flip), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_flip), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIII", CAPTURE, 0, kind, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    data = head + body
    return data[:22] + struct.pack("<I", page_crc(data)) + data[26:]


def stream_pages(packets: list[bytes], granules: list[int], serial: int) -> list[tuple[int, bytes]]:
    """``(granule, page)`` of one logical stream; the first packet, its header, has a page of its own."""
    pages: list[tuple[int, bytes]] = []
    lacing, body, granule, open_packet = bytearray(), bytearray(), NO_PACKET, False

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule, carried
        kind = (FIRST if not pages else 0) | (CONTINUED if carried else 0) | (LAST if last else 0)
        order = granule if granule != NO_PACKET else (pages[-1][0] if pages else 0)
        pages.append((order, _page(kind, granule, serial, len(pages), bytes(lacing), bytes(body))))
        carried = open_packet
        lacing, body, granule = bytearray(), bytearray(), NO_PACKET

    carried = False
    for k, (packet, at) in enumerate(zip(packets, granules)):
        left, more = packet, True
        while more:
            if len(lacing) == SEGMENTS:
                flush(False)
            n = min(255, len(left))
            lacing.append(n)
            body += left[:n]
            left, more = left[n:], n == 255
            open_packet = more
        granule = at
        if k == 0 and len(packets) > 1:
            flush(False)
    flush(True)
    return pages


def mux(payload: bytes, serial: int) -> bytes:
    """The payload as one physical stream; its pages are interleaved by granule position."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    pages = []
    for s in range(STREAMS):
        own = range(s, len(packets), STREAMS)
        header = MAGIC + struct.pack("<IBB", RATE, s, STREAMS)
        granules = [0] + [i * PACKET + len(packets[i]) for i in own]
        pages += [
            (g, n > 0, s, n, page)
            for n, (g, page) in enumerate(stream_pages([header] + [packets[i] for i in own], granules, (serial + s) & 0xFFFFFFFF))
        ]
    pages.sort(key=lambda x: (x[1], x[0], x[2], x[3]))
    return b"".join(x[4] for x in pages)


def demux(data: bytes) -> dict[int, dict]:
    """Per serial number: packets, time stamps (seconds at each page's end, where one ends a packet), pages.

    Raises ValueError for a wrong capture pattern, checksum, page number or broken packet.
    """
    streams: dict[int, dict] = {}
    at = 0
    while at < len(data):
        capture, version, kind, granule, serial, number, crc = struct.unpack_from("<4sBBQIII", data, at)
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        body_at = at + 27 + n
        end = body_at + sum(lacing)
        if capture != CAPTURE or version or end > len(data):
            raise ValueError(f"no page at byte {at}")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"page at byte {at} fails its checksum")
        s = streams.setdefault(serial, {"packets": [], "times": [], "granules": [], "pages": 0, "part": b"", "open": False, "ended": False})
        if number != s["pages"] or bool(kind & FIRST) != (number == 0) or bool(kind & CONTINUED) != s["open"] or s["ended"]:
            raise ValueError(f"page {number} of stream {serial} is out of order")
        parts, x = [s["part"]], body_at
        for value in lacing:
            parts.append(data[x : x + value])
            x += value
            if value < 255:
                s["packets"].append(b"".join(parts))
                parts = []
        s["open"] = bool(n) and lacing[-1] == 255
        s["part"] = b"".join(parts)
        if granule != NO_PACKET:
            s["granules"].append(granule)
            s["times"].append(granule / RATE)
        s["pages"], s["ended"] = s["pages"] + 1, bool(kind & LAST)
        at = end
    if any(s["open"] or not s["ended"] for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def payload_of(streams: dict[int, dict]) -> bytes:
    """The payload: the streams' packets in turn, by the place named in each header."""
    order = {}
    for s in streams.values():
        head = s["packets"][0]
        if not head.startswith(MAGIC):
            raise ValueError("unknown header packet")
        order[head[len(MAGIC) + 4]] = s["packets"][1:]
    lanes = [order[k] for k in sorted(order)]
    out = [b""] * sum(map(len, lanes))
    for k, lane in enumerate(lanes):
        out[k :: len(lanes)] = lane
    return b"".join(out)


def padded(raw: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the packet size."""
    return raw + b"\xff" * (-len(raw) % PACKET if raw else PACKET)


def store_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: every row's whole text as an Ogg file; a null text is empty."""

    def run(batches):
        for b in batches:
            media, sizes = [], []
            for x in b.column(1):
                raw = (x.as_py() or "").encode()
                payload = padded(raw)
                sizes.append(len(raw))
                media.append(mux(payload, zlib.crc32(payload)))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature(streams: dict[int, dict], payload: bytes) -> str:
    """Pages, packets, seconds (from the granules), mean, deviation and zero crossings of the samples."""
    x = np.frombuffer(payload, np.uint8)
    pages = sum(s["pages"] for s in streams.values())
    packets = sum(len(s["packets"]) - 1 for s in streams.values())
    seconds = max(max(s["granules"]) for s in streams.values()) / RATE
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"{len(streams)};{pages};{packets};{seconds:.6f};{x.mean():.4f};{x.std():.4f};{crossings}"


def media_features(media: DataFrame) -> DataFrame:
    """Features and digests of stored media, from the bytes read back."""

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for m in b.column("media"):
                data = m.as_py()
                streams = demux(data)
                payload = payload_of(streams)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(streams, payload))
                for column, value in zip(rows, row):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(rows, types))], names=names)

    return media.mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string",
    )


def media_column(docs: DataFrame) -> DataFrame:
    """Stores every text as Ogg media in a table of the shared folder and reads it back; one row per document.

    Null and empty texts give one packet of padding; equal texts give equal values; repeated rows
    stay; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    return media_features(table(store_media(docs), "media")[0])
