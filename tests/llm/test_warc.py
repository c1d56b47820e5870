import base64
import gzip
import hashlib
import io
import re

import pytest

from flowlake.llm import warc

ROWS = [
    (1, "http://a.example/ x\n", "<p>hällo</p>"), (2, None, "<p>hällo</p>"), (9, "u", "<p>hällo</p>"), (3, "u", None), (4, "u", ""),
    (5, "u", "a\r\n\r\nWARC/1.1\r\n" * 20000), (6, "u", "short"), (6, "u", "short"), (None, "u", "short"), (None, "u", "alone"),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, digest string")
    got = sorted(warc.warc_round_trip(df).collect(), key=str)
    largest = {}
    for p, _, h in ROWS:
        h = h or ""
        largest[h] = max((x for x in (largest.get(h), p) if x is not None), default=None)
    want = []
    for p, _, h in ROWS:
        raw = (h or "").encode()
        top = largest[h or ""]
        revisit = top is not None and top != p
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    small = {r["page_id"]: r["record_type"] for r in warc.warc_round_trip(df, min_bytes=10).where("page_id in (3, 4, 1)").collect()}
    assert small == {1: "revisit", 3: "response", 4: "response"}


def test_empty(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def one(page_id, url, payload, response, date):
    out = io.BytesIO()
    warc.write_record(out, page_id, url, payload, hashlib.sha1(payload).hexdigest(), response, date)
    return out.getvalue()


def test_chunks_carry_running_digests():
    payload = bytes(range(256)) * 1000
    data = one(1, "u", payload, None, "d") + one(2, "u", b"", None, "d") + one(3, "u", payload, (1, "u"), "d")
    rows = list(warc.chunks(io.BytesIO(data), 1000))
    own = [r for r in rows if r[1] == 1]
    assert b"".join(r[6] for r in own) == payload and [r[5] for r in own] == list(range(256))
    for k, r in enumerate(own):
        assert r[7] == (k + 1) * 1000 and r[8] == warc.b32_sha1(payload[: r[7]]) and r[9] == (k == 255)
    assert [r[1] for r in rows if r[9]] == [1, 2, 3] and rows[-1][2:4] == ("revisit", 1) and rows[-1][7] == len(payload)
    with pytest.raises(Exception):
        list(warc.chunks(io.BytesIO(data[:-30])))


def test_writer_never_joins_a_payload(monkeypatch):
    sizes, compressobj = [], warc.zlib.compressobj

    class Seen:
        def __init__(self, *args):
            self.zip = compressobj(*args)

        def compress(self, x):
            sizes.append(len(x))
            return self.zip.compress(x)

        def flush(self):
            return self.zip.flush()

    monkeypatch.setattr(warc.zlib, "compressobj", Seen)
    payload = b"x" * 1_000_000
    rows = list(warc.chunks(io.BytesIO(one(1, None, payload, None, "d"))))
    assert max(sizes) <= warc.CHUNK and rows[-1][7] == len(payload)


def test_record_names_and_references(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    archives = warc.write_warc(df, f"file://{tmp_path}/w")
    rows = warc.record_chunks(archives).where("is_last").collect()
    names = [r["record_id"] for r in rows]
    assert len(names) == len(ROWS) and len(set(names)) == len(set(ROWS))  # only the row that is there twice shares a name
    heads = {}
    for p in tmp_path.glob("w/*.gz"):
        raw = gzip.decompress(p.read_bytes())
        for m in re.finditer(rb"WARC-Record-ID: (\S+)(?:\r\n(?!\r\n)[^\r]*)*?\r\nWARC-Refers-To: (\S+)", raw):
            heads[m[1].decode()] = m[2].decode()
    assert heads and set(heads.values()) <= {r["record_id"] for r in rows if r["record_type"] == "response"}


def test_a_revisit_without_its_response_fails(spark, monkeypatch):
    keep = warc.record_chunks
    monkeypatch.setattr(warc, "record_chunks", lambda a: keep(a).where("not (record_type = 'response' and page_id = 9)"))
    with pytest.raises(Exception, match="refers to no response"):
        warc.warc_round_trip(spark.createDataFrame(ROWS, "page_id long, url string, html string")).collect()
