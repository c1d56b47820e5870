import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

from flowlake.llm import token_files
from flowlake.llm.token_counts import answer, quantile_length, token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ROWS = [(5, "one two three", 1), (2, None, 1), (3, "", 1), (4, "wort " * 90000, 2), (5, "again", 2), (None, "no id", 3), (6, "stop <|endoftext|> go", 3)]


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def naive(text):
    tok = Tokenizer.from_file(PATH)
    return tok.encode(text or "", add_special_tokens=False).ids


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, start int")
    rows = token_files.token_output(df, PATH, 2).collect()
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows)
    at, seen = 0, []
    for start, doc_id, n, crc in got:
        assert start == at
        at += n
        seen.append((doc_id if doc_id is not None else -1, n, crc))
    assert [x[0] for x in seen] == sorted(x[0] for x in seen)
    want = [(-1 if d is None else d, len(i := naive(t) + [2]), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t, _ in ROWS]
    assert sorted(seen) == sorted(want)


def test_many_shards_of_a_task(spark, monkeypatch, tmp_path):
    rows = [(i % 40, f"text {i}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert token_files.write_token_files(df, f"file://{tmp_path}/a", PATH, 2, tasks=2).count() == 2
    out = []
    w = token_files.ShardWriter(File(), np.dtype("<u2"))
    monkeypatch.setattr(token_files, "SHARD_DOCS", 7)
    monkeypatch.setattr(token_files, "READ_DOCS", 3)
    for k in range(20):
        w.add(k, np.arange(3))
        if w.full():
            out.append(len(w.ids))
            w.close()
            w = token_files.ShardWriter(File(), np.dtype("<u2"))
    assert out == [7, 7]


def test_empty(spark):
    assert token_files.token_output(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).collect() == []


def test_reader_opens_only_the_frames_asked_for_and_checks_them():
    out = File()
    w = token_files.ShardWriter(out, np.dtype("<u2"), frame_bytes=64)
    docs = {k: np.arange(k * 7 % 50, dtype="<u2") for k in range(60)}
    docs[60] = np.arange(500, dtype="<u2")
    for k, ids in docs.items():
        w.add(k, ids)
    w.close()
    r = token_files.ShardReader(File(out.getvalue()))
    assert r.find([17])[17][0].tolist() == docs[17].tolist() and r.opened <= 2
    assert all(r.document(k).tolist() == ids.tolist() for k, ids in docs.items())
    plain = b"".join(ids.tobytes() for ids in docs.values())
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read() == plain
    # the seek table as the public layout has it: sizes and the low half of xxh64 of each frame
    raw = out.getvalue()
    n, flag, magic = struct.unpack("<IBI", raw[-9:])
    assert (flag, magic) == (0x80, 0x8F92EAB1) and struct.unpack("<II", raw[-17 - 12 * n : -9 - 12 * n]) == (0x184D2A5E, 12 * n + 9)
    at = 0
    for k in range(n):
        packed, size, crc = struct.unpack("<III", raw[len(raw) - 9 - 12 * (n - k) :][:12])
        content = zstandard.ZstdDecompressor().decompress(raw[at : at + packed]) if size else b""
        assert len(content) == size and xxhash.xxh64(content).intdigest() & 0xFFFFFFFF == crc
        at += packed
    assert at == len(raw) - 17 - 12 * n
    broken = bytearray(out.getvalue())
    broken[20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.ShardReader(File(bytes(broken))).document(1)


def test_token_counts_against_brute_force(spark):
    rows = [(i, "w " * (i * i % 700)) for i in range(120)] + [(7, None), (8, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_tokens int, block int")
    lengths = [len(naive(t)) for _, t in rows]
    counts = token_counts(df, PATH)
    got = {r["context_limit"]: r for r in counts.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        kept = sum(min(x, n) for x in lengths)
        assert (r["n_docs"], r["docs_over"], r["tokens_kept"], r["tokens_cut"]) == (
            lengths.count(n), sum(x > n for x in lengths), kept, sum(lengths) - kept)
        assert r["n_tokens"] == n * lengths.count(n) and abs(r["quantile"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    for r in answer(counts, [0, 3, 64, 10_000]).collect():
        assert r["tokens_kept"] == sum(min(x, r["context_limit"]) for x in lengths)
    assert quantile_length(counts, 0.5).first()[0] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts(df.limit(0), PATH).collect() == []
