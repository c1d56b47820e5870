import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from flowlake.llm import packing, tokens
from flowlake.llm.tokens import Encoder, tokenizer_text

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ROWS = [(1, "one two three", "x"), (2, None, "x"), (3, "", "x"), (4, "wort " * 5000, "y"), (4, "wort " * 5000, "y"), (None, "no id  here", "z"), (6, "stop <|endoftext|> go \n \n on", "z")]


def naive(text, end):
    tok = Tokenizer.from_file(PATH)
    return tok.encode(text or "", add_special_tokens=False).ids + [end]


def check(rows, texts):
    """Every id lies in one piece with its crc; sequences are gapless from 0 and hold at most 1024."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, docs in texts.items():
        ids = naive(docs[0], 0)
        pieces = sorted(by_doc[doc_id], key=lambda r: r["start"])
        covered = np.zeros(len(ids), int)
        for p in pieces:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert len(part) == p["length"] and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            covered[p["start"] : p["start"] + p["length"]] += 1
        assert (covered == len(docs)).all()
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(seqs) == list(range(len(seqs)))
    padding = 0
    for k, parts in seqs.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        padding += packing.WINDOW - at
    assert padding < packing.WINDOW


def test_pack_edge_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, length string")
    rows = packing.pack(df, PATH).collect()
    texts = {}
    for doc_id, text, _ in ROWS:
        texts.setdefault(doc_id, []).append(text)
    check(rows, texts)


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_pack_many(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("ab" for _ in range(int(rng.integers(0, 1500))))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = packing.pack(df, PATH).collect()
    check(out, {i: [t] for i, t in rows})
    # rounding leaves few pieces to the stream, so few pieces are cut twice
    assert len(out) < 1.35 * sum(-(-len(naive(t, 0)) // 1024) for _, t in rows)


def test_plan_uses_exact_combinations():
    hist = np.zeros(1025, np.int64)
    hist[[400, 624]] = 50
    hist[[100, 200, 724]] = 30
    p = packing.plan(hist)
    assert p["total"] == 80 and not p["kind"].any()


def test_least_squares_against_dense():
    lengths = np.array([2, 3, 4, 5, 6])
    combos = packing.combinations(lengths, 10)
    hist = np.zeros(11)
    hist[lengths] = [10, 5, 20, 7, 8]
    x = packing.least_squares(combos, hist, 4000)
    a = np.zeros((11, len(combos)))
    for k, c in enumerate(combos):
        for v in c[c > 0]:
            a[v, k] += 1
    grad = a.T @ (a @ x - hist)
    assert (x >= 0).all() and grad.min() > -1e-3 and abs(grad @ x) < 1e-2


def test_encoder_is_the_library():
    enc, tok = Encoder(tokenizer_text(PATH)), Tokenizer.from_file(PATH)
    rng = np.random.default_rng(1)
    bits = [
        "a", "B", " ", " ", "  ", "\n", "\t", "'s", "'re", "1", "²", "é", "ß", " !", "中", "<|endoftext|>", "\r\n", "\u3000", "_", "\x85", "\x00",
        "\x1c", "\u2028", "\u180e", "\u200b", "\ufeff", "\u0301", "\x0b", " \n", " x", "Ⅷ", "🙂",
    ]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 14)))) for _ in range(20_000)] + [None]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, lengths = enc.encode_all(pa.array(texts))
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    ids, lengths = enc.encode_all(pa.array(texts).slice(7, 900), end_id=2)  # again, from known words
    assert lengths.tolist() == [len(x) + 1 for x in want[7:907]] and ids.tolist() == [i for x in want[7:907] for i in [*x, 2]]
    assert all(enc.encode(t).tolist() == w for t, w in zip(texts[:200], want))


def test_words_and_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    monkeypatch.setattr(tokens, "WORDS", 5)
    enc, tok = Encoder(tokenizer_text(PATH)), Tokenizer.from_file(PATH)
    for k in range(30):
        t = " ".join(f"w{i}, x" for i in range(k, k + 4))
        assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_slabs_cut_no_text(monkeypatch):
    monkeypatch.setattr(tokens, "SLAB", 10)
    b = pa.record_batch([pa.array(range(5)), pa.array(["x" * 25, None, "abc", "defg", "hijkl"])], names=["doc_id", "text"])
    parts = [p.column(1).to_pylist() for p in tokens.slabs(b)]
    assert parts == [["x" * 25], [None, "abc", "defg"], ["hijkl"]]
