import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlake.llm import packing, token_files
from flowlake.llm.token_counts import token_counts
from flowlake.llm.tokens import Encoder, tokenizer_text

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["end of doc <|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "two  spaces <|endoftext|>", "<|endoftext|", "nul\0 <|endoftext|>", "plain text"]


def library(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_the_untouched_library_gives_them(name):
    path = str(public_tokenizers.path(name))
    enc, tok = Encoder(tokenizer_text(path)), Tokenizer.from_file(path)
    added = [t.content for t in tok.get_added_tokens_decoder().values()][:8]
    rng = np.random.default_rng(3)
    bits = ["a", "B", " ", "  ", "\n", "'s", "1", "é", "中", "<|endoftext|", "\x00", *added, *added]
    for t in TEXTS + ["".join(rng.choice(bits, int(rng.integers(0, 14)))) for _ in range(1000)]:
        assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids
    assert library(TEXTS[0]) == [437, 286, 2205, 220, 50256, 1306]


def test_operators_keep_the_added_token(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = {i: library(t) for i, t in enumerate(TEXTS)}
    for r in token_files.token_output(df, PATH, 2).collect():
        ids = want[r["doc_id"]] + [2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.pack(df, PATH, end_id=0).collect()} == {i: len(ids) + 1 for i, ids in want.items()}
    lengths = [len(ids) for ids in want.values()]
    assert {r["context_limit"]: r["n_docs"] for r in token_counts(df, PATH).collect()} == {n: lengths.count(n) for n in lengths}
