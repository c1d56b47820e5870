"""Token ids of whole texts with the tokenizers library, inside Spark tasks."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The split pattern of byte-level BPE files, and the bytes that stand for themselves in their vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Every other byte is written as the next free code point from 256.
BYTE_CHARS = {b: chr(b) for b in PLAIN_BYTES} | {
    b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*PLAIN_BYTES}))
}

#: Pattern pieces in each half of a worker's cache, and words whose ids a worker keeps; some 60 MB when full.
CACHE, WORDS = 100_000, 300_000
#: Bytes of text that are encoded at once: some 100 MB more.
SLAB = 4 << 20
#: Stands between words that are split into pieces together: white space, so it joins neither neighbour.
MARK = "\u2028"
# White space as any of the engines sees it; a space with white space before it, and behind it white space or the end, is no sure boundary.
_BLANK = r"[\s\x0b\x1c-\x1f\x85\pZ]"
UNSURE = f"{_BLANK} ({_BLANK}|$)"
_sure = re.compile(r"(?<=\S)(?= )|(?= \S)")

_encoders: dict[int, "Encoder"] = {}


def tokenizer_text(path: str) -> str:
    """The tokenizer's file, read on the driver and sent to the tasks (a fixed 1 to 5 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Encodes texts as the given tokenizers file does, without special tokens.

    A byte-level BPE never joins bytes across the boundaries of its pattern, and a space next to a
    character that is none is such a boundary. So the texts of a batch are split at spaces in Arrow,
    those of their distinct words that aren't known yet into pattern pieces, and the library's model
    is asked for the ids of each new piece; the ids of the texts are then gathered. Every text that
    holds the string of an added token, and every other kind of tokenizer, goes to the library as a
    whole.
    """

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        self.tok = Tokenizer.from_str(text)
        self.added = sorted({t.content for t in self.tok.get_added_tokens_decoder().values() if t.content})
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_word = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and all(c in model["vocab"] for c in BYTE_CHARS.values())  # so every piece has an id
        )
        self.pattern = regex.compile(PATTERN)
        self.young: dict[str, bytes] = {MARK: b""}
        self.old: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """Known words, their ids in a row, and where each word's ids begin and how many there are."""
        self.words, self.flat = pa.array([], pa.string()), np.empty(0, self.dtype)
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pattern pieces; a mark between words has none. The cache's old half holds what its young half held when full."""
        young, old = self.young, self.old
        if want := list(set(pieces).difference(young)):
            known = list(map(old.get, want))
            young.update((p, ids) for p, ids in zip(want, known) if ids is not None)
            new = [p for p, ids in zip(want, known) if ids is None]
            chars = "\0".join(new).encode().decode("latin-1").translate(BYTE_CHARS).split(BYTE_CHARS[0])
            if len(chars) != len(new):  # a text has the character that stands between them
                chars = [p.encode().decode("latin-1").translate(BYTE_CHARS) for p in new]
            tokenize, code = self.tok.model.tokenize, self.code
            young.update(zip(new, [array(code, [t.id for t in tokenize(c)]).tobytes() for c in chars]))
        got = list(map(young.__getitem__, pieces))
        if len(young) > CACHE:
            self.young, self.old = {MARK: b""}, young
        return got

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new words in a row, and where each word's ids begin and how many there are."""
        bare = pc.utf8_trim_whitespace(words)
        cut = pc.subtract(pc.binary_length(words), pc.binary_length(bare))
        plain = pc.and_(pc.equal(cut, pc.cast(pc.starts_with(words, " "), cut.type)), pc.greater(pc.binary_length(bare), 0))
        plain = plain.to_numpy(zero_copy_only=False)
        count = int(plain.sum())
        lone = words.filter(pa.array(~plain)).to_pylist()
        got = []
        if count:
            together = words.filter(pa.array(plain))
            joined = pc.binary_join(pa.LargeListArray.from_arrays([0, count], together), MARK)[0].as_py() + MARK
            got = self._piece_ids(self.pattern.findall(joined))
            bytes_ = np.fromiter(map(len, got), np.int64, len(got))
            ends = np.flatnonzero(bytes_ == 0)
            if len(ends) != count:  # some word's end is white space to the pattern alone
                plain, lone, got, count = np.zeros(len(words), bool), words.to_pylist(), [], 0
        lengths = np.zeros(len(words), np.int64)
        if count:
            lengths[plain] = np.diff(np.cumsum(bytes_)[ends] // self.dtype.itemsize, prepend=0)
        apart = [b"".join(self._piece_ids(self.pattern.findall(w))) for w in lone]
        lengths[~plain] = [len(x) // self.dtype.itemsize for x in apart]
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.frombuffer(b"".join(got + apart), self.dtype), starts, lengths

    def _codes(self, words: pa.Array) -> np.ndarray:
        """Places of the given words among the known ones, after the new ones are added."""
        if len(self.words) > WORDS:
            self._forget()
        codes = np.array(pc.fill_null(pc.index_in(words, value_set=self.words), -1), np.int64)
        fresh = codes < 0
        if fresh.any():
            new = words.filter(pa.array(fresh))
            codes[fresh] = np.arange(len(self.words), len(self.words) + len(new))
            flat, starts, lengths = self._word_ids(new)
            self.starts = np.concatenate((self.starts, starts + len(self.flat)))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.flat = np.concatenate((self.flat, flat))
            self.words = pa.concat_arrays([self.words, new])
        return codes

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode_all`` for non-empty texts of a byte-level BPE without added tokens."""
        unsure = pc.match_substring_regex(texts, UNSURE).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(~unsure)), " ")
        first = split.offsets[:-1]
        word, head = (x.dictionary_encode() for x in (split.values, split.values.take(first)))
        spaced = pc.binary_join_element_wise("", word.dictionary.cast(pa.string()), " ")
        parts, codes, counts = [spaced, head.dictionary.cast(pa.string())], np.array(word.indices, np.int64), np.zeros(len(texts), np.int64)
        codes[first.to_numpy()] = np.array(head.indices, np.int64) + len(spaced)
        counts[~unsure] = np.diff(split.offsets.to_numpy())
        if unsure.any():
            pieces = [_sure.split(t) for t in texts.filter(pa.array(unsure)).to_pylist()]
            more = pa.array([w for p in pieces for w in p], pa.string()).dictionary_encode()
            counts[unsure] = list(map(len, pieces))
            own = np.repeat(unsure, counts)
            every = np.empty(len(own), np.int64)
            every[~own], every[own] = codes, np.array(more.indices, np.int64) + len(spaced) + len(parts[1])
            codes = every
            parts.append(more.dictionary)
        codes = self._codes(pa.concat_arrays(parts))[codes]
        n = self.lengths[codes]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat((self.starts[codes] - ends[:-1]).astype(np.int32), n)  # a batch has fewer than 2^31 bytes
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each closed by ``end_id`` if given, and their numbers.

        Null and empty texts have no ids of their own.
        """
        texts = texts.cast(pa.string()).fill_null("")
        some = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        whole = some.copy()
        if self.by_word:
            whole[:] = False
            for x in (MARK, *self.added):
                whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        ours = some & ~whole
        raw = self._library(texts.filter(pa.array(whole)).to_pylist())
        ids, lengths = np.frombuffer(b"".join(raw), self.dtype), np.zeros(len(texts), np.int64)
        lengths[whole] = [len(x) // self.dtype.itemsize for x in raw]
        if ours.any():
            own, lengths[ours] = self._by_words(texts.filter(pa.array(ours)))
            if len(raw):
                both = np.empty(len(ids) + len(own), self.dtype)
                theirs = np.repeat(whole, lengths)
                both[theirs], both[~theirs] = ids, own
                ids = both
            else:
                ids = own
        if end_id is not None:
            closed = np.full(len(ids) + len(texts), end_id, self.dtype)
            inner = np.ones(len(closed), bool)
            inner[np.cumsum(lengths + 1) - 1] = False
            closed[inner] = ids
            ids, lengths = closed, lengths + 1
        return ids, lengths

    def encode(self, text: str | None) -> np.ndarray:
        """Null and empty texts have no ids."""
        return self.encode_all(pa.array([text], pa.string()))[0]


def slabs(batch: pa.RecordBatch, text: int | str = 1, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most ``most`` (SLAB) bytes, or one text."""
    most = SLAB if most is None else most
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def encoder(text: str) -> Encoder:
    """One per Python worker."""
    key = zlib.crc32(text.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(text)
    return _encoders[key]


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").data)
