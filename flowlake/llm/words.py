"""Words of whole texts as byte ranges of one buffer, cut by numpy for all texts of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SAME = np.arange(256, dtype=np.uint8)
#: A-Z lower-cased, all other bytes as they are.
LOWER = np.where((SAME >= 65) & (SAME <= 90), SAME + 32, SAME).astype(np.uint8)
#: Bytes of words that only ASCII white space parts.
SPACED = ~np.isin(SAME, (9, 10, 11, 12, 13, 32))
#: Bytes of words of ASCII letters, digits and all that isn't ASCII.
ALNUM = (SAME >= 128) | ((SAME >= 48) & (SAME <= 57)) | ((SAME >= 65) & (SAME <= 90)) | ((SAME >= 97) & (SAME <= 122))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins; the last place is the end. Null texts are empty."""
    t = texts.cast(pa.string())
    if t.null_count:
        t = t.fill_null("")
    if not len(t):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + len(t) + 1].astype(np.int64)
    data = t.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return flat, offsets - offsets[0]


def cut(flat: np.ndarray, offsets: np.ndarray, inner: np.ndarray, letters: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: their bytes in a row, where each word begins (the last place is the end), and words per text.

    ``inner`` tells which bytes belong to words, ``letters`` what stands for each.
    """
    inside = inner[flat]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    seen = np.concatenate(([0], np.cumsum(begins)))
    at = np.cumsum(inside)[begins] - 1
    kept = letters[flat[inside]]
    return kept, np.concatenate((at, [len(kept)])), seen[offsets[1:]] - seen[offsets[:-1]]


def as_array(kept: np.ndarray, at: np.ndarray) -> pa.Array:
    """The words of ``cut`` as an Arrow array of bytes; no byte is copied."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(kept)])
