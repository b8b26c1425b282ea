"""Words and shingles of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_CODES = np.arange(256)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
SAME = _CODES.astype(np.uint8)
#: Bytes that are no ASCII white space (0x20, 0x09 to 0x0D).
NOT_SPACE = ~((_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13)))
#: Bytes of [0-9a-z] and of every character beyond ASCII.
IN_WORD = ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins and ends; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) for runs of whole texts of at most `size` bytes, or of one longer text."""
    raw, at = flat(column)
    first, texts = 0, len(at) - 1
    while first < texts:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, raw[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of lower-cased (A-Z) texts: starts, ends, text and hash of each.

    With SAME and NOT_SPACE, words `[^\\x20\\x09-\\x0D]+` of the texts as they are.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, change: np.ndarray = LOWER, letters: np.ndarray = IN_WORD):
        self.bytes = change[raw]
        inside = letters[self.bytes]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
        after = np.concatenate((inside[1:], [False])) if len(raw) else inside
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.text = np.searchsorted(at, self.starts, "right") - 1
        self.count = np.bincount(self.text, minlength=len(at) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        rolled = (self.bytes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(raw))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(rolled, dtype=np.uint64)))
        self.hash = mix((total[self.ends] - total[self.starts]) * powers(_INVERSE, len(raw) + 1)[self.starts])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of k words in one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index = np.flatnonzero(self.text[:n] == self.text[k - 1:])
        h = np.full(len(index), k, np.uint64)
        for j in range(k):
            h = mix(h * np.uint64(_BASE) + self.hash[index + j])
        return index, h.view(np.int64)

    def word(self, i: int) -> str:
        return self.bytes[self.starts[i]:self.ends[i]].tobytes().decode()
