"""Text as flat byte arrays: words, hashes and n-grams of whole Arrow batches in numpy.

A column of texts becomes one uint8 array with offsets. Words are found by mask
differences and hashed by differences of prefix sums, so that cost per byte is a few
vector operations and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STEP = 1 << 18  # bytes of text handled at once, to bound temporary arrays
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_code = np.arange(256, dtype=np.uint8)
LOWER = np.where((_code >= 65) & (_code <= 90), _code + 32, _code).astype(np.uint8)
#: Bytes of words: digits, ASCII letters and all of every non-ASCII character.
ALNUM = ((_code >= 48) & (_code <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_code >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _PINV)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            have = 1
            step = base
            while have < size:  # out[have:2*have] = out[:have] * base**have
                out[have : 2 * have] = out[:have] * step
                step = np.uint64(int(step) ** 2 % (1 << 64))
                have *= 2
            _powers[k] = out
    return _powers[0], _powers[1]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; a null text is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, step: int = STEP) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges whose text holds about `step` bytes, one row at least."""
    k = batch.schema.get_field_index(column)
    _, offs = flat(batch.column(k))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + step, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a flat buffer: starts, ends (bytes), hash, and per text the range of its words."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, mask: np.ndarray = ALNUM, lower: bool = True):
        n = len(buf)
        m = mask[buf]
        before = np.empty(n, bool)
        before[1:] = m[:-1]
        edge = offs[:-1][offs[:-1] < n]
        if n:
            before[0] = False
            before[edge] = False
        self.starts = np.flatnonzero(m & ~before)
        after = np.empty(n, bool)
        after[:-1] = m[1:]
        if n:
            after[-1] = False
            after[offs[1:][offs[1:] > 0] - 1] = False
        self.ends = np.flatnonzero(m & ~after) + 1
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(((LOWER[buf] if lower else buf).astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        self.hash = mix((total[self.ends] - total[self.starts]) * down[self.starts])
        self.first = np.searchsorted(self.starts, offs)  # of text k: first[k] to first[k + 1]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words at every word, and whether they lie in one text."""
        h = self.hash
        size = len(h)
        out = h.copy()
        for k in range(1, n):
            out[: size - k] = mix(out[: size - k] * _P + h[k:])
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(size)
        return out, left >= n


def once(values: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """The distinct values (indices into `stamp`), in O(n): of equal ones the last stays."""
    at = np.arange(len(values), dtype=stamp.dtype)
    stamp[values] = at
    return values[stamp[values] == at]
