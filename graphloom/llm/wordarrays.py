"""Vectorised words of a batch of texts.

A batch of texts becomes one byte buffer in which every text is followed by a newline; words
are runs of bytes that are not ASCII white space (``[^\\x20\\x09-\\x0D]+``), found with array
operations, so no Python object is made per word.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20240517).integers(1, 2**64, 256, dtype=np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x + np.uint64(salt & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut record batches into runs of rows of about most_bytes of text; a longer text stands alone."""
    for batch in batches:
        raw = batch.column(text).cast(pa.binary()).fill_null(b"").to_pylist()
        start, held = 0, 0
        for i, t in enumerate(raw):
            if held and held + len(t) > most_bytes:
                yield batch.slice(start, i - start), raw[start:i]
                start, held = i, 0
            held += len(t)
        if start < len(raw):
            yield batch.slice(start), raw[start:]


class Words:
    """Words of some texts: start and end (bytes in data), doc (index of the text), first (per text, n + 1)."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        joined = b"\n".join([*texts, b""]) if texts else b"\n"
        self.data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes)])
        self.inside = ~WHITE[self.data]
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = self.inside
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        total = int(length.sum())
        before = np.cumsum(length) - length
        at = np.arange(total, dtype=np.int32) - np.repeat(before.astype(np.int32), length)
        values = _BYTE_VALUES[self.data[self.inside]]
        values *= _powers(int(length.max()))[at]
        return mix(np.add.reduceat(values, before), 1) + mix(length.astype(np.uint64), 2)


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of every run of size consecutive words (len(words) - size + 1 of them), by doubling."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    block, width, out, done = mix(words, salt * 2 + 11), 1, None, 0
    power = mix(np.array([salt + 77], np.uint64))[0] | np.uint64(1)
    scale = power
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        shift = np.uint64(1)
        while True:
            if size & width:
                total += block[done : done + n] * shift
                done += width
                shift *= scale
            if width * 2 > size:
                break
            block = block[:-width] + block[width:] * scale
            scale *= scale
            width *= 2
    return mix(total, salt + 5)


def sliding(values: np.ndarray, size: int, op=np.minimum) -> np.ndarray:
    """op over every run of size consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    width = 1
    while width * 2 <= size:
        values = op(values[:-width], values[width:])
        width *= 2
    return op(values[:n], values[size - width : size - width + n])
