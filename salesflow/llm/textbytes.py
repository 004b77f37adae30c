"""Words and hashes of whole texts as NumPy arrays over the UTF-8 bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # documents are worked on in groups of about this many bytes
BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def byte_table(keep: bytes, fold: bool) -> np.ndarray:
    """Byte to byte: 0 for a separator, else the byte, A-Z lower-cased if ``fold``. Bytes from 128 on are kept."""
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    kept = np.frombuffer(keep, np.uint8)
    table[kept] = kept
    if fold:
        table[65:91] = np.where(table[65:91] > 0, np.arange(97, 123), 0)
    return table


# The byte 0 is a word character of the plain table; 255 never occurs in UTF-8 and stands for it.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_plain = bytes(b for b in range(128) if b not in SPACES)
PLAIN = byte_table(_plain, False)
PLAIN[0] = 255
FOLDED = byte_table(_plain, True)
FOLDED[0] = 255
ALNUM = byte_table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", True)


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the bounds of each text; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each; a longer document is a range of its own."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the splitmix64 finaliser)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below ``n``."""
    global _powers, _inverse
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            up = np.full(n, BASE, np.uint64)
            up[0] = 1
            down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            down[0] = 1
            _powers, _inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers, _inverse


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for spans in ascending order of start; equal content, equal hash."""
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + SLICE_BYTES, "right")))
        high = int(ends[first:last].max())
        up, down = powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[:high - low], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = last
    return mix(out)


class Words:
    """Words of some documents: start and end byte, hash, and index of the document."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
        mapped = table[data]
        on = mapped != 0
        opens, closes = on.copy(), on.copy()
        opens[1:] &= ~on[:-1]
        closes[:-1] &= ~on[1:]
        filled = bounds[:-1][bounds[1:] > bounds[:-1]]  # first bytes of documents that are not empty
        opens[filled] = on[filled]
        closes[filled[1:] - 1] = on[filled[1:] - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.hashes = span_hashes(mapped, self.starts, self.ends)
        self.doc = np.searchsorted(bounds, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(bounds) - 1).astype(np.int64)

    def __len__(self) -> int:
        return len(self.starts)


def grams(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``n`` consecutive hashes; runs over a document's end are for the caller to mask."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    factor = np.uint64((0xC2B2AE3D27D4EB4F + 2 * seed) | 1)
    count = len(hashes) - n + 1
    out = np.full(count, n + 1, np.uint64)
    for j in range(n):
        out *= factor
        out += hashes[j:j + count]
    return mix(out)


def within(doc: np.ndarray, n: int) -> np.ndarray:
    """Which runs of ``n`` consecutive words lie in one document."""
    return doc[:len(doc) - n + 1] == doc[n - 1:] if len(doc) >= n else np.zeros(0, bool)


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list per document from flat values and their counts."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def numbered(docs, *columns: str):
    """The named columns only, under these names whatever else the table holds; a missing one is null."""
    from pyspark.sql import functions as F

    return docs.select(*[docs[c] if c in docs.columns else F.lit(None).alias(c) for c in columns])
