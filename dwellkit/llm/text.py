"""Words of whole texts as 64-bit numbers, inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Lower case, and everything but ASCII letters, digits and bytes above 0x7F is a gap.
LOWER_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xBF58476D1CE4E5B9)
_HALF = np.uint64(32)


class WordHashes(dict):
    """Hash of each word, remembered up to a number of words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _HALF)) * _END
    return h ^ (h >> _HALF)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n consecutive words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = hashes[:count].copy()
    for j in range(1, n):
        h = (h ^ (h >> _HALF)) * _MIX + hashes[j : j + count]
    return mixed(h)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; the whole sequence is one where it has fewer words."""
    if not len(hashes):
        return hashes
    if len(hashes) < n:
        return np.array([xxhash.xxh64_intdigest(hashes.tobytes(), len(hashes))], np.uint64)
    return np.unique(grams(hashes, n))


def cut(joined: str, codes: np.ndarray, at: np.ndarray) -> pa.Array:
    """The strings between the places ``at``, of which the first is 0, of a text with these characters."""
    raw = joined.encode()
    if len(raw) > len(codes):
        widths = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        at = (np.cumsum(widths, dtype=np.int64) - widths)[at]
    offsets = np.append(at, len(raw)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw))


def pieces(batches: Iterator[pa.RecordBatch], most: int = 8 << 20, column: int | str = 0) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose text column has at most so many bytes; a longer text is
    a slice by itself. Bounds what a task holds beside the batch."""
    for batch in batches:
        sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()])
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if batch.num_rows > start:
            yield batch.slice(start)
