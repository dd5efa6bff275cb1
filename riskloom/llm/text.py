"""Words of whole Arrow batches in numpy: boundaries and 64-bit hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1_000_000  # bytes of text worked on at once; a longer text is a block of its own
POWERS = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.ndarray | np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_LOW = powers(BASE, POWERS)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + BLOCK, "right")))
            yield batch.slice(at, end - at)
            at = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    content = np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]] if data else np.zeros(0, np.uint8)
    return content, offsets - offsets[0]


def word_spans(content: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the first word of each text (with the number of words at the end)."""
    inside = ~SEPARATOR[content]
    after = np.zeros(len(content) + 1, dtype=bool)  # whether the byte before is part of the same word
    after[1:] = inside
    after[offsets] = False
    begins = np.flatnonzero(inside & ~after[:-1])
    goes_on = np.zeros(len(content) + 1, dtype=bool)
    goes_on[:-1] = inside
    goes_on[offsets] = False
    ends = np.flatnonzero(inside & ~goes_on[1:]) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def word_hashes(content: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    if not len(begins):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - begins
    first = np.zeros(len(sizes), dtype=np.int64)
    np.cumsum(sizes[:-1], out=first[1:])
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes)
    inside = ~SEPARATOR[content]
    codes = content[inside].astype(np.uint64) + np.uint64(1)
    if sizes.max() <= POWERS:
        codes *= _LOW[place]
    else:
        high = powers(_LOW[-1:] * BASE, int(sizes.max()) // POWERS + 1)
        codes *= _LOW[place % POWERS] * high[place // POWERS]
    return mix(np.add.reduceat(codes, first) + sizes.astype(np.uint64))


def hashed(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the first word of each text (with the number of words at the end)."""
    content, offsets = flat(texts)
    if lower:
        content = LOWER[content]
    begins, ends, first = word_spans(content, offsets)
    return word_hashes(content, begins, ends), first
