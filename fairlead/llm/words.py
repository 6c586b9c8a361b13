"""Vectorised words, hashes and n-grams of Arrow string columns.

A word is `[^\\x20\\x09-\\x0D]+` in UTF-8 (the separators are ASCII, so bytes may be scanned). All
functions take many documents at once and run in numpy; no Python loop runs over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
SHORT = 64  # bytes of the longest word that is hashed in numpy


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def mix1(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U))[0])


@dataclass
class Words:
    """data: bytes of all texts; start, end: each word's bytes; doc_at: first word of each document, and the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc_at: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits for each word: eight bytes at a time through mix; of words over SHORT bytes a part of BLAKE2b."""
        size = self.end - self.start
        out = mix(size.astype(U) * U(0x9E3779B97F4A7C15))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
        live, at, left = np.arange(len(size)), self.start, np.where(size > SHORT, 0, size)
        while len(live := live[left > 0]):
            at, left = at[left > 0], left[left > 0]
            term = eight[at]
            term &= LOW_BYTES[np.minimum(left, 8)]
            term ^= out[live]
            out[live] = mix(term)
            at, left = at + 8, left - 8
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = int.from_bytes(blake2b(self.data[self.start[i] : self.end[i]], digest_size=8).digest(), "little")
        return out

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_at) - 1), np.diff(self.doc_at))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count or not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def split(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SEPARATOR) -> Words:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    first, last = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    edge = edge[inside[edge] & inside[edge + 1]]  # two documents meet within a run of word bytes
    first[edge] = last[edge] = True
    start, end = np.flatnonzero(first[: len(data) + 1]), np.flatnonzero(last)
    return Words(data, start, end, np.searchsorted(start, at))


def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * U(0xD1342543DE82EF95) + y)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive values of h (len(h) - n + 1 of them; none if there are fewer), from those of half as many."""
    if len(h) < n:
        return np.zeros(0, U)
    span = 1
    while span * 2 <= n:
        h, span = both(h[:-span], h[span:]), span * 2
    return mix((both(h[: span - n], h[n - span :]) if span < n else h) + U(n))


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about `most` bytes of text, or one row; rows are never cut. Freed memory goes back to the system at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            to = max(row + 1, int(np.searchsorted(at, at[row] + most)))
            yield batch.slice(row, to - row)
            row = to
    release()


def unused(names: list[str], name: str) -> str:
    """name, with as many underscores after it as set it apart from all names."""
    taken = {x.lower() for x in names}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Returns freed memory to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive values, by running minima from both edges of blocks of n."""
    if len(x) < n:
        return x[:0]
    blocks = np.concatenate([x, np.full(-len(x) % n, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, n)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(x) - n + 1], ahead[n - 1 : len(x)])
