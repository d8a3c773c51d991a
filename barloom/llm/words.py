"""Word splitting and hashing over whole Arrow batches with numpy.

Texts arrive as one UTF-8 buffer plus offsets, so splitting and hashing cost a few
vector passes over the bytes and nothing per word.  All word classes used by the
operators can be told apart on bytes: separators are ASCII, and every byte of a
multi-byte character is 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_MASK = (1 << 64) - 1


def _byte_class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


#: Words between white space: every byte but 0x20 and 0x09-0x0D.
NON_SPACE = ~_byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of ASCII digits and letters and of anything beyond ASCII.
ALNUM = _byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_KEEP = np.arange(256, dtype=np.uint8)
_LOWER = _KEEP.copy()
_LOWER[0x41:0x5B] += 0x20

#: Spans of more bytes are hashed one by one.
_MOST_VECTOR_BYTES = 64
_STEP = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, eight bytes a step, each step mixed.

    Sums of powers would be faster over long spans, but sequences exist that cancel in
    any such sum (those in Thue-Morse order, modulo 2**64).
    """
    size = end - start
    out = mix(size.astype(U64) + _STEP)
    if not len(size):
        return out
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    for k in range(0, min(int(size.max()), _MOST_VECTOR_BYTES), 8):
        live = np.flatnonzero((size > k) & (size <= _MOST_VECTOR_BYTES))
        loaded = eights[start[live] + k].view("<u8").ravel()
        loaded &= U64(_MASK) >> (np.maximum(8 - (size[live] - k), 0).astype(U64) * U64(8))
        out[live] = mix((out[live] ^ loaded) + _STEP)
    long = np.flatnonzero(size > _MOST_VECTOR_BYTES)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(start[long].tolist(), end[long].tolist())]
    return out


def run_hashes(values: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of values[i : i + n] for every i: a sum with an unrelated odd factor for each place, mixed."""
    count = max(0, len(values) - n + 1)
    factors = mix(np.arange(n, dtype=U64) * _STEP + U64((salt * 0x632BE59BD9B4E019 + n) & _MASK)) | U64(1)
    out = np.zeros(count, dtype=U64)
    for k in range(n):
        out += values[k : k + count] * factors[k]
    return mix(out)


def sequence_keys(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for values[start:end] of each span, as two 64-bit numbers."""
    view = memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else memoryview(b"")
    found = b"".join(xxhash.xxh3_128_digest(view[s:e]) for s, e in zip((start * 8).tolist(), (end * 8).tolist()))
    both = np.frombuffer(found, dtype=U64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


@dataclass
class Words:
    """Words of some documents: ``first[d]:first[d + 1]`` are those of document d."""

    data: np.ndarray  # bytes of all texts, folded if asked for
    text_at: np.ndarray  # document d has data[text_at[d]:text_at[d + 1]]
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def split_words(texts: pa.Array, word_bytes: np.ndarray = NON_SPACE, lower: bool = False) -> Words:
    """Split every text of a string array into maximal runs of ``word_bytes``."""
    data, at = text_buffer(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, at, none, none, np.zeros(len(at), np.int64), np.zeros(0, U64))
    inside = word_bytes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = at[:-1][np.diff(at) > 0]
    begins[cuts] = inside[cuts]
    ends = inside
    ends[:-1] &= ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, at, start, end, np.searchsorted(start, at), byte_hashes(data, start, end))


def window_hashes(words: Words, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of n words inside one document."""
    counts = np.maximum(words.counts - (n - 1), 0)
    starts = ragged_ranges(words.first[:-1], counts)
    return starts, run_hashes(words.hash, n, salt)[starts]


def ragged_ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for count[0] values, then the same for each other pair."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(begin - before, count)


def row_slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` of text each; a longer text stands alone."""
    _, at = text_buffer(texts)
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = int(np.searchsorted(at, at[row] + most_bytes, side="right")) - 1
        stop = min(rows, max(stop, row + 1))
        yield row, stop
        row = stop


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)
