"""Vectorised text helpers for Arrow tasks: whole UTF-8 columns as numpy byte buffers.

A text column arrives as one byte buffer plus offsets, so words, word codes and hashes are computed
for all documents of a slice at once.  Slices hold ``SLICE_BYTES`` of text (or one longer document),
which bounds the memory of a task whatever the batch size or document length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20

#: Word separators of every contract: blank and U+0009 to U+000D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

U64 = np.uint64


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``limit`` bytes of text each (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, done + limit, side="right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string / binary column; null counts as empty."""
    col = pc.fill_null(column.cast(pa.large_binary()), b"") if column.null_count else column.cast(pa.large_binary())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    if off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]], off - off[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words ``[^\\x20\\x09-\\x0D]+`` and the word offsets of documents."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    sp = IS_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, sp[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, sp[1:]
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~sp & before), np.flatnonzero(~sp & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Exact dictionary codes of all words of a slice, and the distinct words (binary)."""
    lens = ends - starts
    total = int(lens.sum())
    kind, width = (pa.binary(), np.int32) if total < 2**31 - 1 else (pa.large_binary(), np.int64)
    off = np.zeros(len(starts) + 1, width)
    np.cumsum(lens, out=off[1:])
    flat = np.ascontiguousarray(data[~IS_SPACE[data]])
    words = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(off), pa.py_buffer(flat)])
    enc = words.dictionary_encode()
    return enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one blank after each: bytes, word starts and word ends in them."""
    out, at = ragged_take(data, starts, ends - starts, pad=1)
    new = at[:-1]
    stop = at[1:] - 1
    out[stop] = 0x20
    return out, new, stop


def ragged_take(src: np.ndarray, starts: np.ndarray, lens: np.ndarray, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``src[start:start+len]`` (each followed by ``pad`` zero cells): values, offsets."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lens + pad, out=at[1:])
    total = int(at[-1])
    if total == 0:
        return np.zeros(0, src.dtype), at
    idx = np.repeat(np.asarray(starts, np.int64) - at[:-1], lens + pad)
    idx += np.arange(total, dtype=np.int64)
    if pad:
        np.minimum(idx, len(src) - 1, out=idx)
    out = src[idx]
    if pad:
        out[at[1:] - 1] = 0
    return out, at


# --- hashing --------------------------------------------------------------------------------

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                       0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges at once; ranges of 32 bytes or more go through the xxhash library."""
    n = len(starts)
    starts, lens = np.asarray(starts, np.int64), np.asarray(lens, np.int64)
    if n == 0:
        return np.zeros(0, U64)
    padded = np.concatenate([np.ascontiguousarray(data), np.zeros(8, np.uint8)])
    u8 = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    u4 = np.ndarray(shape=(len(padded) - 3,), dtype="<u4", buffer=padded, strides=(1,))
    h = (lens.astype(U64) + U64(seed)) + P5
    for lane in range(3):
        at = slice(None) if lane == 0 and lens.min() >= 8 else np.flatnonzero(lens >= 8 * lane + 8)
        k = u8[starts[at] + 8 * lane]
        k *= P2
        k = _rot(k, 31)
        k *= P1
        h[at] = _rot(h[at] ^ k, 27) * P1 + P4
    done = lens & ~np.int64(7)
    at = np.flatnonzero(lens & 4)
    h[at] = _rot(h[at] ^ (u4[starts[at] + done[at]].astype(U64) * P1), 23) * P2 + P3
    done += lens & 4
    for b in range(3):
        at = np.flatnonzero((lens & 3) > b)
        h[at] = _rot(h[at] ^ (padded[starts[at] + done[at] + b].astype(U64) * P5), 11) * P1
    h ^= h >> U64(33)
    h *= P2
    h ^= h >> U64(29)
    h *= P3
    h ^= h >> U64(32)
    long = np.flatnonzero(lens >= 32)
    if len(long):
        view = memoryview(padded)
        h[long] = [xxhash.xxh64_intdigest(view[s:s + k], seed) for s, k in zip(starts[long].tolist(), lens[long].tolist())]
    return h


def dictionary_hashes(words: pa.Array, seed: int = 42) -> np.ndarray:
    """XXH64 of each distinct word."""
    data, off = buffers(words)
    return xxh64(data, off[:-1], np.diff(off), seed)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit value for an ordered pair of 64-bit values."""
    x = a * P1 + _rot(b * P2, 29)
    x ^= x >> U64(32)
    x *= P3
    x ^= x >> U64(29)
    return x


def segment_ids(offsets: np.ndarray) -> np.ndarray:
    """The segment number of every element, from segment offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments (empty segments: 0); integer result."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
