"""Words of Arrow text columns as numpy arrays: places, hashes and runs of words.

Everything works on the UTF-8 bytes of whole texts. Words never cross texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import STEP_BYTES

U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def byte_values(seed: int = 1) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and \t \n \v \f \r part words.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Digits, letters and all beyond ASCII are in words.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

BASE = U(0x9DDFEA08EB382D69)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): the column in runs of whole rows of about `most` bytes."""
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, places, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of each word."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[buf]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edge = off[:-1][off[:-1] < len(buf)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


#: Keeps the first 0 to 8 bytes of a little-endian number.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Odd factors of the places of a run of words.
FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * U(0xA24BAED4963EE407)) | U(1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of words (words don't overlap and come in order).

    A word's eights of bytes are each mixed with their place before they are added: a sum of
    powers would let texts like the Thue-Morse string and its complement collide.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    raw = np.zeros(len(buf) + 8, np.uint8)
    raw[: len(buf)] = LOWER[buf] if lower else buf
    eights = np.ndarray((len(buf) + 1,), np.dtype("<u8"), raw, strides=(1,))
    n = (size + 7) >> 3
    first = np.cumsum(n) - n
    k = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(starts, n) + 8 * k
    h = eights[at] & FIRST_BYTES[np.minimum(np.repeat(ends, n) - at, 8)]
    h = mix(h ^ mix((k.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)))
    return mix(np.add.reduceat(h, first) + size.astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of n hashes; runs may cross rows, which the caller masks out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : k + len(out)] * FACTORS[seed + k]
    return mix(out)


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)
