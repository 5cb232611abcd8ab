"""Vectorised word and shingle hashing over Arrow batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D after A-Z are lower-cased, so a word
never depends on the machine's locale. Word hashes are 64-bit: a random value for each byte, weighted by
powers of an odd multiplier, summed by one prefix sum for all texts of a chunk, then mixed. Equal words
have equal hashes everywhere; different words collide with probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_LETTER = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LETTER[65:91] = _LETTER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); a bijection."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((_ODD, _INV)):
            step = np.full(size, base, U)
            step[0] = 1
            _powers[i] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null reads as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer text is a chunk of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, first) for the texts between offsets: first[i] is text i's first word, len = texts + 1."""
    base, end = int(offsets[0]), int(offsets[-1])
    b = raw[base:end]
    cut = offsets - base
    if not len(b):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    space = _SPACE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[cut] = True
    before = np.empty(len(b), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(b), bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    up, down = _power_tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, U)
    np.cumsum(_LETTER[b] * up[: len(b)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts])
    return h, starts + base, ends + base, np.searchsorted(starts, cut)


def shingle_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first) of the n-word shingles of each text; a text of fewer words has its whole sequence as one."""
    counts = np.diff(first)
    out = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    new_first = np.concatenate([[0], np.cumsum(out)])
    weights = [U(w) for w in (0xD6E8FEB86659FD93, 0xA5A35625E6F5C3A5, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0x165667B19E3779F9)]
    if n > len(weights):
        raise ValueError(f"shingles have 1 to {len(weights)} words")
    start = np.repeat(first[:-1], out) + (np.arange(new_first[-1]) - np.repeat(new_first[:-1], out))
    have = np.repeat(np.minimum(counts, n), out)
    padded = np.concatenate([h, np.zeros(n, U)])
    total = have.astype(U) * U(0x27D4EB2F165667C5)
    for i in range(n):
        total += np.where(have > i, padded[start + i] * weights[i], U(0))
    return mix(total), new_first
