"""Vectorised text helpers that run inside Arrow tasks.

A batch of texts is one UTF-8 byte array with document offsets; words are found by a
byte table and hashed with prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of bytes other than space and tab..carriage return.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words are runs of ASCII digits, lower-case letters and non-ASCII bytes.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of text handled at once; bounds the 8-byte arrays derived from them.
SLICE_BYTES = 1 << 18

#: What a worker process keeps between the tasks of one operator; it goes when another one starts.
KEPT: dict[str, object] = {}

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POW: list[np.ndarray] = []


def release() -> None:
    """Give memory that a worker process no longer needs back to the system.

    Workers outlive tasks and operators, and allocators keep what large arrays have freed.
    """
    KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (murmur3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant mod 2**64 and of its inverse."""
    if not _POW or len(_POW[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for out, base in ((0, _ODD), (1, inverse)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            _POW[out : out + 1] = [p]
    return _POW[0], _POW[1]


def kept(name: str, make) -> object:
    """What this worker process keeps under a name; anything that it keeps for another operator goes."""
    if name not in KEPT:
        release()
        KEPT[name] = make(name)
    return KEPT[name]


def utf8(column: pa.Array, user: object = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows (null: empty) and the offsets of rows in them; what is kept for others than ``user`` goes."""
    if KEPT and user not in KEPT.values():
        release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def small_batches(df) -> None:
    """Bound the rows of an Arrow batch for this session, as texts can be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key, "10000")) not in range(1, 513):
        conf.set(key, "512")


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends (bytes) and, per row, the index of its first word."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    m = table[raw]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[cut] = True
    before, after = np.empty_like(m), np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    after[-1], after[:-1] = False, m[1:]
    starts = np.flatnonzero(m & (~before | edge[:-1]))
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _long_hash(word: np.ndarray) -> np.uint64:
    """The hash of one long word, a slice at a time."""
    up, _ = _powers(SLICE_BYTES + 1)
    h, ahead = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for lo in range(0, len(word), SLICE_BYTES):
        part = word[lo : lo + SLICE_BYTES]
        h += ((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)]).sum(dtype=np.uint64) * ahead
        ahead *= up[SLICE_BYTES]
    return mix(h + np.array([len(word)], np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, equal for equal bytes wherever they stand."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        if ends[lo] - base > SLICE_BYTES:
            out[lo] = _long_hash(raw[base : ends[lo]])
            lo += 1
            continue
        hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        part = raw[base : ends[hi - 1]]
        up, down = _powers(len(part) + 1)
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        h = (sums[e] - sums[s]) * down[s]
        out[lo:hi] = mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        lo = hi
    return out


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k-1 entries are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(0xA24BAED4963EE407) + words[j : j + n]
        h ^= h >> np.uint64(29)
    return mix(h + np.uint64(k))


def code_points(raw: np.ndarray) -> np.ndarray:
    """For each byte, how many code points start before it; one entry more at the end."""
    lead = (raw & 0xC0) != 0x80
    out = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(lead, out=out[1:])
    return out
