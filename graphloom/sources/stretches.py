"""K-mers that travel in stretches and meet where they are counted.

Neighbouring k-mers mostly have the same minimizer, the m-mer of the least hash among theirs, and go to the same task.
So they are shuffled as one stretch of bases instead of one by one, and all stretches of a chunk that go to one task as one row of
bytes, four bases a byte; a task expands its stretches and sorts the numbers. A task has the distinct k-mers of its minimizers,
16 bytes each; the number of tasks follows the number of bases. Letters other than A, C, G, T end a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .. import scratch

MAX_K = 31
_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)
#: Bases that are packed at once, k-mers that are sorted at once, bases a task, and the most k-mers of a stretch.
PIECE, CHUNK, TASK, LONGEST = 1 << 18, 1 << 21, 1 << 22, 16
#: No base: before the first or after the last of a sequence.
NONE = 4
#: Stretches that are dealt to the tasks at once, and unitigs whose sums meet in one place.
DEALT, GROUP = 1 << 20, 1 << 16
_PARTS = "target int, first long, part binary"


def forward(codes: np.ndarray, k: int) -> np.ndarray:
    """The k bases from each position on as a number, by doubling."""
    if k == 0:
        return np.zeros(len(codes) + 1, np.uint64)
    power, size = codes.astype(np.uint64), 1
    out, have = None, 0
    while True:
        if k & size:
            if out is None:
                out = power
            else:  # what is longer by now comes first
                n = len(codes) - (have + size) + 1
                out = (power[:n] << np.uint64(2 * have)) | out[size : size + n]
            have += size
        if have == k:
            return out
        power = (power[:-size] << np.uint64(2 * size)) | power[size:]
        size *= 2


def turned(kmers: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements."""
    x = ~kmers
    two, four = np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
    x = ((x >> np.uint64(2)) & two) | ((x & two) << np.uint64(2))
    x = ((x >> np.uint64(4)) & four) | ((x & four) << np.uint64(4))
    return x.byteswap() >> np.uint64(64 - 2 * k)


def minimizer(k: int) -> int:
    return k // 2 + 1


def _hashed(small: np.ndarray) -> np.ndarray:
    return ((small * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def cut(codes: np.ndarray, k: int, both: bool, outer: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Starts, hashes, heads and tails of the stretches of a piece; other letters have the code 4.

    ``head`` is the first k-mer. ``tail`` has the further bases, then the base before and the one after the stretch in three bits
    each and the number of k-mers in five. With ``both``, a k-mer and its reverse complement have the same hash. Bases that
    are ``outer`` are seen beside stretches and are in none.
    """
    many = len(codes) - k + 1
    if many <= 0:
        return (np.empty(0, np.int64),) * 4
    bad = np.concatenate(([0], np.cumsum((codes == NONE) if outer is None else (codes == NONE) | outer, dtype=np.int32)))
    whole = bad[k:] == bad[:-k]
    bases = codes & 3
    m = minimizer(k)
    small = forward(bases, m)
    if both:
        small = np.minimum(small, turned(small, m))
    least, w, size = _hashed(small), k - m + 1, 1
    while 2 * size <= w:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < w:
        least = np.minimum(least[: many], least[w - size : w - size + many])
    fresh = np.ones(many, bool)
    fresh[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
    starts = np.flatnonzero(fresh)
    sizes = np.diff(starts, append=many)
    keep = whole[starts]
    starts, sizes = starts[keep], sizes[keep]
    if len(sizes) and sizes.max() > LONGEST:
        parts = -(-sizes // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, sizes = np.repeat(starts, parts) + nth * LONGEST, np.minimum(np.repeat(sizes, parts) - nth * LONGEST, LONGEST)
    heads = forward(bases, k)[starts]
    padded = np.concatenate([bases, np.zeros(LONGEST, np.uint8)])
    more = forward(padded, LONGEST - 1)[starts + k] >> (2 * (LONGEST - sizes)).astype(np.uint64)
    around = np.concatenate([[NONE], codes, [NONE]]).astype(np.uint64)
    tails = (more << np.uint64(11)) | (around[starts] << np.uint64(8)) | (around[starts + sizes + k] << np.uint64(5)) | sizes.astype(np.uint64)
    return starts, least[starts], heads.view(np.int64), tails.view(np.int64)


def varints(numbers: np.ndarray) -> np.ndarray:
    """Bytes of numbers, seven bits each, the lowest first; all but a number's last byte have the highest bit."""
    x = numbers.astype(np.uint64)
    sizes = np.ones(len(x), np.int64)
    for i in range(1, 10):
        more = x >= np.uint64(1 << 7 * i)
        if not more.any():
            break
        sizes += more
    out, at = np.empty(sizes.sum(), np.uint8), np.cumsum(sizes) - sizes
    for i in range(int(sizes.max(initial=0))):
        own = sizes > i
        low = ((x[own] >> np.uint64(7 * i)) & np.uint64(127)).astype(np.uint8)
        out[at[own] + i] = low | ((sizes[own] > i + 1).astype(np.uint8) << 7)
    return out


def numbers(data: np.ndarray) -> np.ndarray:
    """The numbers of ``varints``."""
    if not len(data):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(data < 128)
    if len(ends) == len(data):
        return data.astype(np.int64)
    begins = np.concatenate(([0], ends[:-1] + 1))
    nth = np.arange(len(data)) - np.repeat(begins, ends + 1 - begins)
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * nth).astype(np.uint64), begins).view(np.int64)


def _ragged(heads: np.ndarray, tails: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The bases of stretches, four a byte, and where each stretch ends; a stretch begins with a byte."""
    heads, tails = heads.view(np.uint64), tails.view(np.uint64)
    sizes = tails & np.uint64(31)
    more = (tails >> np.uint64(11)) << (np.uint64(64) - np.uint64(2) * np.maximum(sizes, 2) + np.uint64(2))
    words = np.empty((len(heads), 2), np.uint64)
    words[:, 0] = (heads << np.uint64(64 - 2 * k)) | (more >> np.uint64(2 * k))
    words[:, 1] = more << np.uint64(64 - 2 * k)
    length = (sizes.astype(np.int64) + k + 2) >> 2
    return words.byteswap().view(np.uint8)[np.arange(16) < length[:, None]], np.cumsum(length)


def _stretched(data: np.ndarray, sizes: np.ndarray, around: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Heads and tails again."""
    words = np.zeros((len(sizes), 16), np.uint8)
    words[np.arange(16) < ((sizes + k + 2) >> 2)[:, None]] = data
    words = words.view(np.uint64).byteswap()
    sizes = sizes.astype(np.uint64)
    more = (words[:, 0] << np.uint64(2 * k)) | (words[:, 1] >> np.uint64(64 - 2 * k))
    more = np.where(sizes > 1, more >> (np.uint64(64) - np.uint64(2) * np.maximum(sizes, 2) + np.uint64(2)), 0)
    tails = (more << np.uint64(11)) | (around.astype(np.uint64) << np.uint64(5)) | sizes
    return (words[:, 0] >> np.uint64(64 - 2 * k)).view(np.int64), tails.view(np.int64)


def _targets(hashes: np.ndarray, tasks: int) -> np.ndarray:
    """Tasks for minimizers."""
    x = hashes.astype(np.uint32)
    for shift, odd in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(odd)
    return (((x ^ (x >> np.uint32(16))).astype(np.uint64) * np.uint64(tasks)) >> np.uint64(32)).astype(np.int32)


def targets_of(kmers: np.ndarray, k: int, tasks: int) -> np.ndarray:
    """The tasks that ``stretches`` of both strands deal k-mers to."""
    m, least = minimizer(k), np.full(len(kmers), 0xFFFFFFFF, np.uint32)
    for i in range(k - m + 1):
        small = (kmers >> np.uint64(2 * i)) & np.uint64((1 << 2 * m) - 1)
        least = np.minimum(least, _hashed(np.minimum(small, turned(small, m))))
    return _targets(least, tasks)


def _parts(hashes: np.ndarray, who: np.ndarray, heads: np.ndarray, tails: np.ndarray, k: int, tasks: int, around: bool) -> pa.RecordBatch:
    """Stretches by task: their number, that of the next bytes, whose they are, sizes, the bases around if asked for, and bases."""
    targets = _targets(hashes, tasks)
    order = np.lexsort((who, targets))
    targets, who, heads, tails = targets[order], who[order], heads[order], tails[order]
    data, ends = _ragged(heads, tails, k)
    sizes = ((tails & 31) - 1).astype(np.uint8)
    beside = ((tails >> 5) & 63).astype(np.uint8)
    steps = np.diff(who, prepend=0)
    at = np.flatnonzero(np.concatenate(([True], targets[1:] != targets[:-1], [True]))) if len(who) else np.zeros(1, np.int64)
    parts = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        owners = varints(steps[lo + 1 : hi])
        two = np.zeros(hi - lo + 1 & ~1, np.uint8)
        two[: hi - lo] = sizes[lo:hi]
        counts = np.array([hi - lo, len(owners)], np.uint32).tobytes()
        parts.append(b"".join([counts, owners.tobytes(), (two[::2] << 4 | two[1::2]).tobytes(), beside[lo:hi].tobytes() if around else b"", data[ends[lo - 1] if lo else 0 : ends[hi - 1]].tobytes()]))
    return pa.RecordBatch.from_arrays([pa.array(targets[at[:-1]]), pa.array(who[at[:-1]]), pa.array(parts, pa.binary())], names=["target", "first", "part"])


def unpacked(first: int, part: bytes, k: int, around: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(who, head, tail) of one row."""
    data = np.frombuffer(part, np.uint8)
    n, at = (int(x) for x in data[:8].view(np.uint32))
    who = first + np.concatenate((np.zeros(1, np.int64), np.cumsum(numbers(data[8 : 8 + at]))))
    at += 8
    two = data[at : at + (n + 1) // 2]
    sizes = np.stack([two >> 4, two & 15], axis=1).ravel()[:n].astype(np.int64) + 1
    at += len(two)
    beside = data[at : at + n] if around else np.zeros(n, np.uint8)
    return who, *_stretched(data[at + n * around :], sizes, beside, k)


def stretches(rows: DataFrame, k: int, both: bool, tasks: int = 1, around: bool = False) -> DataFrame:
    """(target, first, part) of rows (who, bases); a long sequence goes in pieces that know the bases around them.

    A row has the stretches that a chunk has for one of the ``tasks``, by ``who``, of which ``first`` is the least; the bases
    ``around`` stretches go along if asked for.
    """
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}: {k}")

    def emit(who: np.ndarray, sizes: np.ndarray, codes: np.ndarray, outer: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        # each sequence is followed by a line's end
        joined = np.full(len(codes) + len(sizes), NONE, np.uint8)
        joined[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = codes
        starts, hashes, heads, tails = cut(joined, k, both, outer)
        return hashes, who[np.searchsorted(np.cumsum(sizes + 1), starts, "right")], heads, tails

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            who, text = batch.column(0).to_numpy(), batch.column(1).fill_null("").cast(pa.large_string())
            at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            codes = _CODES[np.frombuffer(text.buffers()[2] or b"", np.uint8)]
            i = 0
            while i < len(text):
                j = int(np.searchsorted(at, at[i] + PIECE, "right")) - 1
                if j > i:
                    yield emit(who[i:j], np.diff(at[i : j + 1]), codes[at[i] : at[j]])
                    i = j
                    continue
                lo, end = int(at[i]), int(at[i + 1])
                for first in range(lo, end - k + 1, PIECE):
                    a, b = max(lo, first - 1), min(end, first + PIECE + k)
                    outer = np.zeros(b - a + 1, bool)
                    outer[: first - a] = True
                    outer[first - a + PIECE + k - 1 :] = True
                    yield emit(who[i : i + 1], np.array([b - a]), codes[a:b], outer)
                i += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for one in found(batches):
            if len(one[0]):
                held.append(one)
                size += len(one[0])
            if size >= DEALT:
                yield _parts(*(np.concatenate(c) for c in zip(*held, strict=True)), k, tasks, around)
                held, size = [], 0
        if held:
            yield _parts(*(np.concatenate(c) for c in zip(*held, strict=True)), k, tasks, around)

    return rows.mapInArrow(run, _PARTS)


def expand(heads: np.ndarray, tails: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K-mers of stretches in order, where each stretch begins, and how many it has."""
    heads, tails = heads.view(np.uint64), tails.view(np.uint64)
    sizes = (tails & np.uint64(31)).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    nth = (np.arange(sizes.sum()) - np.repeat(begins, sizes)).astype(np.uint64)
    left = np.repeat(sizes, sizes).astype(np.uint64) - nth - np.uint64(1)
    two = np.uint64(2)
    more = (np.repeat(tails >> np.uint64(11), sizes) >> (two * left)) & ((np.uint64(1) << (two * nth)) - np.uint64(1))
    kmers = ((np.repeat(heads, sizes) << (two * nth)) | more) & np.uint64((1 << 2 * k) - 1)
    return kmers, begins, sizes


def summed(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the sums of their counts."""
    if counts is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
    if not len(values):
        return values, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.diff(first, append=len(values)) if counts is None else np.add.reduceat(counts, first)


class Tally:
    """Sums of values that come in chunks; small ones are joined as they gather, so what is held stays near what is distinct."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.fresh = 0

    def add(self, values: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.parts.append(summed(values, counts))
        self.fresh += len(self.parts[-1][0])
        if self.fresh > max(CHUNK * 2, len(self.parts[0][0])):
            self.end()

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(self.parts) > 1:
            self.parts = [summed(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))]
        self.fresh = 0
        return self.parts[0]


def chunks(batches: Iterator[pa.RecordBatch], k: int, around: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(who, head, tail) of some rows (target, first, part) at a time."""
    held, size = [], 0
    for batch in batches:
        for first, part in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            held.append(unpacked(first, part.as_buffer(), k, around))
            size += len(held[-1][0])
            if size >= CHUNK // 4:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def by_who(who: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    order = np.argsort(who, kind="stable")
    who, heads, tails = who[order], heads[order], tails[order]
    at = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1], [True]))) if len(who) else [0]
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        yield int(who[lo]), heads[lo:hi], tails[lo:hi]


def lesser(kmers: np.ndarray, k: int, both: bool) -> np.ndarray:
    return np.minimum(kmers, turned(kmers, k)) if both else kmers


def tasks_for(df: DataFrame, bases: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-bases // TASK))


def met(rows: DataFrame, tasks: int, sort: bool = False) -> DataFrame:
    """Stretches in the tasks that they are for; with ``sort``, those of the least ``who`` first."""
    dealt = rows.repartitionById(tasks, "target")
    return dealt.sortWithinPartitions("first") if sort else dealt


def total_bases(sequences: DataFrame, bases: str = "bases") -> int:
    return sequences.agg(F.sum(F.length(bases))).first()[0] or 0


def _code(sample: str, samples: Sequence) -> Column:
    """A sample's number, from -1 down; null for others."""
    known = F.lit(None).cast("long")
    for i, s in enumerate(samples):
        known = F.when(F.col(sample).eqNullSafe(F.lit(s)), F.lit(-1 - i).cast("long")).otherwise(known)
    return known


def counts(sequences: DataFrame, k: int, sample: str | None = "sample", bases: str = "bases", both: bool = True) -> DataFrame:
    """(kmer, sample, n): how often each k-mer, as a number, is seen in a sample; without one, (kmer, n).

    With ``both`` strands a k-mer is the lesser of itself and its reverse complement. The samples' names, a row each, reach the driver.
    """
    samples = [None] if sample is None else [r[0] for r in sequences.select(sample).distinct().collect()]
    rows = sequences.select((F.lit(-1).cast("long") if sample is None else _code(sample, samples)).alias("who"), F.col(bases).alias("bases"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[int, Tally] = {}
        for chunk in chunks(batches, k):
            for who, heads, tails in by_who(*chunk):
                tallies.setdefault(who, Tally()).add(lesser(expand(heads, tails, k)[0], k, both))
        for who in sorted(tallies):
            kmers, n = tallies.pop(who).end()
            for lo in range(0, len(kmers), 1 << 16):
                part = kmers[lo : lo + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), who)), pa.array(n[lo : lo + (1 << 16)])], names=["kmer", "who", "n"])

    tasks = tasks_for(sequences, total_bases(sequences, bases))
    found = met(stretches(rows, k, both, tasks), tasks).mapInArrow(run, "kmer long, who long, n long")
    if sample is None:
        return found.select("kmer", "n")
    name = F.element_at(F.array(*map(F.lit, samples)), (-F.col("who")).cast("int")) if samples else F.lit(None).cast(sequences.schema[sample].dataType)
    return found.select("kmer", name.alias("sample"), "n")


def _sums(who: np.ndarray, sums: np.ndarray, size: int) -> Iterator[tuple[int, bytes]]:
    """Sums (a row each, by who in order) as groups of so many unitigs and bytes."""
    first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
    who, sums = who[first], np.add.reduceat(sums, first, axis=0)
    groups = who // size
    at = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        steps = np.diff(who[lo:hi] % size, prepend=0)
        yield int(groups[lo]), np.concatenate([np.array([hi - lo], np.uint32).view(np.uint8), varints(np.concatenate([steps, sums[lo:hi].T.ravel()]))]).tobytes()


def _added(batches: Iterator[pa.RecordBatch], samples: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, places in it, sums) of rows (group, part) in the order of the groups."""
    group, total, seen = None, np.zeros((size, samples), np.int64), np.zeros(size, bool)
    for batch in batches:
        for g, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if g != group:
                if group is not None:
                    yield group, np.flatnonzero(seen), total[seen]
                    total[:], seen[:] = 0, False
                group = g
            data = np.frombuffer(part.as_buffer(), np.uint8)
            n, values = int(data[:4].view(np.uint32)[0]), numbers(data[4:])
            at = np.cumsum(values[:n])
            total[at] += values[n:].reshape(samples, n).T
            seen[at] = True
    if group is not None:
        yield group, np.flatnonzero(seen), total[seen]


class Table:
    """The counts of sorted k-mers in some samples."""

    def __init__(self, ends: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.known = summed(np.concatenate([e[0] for e in ends]))[0]
        self.counts = np.zeros((len(self.known) + 1, len(ends)), np.int64)
        for i, (kmers, n) in enumerate(ends):
            self.counts[np.searchsorted(self.known, kmers), i] = n

    def sums(self, who: np.ndarray, heads: np.ndarray, tails: np.ndarray, k: int, size: int) -> pa.RecordBatch:
        """(group, part) of stretches: their k-mers' counts, summed by who."""
        order = np.argsort(who, kind="stable")
        who, heads, tails, found = who[order], heads[order], tails[order], []
        for lo in range(0, len(who), CHUNK // 16):
            some = slice(lo, lo + CHUNK // 16)
            kmers, begins, _ = expand(heads[some], tails[some], k)
            kmers = lesser(kmers, k, True)
            order = np.argsort(kmers)
            at = np.empty(len(kmers), np.int64)
            at[order] = np.searchsorted(self.known, kmers[order])
            hit = at < len(self.known)
            hit[hit] = self.known[at[hit]] == kmers[hit]
            at[~hit] = len(self.known)
            found.append(np.add.reduceat(self.counts[at], begins, axis=0))
        groups, parts = zip(*_sums(who, np.concatenate(found), size), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(parts, pa.binary())], names=["group", "part"])


#: What ``Table.sums`` gives.
SUMS = "group long, part binary"


def gathered(parts: DataFrame, tasks: int, columns: Sequence[str], size: int) -> DataFrame:
    """(who, a column a sample) of the sums (group, part) of many tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, at, sums in _added(batches, len(columns), size):
            yield pa.RecordBatch.from_arrays([pa.array(group * size + at), *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(len(columns))]], names=["who", *columns])

    return parts.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(add, ", ".join(["who long", *[f"{c} long" for c in columns]]))


def totals(unitigs: DataFrame, sequences: DataFrame, k: int, samples: Sequence, unitig: str = "unitig", bases: str = "bases", sample: str = "sample") -> DataFrame:
    """(unitig, n_kmers, n0, n1, ...): the sums of counts over a unitig's k-mers in each sample, unseen ones as 0, repeated ones repeatedly.

    Sequences and unitigs meet by stretches; a task counts its k-mers, then goes over its unitigs' stretches and returns sums by
    unitig as bytes, which meet by groups of unitigs. Every unitig of k bases or more has a row.
    """
    spark = unitigs.sparkSession
    named = scratch.keep(spark, unitigs.select(F.monotonically_increasing_id().alias("who"), F.col(unitig).alias("unitig"), F.col(bases).alias("bases")), "unitigs", "zstd")
    seen = sequences.select(_code(sample, samples).alias("who"), F.col(bases).alias("bases")).where("who is not null")
    columns, size = [f"n{i}" for i in range(len(samples))], GROUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies, table = [Tally() for _ in samples], None
        for chunk in chunks(batches, k):
            early = chunk[0] < 0  # samples are before unitigs
            for who, heads, tails in by_who(*(c[early] for c in chunk)):
                tallies[-1 - who].add(lesser(expand(heads, tails, k)[0], k, True))
            who, heads, tails = (c[~early] for c in chunk)
            if not len(who):
                continue
            if table is None:
                table = Table([t.end() for t in tallies])
                tallies = []
            yield table.sums(who, heads, tails, k, size)

    tasks = tasks_for(sequences, total_bases(sequences, bases))
    rows = stretches(seen, k, True, tasks).unionByName(stretches(named.select("who", "bases"), k, True, tasks))
    sums = gathered(met(rows, tasks, sort=True).mapInArrow(run, SUMS), tasks, columns, size)
    lengths = named.select("who", "unitig", (F.length("bases") - (k - 1)).alias("n_kmers")).where("n_kmers > 0")
    return lengths.join(sums, "who", "left").select("unitig", "n_kmers", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])


def depths(unitigs: DataFrame, sequences: DataFrame, k: int, samples: Sequence, unitig: str = "unitig", bases: str = "bases", sample: str = "sample") -> DataFrame:
    """(unitig, sample, depth): mean count over a unitig's k-mers, unseen ones as 0, repeated ones repeatedly.

    Every unitig of k bases or more has a depth in each sample.
    """
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"n{i}").alias("total")) for i, s in enumerate(samples)]))
    found = totals(unitigs, sequences, k, samples, unitig, bases, sample)
    return found.select("unitig", "n_kmers", each.alias("e")).select("unitig", "e.sample", (F.col("e.total") / F.col("n_kmers")).alias("depth"))


_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_FOURS = np.stack([_LETTERS[np.arange(256) >> s & 3] for s in (6, 4, 2, 0)], axis=1).copy().view(np.uint32).ravel()


def spell(kmers: np.ndarray, k: int) -> pa.Array:
    """K-mers as text."""
    whole = np.empty((len(kmers), -(-k // 4)), np.uint32)
    bits = kmers.view(np.uint64)
    for i in range(whole.shape[1]):  # from the last four letters on
        whole[:, -1 - i] = _FOURS[((bits >> np.uint64(8 * i)) & np.uint64(255)).astype(np.intp)]
    letters = np.ascontiguousarray(whole.view(np.uint8)[:, whole.shape[1] * 4 - k :])
    ends = (np.arange(len(kmers) + 1) * k).astype(np.int32)
    return pa.StringArray.from_buffers(len(kmers), pa.py_buffer(ends), pa.py_buffer(letters))


def spelled(df: DataFrame, k: int, *columns: str) -> DataFrame:
    """``df`` with columns of k-mers as text instead of numbers."""
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [spell(c.to_numpy(), k) if i in at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return df.mapInArrow(run, StructType([StructField(f.name, StringType() if f.name in columns else f.dataType) for f in df.schema]))


def with_other_strand(df: DataFrame, k: int, column: str, into: str) -> DataFrame:
    """``df`` with the reverse complements of a column's k-mers as a further column of numbers."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            other = turned(b.column(at).to_numpy().view(np.uint64), k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(other.view(np.int64))], names=[*b.schema.names, into])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(into, df.schema[column].dataType)]))


def check_strands(found: DataFrame, k: int, tasks: int) -> DataFrame:
    """(kmer, sample, n) of counts with each k-mer as its lesser strand; a k-mer that is there in both strands fails.

    A table that rows repeat in is summed. Counts are shuffled once, to so many tasks; a task has its k-mers as sorted numbers.
    """
    rows = found.select("kmer", "sample", F.col("n").cast("long").alias("n"))
    kind = rows.schema["sample"].dataType

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = lesser(b.column(0).to_numpy().view(np.uint64), k, True)
            bucket = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *b.columns], names=["bucket", "kmer", "sample", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[object, int] = {}
        tallies: list[Tally] = []
        for b in batches:
            sample = b.column(2).dictionary_encode(null_encoding="encode")
            own = np.array([names.setdefault(x, len(names)) for x in sample.dictionary.to_pylist()], np.int64)[sample.indices.to_numpy()]
            tallies += [Tally() for _ in range(len(names) - len(tallies))]
            kmers, n = b.column(1).to_numpy().view(np.uint64), b.column(3).to_numpy()
            for i in np.unique(own).tolist():
                tallies[i].add(kmers[own == i], n[own == i])
        ends = [t.end() for t in tallies]
        every = summed(np.concatenate([e[0] for e in ends]))[0] if ends else np.empty(0, np.uint64)
        twice, many = summed(lesser(every, k, True))
        if len(many) and many.max() > 1:
            raise ValueError(f"both strands present: {spell(twice[many > 1][:1].view(np.int64), k)[0]}")
        del every, twice, many
        for name, (kmers, n) in zip(names, ends, strict=True):
            for lo in range(0, len(kmers), 1 << 16):
                part = lesser(kmers[lo : lo + (1 << 16)], k, True).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([name] * len(part), b.schema.field(2).type), pa.array(n[lo : lo + (1 << 16)])], names=["kmer", "sample", "n"])

    schema = StructType([rows.schema["kmer"], StructField("sample", kind), rows.schema["n"]])
    dealt = rows.mapInArrow(hashed, StructType([StructField("bucket", IntegerType()), *rows.schema.fields]))
    return dealt.repartition(tasks, "bucket").mapInArrow(run, schema)
