"""Importance resampling towards a target distribution, over hashed word n-grams.

A feature is a run of one to three words; its bucket is the CRC-32 of its bytes. CRC-32 is linear over
XOR: a byte contributes a value that depends on the byte and on how far it stands from the end, and a
constant depends on the length. Contributions come from one table of positions by bytes, and a
feature's checksum is the XOR over its span, for all spans of a slice at once (``bitwise_xor.reduceat``).
Spans longer than the table are folded block by block: what has been summed so far moves one table
length further from the end, which is linear too.

Bucket counts of corpus and target are aggregated by Spark; the gains are a table of ``BUCKETS``
numbers, broadcast to the second pass. The draw ranks by weight plus Gumbel noise: ids by range
partitions, so no task ranks all documents.

Defined cases: a null text or one without words has no features, weight 0 and a score, and is never
drawn; a null id hashes as an empty one and ties after others; rows that repeat an id share its noise
and are ranked one by one; an empty target gives the gains of t = T = 0; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from . import text as tx

BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: Words that a document needs to be drawn, and percent of such documents that are drawn.
MIN_WORDS, DRAWN_PERCENT = 20, 5
#: Positions from the end that the table has, and bytes of spans handled at once.
POSITIONS, SPAN_BYTES = 256, 1 << 20
#: Words whose features are taken at once.
SOME_WORDS = 1 << 16


def _zeros(n: int) -> bytes:
    return bytes(n)


def _position_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contributions by (distance from the end, byte); a checksum moved by a table length, by (its byte, value); constants by length.

    zlib's checksum of a message is a constant of its length XOR the contributions of its bytes.
    """
    constants = np.array([zlib.crc32(_zeros(n)) for n in range(POSITIONS + 1)], dtype=np.uint32)
    at = np.empty((POSITIONS, 256), dtype=np.uint32)
    for b in range(256):
        at[0, b] = zlib.crc32(bytes([b])) ^ int(constants[1])
    for d in range(1, POSITIONS):  # one place further: the low byte is taken out and comes back as its own contribution
        at[d] = (at[d - 1] >> np.uint32(8)) ^ at[0][at[d - 1] & np.uint32(255)]
    unit = np.arange(256, dtype=np.uint32)
    moved = np.stack([unit << np.uint32(8 * i) for i in range(4)])
    for _ in range(POSITIONS):
        moved = (moved >> np.uint32(8)) ^ at[0][moved & np.uint32(255)]
    return at, moved, constants


TABLE, MOVED, CONSTANTS = _position_table()


def _moved(x: np.ndarray) -> np.ndarray:
    """Sums of contributions, each ``POSITIONS`` places further from the end."""
    out = MOVED[0][x & np.uint32(255)]
    for i in range(1, 4):
        out = out ^ MOVED[i][(x >> np.uint32(8 * i)) & np.uint32(255)]
    return out


def _summed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of the contributions of spans of 1 to ``POSITIONS`` bytes."""
    n = ends - starts
    first = np.cumsum(n) - n
    back = np.repeat(first + n - 1, n) - np.arange(n.sum())  # distance from the span's end
    return np.bitwise_xor.reduceat(TABLE[back, raw[np.repeat(ends - 1, n) - back]], first)


def _constant(lengths: np.ndarray) -> np.ndarray:
    """The checksums of so many zero bytes."""
    out = np.empty(len(lengths), dtype=np.uint32)
    short = lengths <= POSITIONS
    out[short] = CONSTANTS[lengths[short]]
    for n in np.unique(lengths[~short]).tolist():
        state = 0
        for at in range(0, n, 1 << 16):
            state = zlib.crc32(_zeros(min(1 << 16, n - at)), state)
        out[lengths == n] = state
    return out


def checksums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of the byte spans, none of them empty."""
    out = np.empty(len(starts), dtype=np.uint32)
    short = np.flatnonzero(ends - starts <= POSITIONS)
    upto = np.cumsum((ends - starts)[short])
    lo = 0
    while lo < len(short):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SPAN_BYTES, "right")))
        part = short[lo:hi]
        out[part] = _summed(raw, starts[part], ends[part])
        lo = hi
    long = np.flatnonzero(ends - starts > POSITIONS)
    if len(long):
        blocks = -(-(ends - starts)[long] // POSITIONS)
        order = np.argsort(-blocks, kind="stable")
        long, blocks = long[order], blocks[order]
        state = np.zeros(len(long), dtype=np.uint32)
        for left in range(int(blocks[0]), 0, -1):  # blocks are full but for a span's first one
            k = int(np.searchsorted(-blocks, -left, "right"))  # the spans that have begun
            e = ends[long[:k]] - (left - 1) * POSITIONS
            for lo in range(0, k, SPAN_BYTES // POSITIONS):
                some = slice(lo, min(k, lo + SPAN_BYTES // POSITIONS))
                state[some] = _moved(state[some]) ^ _summed(raw, np.maximum(starts[long[some]], e[some] - POSITIONS), e[some])
        out[long] = state
    return out ^ _constant(ends - starts)


def _features(raw: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each row's number of words, and (row, bucket) of the features, some words at a time."""
    raw = tx.LOWER[raw]
    starts, ends, first = tx.spans(raw, at, tx.ALNUM)
    # the words of a row with one space between: runs of consecutive words are spans
    keep = tx.ALNUM[raw]
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    spaced = ends < at[1:][row]
    keep[ends[spaced]] = True
    raw[ends[spaced]] = 32
    clean = raw[keep]
    n = ends - starts
    to = np.cumsum(n + spaced) - (n + spaced)
    yield np.diff(first), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo in range(0, len(row), SOME_WORDS):
        rows, lows, highs = [], [], []
        for k in range(1, LONGEST + 1):
            i = np.arange(lo, min(lo + SOME_WORDS, len(row) - k + 1))
            i = i[row[i] == row[i + k - 1]]
            rows.append(row[i])
            lows.append(to[i])
            highs.append(to[i + k - 1] + n[i + k - 1])
        yield np.zeros(0, np.int64), np.concatenate(rows), checksums(clean, np.concatenate(lows), np.concatenate(highs)).astype(np.int64) % buckets


def _sliced(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    raw, at = tx.utf8(batch.column("text"))
    for lo, hi in tx.slices(at):
        for words, row, found in _features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], buckets):
            yield lo, hi, words, row, found


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features of the column ``text``; a task gives each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for *_, found in _sliced(batch, buckets):
                total += np.bincount(found, minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])
        tx.release()

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(counts: DataFrame, buckets: int) -> list[int]:
    out = [0] * buckets
    for r in counts.collect():  # ``buckets`` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """A thousand times the log ratio of the smoothed shares of a bucket, rounded down."""
    m, s_all, t_all = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log(((t + 1.0) * (s_all + m)) / ((s + 1.0) * (t_all + m)))) for s, t in zip(corpus, target, strict=True)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise for an id, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.array(gain.value, dtype=np.int64)
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for lo, hi, words, row, found in _sliced(batch, len(value)):
                if len(words):
                    n_words[lo:hi] = words
                n_features[lo:hi] += np.bincount(row, minlength=hi - lo)
                weight[lo:hi] += np.bincount(row, value[found], minlength=hi - lo).astype(np.int64)  # whole numbers far below 2**53
            ids = batch.column("doc_id")
            score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in (n_words, n_features, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])
        tx.release()

    return run


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: float = DRAWN_PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; documents that are not drawn have no rank."""
    tx.small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = spark.sparkContext.broadcast(gains(_vector(bucket_counts(rows, buckets), buckets), _vector(bucket_counts(target, buckets), buckets)))
    weighed = rows.mapInArrow(_weigh(gain, seed), "doc_id long, n_words long, n_features long, weight long, score long")
    # rows that tie in all else are told apart, so that a range can end among them
    weighed = scratch.keep(spark, weighed.withColumn("_at", F.monotonically_increasing_id()), "weighed")
    able = F.col("n_words") >= min_words
    drawn = math.floor(percent * weighed.where(able).count() / 100)
    order = weighed.where(able).withColumns({"_down": -F.col("score"), "_none": F.col("doc_id").isNull()})
    ranked = scratch.numbered(spark, order, ["_down", "_none", "doc_id", "_at"], "_rank", "ranked")
    names = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("_rank") < drawn, F.col("_rank") + 1).cast("long").alias("rank")
    return ranked.select(*names, rank).union(weighed.where(~able).select(*names, F.lit(None).cast("long").alias("rank")))
