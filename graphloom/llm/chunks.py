"""Substring dedup by content-defined chunking.

A gear rolling hash over the last bytes cuts texts where the hash is small, so an insertion moves
only the cuts around it. Chunks are compared by 128-bit digests; runs of chunks that an earlier
document (by id) has are removed spans if they have enough words.

Chunks move as digests, twice: to find the least and the largest document of each digest
(aggregated before the shuffle) and to meet the digests that several documents have (a plain join,
which Spark splits where a digest is frequent).

Defined cases: a null or empty text has no chunks; repeats within one document stay; rows with
one id count as one document; rows without an id give no spans; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch
from . import text as tx

#: Bytes that the hash looks back, bytes between cuts on average, and least and largest chunks.
REACH, EVERY, LEAST, MOST = 16, 28, 8, 512
#: Words of a removed span at least. A cut or two are lost at either end of a repeated passage,
#: so this is far below the length of passages to find.
MIN_WORDS = 20

_GEAR = (tx.mix(np.arange(1, 258, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
_GEAR[256] = 0  # stands between texts


def gear(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of the last ``REACH`` bytes at each byte; it starts anew with each row."""
    n = np.diff(at)
    place = np.arange(len(raw)) + REACH * (np.repeat(np.arange(len(n)), n) + 1)
    padded = np.full(len(raw) + REACH * (len(n) + 1), 256, dtype=np.int16)
    padded[place] = raw
    h = _GEAR[padded]
    step = 1
    while step < REACH:
        h[step:] += h[:-step] << np.uint16(step)
        step *= 2
    return h[place]


def cuts(raw: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Chunk ends of each row, in bytes from its start, never within a code point."""
    inside = np.zeros(len(raw) + 1, dtype=bool)
    inside[:-1] = (raw & 0xC0) == 0x80
    ends = np.flatnonzero((gear(raw, at) < 65536 // EVERY) & ~inside[1:]) + 1
    first = np.searchsorted(ends, at, "right")
    out = []
    for i in range(len(at) - 1):
        base, size = int(at[i]), int(at[i + 1] - at[i])
        got: list[int] = []
        last = 0
        for e in [*(ends[first[i] : first[i + 1]] - base).tolist(), size]:
            if e > size or e == last or (e - last < LEAST and e < size):
                continue
            while e - last > MOST:
                last += MOST
                while inside[base + last]:
                    last -= 1
                got.append(last)
            if e > last:
                got.append(e)
                last = e
        out.append(got)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        raw, at = tx.utf8(batch.column("text"))
        ids = batch.column("doc_id")
        for lo, hi in tx.slices(at):
            part, own = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            ends = cuts(part, own)
            n = np.array([len(e) for e in ends], dtype=np.int64)
            to = np.concatenate([np.array(e, np.int64) for e in ends]) + np.repeat(own[:-1], n) if n.sum() else np.zeros(0, np.int64)
            since = np.concatenate(([0], to[:-1])) if len(to) else to
            whole = part.tobytes()
            hashes = np.frombuffer(b"".join([digest(whole[a:b]) for a, b in zip(since.tolist(), to.tolist(), strict=True)]), dtype="<i8").reshape(-1, 2)
            starts, _, _ = tx.spans(part, own, tx.SPACED)
            points, words = tx.code_points(part), np.searchsorted(starts, np.concatenate((since, to))).reshape(2, -1)
            doc = np.repeat(np.arange(hi - lo), n)
            columns = [ids.slice(lo, hi - lo).take(pa.array(doc)), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), pa.array(((points[since] - points[own[doc]]) << 24) + ((points[to] - points[since]) << 12) + (words[1] - words[0]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h1", "h2", "place"])


def chunk_table(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 and place (start, length and words packed into one number) of every chunk."""
    tx.small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    return rows.mapInArrow(_cut, "doc_id long, h1 long, h2 long, place long")


def repeated_spans(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, first_doc_id, start, end, n_words: spans (in code points) that earlier documents have.

    ``first_doc_id`` is the least document that has one of the span's chunks.
    """
    chunks = chunk_table(docs)
    several = chunks.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where(F.col("first_doc_id") < F.col("last")).drop("last")
    several = scratch.keep(spark, several, "chunks")  # so that the join is a plain one, which Spark splits where a digest is frequent
    hits = chunks.join(several, ["h1", "h2"]).where(F.col("doc_id") > F.col("first_doc_id"))
    start, size = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(F.lit(4095))
    hits = hits.select("doc_id", "first_doc_id", start.alias("start"), (start + size).alias("end"), F.col("place").bitwiseAND(F.lit(4095)).alias("words"))
    order = Window.partitionBy("doc_id").orderBy("start", "end", "first_doc_id")
    last = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # rows of one id with the same chunk count once
    fresh = F.when(F.lag("start").over(order) == F.col("start"), 0).otherwise(F.col("words"))
    runs = hits.select("*", F.coalesce((F.col("start") > last).cast("int"), F.lit(1)).alias("new"), fresh.alias("own"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "run").agg(F.min("first_doc_id").alias("first_doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("own").alias("n_words"))
    return spans.where(F.col("n_words") >= min_words).drop("run")
