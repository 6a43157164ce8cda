"""Lempel-Ziv phrase fingerprints.

A document is parsed like LZ78 over its words: the longest known phrase and one more word make
the next phrase. The set of phrase hashes is sketched by one-permutation min-hashing, and the
share of equal places of two sketches estimates how many phrases two documents share. An edit
changes the phrases around it; what was parsed before it stays.

Defined cases: a null or empty text has no phrases and an empty fingerprint; two empty ones are
alike (1), an empty and another are not (0); rows with equal ids follow each other in the order of
their texts; the last document is followed by the first, a single one by itself; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

#: Places of a sketch, each of 16 bits.
PLACES = 64
#: Bytes of a symbol; longer words are several symbols.
SYMBOL = 24
#: Documents between two splits of the id range, on average, and splits at most.
SPLIT_ROWS, MAX_SPLITS = 4000, 1_000_000

_MASK = (1 << 61) - 1
_STEP = 0x1F3D5B79A7C15


def symbols(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, long words in parts, and each row's first one."""
    starts, ends, first = tx.spans(raw, at, tx.SPACED)
    parts = -(-(ends - starts) // SYMBOL)
    if len(parts) and parts.max() > 1:
        before = np.cumsum(parts) - parts
        inner = np.arange(parts.sum()) - np.repeat(before, parts)
        lo = np.repeat(starts, parts) + inner * SYMBOL
        ends = np.minimum(lo + SYMBOL, np.repeat(ends, parts))
        first = np.concatenate((before, [parts.sum()]))[first]
        starts = lo
    return tx.word_hashes(raw, starts, ends) >> np.uint64(3), first


def phrases(words: list[int]) -> set[int]:
    """Hashes of the LZ78 phrases of a sequence of symbols."""
    known: set[int] = set()
    add = known.add
    phrase = 0
    for w in words:
        longer = (phrase * _STEP + w) & _MASK
        if longer in known:
            phrase = longer
        else:
            add(longer)
            phrase = 0
    return known


def sketch(found: set[int], places: int = PLACES) -> np.ndarray:
    """One-permutation min-hash; an empty place takes the next one's value, marked by distance."""
    if not found:
        return np.zeros(0, np.uint16)
    h = np.sort(tx.mix(np.fromiter(found, np.uint64, len(found))))
    shift = np.uint64(64 - (places - 1).bit_length())
    bins = (h >> shift).astype(np.int64)
    at = np.searchsorted(bins, np.arange(places))
    own = (at < len(h)) & (bins[np.minimum(at, len(h) - 1)] == np.arange(places))
    value = np.zeros(places, np.uint64)
    value[own] = h[at[own]]
    filled = np.flatnonzero(own)
    source = filled[np.searchsorted(filled, np.arange(places)) % len(filled)]
    away = ((source - np.arange(places)) % places).astype(np.uint64)
    return (tx.mix(value[source] + away * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def sketches(texts: list[str]) -> list[np.ndarray]:
    raw, at = tx.utf8(pa.array(texts, pa.string()))
    out: list[np.ndarray] = []
    for lo, hi in tx.slices(at):
        words, first = symbols(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        listed = words.tolist()
        out += [sketch(phrases(listed[first[i] : first[i + 1]])) for i in range(hi - lo)]
    return out


def _placed(splits: list[int], firsts: dict[int, int] | None = None):
    """The bucket of an id and, for the first id of a bucket, the bucket before it (else -1)."""
    edges = np.array(splits, dtype=np.int64)

    @F.pandas_udf("bucket int, before int")
    def place(ids: pd.Series) -> pd.DataFrame:
        known = ids.fillna(-(2**63)).astype("int64")
        return pd.DataFrame({"bucket": np.searchsorted(edges, known, "right").astype("int32"), "before": [(firsts or {}).get(i, -1) for i in known]}).astype("int32")

    return place


def in_order(spark: SparkSession, docs: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(bucket, guard, doc_id, text): buckets of consecutive ids, sorted, within partitions.

    The last row of a bucket is a guard: a copy of the row that follows the bucket. Splits are a
    hashed share of the ids, so buckets stay small and the number of splits bounded.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = max(split_rows, -(-rows.count() // MAX_SPLITS))
    ids = rows.select("doc_id")
    splits = sorted(r[0] for r in ids.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(every)) == 0).distinct().collect() if r[0] is not None)
    least = ids.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), _placed(splits)("doc_id").alias("at")).groupBy("at.bucket").agg(F.min("doc_id").alias("least")).orderBy("bucket").collect()
    firsts = {r["least"]: least[i - 1]["bucket"] for i, r in enumerate(least)}
    place = _placed(splits, firsts)("doc_id")
    to = F.transform(F.filter(F.array(F.struct(F.col("at.bucket").alias("bucket"), F.lit(False).alias("guard")), F.struct(F.col("at.before").alias("bucket"), F.lit(True).alias("guard"))), lambda x: x["bucket"] >= 0), lambda x: x)
    dealt = rows.withColumn("at", place).select("doc_id", "text", F.explode(to).alias("to")).select("to.bucket", "to.guard", "doc_id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guard", "doc_id", "text")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = list(zip(batch.column("bucket").to_pylist(), batch.column("guard").to_pylist(), batch.column("doc_id").to_pylist(), texts, sketches(texts), strict=True))
            if held is not None:
                rows.insert(0, held)
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[1]]
            edited = []
            for a, b in pairs:
                n = len(a[3])
                edited.append(a[3][: n - n // 4] + b[3][: n // 4])
            after = sketches(edited)
            held = rows[-1] if rows else None
            out = [
                (a[2], len(a[3]), hashlib.sha256(e.encode()).hexdigest(), a[4].astype(">u2").tobytes().hex(), s.astype(">u2").tobytes().hex(), likeness(a[4], s), likeness(a[4], b[4]))
                for (a, b), e, s in zip(pairs, edited, after, strict=True)
            ]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def compare(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    tx.small_batches(docs)
    return in_order(spark, docs).mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
