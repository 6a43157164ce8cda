"""A store of k-mer counts that depth jobs of many samples share.

K-mers are numbers of two bits a base, so k is 31 at most; a k-mer and its reverse complement are one, the lesser. The store
is a table of parts, bucketed by part: a part has the k-mers of some minimizers, a row a sample with their numbers and counts as
bytes. A job shuffles its own stretches only, to the parts, and joins with these.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import scratch
from . import kmer_depth, stretches
from .stretches import _CODES, MAX_K

#: Bases that are packed at once; longer sequences go in pieces that overlap by k - 1.
PIECE = 1 << 20
#: K-mers a part, about, bases of unitigs that meet a part at once, and samples that a task counts at once.
PART, MEET, WIDE = 1 << 20, 1 << 31, 32


def pack(bases: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the k-mers of A, C, G, T alone, and the lesser strand of each as a number."""
    codes = _CODES[np.frombuffer(bases.encode("ascii", "replace"), np.uint8)]
    m = len(codes) - k + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bad = np.concatenate(([0], np.cumsum(codes == 4)))
    starts = np.flatnonzero(bad[k:] == bad[:-k])
    forward, backward = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for j in range(k):
        base = (codes[j : j + m] & 3).astype(np.int64)
        forward = (forward << 2) | base
        backward |= (3 - base) << (2 * j)
    return starts, np.minimum(forward, backward)[starts]


def _counted(keys: pa.Array, held: list[tuple[int, str]], k: int) -> pa.RecordBatch:
    """(key, kmer, n) of pieces (row, bases), counted by key and k-mer before anything is shuffled."""
    starts, numbers = pack("\n".join(p for _, p in held), k)  # no k-mer goes over a line's end
    rows = np.repeat([r for r, _ in held], [len(p) + 1 for _, p in held])
    codes = keys.dictionary_encode(null_encoding="encode")
    owner = codes.indices.to_numpy(zero_copy_only=False)[rows[starts]]
    found = pa.table({"key": pa.array(owner), "kmer": pa.array(numbers)}).group_by(["key", "kmer"]).aggregate([([], "count_all")])
    column = lambda name: found.column(name).combine_chunks()
    return pa.RecordBatch.from_arrays([codes.dictionary.take(column("key")), column("kmer"), column("count_all")], names=["key", "kmer", "n"])


def packed_kmers(sequences: DataFrame, k: int, key: str, bases: str = "bases") -> DataFrame:
    """(key, kmer, n): k-mers counted within batches; the same key and k-mer can come again from another batch.

    Null and too short sequences have no k-mers; k-mers with other letters than A, C, G, T are left out.
    """
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}: {k}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, size = batch.column(0), [], 0
            for row, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                for at in range(0, len(text) - k + 1, PIECE):
                    held.append((row, text[at : at + PIECE + k - 1]))
                    size += len(held[-1][1])
                    if size >= PIECE:
                        yield _counted(keys, held, k)
                        held, size = [], 0
            if held:
                yield _counted(keys, held, k)

    schema = StructType([StructField("key", sequences.schema[key].dataType), StructField("kmer", LongType()), StructField("n", LongType())])
    return sequences.select(F.col(key), F.col(bases)).mapInArrow(run, schema)


@dataclass(frozen=True)
class KmerStore:
    """Parts (bucket, sample, part) in a bucketed table."""

    table: str
    k: int
    parts: int
    buckets: int

    def counts(self, spark: SparkSession) -> DataFrame:
        """(kmer, sample, n)"""
        rows = spark.table(self.table).select("sample", "part")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    kmers, n = _read(batch.column(1)[i].as_buffer())
                    for lo in range(0, len(n), 1 << 16):
                        some = slice(lo, lo + (1 << 16))
                        sample = pa.array([batch.column(0)[i].as_py()] * len(n[some]), batch.schema.field(0).type)
                        yield pa.RecordBatch.from_arrays([pa.array(kmers[some].view(np.int64)), sample, pa.array(n[some])], names=["kmer", "sample", "n"])

        return rows.mapInArrow(run, StructType([StructField("kmer", LongType()), rows.schema["sample"], StructField("n", LongType())]))


def _read(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted k-mers and their counts."""
    data = np.frombuffer(part, np.uint8)
    n, values = int(data[:4].view(np.uint32)[0]), stretches.numbers(data[4:])
    return np.cumsum(values[:n]).view(np.uint64), values[n:]


def _collected(batches: Iterator[pa.RecordBatch], add) -> Iterator[pa.RecordBatch]:
    """(bucket, who, part) of rows in the order of their first column, the part that they are of; ``add`` adds rows to tallies by who."""
    part, tallies = None, {}

    def end() -> Iterator[pa.RecordBatch]:
        for who in sorted(tallies):
            kmers, n = tallies[who].end()
            if len(n):
                data = np.array([len(n)], np.uint32).tobytes() + stretches.varints(np.concatenate([np.diff(kmers, prepend=np.uint64(0)), n.astype(np.uint64)])).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([who], pa.int64()), pa.array([data], pa.binary())], names=["bucket", "who", "part"])

    for batch in batches:
        targets = batch.column(0).to_numpy()
        at = np.flatnonzero(np.concatenate(([True], targets[1:] != targets[:-1], [True]))) if len(targets) else [0]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if targets[lo] != part:
                yield from end()
                part, tallies = int(targets[lo]), {}
            add(tallies, batch.slice(lo, hi - lo))
    yield from end()


def _numbered(rows: DataFrame, sample: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the number ``who`` of their sample, and (who, sample); the samples' names, a row each, reach the driver."""
    kind = rows.schema[sample].dataType
    names = enumerate(r[0] for r in rows.select(sample).distinct().collect())
    known = rows.sparkSession.createDataFrame(list(names), StructType([StructField("who", LongType()), StructField("sample", kind)]))
    return rows.join(F.broadcast(known.withColumnRenamed("sample", "_name")), F.col(sample).eqNullSafe(F.col("_name"))).drop("_name"), known


def _write(rows: DataFrame, known: DataFrame, add, k: int, table: str, parts: int, buckets: int, path: str | None) -> KmerStore:
    """One shuffle serves the sums and the buckets: rows go by part into as many partitions as there are buckets."""
    spark, first = rows.sparkSession, rows.columns[0]
    dealt = rows.repartition(buckets, first).sortWithinPartitions(first)
    found = dealt.mapInArrow(lambda batches: _collected(batches, add), "bucket int, who long, part binary")
    writer = found.join(F.broadcast(known), "who").select("bucket", "sample", "part").write.format("parquet").bucketBy(buckets, "bucket").sortBy("bucket")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('kmer.k' = '{k}', 'kmer.parts' = '{parts}', 'kmer.buckets' = '{buckets}')")
    return KmerStore(table, k, parts, buckets)


def write_store(sequences: DataFrame, k: int, table: str, sample: str = "sample", bases: str = "bases", buckets: int = 200, path: str | None = None) -> KmerStore:
    """Count the k-mers of sequences by sample into a new table, at ``path`` or in the warehouse; one that exists fails."""
    named, known = _numbered(sequences, sample)
    parts = -(-stretches.total_bases(sequences, bases) // PART) or 1

    def add(tallies: dict, rows: pa.RecordBatch) -> None:
        for chunk in stretches.chunks([rows], k):
            for who, heads, tails in stretches.by_who(*chunk):
                tallies.setdefault(who, stretches.Tally()).add(stretches.lesser(stretches.expand(heads, tails, k)[0], k, True))

    return _write(stretches.stretches(named.select("who", F.col(bases).alias("bases")), k, True, parts), known, add, k, table, parts, buckets, path)


def import_store(counts: DataFrame, k: int, table: str, buckets: int = 200, path: str | None = None) -> KmerStore:
    """A store from counts (kmer, sample, n) of k-mers as text, of either strand but not both. K-mers of another length or with other letters fail."""
    checked = kmer_depth.check_strands(counts)
    good = F.col("kmer").rlike(f"^[ACGT]{{{k}}}$")
    number = F.when(good, F.conv(F.translate("kmer", "ACGT", "0123"), 4, 10).cast("long")).otherwise(F.raise_error(F.concat(F.lit(f"not of {k} bases: "), F.col("kmer"))).cast("long"))
    named, known = _numbered(checked.select(number.alias("kmer"), "sample", F.col("n").cast("long").alias("n")), "sample")
    parts = -(-counts.count() // PART) or 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            targets = stretches.targets_of(b.column(1).to_numpy().view(np.uint64), k, parts)
            yield pa.RecordBatch.from_arrays([pa.array(targets), *b.columns], names=["target", *b.schema.names])

    def add(tallies: dict, rows: pa.RecordBatch) -> None:
        who, kmers, n = (rows.column(i).to_numpy() for i in (1, 2, 3))
        for w in np.unique(who).tolist():
            tallies.setdefault(w, stretches.Tally()).add(kmers[who == w].view(np.uint64), n[who == w])

    return _write(named.select("who", "kmer", "n").mapInArrow(dealt, "target int, who long, kmer long, n long"), known, add, k, table, parts, buckets, path)


def open_store(spark: SparkSession, table: str) -> KmerStore:
    """The store that a table of the catalogue holds."""
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return KmerStore(table, *(int(found[f"kmer.{c}"]) for c in ("k", "parts", "buckets")))


def depths(spark: SparkSession, store: KmerStore, unitigs: DataFrame, samples: Sequence[str], unitig: str = "unitig", bases: str = "bases") -> DataFrame:
    """(unitig, sample, depth): mean count over a unitig's k-mers, unseen ones as 0, repeated ones repeatedly.

    Every unitig of k bases or more has a depth in each sample; unitigs that rows repeat count as one with all their k-mers. A part
    is one row, and so are the unitigs' stretches that it meets; they return sums. Of many samples some are done at a time.
    """
    if len(samples) > WIDE:
        return reduce(DataFrame.union, [depths(spark, store, unitigs, samples[i : i + WIDE], unitig, bases) for i in range(0, len(samples), WIDE)])
    named = scratch.keep(spark, unitigs.select(F.monotonically_increasing_id().alias("who"), F.col(unitig).alias("unitig"), F.col(bases).alias("bases")), "unitigs", "zstd")
    wanted, k, size = list(dict.fromkeys(samples)), store.k, stretches.GROUP
    columns = [f"n{i}" for i in range(len(wanted))]
    total = stretches.total_bases(named)
    number = F.lit(None).cast("int")
    for i, s in enumerate(wanted):
        number = F.when(F.col("sample") == F.lit(s), i).otherwise(number)
    asked = stretches.stretches(named.select("who", "bases"), k, True, store.parts).withColumnRenamed("target", "bucket").repartition(store.buckets, "bucket")
    asked = asked.groupBy("bucket", F.pmod(F.xxhash64("first"), F.lit(total // MEET + 1)).alias("turn")).agg(F.collect_list(F.struct("first", "part")).alias("asked"))
    counts = spark.table(store.table).where(F.col("sample").isin(wanted)).groupBy("bucket").agg(F.collect_list(F.struct(number.alias("i"), "part")).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ends = [(np.empty(0, np.uint64), np.empty(0, np.int64))] * len(wanted)
                for c in batch.column(1)[row].values.to_pylist():
                    ends[c["i"]] = _read(c["part"])
                table = stretches.Table(ends)
                own = batch.column(0)[row].values
                for chunk in stretches.chunks([pa.RecordBatch.from_arrays([own.field(0), *own.flatten()], names=["target", "first", "part"])], k):
                    yield table.sums(*chunk, k, size)

    # one row a part and turn: no row is copied for another
    met = asked.join(counts.hint("merge"), "bucket").select("asked", "counts").mapInArrow(run, stretches.SUMS)
    sums = stretches.gathered(met, stretches.tasks_for(named, total), columns, size)
    lengths = named.select("who", "unitig", F.greatest(F.length("bases") - (k - 1), F.lit(0)).alias("n_kmers")).where("n_kmers > 0")
    whole = lengths.join(sums, "who", "left").groupBy("unitig").agg(F.sum("n_kmers").alias("n_kmers"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.col(columns[wanted.index(s)]).alias("total")) for s in samples]))
    return whole.select("unitig", "n_kmers", each.alias("e")).select("unitig", "e.sample", (F.col("e.total") / F.col("n_kmers")).alias("depth"))
