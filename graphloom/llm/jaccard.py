"""N-gram Jaccard join with prefixes under several global orders.

Sets of word shingles that are similar enough share a token among their first few under any
global order of tokens. Here all orders put rare tokens first and differ in how they order tokens
of the same frequency class. One order makes candidates through an inverted index of prefixes; the
others must agree: each bounds the overlap that the two prefixes still allow. What is left is
verified on the whole sets.

Groups never meet pair by pair. Equal sets are one class. Then every token's documents are
compared with one hub only, the document in which the token stands first, and linked ones become
one component; pairs are enumerated only where a token's documents still lie in different
components. What moves are prefixes, a tenth of the sets; whole sets move for surviving pairs only.

Frequencies are counted over all documents in hashed buckets whose number follows the corpus; as any
global order gives right results, the frequent buckets that are broadcast are bounded by raising
the least frequency that counts as frequent.

Defined cases: a null text, an empty one or one without words is an empty set and links with nothing;
a text with fewer words than a shingle has one shingle; rows with a null id get a null component;
rows that repeat an id are rows of their own and get the component of their set; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from . import text as tx

WORDS = 3
#: Similarity from which on sets link, in percent.
PERCENT = 90
#: Frequent buckets that are broadcast at most (9 bytes each), and least frequency of one.
MAX_FREQUENT, LEAST_FREQUENT = 1 << 20, 8
#: Shingles counted before they are written out, and buckets of the filter of set owners.
FLUSH, FILTER_BUCKETS = 1_000_000, 1 << 23
#: Seeds of the orders; the first one makes candidates.
ORDERS = (0x51ED270B, 0x2545F491, 0x9E3779B1)
#: Low bits that the keys of the other orders lose.
CUT_BITS = 32


def sets(raw: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    raw = tx.LOWER[raw]
    starts, ends, first = tx.spans(raw, at, tx.SPACED)
    h = tx.word_hashes(raw, starts, ends)
    grams = tx.grams(h, k)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        else:
            out.append(tx.grams(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


def _batch_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        raw, at = tx.utf8(batch.column("text"))
        for lo, hi in tx.slices(at):
            yield batch.column("doc_id").slice(lo, hi - lo), sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k)
    tx.release()


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _batch_sets(batches, k):
            d = np.array([(int(tx.mix(s).sum()), int(tx.mix(s ^ np.uint64(ORDERS[1])).sum())) for s in found], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in found], pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], ["doc_id", "n", "d1", "d2"])

    return run


def _counts(k: int, bits: int):
    """Per shard of the buckets, the low 16 bits of those seen once and those seen more often with counts."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        seen, n = np.unique(np.concatenate(parts) >> np.uint64(64 - bits), return_counts=True)
        shard = (seen >> np.uint64(16)).astype(np.int64)
        low, n = seen.astype("<u2"), n.astype("<u4")
        rows = []
        edges = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])) if len(shard) else [0]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            once = n[lo:hi] == 1
            rows.append((int(shard[lo]), low[lo:hi][once].tobytes(), low[lo:hi][~once].tobytes(), n[lo:hi][~once].tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["shard", "once", "more", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for _, found in _batch_sets(batches, k):
            parts += [tx.mix(s) for s in found]
            size += sum(map(len, found))
            if size > FLUSH:
                yield flush(parts)
                parts, size = [], 0
        if size:
            yield flush(parts)

    return run


def _frequent(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << 16, dtype=np.int64)
    for once, more, n in zip(*(table.column(c).to_pylist() for c in ("once", "more", "counts")), strict=True):
        total[np.frombuffer(once, "<u2")] += 1
        total[np.frombuffer(more, "<u2")] += np.frombuffer(n, "<u4")
    low = np.flatnonzero(total >= LEAST_FREQUENT)
    shard = table.column("shard")[0].as_py()
    return pa.table({"bucket": pa.array((shard << 16) + low, pa.int64()), "level": pa.array(np.log2(total[low]).astype(np.int8))})


def frequent_buckets(spark: SparkSession, rows: DataFrame, total: int, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits of a bucket, the frequent buckets in order, and their frequencies' log2."""
    bits = min(44, max(20, int(total).bit_length() + 1))
    found = rows.mapInArrow(_counts(k, bits), "shard long, once binary, more binary, counts binary").groupBy("shard").applyInArrow(_frequent, "bucket long, level byte")
    found = scratch.keep(spark, found, "frequent")
    least, kept = 64, 0
    for r in found.groupBy("level").count().orderBy(F.desc("level")).collect():  # 64 levels at most
        kept += r["count"]
        if kept > MAX_FREQUENT:
            break
        least = r["level"]
    table = found.where(F.col("level") >= least).toArrow()
    bucket, level = table.column("bucket").to_numpy(), table.column("level").to_numpy()
    order = np.argsort(bucket)
    return bits, bucket[order], level[order]


def _prefixes(k: int, percent: int, frequent):
    """Each order's first keys; a key is the frequency level (below 64) and then a hash that the order has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, bucket, level = frequent.value
        for ids, found in _batch_sets(batches, k):
            n = np.array([len(s) for s in found], dtype=np.int64)
            flat = tx.mix(np.concatenate([*found, np.zeros(0, np.uint64)]))
            own = (flat >> np.uint64(64 - bits)).astype(np.int64)
            at = np.minimum(np.searchsorted(bucket, own), max(len(bucket) - 1, 0))
            rank = np.where(bucket[at] == own, level[at], 0).astype(np.uint64) if len(bucket) else np.zeros(len(flat), np.uint64)
            upto = np.concatenate(([0], np.cumsum(n))).tolist()
            size = np.where(n > 0, n * (100 - percent) // 100 + 1, 0)
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            lists = []
            for seed in ORDERS:
                keys = (rank << np.uint64(57)) | (tx.mix(flat ^ np.uint64(seed)) >> np.uint64(7))
                first = np.concatenate([*[np.sort(keys[a:b])[:p] for a, b, p in zip(upto, upto[1:], size.tolist(), strict=False)], np.zeros(0, np.uint64)])
                # the orders that only filter need no more than their keys' upper bits
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(first.view(np.int64) if not lists else (first >> np.uint64(CUT_BITS)).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), *lists], ["doc_id", "n", "p0", "p1", "p2"])

    return run


def _owned(k: int, wanted):
    """Whole sets of the rows whose ids the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _batch_sets(batches, k):
            number = ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            take = np.flatnonzero(wanted.value[(tx.mix(number) % np.uint64(FILTER_BUCKETS)).astype(np.int64)])
            some = [found[i] for i in take]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in some], dtype=np.int64))), pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*some, np.zeros(0, np.uint64)]).view(np.int64)))], ["id", "tokens"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = tx.mix(b.column("id").to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).astype(np.int32))], ["bucket"])


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable by links (a, b), for the ids that have links.

    Rounds of least neighbouring labels and pointer jumping; each round is written out.
    """
    edges = scratch.keep(spark, links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = scratch.keep(spark, edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "near").alias("to"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("at"), F.col("component").alias("next"))
        new = hooked.join(jump, F.col("to") == F.col("at"), "left").select("id", F.least("to", F.coalesce("next", "to")).alias("component"), "old")
        new = scratch.keep(spark, new, "labels")
        labels = new.drop("old")
        if new.where(F.col("component") != F.col("old")).isEmpty():
            return labels


class Join:
    """The join over one table of documents."""

    def __init__(self, spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> None:
        self.spark, self.words, self.percent = spark, words, percent
        tx.small_batches(docs)
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.digests = scratch.keep(spark, self.rows.mapInArrow(_digests(words), "doc_id long, n long, d1 long, d2 long"), "digests")

    def enough(self, overlap: Column) -> Column:
        """Whether an overlap of sets of n_a and n_b tokens is similar enough."""
        return overlap * (100 + self.percent) >= (F.col("n_a") + F.col("n_b")) * self.percent

    def _bounded(self, pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
        """The pairs whose overlap no order rules out: common tokens of the known parts and all that follow."""
        a = prefixes.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), *[F.col(f"p{i}").alias(f"a{i}") for i in range(len(ORDERS))])
        b = prefixes.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), *[F.col(f"p{i}").alias(f"b{i}") for i in range(len(ORDERS))])
        both = pairs.select("a", "b").join(a, "a").join(b, "b")
        for i in range(len(ORDERS)):
            x, y = F.col(f"a{i}"), F.col(f"b{i}")
            upto = F.least(F.element_at(x, -1), F.element_at(y, -1))
            # all tokens before the lesser of the last keys are known on both sides; keys of filters may tie,
            # so known and common ones are both counted by distinct key, which never bounds the overlap too low
            known = [F.size(F.array_distinct(F.filter(z, lambda t: t < upto))) for z in (x, y)]
            common = F.size(F.filter(F.array_intersect(x, y), lambda t: t < upto))
            both = both.where((F.size(F.array_intersect(x, y)) > 0) & self.enough(common + F.least(F.col("n_a") - known[0], F.col("n_b") - known[1])))
        return both.select("a", "b", "n_a", "n_b")

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Links among pairs, by the overlap of whole sets."""
        pairs = scratch.keep(self.spark, pairs, f"{name}-pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        found = ids.mapInArrow(_buckets, "bucket int").distinct().toArrow().column("bucket").to_numpy()  # FILTER_BUCKETS rows at most
        wanted = np.zeros(FILTER_BUCKETS, dtype=bool)
        wanted[found] = True
        owned = self.rows.where(F.col("doc_id").isNotNull()).mapInArrow(_owned(self.words, self.spark.sparkContext.broadcast(wanted)), "id long, tokens array<long>")
        owned = scratch.keep(self.spark, owned.join(ids.distinct(), "id", "left_semi"), f"{name}-sets")
        both = pairs.join(owned.select(F.col("id").alias("a"), F.col("tokens").alias("s")), "a").join(owned.select(F.col("id").alias("b"), F.col("tokens").alias("t")), "b")
        linked = both.where((F.size("s") == F.col("n_a")) & (F.size("t") == F.col("n_b")) & self.enough(F.size(F.array_intersect("s", "t"))))
        return scratch.keep(self.spark, linked.select("a", "b").distinct(), f"{name}-links")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Classes of equal sets with their least id; links between classes that hold all of them together.

        The links span the components of the similarity graph; they are not all of its links.
        """
        spark, percent = self.spark, self.percent
        usable = self.digests.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        classes = usable.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
        total = self.digests.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        frequent = spark.sparkContext.broadcast(frequent_buckets(spark, self.rows, total, self.words))
        prefixes = self.rows.where(F.col("doc_id").isNotNull()).mapInArrow(_prefixes(self.words, percent, frequent), "doc_id long, n long, p0 array<long>, p1 array<int>, p2 array<int>")
        reps = classes.select(F.col("rep").alias("doc_id"), "n").distinct()
        prefixes = scratch.keep(spark, prefixes.join(reps, ["doc_id", "n"], "left_semi"), "prefixes")

        entries = prefixes.select(F.col("doc_id").alias("id"), "n", F.posexplode("p0").alias("pos", "key"))
        hubs = entries.groupBy("key").agg(F.min(F.struct("pos", "n", "id")).alias("hub"), F.count("*").alias("m")).where("m > 1").drop("m")
        shared = scratch.keep(spark, entries.join(hubs, "key").select("key", "id", "n", "pos", "hub"), "shared")

        fits = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & self.enough(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")))
        stars = shared.where(F.col("id") != F.col("hub.id")).select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("hub.id").alias("b"), F.col("hub.n").alias("n_b"), F.col("hub.pos").alias("pos_b")).where(fits)
        votes = stars.groupBy("a", "b").agg(F.count("*").alias("votes"))
        best = votes.groupBy("a").agg(F.max_by("b", F.struct("votes", -F.col("b"))).alias("b"))
        first = self._verified(self._bounded(best, prefixes), "hub")

        found = components(spark, first)
        labelled = shared.drop("hub").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        labelled = scratch.keep(spark, labelled, "labelled")
        mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        left = labelled.join(mixed, "key", "left_semi")
        a, b = (left.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "pos", "component")]) for s in "ab")
        rest = a.join(b, "key").where((F.col("component_a") < F.col("component_b")) & fits)
        rest = rest.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
        second = self._verified(self._bounded(rest, prefixes), "rest")
        return classes, first.union(second)

    def members(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every row."""
        classes, links = self.links()
        found = components(self.spark, links)
        labelled = classes.join(found, F.col("rep") == F.col("id"), "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
        labelled = scratch.keep(self.spark, labelled, "classes")  # a plain join follows, which Spark splits where a class is large
        out = self.digests.join(labelled, ["d1", "d2", "n"], "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def link(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) of every document."""
    return Join(spark, docs, words, percent).members()


def keep_one(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The document with the least id of each component; columns as in ``docs``. Rows that repeat its id stay with it."""
    gone = link(spark, docs, words, percent).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
