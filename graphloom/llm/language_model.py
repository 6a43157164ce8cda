"""Hashed maximum-entropy language model.

The probability of a token is that of its class after its context times that of the token in its
class. Classes are a maximum-entropy model over hashed features of the context: the word before
(n-gram), the classes two and three places back (skips) and the pair of the two classes before (n-gram).
The softmax over 256 classes is factored into 16 groups of 16. Frequent words are classes of their own; other words share classes
by their ends, and within a class, where the only feature is the word itself, the maximum-entropy
solution is its smoothed share of the class.

Training is by distributed gradient updates: in each round every task starts from the broadcast
weights, makes mini-batch updates over its share of the training documents, and the tasks' weights
are averaged in Spark. All training documents are used once. Counts of words stay in Spark: the
most frequent ones are broadcast up to a fixed number, the others meet their counts in a join.

Words are identified by 64 bits of hash. Defined cases: a null or empty text is the end token
alone; without training documents, N is 0 and all tokens are unknown; a null id is not held out;
rows that repeat id and text get equal scores; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from . import text as tx

#: Words whose counts are broadcast at most.
MAX_FREQUENT = 1 << 17
#: Classes: the end token, single words, and words by their ends.
GROUP, SINGLES, ENDS = 16, 191, 64
CLASSES = GROUP * GROUP
#: Hashed features: words before, classes two and three back, pairs of classes, and a constant one.
BY_WORD, BY_PAIR = 4096, 2048
FEATURES = BY_WORD + 2 * CLASSES + BY_PAIR + 1
ROUNDS, BATCH, RATE = 2, 8192, 0.3
FLUSH, BLOCKS = 500_000, 64
#: Tokens that a task learns from at least, where there are so many, and tasks whose weights are averaged first.
LEARNER_TOKENS, NEAR_TASKS = 500_000, 32
ROUND_SEED = 17
#: Upper bits of a key by which the broadcast counts are found.
BUCKET_BITS = 18


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def keys(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's key, of which the low bits tell its last two bytes' class; each row's first word."""
    raw = tx.LOWER[raw]
    starts, ends, first = tx.spans(raw, at, tx.SPACED)
    last = raw[ends - 1].astype(np.uint64) * np.uint64(256) + np.where(ends - starts > 1, raw[ends - 2], 0).astype(np.uint64)
    sub = tx.mix(last + np.uint64(1)) & np.uint64(ENDS - 1)
    return (tx.word_hashes(raw, starts, ends) & ~np.uint64(ENDS - 1)) | sub, first


def _released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory is given back before the first one."""
    tx.release()
    yield from batches


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, at = tx.utf8(batch.column("text"))
    for lo, hi in tx.slices(at):
        yield lo, hi, *keys(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        seen, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "c"])

    for batch in _released(batches):
        for _, _, k, _ in _slices(batch):
            parts.append(k)
            if sum(map(len, parts)) > FLUSH:
                yield flush()
                parts.clear()
    if parts:
        yield flush()


class Vocabulary:
    """Broadcast part of the counts: frequent words, single-word classes, classes' normalisers."""

    def __init__(self, key: np.ndarray, count: np.ndarray, end_count: int) -> None:
        order = np.argsort(key)
        self.key, self.count = key[order], count[order]
        #: The first of the sorted keys that have some upper bits or greater ones.
        self.bucket = np.searchsorted(self.key >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        top = np.lexsort((key, -count))[:SINGLES]
        by_key = top[np.argsort(key[top])]
        self.single, self.single_class = key[by_key], np.empty(len(top), np.int64)
        rank = np.empty(len(key), np.int64)
        rank[top] = np.arange(len(top))
        self.single_class = 1 + rank[by_key]
        self.end_count = end_count
        self.norm = np.zeros(CLASSES)
        #: Tokens of each class in training.
        self.tokens = np.zeros(CLASSES)
        self.tokens[0] = end_count
        self.tokens[self.single_class] = self.count[by_key]

    def classes(self, key: np.ndarray) -> np.ndarray:
        out = (CLASSES - ENDS) + (key & np.uint64(ENDS - 1)).astype(np.int64)
        if len(self.single):
            at = np.minimum(np.searchsorted(self.single, key), len(self.single) - 1)
            hit = self.single[at] == key
            out[hit] = self.single_class[at[hit]]
        return out

    def counts(self, key: np.ndarray) -> np.ndarray:
        """Counts of frequent words; -1 for the others. Keys are hashes, so few share their upper bits."""
        out = np.full(len(key), -1, np.int64)
        if not len(self.key):
            return out
        bucket = (key >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        at, end = self.bucket[bucket], self.bucket[bucket + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            place = at[left]
            hit = self.key[place] == key[left]
            out[left[hit]] = self.count[place[hit]]
            at[left] += 1
            left = left[~hit & (place + 1 < end[left])]
        return out


def sequence(key: np.ndarray, first: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and class of every token, each row's end token included; each row's first token."""
    n = np.diff(first) + 1
    begin = np.concatenate(([0], np.cumsum(n)))
    total = int(begin[-1])
    word = np.ones(total, dtype=bool)
    word[begin[1:] - 1] = False
    k = np.zeros(total, np.uint64)
    c = np.zeros(total, np.int64)
    k[word], c[word] = key, words.classes(key)
    pos = np.arange(total) - np.repeat(begin[:-1], n)
    back = [np.concatenate((np.zeros(min(d, total), c.dtype), c[: max(0, total - d)])) for d in (1, 2, 3)]
    back[1][pos < 2] = 0
    back[2][pos < 3] = 0
    before = np.concatenate((np.zeros(1, np.uint64), k[:-1]))
    before[pos == 0] = 0
    f = np.empty((total, 5), np.uint16)
    f[:, 0] = tx.mix(before) % np.uint64(BY_WORD)
    f[:, 1] = BY_WORD + back[1]
    f[:, 2] = BY_WORD + CLASSES + back[2]
    f[:, 3] = BY_WORD + 2 * CLASSES + (tx.mix((back[0] * CLASSES + back[1]).astype(np.uint64) + np.uint64(1)) % np.uint64(BY_PAIR)).astype(np.int64)
    f[:, 4] = FEATURES - 1
    return f, c, begin


class Weights:
    """Rows of 16 weights: by feature for the group, and by feature and group for the class in it."""

    def __init__(self, flat: np.ndarray | None = None) -> None:
        flat = np.zeros(FEATURES * GROUP * (1 + GROUP), np.float32) if flat is None else flat.astype(np.float32)
        self.flat = flat
        self.group = flat[: FEATURES * GROUP].reshape(FEATURES, GROUP)
        self.inner = flat[FEATURES * GROUP :].reshape(FEATURES * GROUP, GROUP)

    @classmethod
    def priors(cls, tokens: np.ndarray) -> Weights:
        """Weights under which every context has the classes' shares of all tokens."""
        out, n = cls(), (tokens + 1).reshape(GROUP, GROUP)
        out.group[FEATURES - 1] = np.log(n.sum(1))
        out.inner[(FEATURES - 1) * GROUP :] = np.log(n)
        return out

    @staticmethod
    def _softmax(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        z = table.take(rows[0], axis=0)
        for r in rows[1:]:
            z += table.take(r, axis=0)
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    @staticmethod
    def _rows(f: np.ndarray, group: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        rows = [f[:, j].astype(np.int64) for j in range(f.shape[1])]
        return rows, [r * GROUP + group for r in rows]

    def log10(self, f: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 probability of the classes c after contexts with features f."""
        out = np.empty(len(c))
        for lo in range(0, len(c), 8192):
            x, y = f[lo : lo + 8192], c[lo : lo + 8192]
            at, group = np.arange(len(y)), y // GROUP
            rows, inner = self._rows(x, group)
            p = self._softmax(self.group, rows)[at, group].astype(np.float64) * self._softmax(self.inner, inner)[at, y % GROUP]
            out[lo : lo + 8192] = np.log10(np.maximum(p, 1e-30))
        return out

    def update(self, f: np.ndarray, c: np.ndarray, squares: Weights, rate: float) -> None:
        """One mini-batch Adagrad update.

        Tokens are sorted by group and then, stably, by each feature, so one order serves both tables.
        """
        group, at = c // GROUP, np.arange(len(c))
        rows, inner = self._rows(f, group)
        g, h = self._softmax(self.group, rows), self._softmax(self.inner, inner)
        g[at, group] -= 1
        h[at, c % GROUP] -= 1
        by_group = np.argsort(group.astype(np.uint8), kind="stable")
        for j in range(f.shape[1]):
            order = by_group[np.argsort(f[by_group, j], kind="stable")]
            for table, square, row, grad in ((self.group, squares.group, rows[j], g), (self.inner, squares.inner, inner[j], h)):
                sorted_rows = row[order]
                begin = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
                one = sorted_rows[begin]
                s = np.add.reduceat(grad.take(order, axis=0), begin, axis=0)
                seen = square.take(one, axis=0)
                seen += s * s
                square[one] = seen
                seen += np.float32(1e-6)
                s /= np.sqrt(seen, out=seen)
                s *= np.float32(rate)
                table[one] = table.take(one, axis=0) - s


def _learn(words, weights, rate: float):
    """Updates over one task's documents; its weights in blocks, with the tokens they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(weights.value.copy())
        squares, seen = Weights(), 0
        for batch in _released(batches):
            for _, _, k, first in _slices(batch):
                f, c, _ = sequence(k, first, words.value)
                for lo in range(0, len(c), BATCH):
                    own.update(f[lo : lo + BATCH], c[lo : lo + BATCH], squares, rate)
                seen += len(c)
        if seen:
            parts = [x.tobytes() for x in np.array_split(own.flat, BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([seen] * BLOCKS, pa.int64()), pa.array(parts, pa.binary())], ["block", "seen", "weights"])

    return run


def _average(table: pa.Table) -> pa.Table:
    seen = np.array(table.column("seen").to_pylist(), dtype=np.float64)
    total = None
    for n, x in zip(seen, table.column("weights"), strict=True):
        part = n * np.frombuffer(x.as_py(), np.float32).astype(np.float64)
        total = part if total is None else total + part
    mean = (total / seen.sum()).astype(np.float32)
    return pa.table({"block": table.column("block")[:1], "seen": pa.array([int(seen.sum())], pa.int64()), "weights": pa.array([mean.tobytes()], pa.binary())})


def train(spark: SparkSession, rows: DataFrame, words, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """Weights after one pass over the training rows, a share of them in each round.

    They start from the classes' shares, so that few documents leave a unigram model. What moves is one copy
    of the weights for each task; so small partitions are read by one task together.
    """
    flat = Weights.priors(words.value.tokens).flat
    learners = min(1 << 20, max(1, int(words.value.tokens.sum()) // (rounds * LEARNER_TOKENS)))
    shape = "block int, seen long, weights binary"
    for r in range(rounds):
        share = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(ROUND_SEED)), F.lit(rounds)) == r).select("text")
        local = share.coalesce(learners).mapInArrow(_learn(words, spark.sparkContext.broadcast(flat), rate), shape)
        salted = local.withColumn("salt", F.floor(F.spark_partition_id() / NEAR_TASKS))
        mean = salted.groupBy("block", "salt").applyInArrow(_average, shape).groupBy("block").applyInArrow(_average, shape)
        got = mean.select("block", "weights").collect()  # BLOCKS rows
        if got:
            flat = np.concatenate([np.frombuffer(x["weights"], np.float32) for x in sorted(got, key=lambda x: x["block"])])
    return flat


def _local(words, weights):
    """What a document's score needs without the counts of rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, w = Weights(weights.value), words.value
        for batch in _released(batches):
            for lo, hi, k, first in _slices(batch):
                f, c, begin = sequence(k, first, w)
                word = np.ones(len(c), dtype=bool)
                word[begin[1:] - 1] = False
                count = np.full(len(c), w.end_count, np.int64)
                count[word] = w.counts(k)
                logs = np.log10(np.maximum(count, 0) + 1.0)
                shared = c >= CLASSES - ENDS
                score = model.log10(f, c) + np.where(shared, logs - w.norm[c], 0)
                columns = [np.diff(begin), np.add.reduceat(count > 0, begin[:-1], dtype=np.int64), np.add.reduceat(logs, begin[:-1]), np.add.reduceat(score, begin[:-1])]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *map(pa.array, columns)], ["doc_id", "text_hash", "n_tokens", "known", "logs", "local"])

    return run


def _rare(words):
    """(doc_id, text_hash, key, tf) of words whose counts are not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _released(batches):
            for lo, hi, k, first in _slices(batch):
                rare = np.flatnonzero(words.value.counts(k) < 0)
                doc = np.searchsorted(first, rare, "right") - 1
                # by a hash of both, which brings repeats together; where hashes tie, a word may be told in two rows
                order = np.argsort(tx.mix(k[rare] + tx.mix(doc.astype(np.uint64))))
                d, x = doc[order], k[rare][order]
                new = np.flatnonzero(np.concatenate((np.ones(min(len(d), 1), dtype=bool), (d[1:] != d[:-1]) | (x[1:] != x[:-1]))))
                tf = np.diff(np.concatenate((new, [len(d)])))
                part = batch.slice(lo, hi - lo).take(pa.array(d[new], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(x[new].view(np.int64)), pa.array(tf, pa.int32())], ["doc_id", "text_hash", "key", "tf"])

    return run


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Unigram base score and the model's score of every document's whole text."""
    tx.small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    training = rows.where(~held_out())
    counts = scratch.keep(spark, training.select("text").mapInArrow(_count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "words")
    ends = training.count()
    levels = counts.groupBy(F.floor(F.log2("c") * 8).alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).orderBy(F.desc("level")).collect()  # 512 levels at most
    total, distinct = sum(r["c"] for r in levels) + ends, sum(r["n"] for r in levels) + (ends > 0)
    least, kept = 1 << 62, 0
    for r in levels:
        kept += r["n"]
        if kept > MAX_FREQUENT:
            break
        least = r["least"]
    table = counts.where(F.col("c") >= least).toArrow()  # MAX_FREQUENT words at most
    vocabulary = Vocabulary(table.column("key").to_numpy().view(np.uint64), table.column("c").to_numpy(), ends)
    end = F.col("key").bitwiseAND(F.lit(ENDS - 1))
    singles = [int(x) for x in vocabulary.single.view(np.int64)]
    shared = counts.where(~F.col("key").isin(singles)) if singles else counts
    for r in shared.groupBy(end.alias("end")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # ENDS classes
        vocabulary.norm[CLASSES - ENDS + r["end"]] = np.log10(r["c"] + r["n"] + 1)
        vocabulary.tokens[CLASSES - ENDS + r["end"]] = r["c"]
    words = spark.sparkContext.broadcast(vocabulary)
    weights = spark.sparkContext.broadcast(train(spark, training, words))

    local = rows.mapInArrow(_local(words, weights), "doc_id long, text_hash long, n_tokens long, known long, logs double, local double")
    rare = rows.mapInArrow(_rare(words), "doc_id long, text_hash long, key long, tf int").join(counts.where(F.col("c") < least), "key")
    rare = rare.groupBy("doc_id", "text_hash").agg(F.sum("tf").cast("long").alias("rare_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    copies = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    rare = rare.join(copies, rare["doc_id"].eqNullSafe(copies["doc_id"]) & rare["text_hash"].eqNullSafe(copies["text_hash"])).select(
        rare["doc_id"].alias("r_id"), rare["text_hash"].alias("r_hash"), (F.col("rare_known") / F.col("copies")).cast("long").alias("rare_known"), (F.col("rare_logs") / F.col("copies")).alias("rare_logs")
    )
    out = local.join(rare, local["doc_id"].eqNullSafe(F.col("r_id")) & local["text_hash"].eqNullSafe(F.col("r_hash")), "left")
    more = F.coalesce("rare_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("local") + more).alias("score"),
    )
