"""Toxicity by subword-bag embeddings.

A window of a few words is the mean of the embeddings of its words' character n-grams (and of the
words themselves), put into a linear softmax; embeddings and softmax are trained jointly in numpy.
A misspelling shares most n-grams, and so most of its vector, with the word it comes from. A
document is as toxic as its most toxic window, so a long text does not hide a short insult; the
document's score is a logistic function of that window, fitted on labelled documents that the
embeddings have not seen.

Training reads at most ``MAX_LABELLED`` labelled documents and ``MAX_LABELLED_BYTES`` of text, those
with the least hashes; labels give only the target. Scoring is one pass over whole texts without a shuffle: as the model is linear
in the embeddings, one number per n-gram bucket suffices.

Defined cases: a null or empty text, or one without words, scores like a window without n-grams;
without labelled rows all scores are 0; with one label all scores are that label; documents with
several labels count once for each; of rows that repeat a labelled id, the least text is learned from;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from . import text as tx

#: Labelled documents that training reads at most.
MAX_LABELLED = 4000
#: Bytes of text that training reads at most; a text of more than a sixteenth of them is not learned from.
MAX_LABELLED_BYTES = 128 << 20
BUCKETS, DIM, NGRAMS = 1 << 17, 8, (3, 4, 5)
#: Words of a window.
WINDOW = 5
#: Predicted toxic from this score on.
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, SEED = 3, 1024, 0.3, 7
#: Share of the labelled sample that fits the embeddings; the rest fits the documents' logistic.
FIT_SHARE = 0.75


#: Bytes of a word whose n-grams are taken in one piece, and bytes of pieces that are taken at once.
PIECE, PIECES = 1 << 14, 1 << 16


def ngrams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each word's n-grams (with marks around the word) and of the word, in the words' order, some bytes at a time; and their words.

    A long word is several pieces, each with the bytes that its last n-grams have of the next one.
    """
    size = ends - starts + 2
    parts = -(-size // PIECE)
    word = np.repeat(np.arange(len(size)), parts)
    begin = (np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)) * PIECE
    length = np.minimum(size[word] - begin, PIECE + max(NGRAMS) - 1)
    upto = np.cumsum(length)
    lo = 0
    while lo < len(word):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PIECES, "right")))
        own, n_bytes = slice(lo, hi), length[lo:hi]
        piece = np.repeat(np.arange(hi - lo), n_bytes)
        total = len(piece)
        inner = np.arange(total) - (np.cumsum(n_bytes) - n_bytes)[piece]
        place = begin[own][piece] + inner
        of = word[own][piece]
        byte = raw[np.clip(starts[of] + place - 1, 0, max(len(raw) - 1, 0))].astype(np.uint64)
        byte[place == 0] = 60
        byte[place == size[of] - 1] = 62
        whole = word[own][begin[own] == 0]
        found, owner = [hashes[whole]], [whole]
        h = np.zeros(total, np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            h = h[: total - n + 1] * np.uint64(0x100000001B3) + byte[n - 1 :] + np.uint64(1) if n > 1 else byte + np.uint64(1)
            if n in NGRAMS:
                keep = np.flatnonzero((inner[: len(h)] < PIECE) & (inner[: len(h)] + n <= n_bytes[piece[: len(h)]]))
                found.append(h[keep] + np.uint64(n << 56))
                owner.append(of[keep])
        where = np.concatenate(owner)
        order = np.argsort(where, kind="stable")
        yield (tx.mix(np.concatenate(found)) & np.uint64(BUCKETS - 1)).astype(np.int32)[order], where[order]
        lo = hi


def distinct_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Distinct words' hashes; each word's place among them; rows' first words; the distinct words' n-grams."""
    raw = tx.LOWER[raw]
    starts, ends, first = tx.spans(raw, at, tx.ALNUM)
    distinct, example, place = np.unique(tx.word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    return distinct, place, first, ngrams(raw, starts[example], ends[example], distinct)


def windows(first: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window, and each row's first window; windows do not cross rows."""
    n = -(-np.diff(first) // size)
    upto = np.concatenate(([0], np.cumsum(n)))
    inner = np.arange(upto[-1]) - np.repeat(upto[:-1], n)
    return np.repeat(first[:-1], n) + inner * size, upto


def _ragged(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of some rows of a ragged array, and the rows' sizes."""
    n = offsets[rows + 1] - offsets[rows]
    return np.repeat(offsets[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


class Bags:
    """Texts as windows of words of n-gram buckets."""

    def __init__(self, texts: list[str | None]) -> None:
        raw, at = tx.utf8(pa.array(texts, pa.string()))
        hashes, buckets, sizes, tokens, firsts = [], [], [], [], [np.zeros(1, np.int64)]
        for lo, hi in tx.slices(at):
            distinct, place, first, grams = distinct_words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            hashes.append(distinct)
            n = np.zeros(len(distinct), np.int64)
            for b, word in grams:
                buckets.append(b)
                n += np.bincount(word, minlength=len(distinct))
            sizes.append(n)
            tokens.append(distinct[place])
            firsts.append(first[1:] + firsts[-1][-1])
        none = np.zeros(0, np.uint64)
        self.first = np.concatenate(firsts)
        distinct, example = np.unique(np.concatenate([*hashes, none]), return_index=True)
        offsets = np.concatenate(([0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)])))).astype(np.int64)
        flat, n = _ragged(offsets, example)
        self.buckets = np.concatenate([*buckets, np.zeros(0, np.int32)])[flat]
        self.offsets = np.concatenate(([0], np.cumsum(n)))
        self.tokens = np.searchsorted(distinct, np.concatenate([*tokens, none]))
        self.starts, self.doc_windows = windows(self.first)
        self.token_offsets = np.concatenate((self.starts, [len(self.tokens)]))

    def batch(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All buckets of some windows in a row, and how many each window has."""
        at, n_words = _ragged(self.token_offsets, chosen)
        flat, n = _ragged(self.offsets, self.tokens[at])
        return self.buckets[flat], np.add.reduceat(n, np.cumsum(n_words) - n_words)


class Model:
    """Bucket weights and bias of the windows' logit; slope, bias and size weight of the documents'."""

    def __init__(self, weights: np.ndarray, bias: float, logistic: np.ndarray) -> None:
        self.weights, self.bias, self.logistic = weights, bias, logistic

    def peaks(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's largest window logit, and its number of windows."""
        distinct, place, first, grams = distinct_words(raw, at)
        starts, upto = windows(first)
        peak = np.full(len(first) - 1, self.bias)
        if len(starts):
            value, n = np.zeros(len(distinct), self.weights.dtype), np.zeros(len(distinct), np.int64)
            for buckets, word in grams:
                new = np.flatnonzero(np.diff(word, prepend=-1))
                value[word[new]] += np.add.reduceat(self.weights[buckets], new)
                n[word[new]] += np.diff(new, append=len(word))
            logit = np.add.reduceat(value[place], starts) / np.add.reduceat(n[place], starts) + self.bias
            full = np.flatnonzero(np.diff(upto))
            peak[full] = np.maximum.reduceat(logit, upto[full])
        return peak, np.diff(upto)

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        peak, n = self.peaks(raw, at)
        z = self.logistic[0] * peak + self.logistic[1] * np.log1p(n) + self.logistic[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _embed(bags: Bags, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Joint training of embeddings and softmax, by Adagrad over batches of windows.

    At first all windows of a toxic document count as toxic; then those that the model finds most
    toxic, while the lower half counts as clean.
    """
    rng = np.random.default_rng(SEED)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    u, b = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    ge, gu, gb = np.full(BUCKETS, 1e-6, np.float32), np.full_like(u, 1e-6), np.full_like(b, 1e-6)
    doc = np.repeat(np.arange(len(toxic)), np.diff(bags.doc_windows))
    target, use = toxic[doc].astype(np.int64), np.ones(len(doc), dtype=bool)
    for epoch in range(EPOCHS):
        if epoch:
            each = np.concatenate([_means(bags, e, np.arange(lo, min(lo + 8192, len(doc)))) @ (u[:, 1] - u[:, 0]) for lo in range(0, len(doc), 8192)])
            for d in np.flatnonzero(toxic):
                lo, hi = bags.doc_windows[d : d + 2]
                order = lo + np.argsort(-each[lo:hi], kind="stable")
                top = max(1, round(0.15 * (hi - lo)))
                target[lo:hi], use[lo:hi] = 0, False
                target[order[:top]] = 1
                use[order[:top]] = use[order[max(top, (hi - lo) // 2) :]] = True
        chosen = rng.permutation(np.flatnonzero(use))
        for lo in range(0, len(chosen), BATCH):
            part = chosen[lo : lo + BATCH]
            flat, n = bags.batch(part)
            mean = np.add.reduceat(e[flat], np.cumsum(n) - n) / n[:, None]
            z = mean @ u + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), target[part]] -= 1
            to_mean = (p @ u.T) / n[:, None]
            order = np.argsort(flat, kind="stable")
            rows, begin = np.unique(flat[order], return_index=True)
            g = np.add.reduceat(np.repeat(to_mean, n, axis=0)[order], begin)
            ge[rows] += (g * g).mean(1)
            e[rows] -= RATE * g / np.sqrt(ge[rows])[:, None]
            for x, gx, grad in ((u, gu, mean.T @ p), (b, gb, p.sum(0))):
                gx += grad * grad
                x -= RATE * grad / np.sqrt(gx)
    return e @ (u[:, 1] - u[:, 0]), float(b[1] - b[0])


def _means(bags: Bags, e: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    flat, n = bags.batch(chosen)
    return np.add.reduceat(e[flat], np.cumsum(n) - n) / n[:, None]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    scale = np.maximum(x.std(0), 1e-3)
    a = np.column_stack((x / scale, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (p - y) + 1e-2 * w)
        w -= np.clip(step, -2, 2)
    return w / np.append(scale, 1)


def train(texts: list[str | None], labels: list[int]) -> Model:
    """Fit embeddings on one part of the labelled texts and the documents' logistic on the other."""
    toxic = np.array(labels, dtype=bool)
    n_fit = max(1, int(FIT_SHARE * len(texts)))
    if not len(toxic) or toxic.all() or not toxic.any():
        return Model(np.zeros(BUCKETS), 0.0, np.array([0, 0, 30.0 if len(toxic) and toxic.all() else -30.0]))
    if toxic[:n_fit].all() or not toxic[:n_fit].any() or toxic[n_fit:].all() or not toxic[n_fit:].any():
        n_fit = len(texts)
    weights, bias = _embed(Bags(texts[:n_fit]), toxic[:n_fit])
    model = Model(weights, bias, np.array([1.0, 0.0, 0.0]))
    rest = slice(n_fit if n_fit < len(texts) else 0, None)
    raw, at = tx.utf8(pa.array(texts[rest], pa.string()))
    got = [model.peaks(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in tx.slices(at)]
    peak, n = (np.concatenate(x) for x in zip(*got, strict=True))
    model.logistic = _logistic(np.column_stack((peak, np.log1p(n))), toxic[rest].astype(float))
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether labels of this document are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, limit_bytes: int = MAX_LABELLED_BYTES) -> Model:
    """A model from a bounded sample of labelled documents that are not held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sample = usable.select("doc_id", "toxic", F.xxhash64("doc_id").alias("order")).orderBy("order", "doc_id", "toxic").limit(limit)
    spark = docs.sparkSession
    ids = sample.select("order", "doc_id").distinct()  # at most ``limit``
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("order", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = scratch.keep(spark, found.withColumn("size", F.octet_length("text").cast("long")).where(F.col("size") <= limit_bytes // 16), "labelled")
    total, cut = 0, None
    for r in found.select("order", "doc_id", "size").orderBy("order", "doc_id").toLocalIterator():  # numbers only
        total += r["size"]
        if total > limit_bytes:
            break
        cut = r
    if cut is None:
        return train([], [])
    within = (F.col("order") < cut["order"]) | ((F.col("order") == cut["order"]) & (F.col("doc_id") <= cut["doc_id"]))
    texts = {r["doc_id"]: r["text"] for r in found.where(within).select("doc_id", "text").collect()}  # at most ``limit_bytes``
    rows = [r for r in sample.collect() if r["doc_id"] in texts]
    rows.sort(key=lambda r: (r["order"], r["doc_id"], r["toxic"]))
    return train([texts[r["doc_id"]] for r in rows], [int(r["toxic"] > 0) for r in rows])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = tx.utf8(batch.column("text"))
            parts = [model.value.scores(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in tx.slices(at)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(np.concatenate([*parts, np.zeros(0)]))], ["row", "text", "score"])

    return run


def _scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` (all columns but the text), ``text`` and ``score``."""
    tx.small_batches(docs)
    model = spark.sparkContext.broadcast(learn(docs, labels))
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    return packed.mapInArrow(_score(model), packed.withColumn("score", F.lit(0.0)).schema)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted label of every document."""
    out = _scored(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return out.select("row.doc_id", "score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic; columns as in ``docs``."""
    out = _scored(spark, docs, labels).where(F.col("score") < threshold)
    return out.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
