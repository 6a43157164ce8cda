"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. Equal directions are one class; what follows sees one vector of each.
2. A rotation of the decorrelated vectors is learned on a bounded sample by iterative
   quantisation: signs of the rotated vectors are the codes, and the rotation is moved to where it is
   nearest to its signs. One rotation gives as many bits as a vector has components; more bits come
   from rotations that start elsewhere.
3. A code is cut into substrings of about log2(vectors) bits, one Hamming table each. Codes that
   differ in fewer bits than there are tables share a substring for certain, and the number of tables is
   such that a pair at the threshold shares one with a probability of ``RECALL``.
4. Groups are balls before they are pairs: in a bucket everything meets the bucket's first vector only, and
   a vector joins the hub that it meets most often, if their cosine is high enough. A hub has a core, of
   vectors within half the threshold's angle, and a shell, of those within the whole angle.
5. Buckets then hold balls instead of vectors, with the bits that all of a ball's vectors have and those that
   any has: their Hamming distance bounds that of any two vectors from below. Pairs of balls are met
   with their hubs' original vectors: by the triangle inequality some link whole, some not at all, and only the
   others are compared vector by vector, in blocks.

So no pair of a group is ever a row: a group of m near copies is one ball and a hub's neighbours.

Defined cases: a vector that is null, empty, zero or has a null or non-finite component links with nothing and is
its own component; a null id gets a null component and links with nothing; rows that repeat an id are vectors of
their own, whose components are those of their vectors; vectors of different lengths are not compared;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from . import text as tx
from .jaccard import components

#: Cosine from which on vectors link.
COSINE = 0.9
#: Probability that the tables bring a pair at the threshold together.
RECALL = 0.98
#: Vectors and bytes of them that rotations are learned on, at most, and lengths of vectors that have one; others take a random rotation.
SAMPLE, SAMPLE_BYTES, FITTED_LENGTHS = 20_000, 64 << 20, 4
#: Vectors of the sample whose pairs are all looked at, the share of links among them to be found, and a sample's least size to be centred.
CHECKED, ENOUGH, LEAST_CENTRED = 1000, 0.95, 256
#: Rounds of the quantisation.
ROUNDS = 30
#: Bits by which substrings are shorter than log2(vectors), and their least and greatest length.
SLACK, LEAST_BITS, MOST_BITS = 3, 6, 30
#: Bits of a code that bound distances, and standard deviations beyond the expected distance that still pass.
CHECK_BITS, DEVIATIONS = 128, 4
#: Balls of a bucket, and vectors of a ball, that are compared at once; vectors that are encoded at once.
BLOCK, ENCODED = 2048, 512
#: Angles are called certain only beyond this.
EPS = 1e-7


def unit(values) -> np.ndarray | None:
    """The direction in double precision, or None where there is none."""
    if values is None or not len(values):
        return None
    x = np.asarray(values, dtype=np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top  # components near the range's ends neither overflow nor vanish
    return x / math.sqrt(float(x @ x)) + 0.0  # no negative zeros


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("embedding")
        flat = column.flatten().cast(pa.float64())
        nulls = flat.null_count
        values = np.where(flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0.0).to_numpy(zero_copy_only=False), np.nan) if nulls else flat.to_numpy(zero_copy_only=False)
        sizes = np.array([len(v) if v.is_valid else 0 for v in column], dtype=np.int64)
        ends = np.cumsum(sizes)
        out, digests = [], []
        for lo, hi in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            u = unit(values[lo:hi])
            out.append(u)
            d = None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest()
            digests.append((None, None) if d is None else (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "d1", "d2", "x"]
        )


def quantisation(x: np.ndarray, rotations: int, centred: bool, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The centre, and a matrix whose columns give the bits: ``rotations`` times as many as a vector has components."""
    d = x.shape[1]
    mean = x.mean(0) if centred else np.zeros(d)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    v = (x - mean) @ axes
    out = []
    for i in range(rotations):
        r = np.linalg.qr(np.random.default_rng([seed, i]).standard_normal((d, d)))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (left @ right).T
        out.append(axes @ r)
    return mean, np.concatenate(out, axis=1)


def random_rotations(d: int, rotations: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng([11, d])
    return np.zeros(d), np.concatenate([np.linalg.qr(draw.standard_normal((d, d)))[0] for _ in range(rotations)], axis=1)


class Codes:
    """What the tasks need to encode a vector: number and length of substrings, and a matrix for each fitted length."""

    def __init__(self, n: int, cosine: float, recall: float) -> None:
        self.bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n, 2))) - SLACK))
        self.angle = math.acos(cosine)
        same = 1 - self.angle / math.pi  # how often the signs of two directions at the threshold agree
        self.tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(same**self.bits))))
        check = min(CHECK_BITS, self.bits * self.tables)
        self.distance = math.ceil(check * (1 - same) + DEVIATIONS * math.sqrt(check * same * (1 - same)))
        self.fitted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def model(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length not in self.fitted:
            self.fit(length, None)
        return self.fitted[length]

    def fit(self, length: int, sample: np.ndarray | None) -> None:
        """Learn the bits for vectors of a length, or draw them at random without a sample.

        Centring balances the bits, but parts vectors that all lie in one narrow cone; so what is learned is held
        against all pairs of ``CHECKED`` vectors of the sample, and the first of three ways that finds enough is taken:
        centred, not centred, random rotations (whose recall is the one that the number of tables is made for).
        """
        rotations = -(-self.bits * self.tables // length)
        if sample is None:
            self.fitted[length] = random_rotations(length, rotations)
            return
        checked = sample[:CHECKED]
        p, q = np.nonzero(np.triu(checked @ checked.T >= math.cos(self.angle), 1))
        tried = []
        for way in (True, False, None):
            if way and len(sample) < LEAST_CENTRED:
                continue
            self.fitted[length] = random_rotations(length, rotations) if way is None else quantisation(sample, rotations, way)
            keys, first = self.encode(checked)
            near = np.bitwise_count((first[p] ^ first[q]).view(np.uint64)).sum(1) <= self.distance
            found = float(((keys[p] == keys[q]).any(1) & near).mean()) if len(p) else 1.0
            tried.append((found, self.fitted[length]))
            if found >= ENOUGH:
                return
        self.fitted[length] = max(tried, key=lambda t: t[0])[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tables) substrings of each vector of one length, and its first bits as two numbers."""
        mean, matrix = self.model(x.shape[1])
        bits = ((x - mean) @ matrix > 0)[:, : self.bits * self.tables]
        keys = bits.reshape(len(x), self.tables, self.bits) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))
        first = np.zeros((len(x), CHECK_BITS), dtype=np.uint8)
        first[:, : min(CHECK_BITS, bits.shape[1])] = bits[:, :CHECK_BITS]
        return keys | (np.int64(x.shape[1]) << np.int64(MOST_BITS)), np.packbits(first, axis=1).view(np.int64)


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length each, and their vectors as a matrix."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield rows, flat[starts[rows][:, None] + np.arange(n)]


def _encoded(codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ENCODED):
                part = batch.slice(lo, ENCODED)
                for rows, x in _lists(pa.concat_arrays([part.column("x")])):
                    keys, first = codes.value.encode(x)
                    nodes = part.column("node").to_numpy()[rows]
                    m = keys.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(m, dtype=np.int32), len(rows))), pa.array(keys.ravel()), pa.array(np.repeat(nodes, m)), pa.array(np.repeat(first[:, 0], m)), pa.array(np.repeat(first[:, 1], m))],
                        ["at", "key", "node", "c0", "c1"],
                    )

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows that are sorted by ``by``, which are numbers: as many at once as a batch has, the last one carried over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows - 1, dtype=bool)
        for c in by:
            v = batch.column(c).to_numpy()
            same &= v[1:] == v[:-1]
        goes_on = bool(held) and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in by)
        edges = np.flatnonzero(~same) + 1
        last = int(edges[-1]) if len(edges) else 0
        if held and not goes_on:
            yield _joined(held)
            held = []
        if last:
            yield _joined([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _edges(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for c in by:
        v = batch.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def _close(distance: int):
    """Pairs of balls of a bucket, or of two of its blocks, whose bits allow vectors within the distance."""
    by = ["at", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, by):
            ball, block, i, j = (batch.column(c).to_numpy() for c in ("ball", "block", "i", "j"))
            every = [np.stack([batch.column(f"{c}{k}").to_numpy().view(np.uint64) for k in (0, 1)], axis=1) for c in "ao"]
            edges = _edges(batch, by)
            sizes = np.diff(edges)
            found = []

            def test(p: np.ndarray, q: np.ndarray) -> None:
                (ap, op), (aq, oq) = ([e[x] for e in every] for x in (p, q))
                near = np.bitwise_count((ap & ~oq) | (aq & ~op)).sum(1) <= distance
                found.append(np.sort(np.stack([ball[p[near]], ball[q[near]]], axis=1), axis=1))

            for n in np.unique(sizes[sizes > 1]).tolist():
                firsts = edges[:-1][sizes == n]
                if n <= 64:  # small buckets of one size at once
                    p, q = np.triu_indices(n, 1)
                    for lo in range(0, len(firsts), max(1, (1 << 18) // len(p))):
                        at = firsts[lo : lo + max(1, (1 << 18) // len(p))]
                        whole = np.repeat(i[at] == j[at], len(p))
                        a, b = (at[:, None] + p).ravel(), (at[:, None] + q).ravel()
                        ok = whole | (block[a] != block[b])
                        test(a[ok], b[ok])
                    continue
                for at in firsts.tolist():
                    for p in range(at, at + n):
                        q = np.arange(p + 1, at + n)
                        q = q if i[at] == j[at] else q[block[q] != block[p]]
                        test(np.full(len(q), p), q)
            pairs = np.unique(np.concatenate([*found, np.zeros((0, 2), np.int64)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["p", "q"])

    return run


def _compared(cosine: float):
    """For two blocks of vectors, how many rows each vector links with there."""
    by = ["p", "q", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, by):
            edges = _edges(batch, by)
            p, q, i, j, node, weight, right = (batch.column(c).to_numpy(zero_copy_only=False) for c in (*by, "node", "weight", "right"))
            vectors = pa.concat_arrays([batch.column("x")])
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                x = flat[at[lo] - at[0] : at[hi] - at[0]].reshape(hi - lo, -1)
                own = p[lo] == q[lo] and i[lo] == j[lo]
                left = np.arange(lo, hi) if own else np.flatnonzero(~right[lo:hi]) + lo
                other = left if own else np.flatnonzero(right[lo:hi]) + lo
                if not len(left) or not len(other):
                    continue
                hit = (x[left - lo] @ x[other - lo].T) >= cosine
                if own:
                    np.fill_diagonal(hit, False)
                sums = [(left, hit @ weight[other])] + ([] if own else [(other, hit.T @ weight[left])])
                rows = np.concatenate([a[s > 0] for a, s in sums])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), p[lo])), pa.array(np.full(len(rows), q[lo])), pa.array(node[rows]), pa.array(np.concatenate([s[s > 0] for _, s in sums]).astype(np.int64))], ["p", "q", "node", "n"]
                )

    return run


def near(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links (other rows that are linked directly), component_id (the least id reachable by links) and kept of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = scratch.keep(spark, rows.mapInArrow(_units, "vec_id long, d1 long, d2 long, x array<double>"), "units")
    usable = units.where(F.col("x").isNotNull() & F.col("vec_id").isNotNull())
    classes = usable.groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("x").alias("x"))
    nodes = scratch.keep(spark, classes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    codes = _learned(spark, nodes, cosine, recall)
    model = spark.sparkContext.broadcast(codes)
    entries = scratch.keep(spark, nodes.select("node", "x").mapInArrow(_encoded(model), "at int, key long, node long, c0 long, c1 long"), "entries")
    members = _balls(spark, nodes, entries, codes)
    balls = members.groupBy("ball").agg(F.max("away").alias("radius"), F.sum("weight").alias("weight"), F.count("*").alias("size"), F.first("hub").alias("hub"))
    balls = scratch.keep(spark, balls.join(nodes.select(F.col("node").alias("hub"), F.col("x").alias("center")), "hub"), "balls")
    pairs = _pairs(spark, entries, members, balls, codes)
    whole, tiles = _met(spark, pairs, balls, cosine, codes.angle)
    parts = scratch.keep(spark, _tiled(tiles, members, nodes, cosine), "parts")

    p, q = ([F.col(f"{s}.{c}") for c in ("ball", "weight")] for s in ("p", "q"))
    known = whole.select(p[0].alias("ball"), q[1].alias("n")).union(whole.where(p[0] != q[0]).select(q[0].alias("ball"), p[1].alias("n")))
    known = known.groupBy("ball").agg(F.sum("n").alias("known"))
    some = parts.groupBy("node").agg(F.sum("n").alias("some"))
    # a ball that links whole with itself counts each vector's own rows, which are taken off again
    itself = whole.where(p[0] == q[0]).select(p[0].alias("ball"), F.lit(1).alias("itself"))
    counted = members.select("node", "ball", "hub", "weight").join(known, "ball", "left").join(itself, "ball", "left").join(some, "node", "left")
    links = F.coalesce("known", F.lit(0)) + F.coalesce("some", F.lit(0)) - F.when(F.col("itself").isNotNull(), F.col("weight")).otherwise(0) + F.col("weight") - 1
    hub_of = lambda s: F.shiftright(s, 1)
    joined = whole.select(hub_of(p[0]).alias("a"), hub_of(q[0]).alias("b")).union(parts.select(hub_of("p"), hub_of("q"))).where("a != b").distinct()
    found = components(spark, joined)
    least = members.join(nodes.select("node", "rep"), "node").groupBy("hub").agg(F.min("rep").alias("least"))
    least = least.join(found, least["hub"] == found["id"], "left").select("hub", "least", F.coalesce("component", "hub").alias("component"))
    least = scratch.keep(spark, least, "least")
    names = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("hub", "component_id")
    labelled = counted.select("node", "hub", links.alias("n_links")).join(scratch.keep(spark, names, "names"), "hub").join(nodes.select("node", "d1", "d2"), "node")
    labelled = scratch.keep(spark, labelled.select("d1", "d2", "n_links", "component_id"), "labelled")  # a plain join follows, which Spark splits where a class is large
    out = units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("d1")).alias("d1"), "d2").join(labelled, ["d1", "d2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _learned(spark: SparkSession, nodes: DataFrame, cosine: float, recall: float) -> Codes:
    """Codes for all vectors; at most ``SAMPLE_BYTES`` of each of the ``FITTED_LENGTHS`` most frequent lengths reach the driver."""
    lengths = nodes.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length")
    total = nodes.count()
    codes = Codes(total, cosine, recall)
    for r in lengths.limit(FITTED_LENGTHS).collect():
        n = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * r["length"])))
        drawn = nodes.where(F.size("x") == r["length"]).orderBy("d1", "d2").limit(n).select("x")  # digests are a random order
        codes.fit(r["length"], np.array([x["x"] for x in drawn.toLocalIterator()], dtype=np.float64))
    return codes


def _balls(spark: SparkSession, nodes: DataFrame, entries: DataFrame, codes: Codes) -> DataFrame:
    """(node, hub, ball, away, weight): every class's ball, which is twice its hub and, in the shell, one more, and its angle to the hub."""
    first = entries.groupBy("at", "key").agg(F.min(F.struct("node", "c0", "c1")).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    apart = F.bit_count(F.col("c0").bitwiseXOR(F.col("first.c0"))) + F.bit_count(F.col("c1").bitwiseXOR(F.col("first.c1")))
    votes = entries.join(first, ["at", "key"]).where((F.col("node") != F.col("first.node")) & (apart <= codes.distance)).groupBy("node", F.col("first.node").alias("hub")).count()
    best = scratch.keep(spark, votes.groupBy("node").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub")), "votes")
    x = nodes.select("node", "x")
    met = best.join(x, "node").join(x.select(F.col("node").alias("hub"), F.col("x").alias("center")), "hub")
    away = F.acos(F.least(F.lit(1.0), F.aggregate(F.zip_with("x", "center", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))
    met = scratch.keep(spark, met.select("node", "hub", away.alias("away")).where(F.col("away") <= codes.angle - EPS), "met")
    met = met.join(met.select(F.col("hub").alias("node")).distinct(), "node", "left_anti")  # hubs stay where they are
    out = nodes.select("node", "weight").join(met, "node", "left").select("node", F.coalesce("hub", "node").alias("hub"), F.coalesce("away", F.lit(0.0)).alias("away"), "weight")
    shell = (F.col("away") > codes.angle / 2 - EPS).cast("long")
    return scratch.keep(spark, out.withColumn("ball", F.col("hub") * 2 + shell), "members")


def _pairs(spark: SparkSession, entries: DataFrame, members: DataFrame, balls: DataFrame, codes: Codes) -> DataFrame:
    """(p, q), p <= q: balls that may have links between them. Buckets of many balls are dealt out as pairs of blocks."""
    bits = [f(c).alias(f"{a}{i}") for a, f in (("a", F.bit_and), ("o", F.bit_or)) for i, c in enumerate(("c0", "c1"))]
    held = scratch.keep(spark, entries.join(members.select("node", "ball"), "node").groupBy("at", "key", "ball").agg(*bits), "buckets")
    many = held.groupBy("at", "key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    dealt = held.join(many, ["at", "key"]).withColumn("block", F.pmod(F.xxhash64("ball"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    by = ["at", "key", "i", "j"]
    near = dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_close(codes.distance), "p long, q long")
    own = balls.where("size > 1 or radius > 0").select(F.col("ball").alias("p"), F.col("ball").alias("q"))
    shells = balls.where("ball % 2 = 1").select((F.col("ball") - 1).alias("p"), F.col("ball").alias("q"))
    return scratch.keep(spark, near.union(own).union(shells).distinct(), "pairs")


def _met(spark: SparkSession, pairs: DataFrame, balls: DataFrame, cosine: float, angle: float) -> tuple[DataFrame, DataFrame]:
    """The pairs of balls that link whole, and those that must be compared vector by vector."""
    side = lambda s: balls.select(F.col("ball").alias(s), F.struct("ball", "radius", "weight", "size").alias(f"{s}_"), F.col("center").alias(f"{s}_center"))
    both = pairs.join(side("p"), "p").join(side("q"), "q")
    dot = F.aggregate(F.zip_with("p_center", "q_center", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    lone = (F.col("p_.radius") == 0) & (F.col("q_.radius") == 0)
    met = both.select(F.col("p_").alias("p"), F.col("q_").alias("q"), dot.alias("dot"), lone.alias("lone"))
    reach, between = F.col("p.radius") + F.col("q.radius"), F.when(F.col("p.ball").bitwiseOR(F.lit(1)) == F.col("q.ball").bitwiseOR(F.lit(1)), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dot")))))
    kind = F.when(F.col("lone"), F.when(F.col("dot") >= cosine, 1).otherwise(0)).when(between + reach <= angle - EPS, 1).when(between - reach > angle + EPS, 0).otherwise(2)
    met = scratch.keep(spark, met.withColumn("kind", kind).where("kind > 0"), "met")
    return met.where("kind = 1").select("p", "q"), met.where("kind = 2").select("p", "q")


def _tiled(tiles: DataFrame, members: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """(p, q, node, n): the rows that a vector of two balls links with in the other one."""
    blocks = lambda s: F.ceil(F.col(f"{s}.size") / BLOCK).cast("int")
    work = tiles.select(F.col("p.ball").alias("p"), F.col("q.ball").alias("q"), blocks("p").alias("m"), blocks("q").alias("n"))
    work = work.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("p != q or i <= j")
    left = work.select("p", "q", "i", "j", F.col("p").alias("ball"), F.col("i").alias("block"), F.lit(False).alias("right"))
    right = work.where("p != q or i != j").select("p", "q", "i", "j", F.col("q").alias("ball"), F.col("j").alias("block"), F.lit(True).alias("right"))
    sizes = members.groupBy("ball").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = members.join(sizes, "ball").join(nodes.select("node", "x"), "node").select("node", "weight", "ball", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "x")
    by = ["p", "q", "i", "j"]
    dealt = left.union(right).join(placed, ["ball", "block"]).select(*by, "right", "node", "weight", "x")
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_compared(cosine), "p long, q long, node long, n long")
