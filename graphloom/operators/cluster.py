"""Clusters of vertices by their depth profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .. import scratch
from .linkage import average_linkage

#: Centres go to all tasks.
MAX_CENTRE_BYTES = 64 << 20


def with_depth(vertices: DataFrame) -> DataFrame:
    """Vertices whose summed depth is over 0."""
    return vertices.where(F.aggregate("depth", F.lit(0.0), lambda a, x: a + x) > 0)


def _features(vertices: DataFrame, exponent: float) -> DataFrame:
    """(vid, p): depths to a power, scaled to length 1, of vertices that have depth."""
    powered = F.transform("depth", lambda x: F.pow(x, F.lit(exponent)))
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x))
    return with_depth(vertices).select("vid", powered.alias("p")).select("vid", F.transform("p", lambda x: x / norm).alias("p"))


def precluster(vertices: DataFrame, clusters: int, exponent: float = 1.0, seed: int = 0, max_iter: int = 20) -> DataFrame:
    """(vid, cluster) by k-means of depths to a power, scaled to length 1."""
    rows = _features(vertices, exponent).select("vid", array_to_vector("p").alias("features"))
    k = min(clusters, rows.count())
    if k < 2:
        return rows.select("vid", F.lit(0).alias("cluster"))
    return KMeans(k=k, seed=seed, maxIter=max_iter, predictionCol="cluster").fit(rows).transform(rows).select("vid", "cluster")


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre (of equal ones the first) and its squared distance, in blocks of bounded size."""
    half = (centres**2).sum(1) / 2
    step = max(1, (1 << 22) // len(centres))
    to = np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, 1) for i in range(0, len(x), step)])
    return to, ((x - centres[to]) ** 2).sum(1)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _first_centres(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k rows, each drawn in proportion to the squared distance from those before it; rows that repeat only where nothing else is left."""
    chosen = [int(random.integers(len(x)))]
    away = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = away.sum()
        chosen.append(int(random.choice(len(x), p=away / total)) if total > 0 else int(random.integers(len(x))))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def precluster_batches(spark: SparkSession, vertices: DataFrame, clusters: int, exponent: float = 1.0, seed: int = 0, batch_rows: int = 1 << 20, passes: int = 3, init_rows: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vid, cluster, loss) by mini-batch k-means of depths to a power, scaled to length 1, and the centres.

    Rows are dealt by a hash of their id into batches of about ``batch_rows``, each written to a folder of its own, so that a
    step reads its batch alone. Tasks sum the rows nearest to each centre, and an aggregate sums the tasks. A centre
    moves to the mean of all rows that it has had: its learning rate is the batch's part of them, and every pass counts anew.
    The first centres come from ``init_rows`` rows (default: 10 a cluster, 2000 at least) by squared distances;
    these and the centres, of at most MAX_CENTRE_BYTES, are all that the driver holds. ``loss`` is the squared distance from the centre.
    Vertices without depth, or with null or infinite ones, are left out; no vertices give no rows and no centres.
    """
    sound = F.forall("p", lambda x: x.isNotNull() & ~F.isnan(x))
    features = _features(vertices, exponent).where(sound)
    n = features.count()
    k = min(clusters, n)
    if k < 1:
        return features.select("vid", F.lit(0).alias("cluster"), F.lit(0.0).alias("loss")), np.empty((0, 0))
    batches = -(-n // batch_rows)
    path = scratch.new_path(spark, "batches")
    features.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), "vid"), F.lit(batches))).write.partitionBy("batch").parquet(path)
    dealt = spark.read.schema(features.schema).option("recursiveFileLookup", "true").parquet(path)
    drawn = dealt.orderBy(F.xxhash64(F.lit(seed + 1), "vid"), "vid").limit(init_rows or max(10 * k, 2000)).select("p").toArrow()
    x = _matrix(drawn.column("p").combine_chunks())
    if k * x.shape[1] * 8 > MAX_CENTRE_BYTES:
        raise ValueError(f"{k} centres of {x.shape[1]} samples are more than {MAX_CENTRE_BYTES} bytes")
    random = np.random.default_rng(seed)
    centres = min((_first_centres(x, k, random) for _ in range(3)), key=lambda c: _nearest(x, c)[1].sum())
    width = x.shape[1]

    def sums(batch: DataFrame, centres: np.ndarray) -> DataFrame:
        def run(parts):
            total, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for part in parts:
                if part.num_rows:
                    x = _matrix(part.column(0))
                    to = _nearest(x, centres)[0]
                    np.add.at(total, to, x)
                    counts += np.bincount(to, minlength=len(centres))
            some = np.flatnonzero(counts)
            offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.ListArray.from_arrays(offsets, pa.array(total[some].ravel()))], names=["cluster", "n", "p"])

        each = batch.select("p").mapInArrow(run, "cluster bigint, n bigint, p array<double>")
        return each.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(width)]).alias("p"))

    for _ in range(passes):
        seen = np.zeros(k, np.int64)
        for b in range(batches):
            if not scratch.exists(spark, f"{path}/batch={b}"):
                continue
            batch = spark.read.schema(features.schema).parquet(f"{path}/batch={b}")
            moved = centres.copy()
            for r in sums(batch, centres).collect():  # a row a centre
                c = r["cluster"]
                seen[c] += r["n"]
                moved[c] += (r["n"] / seen[c]) * (np.array(r["p"]) / r["n"] - centres[c])
            centres = moved

    def assign(parts):
        for part in parts:
            if part.num_rows:
                to, loss = _nearest(_matrix(part.column(1)), centres)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(to.astype(np.int32)), pa.array(loss)], names=["vid", "cluster", "loss"])

    kind = StructType([features.schema["vid"], StructField("cluster", IntegerType()), StructField("loss", DoubleType())])
    return dealt.mapInArrow(assign, kind), centres


def mean_depth(vertices: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, sample, depth, length): depths weighted by length, and summed lengths."""
    rows = vertices.join(clusters, "vid").select("cluster", "length", F.posexplode("depth").alias("sample", "d"))
    return rows.groupBy("cluster", "sample").agg((F.sum(F.col("d") * F.col("length")) / F.sum("length")).alias("depth"), F.sum("length").alias("length"))


def agglomerate(spark, means: DataFrame, threshold: float, exponent: float = 0.5) -> DataFrame:
    """(cluster, merged): average linkage of mean depths to a power by cosine distance, cut at ``threshold``."""
    profile = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", F.pow("depth", F.lit(exponent)).alias("d")))), lambda x: x["d"]).alias("p"))
    return average_linkage(spark, profile, threshold)


def segment_clusters(vertices: DataFrame, clusters: DataFrame) -> DataFrame:
    """(segment, cluster) of every segment of every vertex."""
    return vertices.join(clusters, "vid").select(F.explode("segments").alias("segment"), "cluster")


def metadata(vertices: DataFrame, clusters: DataFrame) -> DataFrame:
    """Vertices, segments, distinct segments, length and depth of each cluster."""
    segments = segment_clusters(vertices, clusters).groupBy("cluster").agg(F.count("*").alias("num_segments"), F.countDistinct("segment").alias("num_unique_segments"))
    counts = clusters.groupBy("cluster").agg(F.count("*").alias("num_vertices"))
    depth = mean_depth(vertices, clusters).groupBy("cluster").agg(F.max("length").alias("total_length"), F.sum("depth").alias("total_depth"))
    return counts.join(segments, "cluster").join(depth, "cluster")


def shared_segments(vertices: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_a, cluster_b, shared, total_a, total_b): distinct segments that two clusters share."""
    each = segment_clusters(vertices, clusters).distinct()
    totals = each.groupBy("cluster").agg(F.count("*").alias("total"))
    a, b = each.withColumnRenamed("cluster", "cluster_a"), each.withColumnRenamed("cluster", "cluster_b")
    shared = a.join(b, "segment").where("cluster_a < cluster_b").groupBy("cluster_a", "cluster_b").agg(F.count("*").alias("shared"))
    return shared.join(totals.select(F.col("cluster").alias("cluster_a"), F.col("total").alias("total_a")), "cluster_a").join(totals.select(F.col("cluster").alias("cluster_b"), F.col("total").alias("total_b")), "cluster_b")
