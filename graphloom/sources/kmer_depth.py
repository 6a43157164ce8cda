"""k-mer counts and depths of unitigs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import canonical, canonical_kmers, kmers


def kmer_counts(sequences: DataFrame, k: int, sample: str = "sample", bases: str = "bases", canonicalise: bool = True) -> DataFrame:
    """(kmer, sample, n): how often each k-mer is seen in a sample."""
    found = canonical_kmers(F.col(bases), k) if canonicalise else kmers(F.col(bases), k)
    return sequences.select(F.col(sample).alias("sample"), F.explode(found).alias("kmer")).groupBy("kmer", "sample").agg(F.count("*").alias("n"))


def check_strands(counts: DataFrame) -> DataFrame:
    """(kmer, sample, n) with each k-mer as its lesser strand; a k-mer that is there in both strands fails.

    A table that rows repeat in is summed. The failure is in the aggregate's result itself, so that no
    rule can move it before the comparison.
    """
    lesser = counts.groupBy(canonical(F.col("kmer")).alias("key"), "sample").agg(F.sum("n").alias("n"), F.min("kmer").alias("lo"), F.max("kmer").alias("hi"))
    both = F.raise_error(F.concat(F.lit("both strands present: "), F.col("lo"))).cast("string")
    ends = lesser.groupBy("key").agg(F.collect_list(F.struct("sample", "n")).alias("samples"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return ends.select(F.when(F.col("lo") == F.col("hi"), F.col("key")).otherwise(both).alias("kmer"), F.explode("samples").alias("s")).select("kmer", "s.sample", "s.n")


def mean_depth(unitigs: DataFrame, counts: DataFrame, k: int, samples: Sequence[str], unitig: str = "unitig", bases: str = "bases") -> DataFrame:
    """(unitig, sample, depth): mean count over a unitig's k-mers, unseen ones as 0, repeated ones repeatedly.

    Counts are of lesser k-mers, in long form; one distributed join serves all unitigs.
    """
    each = unitigs.select(F.col(unitig).alias("unitig"), F.explode(canonical_kmers(F.col(bases), k)).alias("kmer"))
    tally = each.groupBy("unitig", "kmer").agg(F.count("*").alias("m"))
    sums = tally.join(counts, "kmer").groupBy("unitig", "sample").agg(F.sum(F.col("m") * F.col("n")).alias("total"))
    size = unitigs.select(F.col(unitig).alias("unitig"), (F.length(bases) - (k - 1)).alias("n_kmers")).where("n_kmers > 0")
    grid = size.withColumn("sample", F.explode(F.array(*map(F.lit, samples))))  # every unitig has a depth in each sample
    return grid.join(sums, ["unitig", "sample"], "left").select("unitig", "sample", (F.coalesce("total", F.lit(0)) / F.col("n_kmers")).alias("depth"))


def depth_vectors(depths: DataFrame) -> DataFrame:
    """(unitig, depth): the samples' depths as an array, in the order of the samples."""
    ordered = F.array_sort(F.collect_list(F.struct("sample", "depth")))
    return depths.groupBy("unitig").agg(F.transform(ordered, lambda x: x["depth"]).alias("depth"))


def add_depth(vertices: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vertices with their unitig's depth; a vertex without one fails."""
    joined = vertices.join(vectors, "unitig", "left")
    return joined.withColumn("depth", F.when(F.col("depth").isNotNull(), F.col("depth")).otherwise(F.raise_error(F.concat(F.lit("no depth: "), F.col("unitig")))))


