"""Graphs from sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions.sequence import dbg_overlaps, kmers, overlap_edges, overlap_kmers, reverse_complement
from ..model import AssemblyGraph


def kmer_table(sequences: DataFrame, k: int, bases: str = "bases", circular: bool = False, both_strands: bool = False) -> DataFrame:
    """(kmer, n): the k-mers of all sequences, and of their reverse complements if asked for."""
    each = sequences.select(F.col(bases).alias("bases"))
    if both_strands:
        each = each.union(each.select(reverse_complement(F.col("bases"))))
    return each.select(F.explode(kmers(F.col("bases"), k, circular)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def annotated_dbg(sequences: DataFrame, k: int, bases: str = "bases", circular: bool = False, both_strands: bool = False) -> AssemblyGraph:
    """The de Bruijn graph of all sequences: k-mers are the ids and segments, their counts the depths.

    K-mers without edges are absent, as a graph has the vertices that its edges name. Counts and overlaps are written
    once; edges are a projection of the overlaps.
    """
    spark = sequences.sparkSession
    counts = scratch.keep(spark, kmer_table(sequences, k, bases, circular, both_strands), "kmers")
    overlaps = scratch.keep(spark, dbg_overlaps(counts), "overlaps")
    vertices = counts.join(overlap_kmers(overlaps), "kmer", "left_semi").select(F.col("kmer").alias("vid"), F.lit(1).cast("long").alias("length"), F.array("kmer").alias("segments"), F.array(F.col("n").cast("double")).alias("depth"))
    return AssemblyGraph(vertices, overlap_edges(overlaps), k, ("all",))
