"""Graphs as Parquet folders, and small text files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AssemblyGraph


def dump_graph(spark: SparkSession, graph: AssemblyGraph, path: str) -> None:
    """Write vertices, edges and numbers below ``path``; absent rows are purged already."""
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark.createDataFrame([(json.dumps({"k": graph.k, "samples": list(graph.samples)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_graph(spark: SparkSession, path: str) -> AssemblyGraph:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    return AssemblyGraph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), meta["k"], tuple(meta["samples"]))


def checkpoint(spark: SparkSession, graph: AssemblyGraph, folder: str, number: int) -> AssemblyGraph:
    """Write a round's graph and go on from the written one; this also cuts the lineage."""
    dump_graph(spark, graph, f"{folder}/checkpoint_{number}")
    return load_graph(spark, f"{folder}/checkpoint_{number}")


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name per line, without blanks."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")
