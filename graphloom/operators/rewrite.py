"""Trimming, splitting and merging of vertices as joins.

How a property follows a rewrite is said by a rule: a column expression over the parent and its
path for splits, an aggregate over a path's members for merges. New rules are new classes.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..model import AssemblyGraph, validate


class Rule(Protocol):
    requires: tuple[str, ...]

    def on_split(self, name: str) -> Column:
        """The child's value; besides the parent's columns there are path, paths and path_depth."""

    def on_merge(self, name: str) -> Column:
        """The child's value, aggregated over members that have ranks."""


def _in_rank_order(name: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", name, "length"))), lambda x: F.struct(x[name].alias("value"), x["length"].alias("length")))


def _weighted_mean(name: str) -> Column:
    """Element-wise mean of arrays, weighted by length."""
    members = _in_rank_order(name)
    first = F.transform(F.element_at(members, 1)["value"], lambda _: F.lit(0.0))
    total = F.aggregate(members, first, lambda acc, m: F.zip_with(acc, m["value"], lambda a, b: a + b * m["length"]))
    return F.transform(total, lambda x: x / F.sum("length"))


class Length:
    requires = ()

    def on_split(self, name: str) -> Column:
        return F.col(name)

    def on_merge(self, name: str) -> Column:
        return F.sum(name)


class Segments:
    requires = ("length",)

    def on_split(self, name: str) -> Column:
        return F.col(name)

    def on_merge(self, name: str) -> Column:
        return F.flatten(F.transform(_in_rank_order(name), lambda x: x["value"]))


class Depth:
    """A child has its path's depth; a merged vertex the mean depth, weighted by length."""

    requires = ("length",)

    def on_split(self, name: str) -> Column:
        return F.col("path_depth")

    def on_merge(self, name: str) -> Column:
        return _weighted_mean(name)


class Position:
    """Children are spread around the parent; a merged vertex stands in the middle."""

    requires = ("length",)

    def __init__(self, offset: tuple[float, float] = (0.1, 0.1)) -> None:
        self.offset = offset

    def on_split(self, name: str) -> Column:
        share = F.when(F.col("paths") > 1, F.col("path") / F.greatest(F.col("paths") - 1, F.lit(1)) - 0.5).otherwise(F.lit(-0.5))
        return F.array(*[F.element_at(name, i + 1) + share * o * F.col("paths") for i, o in enumerate(self.offset)])

    def on_merge(self, name: str) -> Column:
        return _weighted_mean(name)


class Touched:
    requires = ()

    def on_split(self, name: str) -> Column:
        return F.lit(True)

    def on_merge(self, name: str) -> Column:
        return F.lit(True)


RULES: Mapping[str, Rule] = {"length": Length(), "segments": Segments(), "depth": Depth(), "position": Position(), "touched": Touched()}


def _rules_for(graph: AssemblyGraph, rules: Mapping[str, Rule]) -> list[str]:
    """The names of the vertices' properties, once each is known to have a rule."""
    validate(graph, {name: rule for name, rule in rules.items() if name in graph.vertices.columns})
    return [c for c in graph.vertices.columns if c != "vid"]


def trim(graph: AssemblyGraph, gone: DataFrame) -> AssemblyGraph:
    """The graph without some vertices and their edges."""
    ids = gone.select("vid").distinct()
    edges = graph.edges.join(ids.select(F.col("vid").alias("src")), "src", "left_anti").join(ids.select(F.col("vid").alias("dst")), "dst", "left_anti")
    return graph.with_(vertices=graph.vertices.join(ids, "vid", "left_anti"), edges=edges.select(*graph.edges.columns))


def number_children(spark: SparkSession, graph: AssemblyGraph, paths: DataFrame, order: list[str]) -> DataFrame:
    """``paths`` with ``child``: ids after the largest one, in order."""
    top = graph.vertices.agg(F.coalesce(F.max("vid"), F.lit(-1))).first()[0]
    return scratch.numbered(spark, paths, order, "child").withColumn("child", F.col("child") + F.lit(top + 1))


def split_edges(children: DataFrame) -> DataFrame:
    """Distinct edges of children (child, left, parent, right).

    Where a neighbour is split too, a child joins all of the neighbour's children whose path has the
    same edge. A neighbour that is split but has no path over that edge fails.
    """
    own = children.select("child", "left", "parent", "right")
    into = own.select(F.col("child").alias("other"), F.col("parent").alias("left"), F.col("right").alias("parent"))
    onto = own.select(F.col("child").alias("other"), F.col("parent").alias("right"), F.col("left").alias("parent"))
    parents = own.select("parent").distinct()
    gone_left, gone_right = parents.select(F.col("parent").alias("left"), F.lit(True).alias("gone")), parents.select(F.col("parent").alias("right"), F.lit(True).alias("gone"))

    def end(side: str, gone: DataFrame, matches: DataFrame) -> DataFrame:
        joined = own.join(matches, [side, "parent"], "left").join(gone, side, "left")
        lost = F.raise_error(F.concat(F.lit("a split vertex keeps an edge: "), F.col(side).cast("string")))
        return joined.select("child", F.when(F.col("other").isNotNull(), F.col("other")).when(F.col("gone"), lost.cast(dict(own.dtypes)["child"])).otherwise(F.col(side)).alias("end"))

    lefts, rights = end("left", gone_left, into), end("right", gone_right, onto)
    return lefts.select(F.col("end").alias("src"), F.col("child").alias("dst")).union(rights.select(F.col("child").alias("src"), F.col("end").alias("dst"))).distinct()


def split(spark: SparkSession, graph: AssemblyGraph, paths: DataFrame, rules: Mapping[str, Rule] = RULES) -> AssemblyGraph:
    """Replace parents by one child for each of their paths (parent, path, left, right, path_depth).

    Edges carry no properties afterwards; they are estimated anew.
    """
    names = _rules_for(graph, rules)
    children = number_children(spark, graph, paths, ["parent", "path"])
    sizes = paths.groupBy("parent").agg(F.count("*").alias("paths"))
    rows = children.join(sizes, "parent").join(graph.vertices.withColumnRenamed("vid", "parent"), "parent")
    born = rows.select(F.col("child").alias("vid"), *[rules[c].on_split(c).alias(c) for c in names])
    rest = trim(graph, paths.select(F.col("parent").alias("vid")))
    edges = rest.edges.select("src", "dst").union(split_edges(children))
    return graph.with_(vertices=rest.vertices.unionByName(born), edges=edges)


def split_residuals(graph: AssemblyGraph, paths: DataFrame) -> DataFrame:
    """(vid, depth): what split parents keep of their depths; it may be negative."""
    summed = paths.select("parent", F.posexplode("path_depth").alias("i", "d")).groupBy("parent", "i").agg(F.sum("d").alias("d"))
    taken = summed.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]).alias("taken"))
    return graph.vertices.join(taken, F.col("vid") == F.col("parent")).select("vid", F.zip_with("depth", "taken", lambda a, b: a - b).alias("depth"))


def merge(spark: SparkSession, graph: AssemblyGraph, paths: DataFrame, rules: Mapping[str, Rule] = RULES) -> AssemblyGraph:
    """Replace disjoint paths (path, rank, vid) by one vertex each.

    It inherits the edges into the first and out of the last vertex; a cycle becomes a loop.
    """
    names = _rules_for(graph, rules)
    ids = number_children(spark, graph, paths.groupBy("path").agg((F.count("*") - 1).alias("last")), ["path"])
    members = paths.join(ids, "path")
    born = members.join(graph.vertices, "vid").groupBy(F.col("child").alias("vid")).agg(*[rules[c].on_merge(c).alias(f"new_{c}") for c in names])
    born = born.withColumnsRenamed({f"new_{c}": c for c in names})
    head = members.select(F.col("vid").alias("dst"), F.col("child").alias("to"), (F.col("rank") == 0).alias("first"))
    tail = members.select(F.col("vid").alias("src"), F.col("child").alias("of"), (F.col("rank") == F.col("last")).alias("final"))
    moved = graph.edges.select("src", "dst").join(tail, "src", "left").join(head, "dst", "left").where((F.col("of").isNull() | F.col("final")) & (F.col("to").isNull() | F.col("first")))
    edges = moved.select(F.coalesce("of", "src").alias("src"), F.coalesce("to", "dst").alias("dst")).distinct()
    rest = graph.vertices.join(members.select("vid"), "vid", "left_anti")
    return graph.with_(vertices=rest.unionByName(born), edges=edges)


def merge_residuals(graph: AssemblyGraph, paths: DataFrame) -> DataFrame:
    """(vid, depth): what merged members keep of their depths beyond the mean."""
    members = paths.join(graph.vertices.select("vid", "length", "depth"), "vid")
    means = members.groupBy("path").agg(_weighted_mean("depth").alias("mean"))
    return members.join(means, "path").select("vid", F.zip_with("depth", "mean", lambda a, b: a - b).alias("depth"))
