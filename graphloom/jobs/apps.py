"""The jobs that a user runs: load, trim, focus, unzip, dump, info, describe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions.sequence import reverse_complement_segments
from ..model import AssemblyGraph, validate
from ..operators import deconvolve, flow, results, rewrite, topology
from ..sources import fasta, kmer_depth, layout


def load(spark: SparkSession, records: DataFrame, k: int, dialect: str = "bcalm", depths: DataFrame | None = None, samples: tuple[str, ...] = ()) -> tuple[AssemblyGraph, DataFrame]:
    """A graph with numeric ids from linked FASTA records, and its unitigs (unitig, length, links, bases)."""
    unitigs = scratch.keep(spark, fasta.parse(records, k, dialect), "unitigs", "zstd")
    links = fasta.link_edges(unitigs)
    named = scratch.numbered(spark, fasta.oriented_vertices(unitigs, links), ["vertex"], "vid")
    if depths is not None:
        named = kmer_depth.add_depth(named, kmer_depth.depth_vectors(depths))
    ids = named.select("vertex", "vid")
    edges = links.join(ids.select(F.col("vertex").alias("src"), F.col("vid").alias("a")), "src").join(ids.select(F.col("vertex").alias("dst"), F.col("vid").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    vertices = named.select("vid", "length", F.array("vertex").alias("segments"), *(["depth"] if depths is not None else []))
    return AssemblyGraph(vertices, edges, k, samples), unitigs


def depth(unitigs: DataFrame, counts: DataFrame, k: int, samples: tuple[str, ...]) -> DataFrame:
    """(unitig, sample, depth) from counts (kmer, sample, n) that may have either strand of a k-mer, but not both."""
    return kmer_depth.mean_depth(unitigs, kmer_depth.check_strands(counts), k, samples)


def press(spark: SparkSession, graph: AssemblyGraph) -> AssemblyGraph:
    """Merge all paths without branches."""
    return rewrite.merge(spark, graph, scratch.keep(spark, topology.unitig_paths(spark, graph), "paths"))


def trim(spark: SparkSession, graph: AssemblyGraph, multiple: float = 1.0, pressed: bool = True) -> AssemblyGraph:
    """Drop tips shorter than k times ``multiple``, once; then merge paths."""
    short = topology.tips(graph, F.col("length") < graph.k * multiple)
    out = rewrite.trim(graph, scratch.keep(spark, short, "tips"))
    return press(spark, out) if pressed else out


def focus(spark: SparkSession, graph: AssemblyGraph, vertices: DataFrame | None = None, segments: DataFrame | None = None, radius: float = 0) -> AssemblyGraph:
    """The part of the graph within ``radius`` of some vertices and of those with some segments."""
    none = graph.vertices.select("vid").limit(0)
    core = (vertices.select("vid") if vertices is not None else none).union(results.with_any_segment(graph.vertices, segments) if segments is not None else none).distinct()
    if radius > 0:
        core = topology.distances(spark, graph, core, max_length=radius, adjusted=False).select("vid")
    return topology.induced(graph, core)


@dataclass(frozen=True)
class UnzipSettings:
    """Settings of the rounds; the defaults are those of the command line."""

    model: str = "Default"
    score: str = "bic"
    max_rounds: int = 100
    drop_low_depth: bool = True
    min_depth: float = 0.0
    margin: float = 10.0
    relative: float = 0.1
    absolute: float = 1.0
    completeness: float = 1.0
    excess: int = 0
    extra_large: float = 100
    skip: tuple[str, ...] = ()
    balance: bool = True
    swap: bool = True
    flow_eps: float = 1e-6
    flow_iter: int = 1000
    if_not_converged: str = "error"


def _flows(spark: SparkSession, graph: AssemblyGraph, s: UnzipSettings) -> DataFrame:
    return flow.estimate_vertices(spark, graph.edges, graph.vertices, s.flow_eps, s.flow_iter, s.if_not_converged)[0]


def _solved(spark: SparkSession, problems: DataFrame, s: UnzipSettings) -> tuple[DataFrame, DataFrame]:
    """All decisions, written out, and those that pass the gates."""
    solved = scratch.keep(spark, deconvolve.solve(spark, problems, s.model, s.score, s.balance, s.swap), "solved")
    return solved, deconvolve.gated(solved, s.margin, s.relative, s.absolute, s.completeness, s.excess)


def unzip(spark: SparkSession, graph: AssemblyGraph, settings: UnzipSettings = UnzipSettings(), folder: str | None = None) -> AssemblyGraph:
    """Split junctions whose paths are clear, merge paths, and go on until nothing changes.

    All classes of junctions of a round are solved on the same graph. Each round's graph is written to
    ``folder`` (default: a new one), and so are its problems, by round and kind, whether they are
    solved or skipped. A folder that has rounds already is gone on with from its last whole one.
    """
    folder = folder or scratch.new_path(spark, "unzip")
    start = 0
    while scratch.exists(spark, f"{folder}/checkpoint_{start}/meta/_SUCCESS"):
        start += 1
    if start:
        start -= 1
        graph = layout.load_graph(spark, f"{folder}/checkpoint_{start}")
    else:
        validate(graph, {name: rule for name, rule in rewrite.RULES.items() if name in graph.vertices.columns})
        if settings.drop_low_depth:
            graph = graph.with_(edges=flow.low_flow_edges(_flows(spark, graph, settings), settings.min_depth))
        graph = layout.checkpoint(spark, press(spark, graph), folder, 0)
    for i in range(start, settings.max_rounds):
        flows = scratch.keep(spark, flow.flow_vectors(_flows(spark, graph, settings)), "flows")
        kinds = deconvolve.junction_classes(graph, settings.extra_large)
        found = deconvolve.problems(graph, flows, deconvolve.without_unidentifiable(graph, kinds)).join(kinds.select(F.col("vid").alias("junction"), "kind"), "junction")
        found.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/problems_{i}")
        found = spark.read.schema(found.schema).parquet(f"{folder}/problems_{i}")
        wanted = found.where(~F.col("kind").isin(list(settings.skip))) if settings.skip else found
        _, accepted = _solved(spark, wanted.drop("kind"), settings)
        paths = scratch.keep(spark, deconvolve.split_paths(accepted), "split")
        if paths.isEmpty():
            break
        graph = layout.checkpoint(spark, press(spark, rewrite.split(spark, graph, paths)), folder, i + 1)
    return graph


def benchmark(spark: SparkSession, problems: DataFrame, settings: UnzipSettings = UnzipSettings(), part: tuple[int, int] | None = None) -> DataFrame:
    """How well a model fits saved problems, and whether the gates accept its decisions.

    ``part`` takes problems by their number in ascending order of junctions, the first included, the last not.
    """
    problems = problems.drop("kind") if "kind" in problems.columns else problems
    if part is not None:
        numbered = scratch.numbered(spark, problems, ["junction"], "number")
        problems = numbered.where((F.col("number") >= part[0]) & (F.col("number") < part[1])).drop("number")
    solved, accepted = _solved(spark, problems, settings)
    path = F.transform(F.arrays_zip("left", "right"), lambda p: F.concat(p["left"].cast("string"), F.lit(">"), p["right"].cast("string")))
    table = solved.join(accepted.select("junction", F.lit(True).alias("accepted")), "junction", "left").fillna(False, ["accepted"])
    return table.select(
        "junction", "converged", "loglik", "num_params", "rmse", "mae", "completeness", "excess_paths", "score_margin", deconvolve.identifiable(settings.relative, settings.absolute).alias("identifiable"),
        F.lit(settings.score).alias("score_name"), F.lit(settings.model).alias("model"), F.concat_ws(",", path).alias("paths"), "accepted",
    )


def smooth(spark: SparkSession, graph: AssemblyGraph, samples: list[str] | None = None, symmetric: bool = False, eps: float = 1e-4, **settings) -> AssemblyGraph:
    """The graph of all samples or some of them, with depths that flows explain.

    With ``symmetric``, a vertex and its twin, which has the reverse complement of its segments, both get
    their mean smoothed depth; vertices without a twin keep theirs.
    """
    names = list(samples) if samples is not None else list(graph.samples)
    if unknown := set(names) - set(graph.samples):
        raise ValueError(f"no such samples: {sorted(unknown)}")
    at = [graph.samples.index(n) for n in names]
    chosen = graph.with_(vertices=graph.vertices.withColumn("depth", F.array(*[F.element_at("depth", i + 1) for i in at])), samples=tuple(names))
    out = flow.smooth(spark, chosen, eps=eps, **settings)
    if not symmetric:
        return out
    vertices = scratch.keep(spark, out.vertices, "smooth")
    least = vertices.groupBy(F.col("segments").alias("_twin")).agg(F.min_by("depth", "vid").alias("_other"))  # of twins, the least
    near = vertices.withColumn("_twin", reverse_complement_segments(F.col("segments"))).join(least, "_twin", "left")
    mean = F.when(F.col("_other").isNull(), F.col("depth")).otherwise(F.zip_with("depth", "_other", lambda a, b: (a + b) / 2))
    return out.with_(vertices=near.withColumn("depth", mean).select(*vertices.columns))


def add_depth(spark: SparkSession, graph: AssemblyGraph, depths: DataFrame, samples: tuple[str, ...]) -> AssemblyGraph:
    """A loaded graph of single unitigs with the depths (unitig, sample, depth) of its unitigs; one that lacks them fails."""
    vectors = kmer_depth.depth_vectors(depths)
    segment = F.element_at("segments", 1)
    named = graph.vertices.withColumn("unitig", F.substr(segment, F.lit(1), F.length(segment) - 1))
    named = named.drop("depth") if "depth" in named.columns else named
    return graph.with_(vertices=kmer_depth.add_depth(named, vectors).drop("unitig"), samples=tuple(samples))


def contigs(graph: AssemblyGraph, unitigs: DataFrame, min_depth: float = 0.0, derep: bool = True) -> DataFrame:
    """(name, bases) of vertices deeper than ``min_depth``; the same path on both strands is one contig."""
    deep = graph.vertices.join(results.total_depth(graph.vertices), "vid").where(F.col("total_depth") > min_depth)
    if derep:
        named = results.dereplicate(deep).select(F.element_at("vertices", 1).alias("vid"), F.concat_ws("_", "vertices").alias("name"), F.col("canonical_segments").alias("segments"))
    else:
        named = deep.select("vid", F.col("vid").cast("string").alias("name"), "segments")
    return results.assemble(named.select("vid", "segments"), unitigs, graph.k).join(named.select("vid", "name"), "vid").select("name", "bases")


def dump(graph: AssemblyGraph, unitigs: DataFrame, folder: str) -> None:
    """Contigs as FASTA, depths and segments as tab-separated tables, the longest vertices first (then the least).

    Each is sorted by ranges, so the folder's files follow each other and no task has all vertices.
    """
    longest_first = lambda df, n: df.orderBy(F.desc(n), *[c for c in ("vid", "name") if c in df.columns])
    bases = contigs(graph, unitigs)
    ordered = longest_first(bases.withColumn("_n", F.length("bases")), "_n").drop("_n")
    fasta.to_fasta(ordered).write.mode("overwrite").text(f"{folder}/contigs.fasta")
    lengths = graph.vertices.select("vid", F.col("length").alias("_n"))
    depth = results.depth_table(graph.vertices, graph.samples).join(lengths, "vid")
    layout.write_tsv(longest_first(depth, "_n").drop("_n"), f"{folder}/depth.tsv")
    layout.write_tsv(longest_first(graph.vertices, "length").select("vid", F.concat_ws(",", "segments")), f"{folder}/segments.tsv", header=False)


def info(graph: AssemblyGraph) -> DataFrame:
    return results.summary(graph)


def describe(graphs: dict[str, AssemblyGraph]) -> DataFrame:
    """(in_degree, out_degree) by graph: how many vertices have them; 0 where none."""
    names = list(graphs)
    rows = None
    for name, g in graphs.items():
        one = topology.degrees(g).select(F.lit(name).alias("graph"), "in_degree", "out_degree")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("in_degree", "out_degree").pivot("graph", names).count().fillna(0)


def draw_attributes(vertices: DataFrame) -> DataFrame:
    """(vid, color, size) of a drawing's vertices."""
    total = F.aggregate("depth", F.lit(0.0), lambda a, x: a + x)
    return vertices.select("vid", F.log(total + 1).alias("color"), (4 * F.log(F.col("length") + 1.0)).alias("size"))
