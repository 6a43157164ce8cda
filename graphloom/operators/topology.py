"""Degrees, paths, distances and motifs as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch
from ..model import AssemblyGraph


def degrees(graph: AssemblyGraph) -> DataFrame:
    """(vid, in_degree, out_degree) of every vertex; parallel edges count."""
    rows = lambda df, vid, *ones: df.select(F.col(vid).alias("vid"), *[F.lit(int(c in ones)).alias(c) for c in ("i", "o", "v")])
    ends = rows(graph.vertices, "vid", "v").union(rows(graph.edges, "src", "o")).union(rows(graph.edges, "dst", "i"))
    counted = ends.groupBy("vid").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.max("v").alias("v"))
    return counted.where("v = 1").select("vid", "in_degree", "out_degree")


def sibling_free_edges(edges: DataFrame) -> DataFrame:
    """Edges that are the only one out of their source and the only one into their target."""
    single_out = edges.groupBy("src").agg(F.count("*").alias("n")).where("n = 1").select("src")
    single_in = edges.groupBy("dst").agg(F.count("*").alias("n")).where("n = 1").select("dst")
    return edges.join(single_out, "src", "left_semi").join(single_in, "dst", "left_semi").select(*edges.columns)


def unitig_subgraph(graph: AssemblyGraph) -> AssemblyGraph:
    """Sibling-free edges and the vertices that have one."""
    edges = sibling_free_edges(graph.edges)
    ends = edges.select(F.col("src").alias("vid")).union(edges.select("dst")).distinct()
    return graph.with_(vertices=graph.vertices.join(ends, "vid", "left_semi"), edges=edges)


def drop_in_edges(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges that do not lead to one of the vertices."""
    return edges.join(targets.select(F.col("vid").alias("dst")), "dst", "left_anti").select(*edges.columns)


def tips(graph: AssemblyGraph, also: Column | None = None) -> DataFrame:
    """(vid) of vertices without edges in or without edges out."""
    found = degrees(graph).where((F.col("in_degree") == 0) | (F.col("out_degree") == 0))
    return _required(graph, found, also)


def junctions(graph: AssemblyGraph, also: Column | None = None) -> DataFrame:
    """(vid) of vertices with edges on both sides and several on one."""
    i, o = F.col("in_degree"), F.col("out_degree")
    return _required(graph, degrees(graph).where(((i > 1) & (o >= 1)) | ((i >= 1) & (o > 1))), also)


def _required(graph: AssemblyGraph, found: DataFrame, also: Column | None) -> DataFrame:
    if also is None:
        return found.select("vid")
    return found.select("vid").join(graph.vertices.where(also).select("vid"), "vid", "left_semi")


def backlinked(edges: DataFrame) -> DataFrame:
    """All edges and their reverses."""
    return edges.select("src", "dst").union(edges.select("dst", "src"))


def neighbors(graph: AssemblyGraph) -> DataFrame:
    """(vid, in_neighbors, out_neighbors), in ascending order."""
    into = graph.edges.groupBy(F.col("dst").alias("vid")).agg(F.sort_array(F.collect_list("src")).alias("in_neighbors"))
    out = graph.edges.groupBy(F.col("src").alias("vid")).agg(F.sort_array(F.collect_list("dst")).alias("out_neighbors"))
    kind = dict(graph.edges.dtypes)
    return (
        graph.vertices.select("vid").join(into, "vid", "left").join(out, "vid", "left")
        .select("vid", F.coalesce("in_neighbors", F.array().cast(f"array<{kind['src']}>")).alias("in_neighbors"), F.coalesce("out_neighbors", F.array().cast(f"array<{kind['dst']}>")).alias("out_neighbors"))
    )


#: Rows, of a few bytes each, of what is left of an iteration that one task ends instead of many rounds over the cluster.
FEW = 1 << 18


def _united(links: pd.DataFrame) -> pd.DataFrame:
    """(a, to): each end of some links and the first one of its component."""
    codes, names = pd.factorize(pd.concat([links["a"], links["b"]], ignore_index=True))
    x, y = np.split(codes, 2)
    root = np.arange(len(names))
    while True:
        new, least = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return pd.DataFrame({"a": names, "to": names[root]})
        root = new


def contracted(spark: SparkSession, links: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """(vid, root) for the ends of links (a, b), which stand in both directions: vertices with equal roots are connected.

    Random contraction: each round a vertex goes to the least of itself and its neighbours in an order that is drawn anew, and
    only links between different targets go on. In expectation a quarter of the vertices or more goes each
    round, whatever the graph, so rounds are logarithmic; the table of links shrinks with them. The last ``FEW`` links, and no
    more, are followed to their ends in one task. Targets are then followed back from the smallest table to the largest. ``sizes`` takes the links of each round.
    """
    edges = scratch.keep(spark, links.select("a", "b").where("a < b").distinct(), "links")  # one direction says it
    maps: list[DataFrame] = []
    n = edges.count()
    while n:
        if sizes is not None:
            sizes.append(n)
        if n <= FEW:
            kind = dict(edges.dtypes)["a"]
            maps.append(scratch.keep(spark, edges.groupBy().applyInPandas(_united, f"a {kind}, to {kind}"), "targets"))
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        near = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min(order("b")).alias("least"))
        to = scratch.keep(spark, near.select("a", F.least("least", order("a"))["v"].alias("to")), "targets")
        maps.append(to)
        moved = edges.join(to, "a").select(F.col("to").alias("a"), "b").join(to.select(F.col("a").alias("b"), F.col("to").alias("other")), "b")
        edges = scratch.keep(spark, moved.where("a <> other").select(F.least("a", "other").alias("a"), F.greatest("a", "other").alias("b")).distinct(), "links")
        n = edges.count()
    if not maps:
        return edges.select(F.col("a").alias("vid"), F.col("b").alias("root"))
    roots = maps.pop()
    while maps:
        after = roots.select(F.col("a").alias("to"), F.col("to").alias("root"))
        roots = scratch.keep(spark, maps.pop().join(after, "to", "left").select("a", F.coalesce("root", "to").alias("to")), "roots")
    return roots.select(F.col("a").alias("vid"), F.col("to").alias("root"))


def weak_components(spark: SparkSession, graph: AssemblyGraph) -> DataFrame:
    """(vid, component): the least vertex reachable over edges in either direction."""
    roots = contracted(spark, backlinked(graph.edges).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    least = roots.groupBy("root").agg(F.min("vid").alias("component"))
    return graph.vertices.select("vid").join(roots.join(least, "root"), "vid", "left").select("vid", F.coalesce("component", "vid").alias("component"))


def component_tables(spark: SparkSession, graph: AssemblyGraph) -> DataFrame:
    """(component, vid, in_degree, out_degree, rank): each component's vertices by degrees, then id.

    All vertices are numbered in one order by ranges, so a large component is the work of many tasks; its ranks
    count from its first number.
    """
    sub = unitig_subgraph(graph)
    table = weak_components(spark, sub).join(degrees(sub), "vid")
    placed = scratch.keep(spark, scratch.numbered(spark, table, ["component", "in_degree", "out_degree", "vid"], "number", "component-tables"), "component-ranks")
    first = placed.groupBy("component").agg(F.min("number").alias("first"))
    return placed.join(first, "component").withColumn("rank", (F.col("number") - F.col("first")).cast("int")).drop("number", "first")


def _walked(state: pd.DataFrame) -> pd.DataFrame:
    """A state of pointer doubling, doubled until all that end have ended."""
    names = state["vid"].to_numpy()
    order = np.argsort(names, kind="stable")
    place = np.empty(len(names), int)
    place[order] = np.arange(len(names))
    find = pd.Index(names).get_indexer
    at, least = find(state["at"]), place[find(state["least"])]
    hops, done, steps = state["hops"].to_numpy(copy=True), state["done"].to_numpy(copy=True), 1
    while steps < 2 * len(names) and not done.all():
        w = np.flatnonzero(~done)
        there = at[w]
        more, over, low, onward = hops[there], done[there], least[there], at[there]
        hops[w], done[w], least[w], at[w] = hops[w] + more, over, np.minimum(least[w], low), onward
        steps *= 2
    return pd.DataFrame({"vid": names, "at": names[at], "hops": hops, "done": done, "least": names[order[least]]})


def _doubled(spark: SparkSession, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling over predecessors (vid, prev); no more than ``FEW`` are followed in one task.

    Returns (vid, head, rank) of vertices that have a head, and (vid, least) of those on cycles.
    """
    rounds = scratch.Rounds(spark, "walk")
    state = rounds.keep(before.select("vid", F.coalesce("prev", "vid").alias("at"), F.col("prev").isNotNull().cast("long").alias("hops"), F.col("prev").isNull().alias("done"), F.least("vid", F.coalesce("prev", "vid")).alias("least")))
    steps, n = 1, state.count()
    if n <= FEW:
        kinds = dict(state.dtypes)
        state = rounds.keep(state.groupBy().applyInPandas(_walked, ", ".join(f"{c} {kinds[c]}" for c in state.columns)))
        steps = 2 * max(n, 1)
    while steps < 2 * max(n, 1):
        there = state.select(F.col("vid").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"), F.col("done").alias("over"), F.col("least").alias("low"))
        walking = state.where("not done").join(there, "at").select("vid", F.col("next").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), F.col("over").alias("done"), F.least("least", "low").alias("least"))
        state = rounds.keep(state.where("done").unionByName(walking))
        steps *= 2
        if state.where("not done").isEmpty():
            break
    heads = state.where("done").select("vid", F.col("at").alias("head"), F.col("hops").alias("rank"))
    return heads, state.where("not done").select("vid", "least")


def unitig_paths(spark: SparkSession, graph: AssemblyGraph) -> DataFrame:
    """(path, rank, vid): maximal paths without branches, of two vertices or more.

    ``path`` is the first vertex; a cycle starts at its least vertex. Pointer doubling takes
    a number of rounds that is logarithmic in the longest path.
    """
    links = scratch.keep(spark, sibling_free_edges(graph.edges).where("src <> dst").select("src", "dst"), "links")
    ends = links.select(F.col("src").alias("vid")).union(links.select("dst")).distinct()
    before = ends.join(links.select(F.col("dst").alias("vid"), F.col("src").alias("prev")), "vid", "left")
    placed, cycles = _doubled(spark, before)
    if not cycles.isEmpty():
        cut = cycles.where("vid = least").select(F.col("vid").alias("dst"))
        opened = links.join(cycles.select(F.col("vid").alias("src")), "src", "left_semi").join(cut, "dst", "left_anti")
        again = cycles.select("vid").join(opened.select(F.col("dst").alias("vid"), F.col("src").alias("prev")), "vid", "left")
        placed = placed.unionByName(_doubled(spark, again)[0])
    return placed.select(F.col("head").alias("path"), "rank", "vid")


def distances(spark: SparkSession, graph: AssemblyGraph, roots: DataFrame, max_length: float | None = None, adjusted: bool = True, delta: float | None = None, written: list[int] | None = None) -> DataFrame:
    """(vid, distance) to the nearest root, over edges in either direction, for vertices in reach.

    An edge is as long as the vertex it leaves. ``adjusted`` distances are less the root's length,
    so that a root is at minus its length and its neighbours at 0; others have the root at 0.

    Distances are settled by buckets of ``delta`` (default: the longest edge), the nearest first. Within a bucket only the
    front, those vertices that have just come nearer, is written each round. A settled bucket is written once. As edges lead both
    ways, a neighbour that is settled is at most the longest edge before the bucket, so steps are held against the last buckets
    alone. ``written`` takes the rows of each table.
    """
    weight = graph.vertices.select(F.col("vid").alias("src"), F.col("length").cast("double").alias("weight"))
    links = scratch.keep(spark, backlinked(graph.edges).distinct().join(weight, "src"), "links")
    own = graph.vertices.join(roots.select("vid").distinct(), "vid", "left_semi")
    start = own.select("vid", (-F.col("length").cast("double") if adjusted else F.lit(0.0)).alias("distance"))
    longest = links.agg(F.max("weight")).first()[0] or 0.0
    delta = delta or longest or 1.0
    base = scratch.new_path(spark, "distances")
    read = lambda paths: spark.read.schema(start.schema).parquet(*paths)
    nearest = lambda df: df.groupBy("vid").agg(F.min("distance").alias("distance"))

    def write(df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        if written is not None:
            written.append(read([path]).count())
        return read([path])

    def steps(front: DataFrame) -> DataFrame:
        found = links.join(front, links["src"] == front["vid"]).select(F.col("dst").alias("vid"), (F.col("distance") + F.col("weight")).alias("distance"))
        return nearest(found if max_length is None else found.where(F.col("distance") <= max_length))

    waiting = write(start, f"{base}/waiting_0")
    settled: list[tuple[str, float]] = []
    while (least := waiting.agg(F.min("distance")).first()[0]) is not None:
        n, end = len(settled), least + delta
        within = (F.col("distance") < end) | (F.col("distance") <= least)
        recent = [p for p, e in settled if e >= least - longest]
        fronts = [f"{base}/front_{n}_0"]
        front = write(waiting.where(within), fronts[0])
        while True:
            known = nearest(read(fronts + recent)).select("vid", F.col("distance").alias("known"))
            nearer = steps(front).where(within).join(known, "vid", "left").where("known is null or distance < known").select("vid", "distance")
            path = f"{base}/front_{n}_{len(fronts)}"
            front = write(nearer, path)
            if front.isEmpty():
                break
            fronts.append(path)
        settled.append((f"{base}/settled/bucket_{n}", end))
        bucket = write(nearest(read(fronts)), settled[-1][0])
        later = waiting.where(~within).unionByName(steps(bucket).where(~within))
        past = read(recent + [settled[-1][0]]).select("vid")
        waiting = write(nearest(later).join(past, "vid", "left_anti"), f"{base}/waiting_{n + 1}")
        scratch.delete(spark, f"{base}/waiting_{n}")
        for path in [*fronts, f"{base}/front_{n}_{len(fronts)}"]:
            scratch.delete(spark, path)
    scratch.delete(spark, f"{base}/waiting_{len(settled)}")
    return read([p for p, _ in settled]) if settled else start


def pairwise_distances(spark: SparkSession, graph: AssemblyGraph, chosen: DataFrame, rounds: int | None = None) -> DataFrame:
    """(root, vid, distance) within the induced subgraph of the chosen vertices, for pairs in reach."""
    sub = induced(graph, chosen)
    weight = sub.vertices.select(F.col("vid").alias("src"), F.col("length").cast("double").alias("weight"))
    links = scratch.keep(spark, backlinked(sub.edges).distinct().join(weight, "src"), "links")
    kept = scratch.Rounds(spark, "pairs")
    found = kept.keep(sub.vertices.select(F.col("vid").alias("root"), "vid", F.lit(0.0).alias("distance")))
    while rounds is None or rounds > 0:
        step = links.join(found, links["src"] == found["vid"]).select("root", F.col("dst").alias("vid"), (F.col("distance") + F.col("weight")).alias("distance"))
        both = found.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False))).groupBy("root", "vid").agg(F.min("distance").alias("distance"), F.min(F.when(F.col("old"), F.col("distance"))).alias("was"))
        both = kept.keep(both)
        found = both.drop("was")
        rounds = None if rounds is None else rounds - 1
        if both.where("was is null or distance < was").isEmpty():
            break
    return found


def vertex_or_neighbors(graph: AssemblyGraph, flagged: DataFrame) -> DataFrame:
    """(vid, near): whether a vertex or one of its neighbours is flagged."""
    near = flagged.select("vid").union(backlinked(graph.edges).join(flagged.select(F.col("vid").alias("src")), "src", "left_semi").select("dst")).distinct()
    return graph.vertices.select("vid").join(near.withColumn("near", F.lit(True)), "vid", "left").select("vid", F.coalesce("near", F.lit(False)).alias("near"))


def biclique(spark: SparkSession, n: int, m: int) -> DataFrame:
    """(src, dst) of the directed complete bipartite graph of n and m vertices; a fixed small pattern."""
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(n).cast("long"), F.lit(n + m - 1).cast("long"))).alias("dst"))


def _pattern(pattern: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """A pattern's distinct edges and its vertices."""
    wanted = list(dict.fromkeys(pattern))
    names = sorted({v for e in wanted for v in e})
    if names != list(range(len(names))) or any(a == b for a, b in wanted):
        raise ValueError("a pattern has vertices 0, 1, ... and no loops")
    return wanted, names


def motifs(graph: AssemblyGraph, pattern: list[tuple[int, int]]) -> DataFrame:
    """(vertices): induced occurrences of a small connected pattern of directed edges (no loops), once for each set of vertices.

    Entry i of ``vertices`` stands for the pattern's vertex i; of several ways to place the pattern on a set
    the least counts. Edges that no occurrence can have go first: those at a loop, those whose reverse is there but is in no
    pattern edge's place, and those whose ends have too few edges. Pattern edges are joined one after another, each to a vertex
    that is placed already, and what has a further edge that the pattern lacks is dropped.
    """
    spark = graph.edges.sparkSession
    every = scratch.keep(spark, graph.edges.select("src", "dst").distinct(), "edges")
    wanted, names = _pattern(pattern)
    one_way = not any((b, a) in wanted for a, b in wanted)
    edges = every.where("src <> dst")
    loops = every.where("src = dst")
    for end in ("src", "dst"):
        edges = edges.join(loops.select(F.col("src").alias(end)), end, "left_anti")
    if one_way:
        edges = edges.join(every.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
    outs, ins = (every.where("src <> dst").groupBy(c).agg(F.count("*").alias(f"_{c}")) for c in ("src", "dst"))
    fits = F.lit(False)
    for a, b in wanted:
        fits = fits | ((F.col("_src") >= sum(x == a for x, _ in wanted)) & (F.col("_dst") >= sum(y == b for _, y in wanted)))
    edges = scratch.keep(spark, edges.join(outs, "src").join(ins, "dst").where(fits).select("src", "dst"), "edges")
    first, left = wanted[0], wanted[1:]
    placed = edges.where("src <> dst").select(F.col("src").alias(f"v{first[0]}"), F.col("dst").alias(f"v{first[1]}"))
    done = set(first)
    while left:
        a, b = next((e for e in left if done & set(e)), (None, None))
        if a is None:
            raise ValueError("a pattern is connected")
        left.remove((a, b))
        if {a, b} <= done:
            placed = placed.join(edges.select(F.col("src").alias(f"v{a}"), F.col("dst").alias(f"v{b}")), [f"v{a}", f"v{b}"], "left_semi")
            continue
        old, new = (a, b) if a in done else (b, a)
        step = edges.select(F.col("src" if old == a else "dst").alias(f"v{old}"), F.col("dst" if old == a else "src").alias(f"v{new}"))
        placed = placed.join(step, f"v{old}")
        for v in sorted(done):
            placed = placed.where(F.col(f"v{new}") != F.col(f"v{v}"))
        done.add(new)
    found = placed.select(F.array(*[F.col(f"v{v}") for v in names]).alias("vertices"))
    once = found.groupBy(F.array_sort("vertices").alias("members")).agg(F.min("vertices").alias("vertices"))
    others = [(a, b) for a in names for b in names if a != b and (a, b) not in wanted and not (one_way and (b, a) in wanted)]
    if not others:
        return once.select("vertices")
    once = scratch.keep(spark, once.select(F.monotonically_increasing_id().alias("id"), "vertices"), "motifs")
    extra = F.explode(F.array(*[F.struct(F.element_at("vertices", a + 1).alias("src"), F.element_at("vertices", b + 1).alias("dst")) for a, b in others]))
    bad = once.select("id", extra.alias("e")).select("id", "e.src", "e.dst").join(every, ["src", "dst"], "left_semi").select("id").distinct()
    return once.join(bad, "id", "left_anti").select("vertices")


def _automorphisms(wanted: list[tuple[int, int]], n: int) -> list[list[int]]:
    """The ways to place a pattern on itself."""
    found = [[]]
    for i in range(n):
        fits = lambda p, v: v not in p and all(((j, i) in wanted) == ((p[j], v) in wanted) and ((i, j) in wanted) == ((v, p[j]) in wanted) for j in range(len(p)))
        found = [[*p, v] for p in found for v in range(n) if fits(p, v)]
    return found


def _lesser_first(wanted: list[tuple[int, int]], n: int) -> set[tuple[int, int]]:
    """Pairs of a pattern's vertices, the first to be the lesser, that leave of the ways to place it on a set the least one alone."""
    ways, out = _automorphisms(wanted, n), set()
    for i in range(n):
        out |= {(i, p[i]) for p in ways if p[i] != i}
        ways = [p for p in ways if p[i] == i]
    return out


def block_motifs(blocks: DataFrame, pattern: list[tuple[int, int]], joined: Callable[[str, str], Column]) -> DataFrame:
    """(vertices): the occurrences of ``motifs``, in a graph whose edges come in blocks.

    A block (firsts, lasts) has all edges from its firsts to its lasts, and edges with a common end are in one block. Whether an edge
    leads from one vertex to another, ``joined`` tells of two columns. So pattern edges with a common end, and those linked by
    such ones, are placed within a block, where it is; only where the pattern leaves a block rows meet by their common vertices.
    What has a further edge or a loop, and what is not the least way to place the pattern on its vertices, goes at once.
    """
    wanted, names = _pattern(pattern)
    order = _lesser_first(wanted, len(names))
    classes: list[list[tuple[int, int]]] = []
    for a, b in wanted:
        near = [c for c in classes if any(a == x or b == y for x, y in c)]
        classes = [c for c in classes if c not in near] + [[(a, b), *(e for c in near for e in c)]]

    def kept(df: DataFrame, had: list[int], v: int) -> DataFrame:
        fits = ~joined(f"v{v}", f"v{v}")
        for x in had:
            fits = fits & (F.col(f"v{x}") != F.col(f"v{v}"))
            for a, b in ((x, v), (v, x)):
                if (a, b) in order:
                    fits = fits & (F.col(f"v{a}") < F.col(f"v{b}"))
                if (a, b) not in wanted:
                    fits = fits & ~joined(f"v{a}", f"v{b}")
        return df.where(fits)

    def placed(edges: list[tuple[int, int]]) -> tuple[DataFrame, list[int]]:
        srcs, dsts = sorted({a for a, _ in edges}), sorted({b for _, b in edges})
        rows, had = blocks.select("firsts", "lasts").where((F.size("firsts") >= len(srcs)) & (F.size("lasts") >= len(dsts))), []
        for c, own in (("firsts", srcs), ("lasts", dsts)):
            for v in own:
                if v in had:
                    rows = rows.where(F.array_contains(c, F.col(f"v{v}")))
                    continue
                rows = kept(rows.withColumn(f"v{v}", F.explode(c)), had, v)
                had.append(v)
        return rows.drop("firsts", "lasts"), had

    found, done = placed(classes.pop(0))
    while classes:
        edges = next((c for c in classes if set(done) & {v for e in c for v in e}), None)
        if edges is None:
            raise ValueError("a pattern is connected")
        classes.remove(edges)
        more, own = placed(edges)
        found = found.join(more, [f"v{v}" for v in own if v in done])
        for v in own:
            if v not in done:
                found = kept(found, done, v)
                done = [*done, v]
    return found.select(F.array(*[F.col(f"v{v}") for v in names]).alias("vertices"))


def _target_classes(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(unit, ss, ts): sources with equal sets of two targets or more, and these targets, both in order; written out."""
    out = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("ts")).where(F.size("ts") > 1)
    classes = out.groupBy("ts").agg(F.array_sort(F.collect_list("src")).alias("ss"))
    return scratch.keep(spark, classes.select(F.monotonically_increasing_id().alias("unit"), "ss", "ts"), "classes")


def _boxes(spark: SparkSession, graph: AssemblyGraph) -> tuple[DataFrame, DataFrame]:
    """Classes (ss, ts) of which any two sources and any two targets are an induced biclique; and all other ones, as (a, b, c, d).

    Sources with equal targets are one class, and a class is tested as a whole: what could spoil a biclique of it is a
    source that is a target too, or an edge from a target to a source or target. Only where there is one, and
    where two classes have two targets in common, are bicliques looked at one by one.
    """
    edges = graph.edges.select("src", "dst")
    classes = _target_classes(spark, edges)
    wide = classes.where(F.size("ss") > 1)
    members = wide.select("unit", F.explode(F.array_union("ss", "ts")).alias("dst"))
    back = wide.select("unit", F.explode("ts").alias("src")).join(edges, "src").select("unit", "dst").join(members, ["unit", "dst"], "left_semi").select("unit")
    spoilt = scratch.keep(spark, back.union(wide.where(F.arrays_overlap("ss", "ts")).select("unit")).distinct(), "spoilt")
    clean = wide.join(spoilt, "unit", "left_anti").select("ss", "ts")

    def pairs(units: DataFrame, c: str, one: str, two: str) -> DataFrame:
        first = units.select("*", F.posexplode(c).alias("i", one))
        return first.withColumn(two, F.explode(F.expr(f"slice({c}, i + 2, size({c}))"))).drop("i", c)

    doubtful = pairs(pairs(wide.join(spoilt, "unit", "left_semi"), "ss", "a", "b"), "ts", "c", "d").select("a", "b", "c", "d")
    each = classes.select("unit", F.explode("ts").alias("t"))
    common = each.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t")
    each = scratch.keep(spark, each.join(common, "t", "left_semi"), "common")
    met = each.select("t", F.col("unit").alias("u")).join(each.select("t", F.col("unit").alias("v")), "t").where("u < v").groupBy("u", "v").agg(F.array_sort(F.collect_list("t")).alias("ts")).where(F.size("ts") > 1)
    side = lambda u, c: classes.select(F.col("unit").alias(u), F.col("ss").alias(c))
    crossed = met.join(side("u", "us"), "u").join(side("v", "vs"), "v").select("ts", F.explode("us").alias("x"), "vs").select("ts", "x", F.explode("vs").alias("y"))
    crossed = pairs(crossed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ts"), "ts", "c", "d").select("a", "b", "c", "d")
    boxes = scratch.keep(spark, doubtful.union(crossed), "boxes")
    extra = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b")]
    both = F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in extra])
    bad = boxes.select("a", "b", "c", "d", F.explode(both).alias("e")).select("a", "b", "c", "d", "e.src", "e.dst").join(edges, ["src", "dst"], "left_semi")
    return clean, boxes.join(bad.select("a", "b", "c", "d"), ["a", "b", "c", "d"], "left_anti")


def blackboxes(graph: AssemblyGraph) -> DataFrame:
    """(a, b, c, d): induced 2x2 bicliques, a and b before c and d, without further edges or loops among the four."""
    clean, single = _boxes(graph.edges.sparkSession, graph)
    sources = clean.select("ts", F.posexplode("ss").alias("i", "a"), "ss").select("ts", "a", F.explode(F.expr("slice(ss, i + 2, size(ss))")).alias("b"))
    targets = sources.select("a", "b", F.posexplode("ts").alias("i", "c"), "ts").select("a", "b", "c", F.explode(F.expr("slice(ts, i + 2, size(ts))")).alias("d"))
    return targets.union(single)


def blackbox_vertices(graph: AssemblyGraph) -> DataFrame:
    """(vid) of the vertices of induced 2x2 bicliques; a class's vertices are taken as they are, not by pairs."""
    clean, single = _boxes(graph.edges.sparkSession, graph)
    return clean.select(F.explode(F.concat("ss", "ts")).alias("vid")).union(single.select(F.explode(F.array("a", "b", "c", "d")))).distinct()


def self_loops(graph: AssemblyGraph) -> DataFrame:
    return graph.edges.where("src = dst").select(F.col("src").alias("vid")).distinct()


def induced(graph: AssemblyGraph, chosen: DataFrame) -> AssemblyGraph:
    """The graph of some vertices and the edges between them."""
    ids = chosen.select("vid").distinct()
    edges = graph.edges.join(ids.select(F.col("vid").alias("src")), "src", "left_semi").join(ids.select(F.col("vid").alias("dst")), "dst", "left_semi")
    return graph.with_(vertices=graph.vertices.join(ids, "vid", "left_semi"), edges=edges.select(*graph.edges.columns))
