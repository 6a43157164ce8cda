"""Topology and rewriting on random graphs against plain Python, and on small ones by hand."""

import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import derived, queries, scratch
from graphloom.jobs import apps
from graphloom.model import AssemblyGraph, validate
from graphloom.operators import results, rewrite, topology


def graph(spark, edges, lengths=None, depths=None, positions=None, vertices=None, k=3):
    ids = sorted(set(vertices or ()) | {v for e in edges for v in e})
    lengths = lengths or dict.fromkeys(ids, 1)
    rows = [(i, int(lengths[i]), [chr(97 + i % 26)], [float(x) for x in (depths[i] if depths else [1.0])], *([positions[i]] if positions else [])) for i in ids]
    schema = "vid long, length long, segments array<string>, depth array<double>" + (", position array<double>" if positions else "")
    return AssemblyGraph(spark.createDataFrame(rows, schema), spark.createDataFrame(edges, "src long, dst long"), k, ("s",) * len(rows[0][3]))


def ids(df):
    return {r["vid"] for r in df.collect()}


def paths(spark, g):
    found = {}
    for r in topology.unitig_paths(spark, g).collect():
        found.setdefault(r["path"], []).append((r["rank"], r["vid"]))
    return {tuple(v for _, v in sorted(p)) for p in found.values()}


def split(spark, g, **wanted):
    rows = [(int(p[1:]), i, a, b, [0.0] * len(g.samples)) for p, ends in wanted.items() for i, (a, b) in enumerate(ends)]
    return rewrite.split(spark, g, spark.createDataFrame(rows, "parent long, path int, left long, right long, path_depth array<double>"))


def random_edges(seed, n=40, m=45, chains=3):
    """Distinct edges: some at random, loops among them, and some long chains and rings of vertices of their own."""
    rng = random.Random(seed)
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    at = n
    for i in range(chains):
        own = list(range(at, at + rng.randint(2, 9)))
        rng.shuffle(own)
        at += len(own)
        edges |= set(zip(own, own[1:]))
        if i % 2:
            edges.add((own[-1], own[0]))
        if i == 2:
            edges.add((rng.randrange(n), own[0]))
    return sorted(edges)


def sides(edges):
    into, out = defaultdict(list), defaultdict(list)
    for a, b in edges:
        out[a].append(b)
        into[b].append(a)
    return into, out


def plain_paths(edges):
    """Walks over edges that have no sibling; a ring starts at its least vertex."""
    into, out = sides(edges)
    after = {a: b for a, b in edges if a != b and len(out[a]) == 1 and len(into[b]) == 1}
    heads = sorted(set(after) - set(after.values()))
    found, seen = set(), set()
    for start in [*heads, *sorted(after)]:
        if start in seen:
            continue
        walk = [start]
        while walk[-1] in after and after[walk[-1]] != start:
            walk.append(after[walk[-1]])
        seen |= set(walk)
        found.add(tuple(walk))
    return found


def plain_split(edges, wanted):
    """Edges after vertices became children, one for each (left, right) that is wanted."""
    children, n = [], max(v for e in edges for v in e)
    for parent in sorted(wanted):
        for left, right in wanted[parent]:
            n += 1
            children.append((n, left, parent, right))
    new = {(a, b) for a, b in edges if a not in wanted and b not in wanted}
    for child, left, parent, right in children:
        new |= {(other, child) for other, _, p, r in children if p == left and r == parent} if left in wanted else {(left, child)}
        new |= {(child, other) for other, x, p, _ in children if p == right and x == parent} if right in wanted else {(child, right)}
    return new


def edge_set(g):
    return {(r["src"], r["dst"]) for r in g.edges.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    edges = random_edges(seed)
    g = graph(spark, edges, vertices=[900 + seed])
    into, out = sides(edges)
    names = {v for e in edges for v in e} | {900 + seed}
    assert ids(topology.tips(g)) == {v for v in names if not into[v] or not out[v]}
    assert ids(topology.junctions(g)) == {v for v in names if into[v] and out[v] and len(into[v]) + len(out[v]) > 2}
    assert ids(topology.tips(g, F.col("vid") > 9)) == {v for v in names if v > 9 and (not into[v] or not out[v])}
    known = plain_paths(edges)
    assert paths(spark, g) == known
    # merging: members and edges by what a merged vertex is made of
    named = g.with_(vertices=g.vertices.withColumn("segments", F.array(F.col("vid").cast("string"))))
    pressed = apps.press(spark, named)
    made = {r["vid"]: tuple(map(int, r["segments"])) for r in pressed.vertices.collect()}
    inner = {v for p in known for v in p}
    assert set(made.values()) == known | {(v,) for v in names - inner}
    last, first = {p[-1]: p for p in known}, {p[0]: p for p in known}
    expected = {(last.get(a, (a,)), first.get(b, (b,))) for a, b in edges if (a in last or a not in inner) and (b in first or b not in inner)}
    assert {(made[a], made[b]) for a, b in edge_set(pressed)} == expected


@pytest.mark.parametrize("seed", range(4))
def test_random_splits(spark, seed):
    rng = random.Random(seed)
    edges = random_edges(seed + 50, 25, 45, 0)
    into, out = sides(edges)
    wanted = {}
    for v in sorted(into):
        if out[v] and (v, v) not in edges and rng.random() < 0.6:
            pairs = {(a, rng.choice(out[v])) for a in into[v]} | {(rng.choice(into[v]), b) for b in out[v]}
            wanted[v] = sorted(pairs)
    g = split(spark, graph(spark, edges), **{f"p{v}": p for v, p in wanted.items()})
    assert edge_set(g) == plain_split(edges, wanted)


def test_rings_are_split_open(spark):
    """A ring with an entry, one of whose vertices is split by way in, and a loop that its own children lose."""
    g = graph(spark, [(20, 21), (21, 22), (22, 20), (25, 20)])
    assert edge_set(split(spark, g, p20=[(22, 21), (25, 21)])) == {(21, 22), (22, 26), (25, 27), (26, 21), (27, 21)}
    own = split(spark, graph(spark, [(5, 5), (5, 6), (5, 7)]), p5=[(5, 5), (5, 6), (5, 7)])
    assert 5 not in {v for e in edge_set(own) for v in e}


def test_long_path_takes_few_rounds(spark):
    n = 70
    order = np.random.default_rng(0).permutation(n).tolist()
    g = graph(spark, [(order[i], order[i + 1]) for i in range(n - 1)])
    assert paths(spark, g) == {tuple(order)}


def test_a_kept_parent_fails(spark):
    with pytest.raises(Exception, match="keeps an edge"):
        split(spark, graph(spark, [(2, 3), (3, 4), (4, 9), (8, 4)]), p3=[(2, 4)], p4=[(8, 9)]).edges.collect()


def test_lengths_segments_depths_and_positions(spark):
    """A parent with three paths, then a path of three vertices, by plain arithmetic."""
    lengths, depths, places = {1: 3, 2: 7, 3: 5, 4: 2}, {i: [10.0 * i, 4.0 - i] for i in range(1, 5)}, {i: [2.0 * i, -1.0] for i in range(1, 5)}
    g = graph(spark, [(1, 2), (2, 3), (3, 4)], lengths, depths, places)
    taken = [[5.0, 0.5], [6.0, 1.0], [8.0, 0.25]]
    rows = spark.createDataFrame([(2, i, 1, 3, t) for i, t in enumerate(taken)], "parent long, path int, left long, right long, path_depth array<double>")
    assert rewrite.split_residuals(g, rows).first()["depth"] == pytest.approx([20 - 19, 2 - 1.75])
    children = {r["vid"]: r for r in rewrite.split(spark, g, rows).vertices.where("vid > 4").collect()}
    for i, t in enumerate(taken):
        r = children[5 + i]
        assert (r["length"], r["segments"], r["depth"]) == (7, ["c"], t)
        assert r["position"] == pytest.approx([4 + (i / 2 - 0.5) * 0.3, -1 + (i / 2 - 0.5) * 0.3])
    path = spark.createDataFrame([(1, i, v) for i, v in enumerate((1, 2, 3))], "path long, rank long, vid long")
    merged = rewrite.merge(spark, g, path)
    whole = {r["vid"]: r for r in merged.vertices.collect()}[5]
    weighted = lambda values: [sum(lengths[v] * values[v][s] for v in (1, 2, 3)) / 15 for s in (0, 1)]
    assert (whole["length"], whole["segments"]) == (15, ["b", "c", "d"]) and edge_set(merged) == {(5, 4)}
    assert whole["depth"] == pytest.approx(weighted(depths)) and whole["position"] == pytest.approx(weighted(places))
    left = {r["vid"]: r["depth"] for r in rewrite.merge_residuals(g, path).collect()}
    assert left[3] == pytest.approx([30 - weighted(depths)[0], 1 - weighted(depths)[1]])


class Label:
    """A rule of a user: children say which path they are, merged vertices how many members they have."""

    requires = ("length",)

    def on_split(self, name):
        return F.concat(F.col(name), F.lit("/"), F.col("path").cast("string"))

    def on_merge(self, name):
        return F.concat(F.lit("of "), F.count(name).cast("string"))


def test_a_rule_of_ones_own(spark):
    g = graph(spark, [(1, 2), (2, 3)])
    g = g.with_(vertices=g.vertices.withColumn("label", F.lit("x")))
    rules = {**rewrite.RULES, "label": Label()}
    rows = spark.createDataFrame([(2, i, 1, 3, [1.0]) for i in range(2)], "parent long, path int, left long, right long, path_depth array<double>")
    assert {r["label"] for r in rewrite.split(spark, g, rows, rules).vertices.where("vid > 3").collect()} == {"x/0", "x/1"}
    path = spark.createDataFrame([(1, i, v) for i, v in enumerate((1, 2, 3))], "path long, rank long, vid long")
    assert rewrite.merge(spark, g, path, rules).vertices.first()["label"] == "of 3"
    with pytest.raises(ValueError, match="without a rule"):
        rewrite.split(spark, g, rows)


def test_rules_are_validated(spark):
    g = graph(spark, [(0, 1)])
    validate(g, {n: rewrite.RULES[n] for n in ("length", "segments", "depth")})
    with pytest.raises(ValueError, match="without a rule"):
        validate(g, {"length": rewrite.RULES["length"]})
    with pytest.raises(ValueError, match="without a property"):
        validate(g, dict(rewrite.RULES))


def test_distances(spark):
    g = graph(spark, [(0, 1), (1, 2), (3, 2), (4, 5)], {0: 2, 1: 3, 2: 5, 3: 7, 4: 1, 5: 1})
    roots = spark.createDataFrame([(0,)], "vid long")
    assert {r["vid"]: r["distance"] for r in topology.distances(spark, g, roots).collect()} == {0: -2.0, 1: 0.0, 2: 3.0, 3: 8.0}
    assert {r["vid"]: r["distance"] for r in topology.distances(spark, g, roots, adjusted=False).collect()} == {0: 0.0, 1: 2.0, 2: 5.0, 3: 10.0}
    assert {r["vid"] for r in topology.distances(spark, g, roots, max_length=3).collect()} == {0, 1, 2}
    pairs = {(r["root"], r["vid"]): r["distance"] for r in topology.pairwise_distances(spark, g, spark.createDataFrame([(0,), (1,), (2,)], "vid long")).collect()}
    assert pairs[0, 2] == 5.0 and pairs[2, 0] == 8.0 and (0, 3) not in pairs
    assert {r["vid"] for r in apps.focus(spark, g, roots, radius=5).vertices.collect()} == {0, 1, 2}


def plain_motifs(edges, pattern, n):
    """Vertex sets on which the pattern's edges are all the edges and loops there are."""
    edges, names = set(edges), sorted({v for e in edges for v in e})
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    found = set()

    def grow(chosen):
        if len(chosen) == n:
            own = {(a, b) for a, b in edges if a in chosen and b in chosen}
            if any(own == {(order[a], order[b]) for a, b in pattern} for order in permutations(chosen)):
                found.add(frozenset(chosen))
            return
        for v in {w for c in chosen for w in near[c]} - set(chosen):
            grow([*chosen, v])

    for v in names:
        grow([v])
    return found


@pytest.mark.parametrize("pattern", [[(0, 2), (0, 3), (1, 2), (1, 3)], [(0, 1), (1, 2), (2, 0)], [(0, 1), (1, 0)], [(0, 1), (0, 2), (2, 3)]])
def test_motifs_match_plain_search(spark, pattern):
    rng = random.Random(8)
    edges = sorted({(rng.randrange(9), rng.randrange(9, 16)) for _ in range(22)} | {(rng.randrange(16), rng.randrange(16)) for _ in range(14)})
    n = 1 + max(max(e) for e in pattern)
    rows = topology.motifs(graph(spark, edges), pattern).collect()
    sets = [frozenset(r["vertices"]) for r in rows]
    assert len(sets) == len(set(sets)) and set(sets) == plain_motifs(edges, pattern, n)
    if n == 4 and len(pattern) == 4:
        assert {tuple(r["vertices"]) for r in rows} == {tuple(r) for r in topology.blackboxes(graph(spark, edges)).collect()}
    with pytest.raises(ValueError, match="connected"):
        topology.motifs(graph(spark, edges), [(0, 1), (2, 3)])


def test_loops_neighbours_and_components(spark):
    g = graph(spark, [(0, 2), (0, 3), (1, 2), (5, 4), (8, 8)])
    assert ids(topology.self_loops(g)) == {8}
    assert {tuple(r) for r in topology.biclique(spark, 2, 2).collect()} == {(0, 2), (0, 3), (1, 2), (1, 3)}
    assert {r["vid"] for r in topology.vertex_or_neighbors(g, spark.createDataFrame([(2,)], "vid long")).where("near").collect()} == {0, 1, 2}
    assert {(r["vid"], r["component"]) for r in topology.weak_components(spark, g).where("vid in (3, 5, 8)").collect()} == {(3, 0), (5, 4), (8, 8)}


def test_compared_twins_meet_in_lists(spark, monkeypatch):
    rng = random.Random(6)
    names = [["1+", "2-"], ["2+", "1-"], ["3+", "3-"], ["4+"], None]
    rows = [(i, 2, names[min(i // 100, 4)], [float(rng.randrange(3))]) for i in range(330)] + [(400, 2, names[4], [1.0])]
    v = spark.createDataFrame(rows, "vid long, length long, segments array<string>, depth array<double>")
    edges = [(rng.randrange(330), rng.randrange(330)) for _ in range(300)] + [(5, 6), (5, 6), (7, 7), (990, 8)]
    g = AssemblyGraph(v, spark.createDataFrame(edges, "src long, dst long"), 3, ("s",))
    data = results.vertex_data(g).drop("in_neighbors", "out_neighbors")
    plain = lambda df: sorted((tuple(r) for r in df.select(sorted(data.columns)).collect()), key=str)
    assert plain(results.comparable(g)) == plain(data)
    kept, keep = [], scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda *a: kept.append(keep(*a)) or kept[-1])
    got = sorted(tuple(r) for r in results.compared_twins(data).collect())
    assert got == sorted(tuple(r) for r in results.twin_differences(results.twins(v), data).collect())
    assert len(got) == 2 * 100 * 100 + 100 * 100 and kept[-1].count() <= 4 * results.LISTS and len(kept[-1].columns) == 2


def test_twins_and_positions(spark):
    v = spark.createDataFrame([(0, 4, ["1+", "2-"], [1.0]), (1, 4, ["2+", "1-"], [1.0]), (2, 4, ["1+", "2-"], [3.0])], "vid long, length long, segments array<string>, depth array<double>")
    g = AssemblyGraph(v, spark.createDataFrame([(0, 1)], "src long, dst long"), 3, ("s",))
    assert {tuple(r) for r in results.twins(v).collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}
    assert {tuple(r["vertices"]) for r in results.dereplicate(v).collect()} == {(0, 1, 2)}
    data = results.vertex_data(g)
    same = {(r["vid"], r["twin"]): r["same"] for r in results.twin_differences(results.twins(v), data).collect()}
    assert same[0, 1] and not same[1, 2]
    compared = results.compared_twins(data)
    assert {(r["vid"], r["twin"]): r["same"] for r in compared.collect()} == same
    deep = {tuple(r["vertices"]): (r["vid"], r["total_depth"]) for r in results.deduplicate(data).collect()}
    assert deep == {(0, 2): (2, 4.0), (1,): (1, 1.0)}
    lengths = spark.createDataFrame([("1+", 5), ("2-", 7), ("2+", 7), ("1-", 5)], "segment string, length long")
    at = {(r["vid"], r["segment"]): (r["left"], r["right"]) for r in results.segment_positions(v, lengths, 3).collect()}
    assert at[0, "1+"] == (0, 7) and at[0, "2-"] == (5, 14)


def test_pairs_of_twins_are_not_shuffled(spark):
    """Above the join by segments, which makes the pairs, nothing is exchanged or joined."""
    plan = queries.QUERIES["rs_08_validate_twins"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "[segments" in next(line for line in plan.splitlines() if "Join" in line)


def test_contraction_of_a_long_path(spark):
    """A path of 10^6 vertices with shuffled ids: few rounds, and the table of links shrinks in each."""
    n = 1_000_000
    name = lambda c: F.pmod(c * 611_953 + 7, F.lit(n))
    path = spark.range(n - 1).select(name(F.col("id")).alias("src"), name(F.col("id") + 1).alias("dst"))
    sizes = []
    roots = topology.contracted(spark, topology.backlinked(path).select(F.col("src").alias("a"), F.col("dst").alias("b")), sizes)
    assert roots.agg(F.countDistinct("root"), F.count("*")).first()[:] == (1, n)
    assert len(sizes) <= 25 and all(b < a for a, b in zip(sizes, sizes[1:], strict=False))


def plain_boxes(edges):
    """Induced 2x2 bicliques by looking at all fours."""
    own = set(edges)
    vertices = sorted({v for e in edges for v in e})
    out, into = defaultdict(set), set()
    for a, b in own:
        out[a].add(b)
    for i, a in enumerate(vertices):
        for b in vertices[i + 1 :]:
            both = sorted(out[a] & out[b])
            for j, c in enumerate(both):
                for d in both[j + 1 :]:
                    four = (a, b, c, d)
                    if len(set(four)) == 4 and {(x, y) for x in four for y in four if (x, y) in own} == {(a, c), (a, d), (b, c), (b, d)}:
                        into.add(four)
    return into


def test_bicliques_by_classes_of_sources(spark):
    """Random graphs with loops and back edges, classes that cross, repeated edges; against all fours."""
    rng = random.Random(8)
    for n, m in ((9, 30), (12, 40), (16, 60), (7, 40)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        edges += [(100 + i, 200 + j) for i in range(3) for j in range(3)] + [(103, 200), (103, 201), (104, 201), (104, 202), (104, 300)] + edges[:3]
        g = AssemblyGraph(None, spark.createDataFrame(edges, "src long, dst long"))
        want = plain_boxes(edges)
        assert {tuple(r) for r in topology.blackboxes(g).collect()} == want
        assert {r["vid"] for r in topology.blackbox_vertices(g).collect()} == {v for f in want for v in f}


def test_a_hub_of_many_sources(spark):
    """100,000 sources of the same three targets: their vertices come without a row for each pair."""
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(*[F.lit(n + i).cast("long") for i in range(3)])).alias("dst"))
    assert topology.blackbox_vertices(AssemblyGraph(None, edges)).count() == n + 3


def test_few_vertices_are_followed_in_one_task(spark, monkeypatch):
    """Components and paths of a small graph take one round; they are those of the rounds over the cluster."""
    ids = [f"v{i * 7 % 31:02}" for i in range(31)]
    pairs = [(ids[i], ids[i + 1]) for i in range(30) if i not in (9, 14, 22)] + [(ids[22], ids[15]), (ids[24], ids[29])]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    graph = AssemblyGraph(spark.createDataFrame([(i, 1) for i in ids], "vid string, length int"), edges)
    results = []
    for few in (topology.FEW, 0):
        monkeypatch.setattr(topology, "FEW", few)
        sizes = []
        topology.contracted(spark, topology.backlinked(edges).select(F.col("src").alias("a"), F.col("dst").alias("b")), sizes)
        parts = sorted(map(tuple, topology.weak_components(spark, graph).collect()))
        results.append((parts, sorted(map(tuple, topology.unitig_paths(spark, graph).collect())), len(sizes)))
    assert results[0][:2] == results[1][:2] and results[0][2] == 1 < results[1][2]


def test_twins_are_joined_as_lists(spark):
    """Forty copies of either strand and one palindrome: the join has a row for each two lists, not for each pair."""
    rows = [(i, ["a+", "b-"]) for i in range(40)] + [(100 + i, ["b+", "a-"]) for i in range(40)] + [(200, ["a+", "a-"]), (300, None)]
    pairs = results.twins(spark.createDataFrame(rows, "vid long, segments array<string>"))
    found = [tuple(r) for r in pairs.collect()]
    assert sorted(found) == sorted([(i, 100 + j) for i in range(40) for j in range(40)] + [(100 + j, i) for i in range(40) for j in range(40)] + [(200, 200)])
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Generate") < plan.index("Join") < plan.index("collect_list")


def test_spans_of_ranks_do_not_cut_segments(spark, monkeypatch):
    """An event's next three segments are the same, wherever spans end."""
    read = lambda: sorted(map(tuple, derived.segment_vertices(spark, "/root/testdata/sf0.001").select("vid", "segments").collect()))
    whole = read()
    for span in (3, 4):
        monkeypatch.setattr(derived, "SPAN", span)
        assert read() == whole


def test_degrees_sort_and_join_nothing(spark):
    """Ends and vertices are counted in one aggregate; a vertex without edges has 0, an end that is no vertex has no row."""
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 9)], "src long, dst long")
    found = topology.degrees(AssemblyGraph(spark.createDataFrame([(1,), (2,), (3,), (4,)], "vid long"), edges))
    assert sorted(map(tuple, found.collect())) == [(1, 0, 2), (2, 2, 1), (3, 1, 1), (4, 0, 0)]
    assert not any(x in found._jdf.queryExecution().sparkPlan().toString() for x in ("Join", "Sort"))
