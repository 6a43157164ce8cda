"""The k-mer store, average linkage, mini-batch preclusters and bucketed distances against plain versions."""

import heapq
import random
import uuid
from collections import Counter

import numpy as np
import pytest

from graphloom import scratch
from graphloom.model import AssemblyGraph
from graphloom.operators import cluster, linkage, topology
from graphloom.sources import kmer_store

OTHER = str.maketrans("ACGT", "TGCA")


def lesser_kmers(bases, k):
    found = (bases[i : i + k] for i in range(len(bases or "") - k + 1))
    return [min(x, x[::-1].translate(OTHER)) for x in found if set(x) <= set("ACGT")]


def number(kmer):
    return int(kmer.translate(str.maketrans("ACGT", "0123")), 4)


def new_store(spark, sequences, k, write=kmer_store.write_store, **more):
    table = f"store_{uuid.uuid4().hex}"
    return write(sequences, k, table, buckets=4, path=scratch.new_path(spark, table), **more)


@pytest.mark.parametrize("k", [1, 4, 15, 31])
def test_packed_kmers(spark, monkeypatch, k):
    monkeypatch.setattr(kmer_store, "PIECE", 100)  # sequences go in pieces, and batches in several tables
    r = random.Random(k)
    rows = [(r.choice(["a", "b", None]), "".join(r.choices("ACGTN", [30, 30, 30, 30, 1], k=r.randrange(400)))) for _ in range(60)]
    rows += [("a", None), ("a", ""), ("b", "ACGTé" * 20), ("c", "A" * 3000), ("c", "acgt" * 30)]
    want = Counter((s, number(x)) for s, bases in rows for x in lesser_kmers(bases, k))
    df = spark.createDataFrame(rows, "sample string, bases string")
    got = Counter()
    for row in kmer_store.packed_kmers(df, k, "sample").collect():
        got[row["key"], row["kmer"]] += row["n"]
    assert got == want
    assert kmer_store.packed_kmers(df.limit(0), k, "sample").collect() == []


def test_packed_kmers_of_a_bad_k(spark):
    for k in (0, 32):
        with pytest.raises(ValueError, match="from 1 to 31"):
            kmer_store.packed_kmers(spark.createDataFrame([("a", "A")], "sample string, bases string"), k, "sample")


def test_store_gives_mean_depths_without_a_shuffle_of_its_counts(spark):
    k, r = 5, random.Random(3)
    seqs = [(r.choice("xy"), "".join(r.choices("ACGT", k=200))) for _ in range(20)]
    units = [(str(i), "".join(r.choices("ACGT", k=r.randrange(3, 60)))) for i in range(30)] + [("poly", "A" * 50), ("none", None)]
    store = new_store(spark, spark.createDataFrame(seqs, "sample string, bases string"), k)
    assert kmer_store.open_store(spark, store.table) == store
    counts = Counter((s, x) for s, b in seqs for x in lesser_kmers(b, k))
    want = {(u, s): sum(counts[s, x] for x in lesser_kmers(b, k)) / (len(b) - k + 1) for u, b in units if b and len(b) >= k for s in "xyz"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = kmer_store.depths(spark, store, spark.createDataFrame(units, "unitig string, bases string"), ["x", "y", "z"])
        assert {(row["unitig"], row["sample"]): row["depth"] for row in out.collect()} == pytest.approx(want)
        whole = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the lines from the join's second side down to the store's scan: what the counts go through
    lines = whole.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = [line.index("+-") if "+-" in line else 0 for line in lines]
    side, at = [lines[scan]], scan
    for i in range(scan - 1, -1, -1):
        if depth[i] < depth[at]:
            if "SortMergeJoin" in lines[i]:
                break
            side.append(lines[i])
            at = i
    assert not any("Exchange" in line for line in side) and any("Filter" in line for line in side), whole
    with pytest.raises(Exception, match="(?i)already exists"):
        kmer_store.write_store(spark.createDataFrame(seqs, "sample string, bases string"), k, store.table)


def test_parts_of_a_store_meet_unitigs_as_rows(spark, monkeypatch):
    k, r = 7, random.Random(4)
    monkeypatch.setattr(kmer_store, "PART", 300)  # many parts, and several turns a part
    monkeypatch.setattr(kmer_store, "MEET", 500)
    monkeypatch.setattr(kmer_store, "WIDE", 1)
    seqs = [(r.choice(["x", "y", None]), "".join(r.choices("ACGT", k=200))) for _ in range(20)]
    store = new_store(spark, spark.createDataFrame(seqs, "sample string, bases string"), k)
    counts = Counter((s, x) for s, b in seqs for x in lesser_kmers(b, k))
    assert {(row["sample"], row["kmer"]): row["n"] for row in store.counts(spark).collect()} == {(s, number(x)): n for (s, x), n in counts.items()}
    assert store.parts == 14 and spark.table(store.table).count() <= 3 * store.parts < len(counts) / 9
    units = [(str(i), b[i : i + 60]) for i, (_, b) in enumerate(seqs)] + [("0", seqs[0][1][:30]), ("none", None)]
    want = {}
    for s in "yx":
        for u in {u for u, b in units if b}:
            own = [x for v, b in units if u == v for x in lesser_kmers(b, k)]
            want[u, s] = sum(counts[s, x] for x in own) / len(own)
    out = kmer_store.depths(spark, store, spark.createDataFrame(units, "unitig string, bases string"), ["y", "x"])
    assert {(row["unitig"], row["sample"]): row["depth"] for row in out.collect()} == pytest.approx(want)
    empty = new_store(spark, spark.createDataFrame([], "sample string, bases string"), k)
    none = kmer_store.depths(spark, empty, spark.createDataFrame(units, "unitig string, bases string"), ["y"])
    assert empty.counts(spark).count() == 0 and {(row["unitig"], row["depth"]) for row in none.collect()} == {(u, 0.0) for u, b in units if b}
    rows = [("".join(x), "x", 2) for x in {min(x, x[::-1].translate(OTHER)) for x in ("".join(r.choices("ACGT", k=k)) for _ in range(500))}]
    taken = new_store(spark, spark.createDataFrame(rows, "kmer string, sample string, n long"), k, kmer_store.import_store)
    alike = new_store(spark, spark.createDataFrame([("x", x) for x, _, _ in rows] * 2, "sample string, bases string"), k)
    assert sorted(map(tuple, taken.counts(spark).collect())) == sorted(map(tuple, alike.counts(spark).collect())) and taken.parts > 1


def test_import_of_counts(spark):
    rows = [("ACGTT", "x", 2), ("TTTTT", "x", 3), ("TTTTT", "y", 4), ("ACGTT", "x", 1)]
    store = new_store(spark, spark.createDataFrame(rows, "kmer string, sample string, n long"), 5, kmer_store.import_store)
    assert {tuple(r) for r in store.counts(spark).select("kmer", "sample", "n").collect()} == {(number("AACGT"), "x", 3), (0, "x", 3), (0, "y", 4)}
    for bad, message in (([("ACGTT", "x", 1), ("AACGT", "y", 1)], "both strands"), ([("ACG", "x", 1)], "not of 5 bases"), ([("ACNTT", "x", 1)], "not of 5 bases")):
        with pytest.raises(Exception, match=message):
            new_store(spark, spark.createDataFrame(bad, "kmer string, sample string, n long"), 5, kmer_store.import_store)


def plain_linkage(p, threshold):
    """Average linkage, the nearest two groups at a time."""
    u = p / np.linalg.norm(p, axis=1)[:, None]
    d = 1 - u @ u.T
    groups = {i: [i] for i in range(len(p))}
    means = {(i, j): d[i, j] for i in groups for j in groups if i < j}
    while means:
        (i, j), low = min(means.items(), key=lambda x: (x[1], x[0]))
        if low >= threshold:
            break
        a, b = len(groups[i]), len(groups[j])
        groups[i] += groups.pop(j)
        for x in groups:
            if x != i:
                near, far = tuple(sorted((x, i))), tuple(sorted((x, j)))
                means[near] = (a * means[near] + b * means[far]) / (a + b)
        means = {pair: v for pair, v in means.items() if j not in pair}
    return {m: min(g) for g in groups.values() for m in g}


@pytest.mark.parametrize("threshold", [0.3, 2.1])
def test_average_linkage(spark, monkeypatch, threshold):
    monkeypatch.setattr(linkage, "TILE", 64)  # several tiles, the last ones smaller
    rng = np.random.default_rng(4)
    p = rng.gamma(0.5, 1, (300, 6))
    df = spark.createDataFrame([(100 + i, x.tolist()) for i, x in enumerate(p)], "cluster long, p array<double>")
    sizes = []
    got = {r["cluster"] - 100: r["merged"] - 100 for r in linkage.average_linkage(spark, df, threshold, sizes).collect()}
    assert got == plain_linkage(p, threshold)
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and len(sizes) < 40


def test_linkage_of_few_odd_and_equal_profiles(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 1.0]), (6, [2.0, 2.0]), (7, [1.0, 1.0]), (8, [3.0, 0.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "cluster long, p array<double>")
    got = {r["cluster"]: r["merged"] for r in linkage.average_linkage(spark, df, 0.05).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9}
    assert linkage.average_linkage(spark, df.limit(0), 0.05).count() == 0
    assert linkage.average_linkage(spark, df.where("cluster = 5"), 0.05).collect() == [(5, 5)]
    assert {r["merged"] for r in linkage.average_linkage(spark, df.where("cluster > 4 and cluster < 9"), 5.0).collect()} == {5}


def test_mini_batches_come_close_to_full_means(spark):
    rng = np.random.default_rng(5)
    centre = rng.gamma(0.3, 1, (8, 12)) + 0.01
    x = centre[rng.integers(0, 8, 6000)] * rng.gamma(20, 1 / 20, (6000, 12)) * rng.uniform(0.1, 10, (6000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [0.0] * 12), (9001, None), (9002, [None] * 12)]
    v = spark.createDataFrame(rows, "vid long, depth array<double>").cache()
    u = x / np.linalg.norm(x, axis=1)[:, None]

    def loss(rows):
        label = np.array([c for _, c in sorted(rows)])
        return sum(((u[label == c] - u[label == c].mean(0)) ** 2).sum() for c in set(label.tolist()))

    found, centres = cluster.precluster_batches(spark, v, 8, batch_rows=700)
    got = found.collect()
    assert len(got) == 6000 and centres.shape == (8, 12)
    assert all(np.isclose(r["loss"], ((u[r["vid"]] - centres) ** 2).sum(1).min()) for r in got)
    full = [(r["vid"], r["cluster"]) for r in cluster.precluster(v, 8).collect()]
    assert loss([(r["vid"], r["cluster"]) for r in got]) <= 1.05 * loss(full)
    assert np.array_equal(centres, cluster.precluster_batches(spark, v.repartition(3), 8, batch_rows=700)[1]) or np.allclose(centres, cluster.precluster_batches(spark, v, 8, batch_rows=700)[1])
    few = cluster.precluster_batches(spark, v.where("vid < 3"), 8)
    assert sorted(r["loss"] for r in few[0].collect()) == pytest.approx([0, 0, 0]) and len(few[1]) == 3
    assert cluster.precluster_batches(spark, v.limit(0), 8)[0].count() == 0


def nearest_roots(n, edges, lengths, roots, adjusted):
    to = [set() for _ in range(n)]
    for a, b in edges:
        to[a].add(b), to[b].add(a)
    best, heap = {}, [(-float(lengths[r]) if adjusted else 0.0, r) for r in set(roots)]
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if v not in best:
            best[v] = d
            for w in to[v]:
                heapq.heappush(heap, (d + lengths[v], w))
    return best


def length_graph(spark, n, edges, lengths):
    v = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "vid long, length long")
    return AssemblyGraph(v, spark.createDataFrame([(int(a), int(b)) for a, b in edges], "src long, dst long"), 5, ())


@pytest.mark.parametrize("shape", ["random", "ring", "star"])
def test_bucketed_distances(spark, shape):
    r = random.Random(7)
    n = {"random": 120, "ring": 24, "star": 400}[shape]
    edges = {"random": [(r.randrange(n), r.randrange(n)) for _ in range(150)], "ring": [(i, (i + 1) % n) for i in range(n)], "star": [(0, i) for i in range(1, n)]}[shape]
    lengths = [r.choice([1, 2, 3, 50] if shape == "random" else [4, 9, 10]) for _ in range(n)]
    roots = [3, 3, 17]
    g = length_graph(spark, n, edges, lengths)
    rows = spark.createDataFrame([(x,) for x in roots], "vid long")
    for adjusted, delta in ((True, None), (False, 20.0)):
        written = []
        got = {x["vid"]: x["distance"] for x in topology.distances(spark, g, rows, adjusted=adjusted, delta=delta, written=written).collect()}
        assert got == nearest_roots(n, edges, lengths, roots, adjusted)
        assert sum(written) < 6 * len(got)
    near = topology.distances(spark, g, rows, max_length=30).collect()
    assert {x["vid"]: x["distance"] for x in near} == {v: x for v, x in nearest_roots(n, edges, lengths, roots, True).items() if x <= 30}
    assert topology.distances(spark, g, rows.limit(0)).count() == 0
