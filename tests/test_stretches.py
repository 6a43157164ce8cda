"""K-mers by stretches against plain counts, and the packed de Bruijn graph."""

import random
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import scratch
from graphloom.operators import build, dbg, deconvolve, topology
from graphloom.sources import stretches

OTHER = str.maketrans("ACGT", "TGCA")


def plain_kmers(bases, k, both):
    found = (bases[i : i + k] for i in range(len(bases or "") - k + 1))
    return [min(x, x[::-1].translate(OTHER)) if both else x for x in found if set(x) <= set("ACGT")]


def some_sequences(seed, letters="ACGTN"):
    r = random.Random(seed)
    rows = [(r.choice("ab"), "".join(r.choices(letters, [30, 30, 30, 30, 1][: len(letters)], k=r.randrange(300)))) for _ in range(40)]
    return rows + [("a", None), ("b", ""), ("a", "A" * 700), ("b", "ACGT" * 150), ("b", rows[0][1])]


@pytest.mark.parametrize("k", [1, 4, 15, 31])
@pytest.mark.parametrize("both", [True, False])
def test_counts(spark, monkeypatch, k, both):
    monkeypatch.setattr(stretches, "PIECE", 100)  # longer sequences go in pieces
    rows = some_sequences(k)
    want = Counter((x, s) for s, bases in rows for x in plain_kmers(bases, k, both))
    df = spark.createDataFrame(rows, "sample string, bases string")
    got = stretches.spelled(stretches.counts(df, k, both=both), k, "kmer").collect()
    assert len(got) == len(want) and {(r["kmer"], r["sample"]): r["n"] for r in got} == want


def test_depths_shuffle_fewer_rows_than_kmers(spark):
    k, r = 15, random.Random(5)
    seqs = [("xyz"[i % 3], "".join(r.choices("ACGT", k=2000))) for i in range(9)]
    units = [(f"{i}-{j}", b[j : j + 114]) for i, (_, b) in enumerate(seqs) for j in range(0, 1900, 100)] + [("new", "".join(r.choices("ACGT", k=60))), ("short", "ACGT")]
    counts = Counter((s, x) for s, b in seqs for x in plain_kmers(b, k, True))
    want = {(u, s): sum(counts[s, x] for x in plain_kmers(b, k, True)) / (len(b) - k + 1) for u, b in units if len(b) >= k for s in "xy"}
    df = spark.createDataFrame(seqs, "sample string, bases string")
    out = stretches.depths(spark.createDataFrame(units, "unitig string, bases string"), df, k, ["x", "y"])
    assert {(x["unitig"], x["sample"]): x["depth"] for x in out.collect()} == want
    shuffled = stretches.stretches(df.select(F.lit(-1).cast("long").alias("who"), "bases"), k, True).count()
    assert shuffled < 9 * (2000 - k + 1) / 3


def test_strands_of_packed_counts(spark):
    k = 5
    df = spark.createDataFrame(some_sequences(1), "sample string, bases string")
    counts = stretches.counts(df, k)
    turned = stretches.with_other_strand(counts, k, "kmer", "other").select(F.col("other").alias("kmer"), "sample", "n")
    assert Counter(map(tuple, stretches.check_strands(turned, k, 3).collect())) == Counter(map(tuple, counts.collect()))
    with pytest.raises(Exception, match="both strands present"):
        stretches.check_strands(counts.union(turned), k, 3).collect()


@pytest.mark.parametrize("k", [3, 4, 6])
def test_packed_graph_is_the_graph_of_texts(spark, monkeypatch, k):
    monkeypatch.setattr(stretches, "PIECE", 100)
    rows = [x for x in some_sequences(k, "ACGT") if x[1]][: 6 * k] + [("a", "ACGTACGT"[:k]), ("a", "A" * 50), ("a", "AC" * 20)]
    if k == 6:
        rows = [(s, b[:90]) for s, b in rows]
    df = spark.createDataFrame(rows, "sample string, bases string")
    text, packed = build.annotated_dbg(df, k), dbg.overlaps(df, k)
    got = lambda x, *c: sorted(map(tuple, stretches.spelled(x, k, *c).collect()))
    want = lambda x: sorted(map(tuple, x.collect()))
    assert got(packed.edges(), "src", "dst") == want(text.edges)
    v = packed.graph().vertices.select("vid", F.element_at("depth", 1))
    assert got(v, "vid") == want(text.vertices.select("vid", F.element_at("depth", 1)))
    assert got(packed.boxes(), *"abcd") == want(topology.blackboxes(text))
    assert got(packed.box_vertices(), "vid") == want(topology.blackbox_vertices(text))
    assert got(packed.self_loops(), "vid") == want(topology.self_loops(text))
    assert got(packed.identifiable_junctions(), "vid") == want(deconvolve.without_unidentifiable(text, topology.junctions(text)))


@pytest.mark.parametrize("k", [1, 2, 15, 30, 31])
@pytest.mark.parametrize("around", [True, False])
def test_stretches_come_back_from_bytes(k, around):
    rng = np.random.default_rng(k)
    codes = rng.choice(5, 5000, p=[0.24, 0.24, 0.24, 0.24, 0.04] if k < 15 else [0.25, 0.25, 0.249, 0.249, 0.002]).astype(np.uint8)
    _, hashes, heads, tails = stretches.cut(codes, k, True)
    who = np.sort(rng.choice([-3, -1, 5, 300, 1 << 40], len(heads)))
    batch = stretches._parts(hashes, who, heads, tails, k, 7, around)
    assert batch.column(0).to_pylist() == sorted(set(batch.column(0).to_pylist())) and len(heads) > 100
    got = [x for row in batch.to_pylist() for x in zip(*stretches.unpacked(row["first"], row["part"], k, around), strict=True)]
    bare = tails if around else tails & ~(63 << 5)
    assert Counter(got) == Counter(zip(who, heads, bare, strict=True))


def test_numbers_come_back_from_bytes():
    rng = np.random.default_rng(1)
    for want in ([], [0], [127, 128, 1 << 62], rng.integers(0, 1 << 20, 1000), [5] * 9):
        want = np.array(want, np.int64)
        assert stretches.numbers(stretches.varints(want)).tolist() == want.tolist()


def test_depths_shuffle_two_bytes_a_base_at_most(spark):
    r = random.Random(7)
    units = [(i, "".join(r.choices("ACGT", k=114))) for i in range(5000)]
    rows = stretches.stretches(spark.createDataFrame(units, "who long, bases string").coalesce(1), 15, True, 20)
    assert rows.count() <= 20 and rows.agg(F.sum(F.length("part"))).first()[0] < 2 * 5000 * 114


def test_sums_meet_by_groups_of_unitigs(spark, monkeypatch):
    monkeypatch.setattr(stretches, "GROUP", 8)
    test_depths_shuffle_fewer_rows_than_kmers(spark)


@pytest.mark.parametrize("pattern", [[(0, 2), (0, 3), (1, 2), (1, 3)], [(0, 1), (1, 2), (2, 0)], [(0, 1), (1, 0)], [(0, 1), (0, 2), (2, 3)], [(1, 0), (2, 0), (3, 0)], [(0, 1), (0, 2), (1, 2)], [(0, 1), (1, 2)]])
def test_motifs_in_blocks_are_those_of_the_edges(spark, pattern):
    k = 4
    df = spark.createDataFrame([x for x in some_sequences(2, "ACGT") if x[1]][:2] + [("a", "A" * 9), ("a", "AC" * 9), ("a", "ACG" * 9)], "sample string, bases string")
    packed = dbg.overlaps(df, k)
    got = topology.block_motifs(packed.sides(), pattern, packed.joined)
    rows = sorted(tuple(r["vertices"]) for r in got.collect())
    assert rows == sorted(tuple(r["vertices"]) for r in topology.motifs(packed.graph(), pattern).collect())
    assert rows or pattern == [(0, 1), (0, 2), (1, 2)]
    if len(pattern) == 4:  # within a block: nothing is joined or shuffled
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    with pytest.raises(ValueError, match="connected"):
        topology.block_motifs(packed.sides(), [(0, 1), (2, 3)], packed.joined)


def test_depths_keep_bases_in_a_third_of_a_byte(spark, monkeypatch):
    r = random.Random(3)
    units = [(i, "".join(r.choices("ACGT", k=514))) for i in range(2000)]
    kept, keep = [], scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda *a: kept.append(keep(*a)) or kept[-1])
    df = spark.createDataFrame(units, "unitig long, bases string")
    stretches.depths(df, df.select(F.lit("x").alias("sample"), "bases"), 15, ["x"])
    assert sum(Path(urlparse(f).path).stat().st_size for f in kept[0].inputFiles()) < 2000 * 514 * 0.34
