"""Sequences, linked FASTA and k-mer depths."""

import random
import time
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from graphloom.functions import sequence as sq
from graphloom.jobs import apps
from graphloom.operators import results
from graphloom.sources import fasta, kmer_depth, layout


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'string'}" for n in names)).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, sq.reverse_complement(F.col("s")), s="AACGT") == "ACGTT"
    assert one(spark, sq.canonical(F.col("s")), s="TTT") == "AAA"
    assert one(spark, sq.kmers(F.col("s"), 3), s="ACGTA") == ["ACG", "CGT", "GTA"]
    assert one(spark, sq.kmers(F.col("s"), 3, circular=True), s="ACGT") == ["ACG", "CGT", "GTA", "TAC"]
    assert one(spark, sq.kmers(F.col("s"), 4), s="ACG") == []
    assert one(spark, sq.reverse_complement_segments(F.col("s")), s=["1+", "22-"]) == ["22+", "1-"]
    assert one(spark, sq.canonical_segments(F.col("s")), s=["9+", "1-"]) == ["1+", "9-"]
    with pytest.raises(Exception, match="not a base"):
        one(spark, sq.base_pair(F.col("s"), strict=True), s="ACGN")


def test_windows_and_lesser_kmers(spark):
    text = "ACGTTGCAAC" * 3 + "G"
    for size, step, at_least in ((4, 1, 4), (8, 3, 5), (40, 7, 2), (31, 31, 1), (32, 5, 32)):
        want = [text[i : i + size] for i in range(0, len(text), step) if len(text) - i >= at_least]
        assert one(spark, sq.windows(F.col("s"), size, step, at_least), s=text) == want
    turned = [min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))) for x in (text[i : i + 5] for i in range(len(text) - 4))]
    assert one(spark, sq.canonical_kmers(F.col("s"), 5), s=text) == turned
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "ACG"), (4, "ACNGT")], "id int, s string")
    assert {r["id"]: r["x"] for r in rows.select("id", sq.canonical_kmers(F.col("s"), 4).alias("x")).collect()} == {1: [], 2: [], 3: [], 4: ["ACNG", "ACNG"]}


def test_kmers_of_a_long_sequence(spark):
    """A million bases: one pass, where counting each k-mer off from the start would take hours."""
    long = spark.range(1).select(F.repeat(F.lit("ACGTT"), 200_000).alias("s"))
    found = long.select(F.explode(sq.canonical_kmers(F.col("s"), 15)).alias("kmer")).groupBy("kmer").count().collect()
    assert len(found) == 5 and sum(r["count"] for r in found) == 1_000_000 - 14


def test_dbg_edges_have_self_edges(spark):
    nodes = spark.createDataFrame([("AAA",), ("AAC",), ("ACT",), ("ACT",), ("GGG",)], "kmer string")
    assert {tuple(r) for r in sq.dbg_edges(nodes).collect()} == {("AAA", "AAA"), ("AAA", "AAC"), ("AAC", "ACT"), ("GGG", "GGG")}


def test_random_sequences_are_seeded(spark):
    a, b = (sq.random_sequences(spark, 5, 50, 3).orderBy("id").collect() for _ in range(2))
    assert a == b and all(len(r["bases"]) == 50 and set(r["bases"]) <= set("ACGT") for r in a)


#: name: bases, links as (own strand, other, other's strand)
RECORDS = {"7": (23, [("+", "12", "+"), ("-", "30", "-")]), "12": (31, [("+", "44", "-")]), "30": (28, [("+", "7", "+")]), "44": (40, []), "51": (22, [])}


@pytest.mark.parametrize("dialect", ["bcalm", "ggcat"])
def test_linked_fasta(spark, tmp_path, dialect):
    lines, want = ["", "  "], set()
    for name, (size, links) in RECORDS.items():
        said = " ".join(f"L:{a}:{other}:{b}" for a, other, b in links)
        lines += [f">{name} LN:i:{size} " + ("KC:i:9 km:f:2.0 " if dialect == "bcalm" else "") + said, "C" * size]
        want |= {(name + a, other + b) for a, other, b in links}
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, offset long, line string")
    (tmp_path / "u.fa").write_text("\n".join(lines) + "\n")
    for found in (fasta.records(df), fasta.read_records(spark, f"{tmp_path}/u.fa")):
        unitigs = fasta.parse(found, 21, dialect)
        edges = fasta.link_edges(unitigs)
        assert {tuple(r) for r in edges.collect()} == want
        ends = {v for e in want for v in e} | {"44+", "44-", "51+", "51-"}
        vertices = {r["vertex"]: r["length"] for r in fasta.oriented_vertices(unitigs, edges).collect()}
        assert vertices == {v: RECORDS[v[:-1]][0] - 20 for v in ends}
    graph, _ = apps.load(spark, fasta.records(df), 21, dialect)
    assert graph.edges.count() == len(want) and sorted(r["vid"] for r in graph.vertices.collect()) == list(range(len(ends)))


def test_fasta_files_split_anywhere(spark, tmp_path):
    """Small splits cut records; each is read once, with its own bases."""
    import random

    rng = random.Random(4)
    want = {f"r{i} x>y": "".join(rng.choices("ACGT", k=rng.randint(1, 400))) for i in range(300)}
    (tmp_path / "a.fa").write_text("\n\n" + "".join(f">{h}\r\nIGNORED\r\n{b}\r\n\r\n" if i % 9 == 0 else f">{h}\n{b}\n" for i, (h, b) in enumerate(want.items())) + ">last")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = fasta.read_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 301 and {r["header"]: r["bases"] for r in rows} == {**want, "last": None}


def test_graph_from_circular_sequences_and_both_strands(spark):
    from graphloom.operators import build

    s = spark.createDataFrame([("ACGGT",), ("TTG",)], "bases string")
    whole = [x + x[:2] for x in ("ACGGT", "TTG")]
    other = [x[::-1].translate(str.maketrans("ACGT", "TGCA")) for x in ("ACGGT", "TTG")]
    want = [w[i : i + 3] for w in [*whole, *[x + x[:2] for x in other]] for i in range(len(w) - 2)]
    got = {r["kmer"]: r["n"] for r in build.kmer_table(s, 3, circular=True, both_strands=True).collect()}
    assert got == {k: want.count(k) for k in want}
    g = build.annotated_dbg(s, 3, circular=True, both_strands=True)
    assert {(r["src"], r["dst"]) for r in g.edges.collect()} == {(a, b) for a in want for b in want if a[1:] == b[:2]}
    assert {r["vid"]: r["depth"] for r in g.vertices.collect()} == {k: [float(want.count(k))] for k in want}


def test_fasta_oddities(spark):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(["", ">a LN:i:4", "AAAA", "CCCC", "", ">b LN:i:4"])], "file string, offset long, line string")
    assert {(r["header"], r["bases"]) for r in fasta.records(df).collect()} == {("a LN:i:4", "CCCC"), ("b LN:i:4", None)}
    assert fasta.records(df.limit(0)).collect() == []
    bad = spark.createDataFrame([("a LN:i:4 KC:i:1 km:f:1 L:*:b:+", "AAAA")], "header string, bases string")
    with pytest.raises(Exception, match="malformed link"):
        fasta.link_edges(fasta.parse(bad, 3)).collect()


def test_depths_count_repeats_and_both_strands(spark):
    seqs = spark.createDataFrame([("s1", "AAACC"), ("s2", "GGTTT"), ("s2", "AAA")], "sample string, bases string")
    counts = kmer_depth.kmer_counts(seqs, 3)
    unitigs = spark.createDataFrame([("u", "AAACCG"), ("v", "TTTTT"), ("w", "AC")], "unitig string, bases string")
    got = {(r["unitig"], r["sample"]): r["depth"] for r in kmer_depth.mean_depth(unitigs, counts, 3, ("s1", "s2")).collect()}
    assert got == {("u", "s1"): 3 / 4, ("u", "s2"): 4 / 4, ("v", "s1"): 1.0, ("v", "s2"): 2.0}
    vectors = kmer_depth.depth_vectors(kmer_depth.mean_depth(unitigs, counts, 3, ("s1", "s2")))
    assert {r["unitig"]: r["depth"] for r in vectors.collect()}["v"] == [1.0, 2.0]
    with pytest.raises(Exception, match="no depth"):
        kmer_depth.add_depth(spark.createDataFrame([("w", 1)], "unitig string, vid long"), vectors).collect()


def test_both_strands_fail(spark):
    schema = "kmer string, sample string, n long"
    counts = spark.createDataFrame([("AAA", "s", 1), ("TTT", "s", 1)], schema).repartition(2)
    with pytest.raises(Exception, match="both strands"):
        kmer_depth.check_strands(counts).collect()
    apart = spark.createDataFrame([("ACC", "s", 1), ("CCC", "s", 4), ("GGT", "t", 1)], schema)  # in different samples
    with pytest.raises(Exception, match="both strands present: ACC"):
        apps.depth(spark.createDataFrame([("u", "ACCC")], "unitig string, bases string"), apart, 3, ("s", "t")).collect()
    single = spark.createDataFrame([("TTT", "s", 1), ("ACC", "s", 2), ("ACC", "t", 3), ("GGC", "t", 5), ("TTT", "s", 4)], schema)
    assert {tuple(r) for r in kmer_depth.check_strands(single).collect()} == {("AAA", "s", 5), ("ACC", "s", 2), ("ACC", "t", 3), ("GCC", "t", 5)}
    assert kmer_depth.check_strands(single.limit(0)).collect() == []


def test_files_round_trip(spark, tmp_path):
    from graphloom.model import AssemblyGraph

    v = spark.createDataFrame([(0, 3, ["1+"], [1.0]), (1, 2, ["2-", "3+"], [0.5])], "vid long, length long, segments array<string>, depth array<double>")
    graph = AssemblyGraph(v, spark.createDataFrame([(0, 1)], "src long, dst long"), 5, ("s",))
    again = layout.checkpoint(spark, graph, str(tmp_path), 3)
    assert (again.k, again.samples) == (5, ("s",)) and again.vertices.orderBy("vid").collect() == v.collect()
    unitigs = spark.createDataFrame([("1", "AAAACCC"), ("2", "ACGTAA"), ("3", "ACGTTT")], "unitig string, bases string")
    apps.dump(graph, unitigs.where("unitig <> '2'").union(spark.createDataFrame([("2", "ACGTCC")], unitigs.schema)), f"{tmp_path}/out")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/out/contigs.fasta").collect()]
    assert ">0" in lines and "AAAACCC" in lines and "GGACGTTT" in lines
    (tmp_path / "names").write_text(" 1+ \n\n2-\n")
    assert {r["name"] for r in layout.read_names(spark, f"{tmp_path}/names").collect()} == {"1+", "2-"}


def test_assembly_checks_overlaps(spark):
    v = spark.createDataFrame([(0, ["1+", "2+"])], "vid long, segments array<string>")
    u = spark.createDataFrame([("1", "AACC"), ("2", "GGTT")], "unitig string, bases string")
    with pytest.raises(Exception, match="do not overlap"):
        results.assemble(v, u, 3).collect()


def cut(bases, size, k):
    """Stretches of a sequence that overlap by k - 1 bases."""
    return [bases[i : i + size + k - 1] for i in range(0, len(bases) - k + 1, size)]


def test_assembly_of_long_paths_takes_time_in_proportion(spark):
    """A contig of 16,000 segments, of which some are read from the other strand."""
    k, rng = 7, random.Random(5)
    flip = str.maketrans("ACGT", "TGCA")
    results.assemble(spark.createDataFrame([(0, ["1+"])], "vid long, segments array<string>"), spark.createDataFrame([("1", "AACCAAC")], "unitig string, bases string"), k).collect()
    took = {}
    for n in (2000, 16_000):
        bases = "".join(rng.choices("ACGT", k=50 * n + k - 1))
        parts = cut(bases, 50, k)
        assert len(parts) == n
        strands = [rng.choice("+-") for _ in parts]
        u = spark.createDataFrame([(str(i), p if s == "+" else p.translate(flip)[::-1]) for i, (p, s) in enumerate(zip(parts, strands, strict=True))], "unitig string, bases string").repartition(4).cache()
        v = spark.createDataFrame([(9, [f"{i}{s}" for i, s in enumerate(strands)])], "vid long, segments array<string>").cache()
        u.count(), v.count()
        began = time.perf_counter()
        assert [tuple(r) for r in results.assemble(v, u, k).collect()] == [(9, bases)]
        took[n] = time.perf_counter() - began
    assert took[16_000] < 8 and took[16_000] < 16 * took[2000] + 2
    wrong = v.select("vid", F.concat(F.slice("segments", 1, 10_000), F.slice("segments", 10_002, 6000)).alias("segments"))
    with pytest.raises(Exception, match="do not overlap"):
        results.assemble(wrong, u, k).collect()
    missing = u.where("unitig <> '12000'")
    with pytest.raises(Exception, match="do not overlap"):
        results.assemble(v, missing, k).collect()


def test_cumulated_lengths(spark):
    from graphloom.model import AssemblyGraph

    rng = random.Random(1)
    rows = [(i, rng.randint(1, 30), [rng.randint(0, 9) / 2, 1.0]) for i in range(500)]
    v = spark.createDataFrame(rows, "vid long, length long, depth array<double>").repartition(7)
    got = sorted((r.asDict() for r in results.length_curve(spark, AssemblyGraph(v, None)).collect()), key=lambda r: (-r["length"], r["vid"]))
    total = 0.0
    for r, (vid, n, d) in zip(got, sorted(rows, key=lambda x: (-x[1], x[0])), strict=True):
        total += n * sum(d)
        assert r == {"vid": vid, "length": n, "weight": n * sum(d), "cumulated": pytest.approx(total)}
    assert results.length_curve(spark, AssemblyGraph(v.limit(0), None)).collect() == []


def test_assembled_bases_are_shuffled_once(spark):
    """After their join with the unitigs, parts meet by vertex in one exchange."""
    v = spark.createDataFrame([(0, ["1+", "2+"])], "vid long, segments array<string>")
    u = spark.createDataFrame([("1", "AACC"), ("2", "CCGG")], "unitig string, bases string")
    found = results.assemble(v, u, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Join")[0]
    assert above.count("Exchange") == 1 and [tuple(r) for r in found.collect()] == [(0, "AACCGG")]


def test_load_keeps_bases_in_a_third_of_a_byte(spark):
    r = random.Random(2)
    rows = [(f"{i} LN:i:514 KC:i:1 km:f:1.0", "".join(r.choices("ACGT", k=514))) for i in range(2000)]
    _, unitigs = apps.load(spark, spark.createDataFrame(rows, "header string, bases string"), 15)
    assert {x["unitig"]: x["bases"] for x in unitigs.collect()} == {h.split()[0]: b for h, b in rows}
    files = [Path(urlparse(f).path) for f in unitigs.inputFiles()]
    assert sum(f.stat().st_size for f in files) < 2000 * 514 * 0.34
