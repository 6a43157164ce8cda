"""Flows, depth models, junctions and clusters against known numbers."""

import math

import numpy as np
import pandas as pd
import pytest

from graphloom.jobs import apps
from graphloom.model import AssemblyGraph
from graphloom.operators import cluster, deconvolve, flow
from graphloom.operators.models import MODELS


def parts(spark, edges, depths, lengths=None):
    ids = range(len(depths))
    v = spark.createDataFrame([(i, (lengths or [1] * len(depths))[i], [float(depths[i])]) for i in ids], "vid long, length long, depth array<double>")
    return v, spark.createDataFrame(edges, "src long, dst long")


def flows(spark, edges, depths, **settings):
    v, e = parts(spark, edges, depths)
    out, losses = flow.estimate(spark, e, v.select("vid", "length"), flow.long_depths(v), **settings)
    return {(r["src"], r["dst"]): r["flow"] for r in out.collect()}, losses


RING = [(0, 1), (1, 2), (2, 3), (3, 0)]


def test_flow_on_a_ring(spark):
    got, losses = flows(spark, RING, [2, 1, 1, 1], max_iter=20)
    assert [got[e] for e in RING] == pytest.approx([1.5, 1, 1, 1.5])
    assert losses[0][-1] < 1e-6


def test_flow_with_a_minor_branch(spark):
    got, _ = flows(spark, [*RING, (0, 4)], [1, 1, 1, 1, 0.01], max_iter=15, eps=1e-3, if_not_converged="ignore")
    assert got[0, 1] < 1 and got[0, 4] < 0.011  # below 0.01 in the limit, see the next test but one


def test_flow_says_when_it_does_not_converge(spark):
    edges, depths = [(0, 2), (1, 2), (2, 3), (2, 4)], [10, 1, 5, 2, 1]
    with pytest.warns(UserWarning, match="did not converge"):
        flows(spark, edges, depths, max_iter=2, eps=1e-10)
    with pytest.raises(RuntimeError, match="did not converge"):
        flows(spark, edges, depths, max_iter=1, eps=1e-10, if_not_converged="error")


def plain_flow(edges, d, lengths, rounds, start=1.0):
    """The corrections in numpy: so many rounds with equal shares, so many by lengths."""
    src, dst = np.array(edges).T
    d, size, f, n = np.asarray(d, float), np.asarray(lengths, float), np.full(len(edges), start), len(d)
    for alpha in (0, 1):
        share = size[src] ** alpha / (size[src] ** alpha + size[dst] ** alpha)
        for _ in range(rounds):
            out, into = np.bincount(src, f, n)[src], np.bincount(dst, f, n)[dst]
            f = np.maximum(0, f + (d[src] - out) * f / out * share + (d[dst] - into) * f / into * (1 - share))
    return dict(zip(edges, f.tolist(), strict=True))


def test_flows_match_numpy(spark):
    """Three samples that stop after different numbers of rounds, and a number of rounds that is given."""
    rng = np.random.default_rng(3)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2)) if a != b})
    d, lengths = rng.uniform(1, 50, (12, 2)), rng.integers(1, 9, 12)
    rows = [(i, int(lengths[i]), [*d[i].tolist(), 0.0]) for i in range(12)]
    v = spark.createDataFrame(rows, "vid long, length long, depth array<double>")
    e = spark.createDataFrame(edges, "src long, dst long")
    for rounds in (2, 10):
        out, losses = flow.estimate(spark, e, v.select("vid", "length"), flow.long_depths(v), eps=0.0, max_iter=rounds, if_not_converged="ignore")
        got = {(r["src"], r["dst"], r["sample"]): r["flow"] for r in out.collect()}
        assert len(got) == 3 * len(edges) and len(losses[0]) == 2 * rounds
        for s in (0, 1):
            want = plain_flow(edges, d[:, s], lengths, rounds)
            assert [got[*k, s] for k in edges] == pytest.approx([want[k] for k in edges], rel=1e-6)
    out, losses = flow.estimate(spark, e, v.select("vid", "length"), flow.long_depths(v), eps=0.03, max_iter=60)
    assert all(x[-1] < 0.03 for x in losses.values()) and out.count() == 3 * len(edges)


def test_flow_formula_reaches_its_limit():
    """The same corrections in numpy tend to known flows."""


    def limit(edges, d, rounds):
        src, dst = np.array(edges).T
        f = np.ones(len(edges))
        for _ in range(rounds):
            out, into = np.bincount(src, f, 5)[src], np.bincount(dst, f, 5)[dst]
            f = np.maximum(0, f + (d[src] - out) * f / out / 2 + (d[dst] - into) * f / into / 2)
        return f

    assert limit([(0, 2), (1, 2), (2, 3), (2, 4)], np.array([10.0, 1, 5, 2, 1]), 60) == pytest.approx([7.2727, 0.7273, 2.6667, 1.3333], abs=1e-4)
    branch = limit([*RING, (0, 4)], np.array([1, 1, 1, 1, 0.01]), 2000)
    assert branch[0] < 1 and branch[4] < 0.01


def test_all_zero_depths(spark):
    got, losses = flows(spark, [(0, 1)], [0, 0], max_iter=5, if_not_converged="ignore")
    assert got[0, 1] == 0 and len(losses[0]) >= 1


def test_depth_from_flow_and_smoothing(spark):
    v, e = parts(spark, [(0, 1), (1, 2)], [4, 1, 4], [1, 1, 1])
    graph = AssemblyGraph(v, e, 3, ("s",))
    f = spark.createDataFrame([(0, 1, 0, 2.0), (1, 2, 0, 3.0)], "src long, dst long, sample int, flow double")
    depth = {r["vid"]: r["depth"] for r in flow.depth_from_flow(v, f, flow.pseudoflow(v)).collect()}
    assert depth == {0: 2.0, 1: 2.5, 2: 2.5}
    assert {r["vid"]: r["residual"] for r in flow.mean_residual(v, f).collect()} == {0: 3.0, 1: -1.5, 2: 2.5}
    smooth = flow.smooth(spark, graph, max_iter=1, flow_iter=3, if_not_converged="ignore").vertices
    assert smooth.count() == 3 and {r["src"] for r in flow.low_flow_edges(f, 2.5).collect()} == {1}


def test_candidates():
    for n in range(1, 5):
        for m in range(1, 5):
            found = list(deconvolve.minimal_pathsets(n, m))
            assert found == [deconvolve.nth_pathset(i, n, m) for i in range(len(found))]
            a, b = max(n, m), min(n, m)
            assert len(found) == math.factorial(b) * b ** (a - b)
            counts = {}
            for p in found:
                assert {i for i, _ in p} == set(range(n)) and {j for _, j in p} == set(range(m))
                for path in p:
                    counts[path] = counts.get(path, 0) + 1
            assert len(set(counts.values())) == 1
    assert deconvolve.best_of({((0, 0),): 1.0, ((0, 1),): 1.0}) == (((0, 0),), 1.0, 0.0)
    assert deconvolve.best_of({((0, 0),): -math.inf})[2] == -math.inf
    with pytest.raises(ValueError, match="no such path"):
        deconvolve.design(((2, 0),), 2, 1)
    p = deconvolve.random_pathset(3, 2, 1, np.random.default_rng(0))
    assert len(p) == 4 and {j for _, j in p} == {0, 1}


# The paths of the fit below.
PATHS = ((0, 1), (0, 2), (1, 0))  # columns 1, 2, 3 of a 2 x 3 junction


def test_exact_depths_are_recovered():
    x = deconvolve.design(PATHS, 2, 3)
    beta = np.array([[7, 3, 0], [120, 40, 900], [55, 80, 1.5]])
    fit = MODELS["Default"]().fit(x @ beta, x)
    assert np.allclose(fit.beta, beta, rtol=1e-4, atol=1e-3) and np.allclose(fit.scale, 0, atol=1e-4) and math.isfinite(fit.score())


# True depths, noise on the logs of five edges in three samples, and what a fit to them must give.
TRUE = [[4.3, 554.2, 0], [148.6, 0, 6765.2], [99.2, 0, 213460]]
NOISE = [[1.08081191, 0.48431215, 0.57914048], [-0.18158257, 1.41020463, -0.37447169], [0.27519832, -0.96075461, 0.37692697], [0.03343893, 0.68056724, -1.56349669], [-0.56669762, -0.24214951, 1.51439128]]
BETA = [[4.5765247, 992.2348, -2.7179718e-05], [191.12575, -1.0251999e-04, 19269.342], [103.97991, -6.5565109e-07, 213723.84]]
STDERR = [[3.0417686, 43.542957, 0.37935179], [74.494919, 0.06198924, 5169.2056], [40.011986, 0.043839715, 57332.566]]


def test_noisy_fit_has_the_known_numbers():
    x = deconvolve.design(PATHS, 2, 3)
    fit = MODELS["OffsetLogNormal"]().fit(x @ np.array(TRUE) * np.exp(NOISE), x)
    assert np.allclose(fit.beta, BETA, rtol=5e-4, atol=1e-3)
    assert np.allclose(fit.scale, [[0.53901196, 0.06199879, 0.37936726]], rtol=5e-4)
    assert np.allclose(fit.stderr, STDERR, rtol=1e-3, atol=1e-4)
    assert fit.score("bic") == pytest.approx(-63.882275, rel=5e-4) and fit.converged


@pytest.mark.parametrize("name", sorted(MODELS))
def test_models_fit_and_score(name):
    rng = np.random.default_rng(4)
    x = deconvolve.design(((0, 0), (1, 1)), 2, 2)
    y = x @ rng.uniform(20, 60, (2, 6)) + rng.normal(0, 1, (4, 6))
    fit = MODELS[name]().fit(y, x)
    assert np.allclose(fit.beta, (y[:2] + y[2:]) / 2, rtol=0.1) and fit.converged
    assert all(math.isfinite(fit.score(s)) for s in ("aic", "bic", "aicc"))
    assert np.isinf(fit.stderr).all() if "Laplace" in name else (fit.stderr > 0).all()
    if name in ("Normal", "OffsetLogNormal", "Default"):
        assert not MODELS[name](max_iter=2).fit(y, x).converged


def zoomed(cost, lo, hi, points=11, shrink=0.5):
    """Where a function of vectors is least, by ever finer grids around the best point so far."""
    lo, hi = np.array(lo, float), np.array(hi, float)
    best, half = (lo + hi) / 2, (hi - lo) / 2
    while half.max() > 1e-9 * (1 + np.abs(best).max()):
        axes = [np.linspace(b - h, b + h, points) for b, h in zip(best, half, strict=True)]
        grid = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, len(best))
        best, half = grid[np.argmin(cost(grid))], half * shrink
    return best


def normal(r, s):
    return -((r / s) ** 2) / 2 - np.log(s * math.sqrt(2 * math.pi))


def student(r, s, df=5.0):
    return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - np.log(s * math.sqrt(df * math.pi)) - (df + 1) / 2 * np.log(1 + (r / s) ** 2 / df)


def laplace(r, s):
    return -np.abs(r) / s - np.log(2 * s)


def huber(r):
    return np.where(np.abs(r) <= 1, r**2 / 2, np.abs(r) - 0.5)


#: By model: what betas make least of an edge's residual, the density, whether all samples share a scale, the scale of the residuals.
PLAIN = {
    "Normal": (np.square, normal, False, lambda z: z), "NormalPooled": (np.square, normal, True, lambda z: z), "OffsetLogNormal": (np.square, normal, False, lambda z: np.log(z + 1)),
    "Laplace": (np.abs, laplace, False, lambda z: z), "LaplacePooled": (np.abs, laplace, True, lambda z: z), "StudentsT": (np.square, student, False, lambda z: z), "Huber": (huber, normal, None, lambda z: z),
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_fits_match_a_grid_search(name):
    """Betas, scales and likelihood of three paths over five edges against grids of the plain formulas."""
    rng = np.random.default_rng(12)
    x = deconvolve.design(((0, 0), (1, 1), (2, 1)), 3, 2)
    y = x @ rng.uniform(5, 30, (3, 2)) + rng.normal(0, 1.5, (5, 2))
    loss, density, pooled, scaled = PLAIN[name]
    fit = MODELS[name]().fit(y, x)
    for s in range(2):
        cost = lambda b, s=s: loss(scaled(y[:, s]) - scaled(np.maximum(b @ x.T, 0))).sum(-1)
        best = zoomed(cost, [0] * 3, [60] * 3)
        assert cost(fit.beta[:, s]) <= cost(best) * (1 + 1e-6)
        if "Laplace" not in name:  # whose betas are not unique: any between the two edges of a path are as good
            assert np.allclose(fit.beta[:, s], best, rtol=1e-4)
    rest = scaled(y) - scaled(x @ fit.beta)
    groups = [] if pooled is None else [rest.ravel()] if pooled else list(rest.T)
    scales = [math.exp(zoomed(lambda t, r=r: -density(r, np.exp(t)).sum(-1), [-6], [6])[0]) for r in groups] or [1.0]
    assert np.allclose(fit.scale.ravel(), np.resize(scales, 2), rtol=1e-5)
    assert fit.loglik == pytest.approx(density(rest, np.resize(scales, 2)).sum(), rel=1e-6)
    assert fit.n_params == 6 + len(groups)


def test_scaled_noise_is_at_a_maximum():
    """The scale s0 + s1 mu, both positive, and the betas: no step away from the fit gains anything."""
    rng = np.random.default_rng(12)
    x = deconvolve.design(((0, 0), (1, 1), (2, 1)), 3, 2)
    y = x @ rng.uniform(5, 30, (3, 4)) + rng.normal(0, 1.5, (5, 4))
    fit = MODELS["NormalScaled2"]().fit(y, x)
    mu = x @ fit.beta
    s1, s0 = np.polyfit(mu.ravel(), fit.scale.ravel(), 1)
    assert np.allclose(s0 + s1 * mu, fit.scale) and s0 > -1e-6 and s1 > -1e-6
    at = lambda beta, a, b: normal(y - x @ beta, a + b * (x @ beta)).sum()
    assert fit.loglik == pytest.approx(at(fit.beta, s0, s1), rel=1e-6)
    for _ in range(300):
        size = 10.0 ** rng.uniform(-4, -1)
        beta, a, b = fit.beta * (1 + size * rng.normal(size=fit.beta.shape)), s0 * math.exp(size * rng.normal()), s1 * math.exp(size * rng.normal())
        assert at(beta, a, b) <= fit.loglik + 1e-3


def test_search_finds_the_true_paths():
    rng = np.random.default_rng(0)
    beta = rng.uniform(10, 200, (2, 4))
    x = deconvolve.design(((0, 0), (1, 0)), 2, 1)
    y = x @ beta * np.exp(rng.normal(0, 0.01, (3, 4)))
    scores = deconvolve.greedy(y[:2], y[2:], MODELS["Default"]())
    assert deconvolve.best_of(scores)[0] == ((0, 0), (1, 0))


def test_orientation_and_balance():
    a, b = np.array([[1.0, 2]]), np.array([[1.0, 1], [1, 1]])
    assert deconvolve.should_swap(b, a) and not deconvolve.should_swap(a, b)
    assert deconvolve.should_swap(2 * a, a) and not deconvolve.should_swap(a, a)
    assert np.allclose(deconvolve.balanced(np.array([[1.0, 0], [3, 0]]), np.array([8.0, 5])), [[2, 0], [6, 0]])


def strains(spark, depth=30.0):
    """Two strains that share the middle of their sequences: 0-2-3 and 1-2-4, with different depths in four samples."""
    one, two = np.array([1.0, 2, 4, 8]) * depth, np.array([9.0, 3, 2, 1]) * depth
    rows = [(0, 50, ["0+"], one), (1, 50, ["1+"], two), (2, 50, ["2+"], one + two), (3, 50, ["3+"], one), (4, 50, ["4+"], two)]
    v = spark.createDataFrame([(i, n, s, d.tolist()) for i, n, s, d in rows], "vid long, length long, segments array<string>, depth array<double>")
    return AssemblyGraph(v, spark.createDataFrame([(0, 2), (1, 2), (2, 3), (2, 4)], "src long, dst long"), 5, ("a", "b", "c", "d"))


def test_two_strains_are_told_apart(spark, tmp_path):
    out = apps.unzip(spark, strains(spark), apps.UnzipSettings(max_rounds=2, flow_eps=1e-4), str(tmp_path))
    assert {tuple(r["segments"]) for r in out.vertices.collect()} == {("0+", "2+", "3+"), ("1+", "2+", "4+")}
    assert out.edges.count() == 0


def test_blocks_of_candidates_give_the_best_of_all(spark, monkeypatch):
    """Junctions of several rows of work against every candidate in one list."""
    monkeypatch.setattr(deconvolve, "BLOCK", 5)
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for j, (n, m) in enumerate([(2, 2), (3, 3), (2, 4), (4, 2), (1, 3), (1, 1)]):
        into, out = rng.uniform(5, 90, (n, 2)), rng.uniform(5, 90, (m, 2))
        rows.append((j, [50.0, 50.0], list(range(n)), list(range(10, 10 + m)), into.tolist(), out.tolist()))
        p = deconvolve.Problem(dict(in_flows=into, out_flows=out, in_nb=range(n), out_nb=range(10, 10 + m), depth=[50.0, 50.0]), True, True)
        best, _, margin = deconvolve.best_of(deconvolve.exhaustive(*p.sides, MODELS["Default"]()))
        ends = {(p.names[0][a], p.names[1][b]) for a, b in best}
        want[j] = ({(b, a) for a, b in ends} if p.swapped else ends, margin)
    found = spark.createDataFrame(rows, "junction long, depth array<double>, in_nb array<long>, out_nb array<long>, in_flows array<array<double>>, out_flows array<array<double>>")
    solved = {r["junction"]: r for r in deconvolve.solve(spark, found).collect()}
    for j, (ends, margin) in want.items():
        assert set(zip(solved[j]["left"], solved[j]["right"], strict=True)) == ends and solved[j]["score_margin"] == pytest.approx(margin)
    few = found.where("junction in (0, 2, 4, 5)")
    whole = {r["junction"]: r for r in deconvolve.solve(spark, few, "NormalScaled2", max_iter=20).collect()}  # fitted candidate by candidate, in blocks
    assert set(whole) == {0, 2, 4, 5} and all(len(r["left"]) == len(solved[j]["left"]) for j, r in whole.items()) and whole[5]["score_margin"] == float("inf")


def test_unzip_goes_on_from_a_folder(spark, tmp_path):
    loose = dict(flow_eps=1e-2, flow_iter=10, if_not_converged="ignore", drop_low_depth=False)
    settings = apps.UnzipSettings(max_rounds=1, **loose)
    apps.unzip(spark, strains(spark), settings, str(tmp_path))
    saved = spark.read.parquet(f"{tmp_path}/problems_0")
    assert [r["kind"] for r in saved.collect()] == ["canonical"] and apps.benchmark(spark, saved).first()["accepted"]
    again = apps.unzip(spark, strains(spark).with_(vertices=strains(spark).vertices.limit(0)), apps.UnzipSettings(max_rounds=2, **loose), str(tmp_path))
    assert {tuple(r["segments"]) for r in again.vertices.collect()} == {("0+", "2+", "3+"), ("1+", "2+", "4+")}
    other = apps.unzip(spark, strains(spark), apps.UnzipSettings(max_rounds=0, **loose))  # in a folder of its own
    assert other.vertices.count() == 5 and again.vertices.count() == 2


def test_smoothing_by_samples_and_strands(spark):
    rows = [(0, 3, ["a+"], [4.0, 1.0]), (1, 3, ["b+"], [6.0, 2.0]), (2, 3, ["b-"], [8.0, 2.0]), (3, 3, ["a-"], [2.0, 2.0])]
    v = spark.createDataFrame(rows, "vid long, length long, segments array<string>, depth array<double>")
    g = AssemblyGraph(v, spark.createDataFrame([(0, 1), (2, 3)], "src long, dst long"), 3, ("x", "y"))
    plain = apps.smooth(spark, g, ["y"], max_iter=2, flow_iter=4, if_not_converged="ignore")
    even = apps.smooth(spark, g, ["y"], True, max_iter=2, flow_iter=4, if_not_converged="ignore")
    a, b = ({r["vid"]: r["depth"] for r in x.vertices.collect()} for x in (plain, even))
    assert plain.samples == ("y",) and all(len(d) == 1 for d in a.values())
    # one round by hand: the flow of one edge between depths, then each vertex the mean of flow and pseudoflow
    assert b[0] == b[3] == pytest.approx([(a[0][0] + a[3][0]) / 2]) and b[1] == b[2] == pytest.approx([(a[1][0] + a[2][0]) / 2])
    once = apps.smooth(spark, g, ["y"], max_iter=1, flow_iter=15, if_not_converged="ignore").vertices
    f = plain_flow([(0, 1), (2, 3)], [1, 2, 2, 2], [3] * 4, 15)
    want = {0: (f[0, 1] + 0.75) / 2, 1: (f[0, 1] + 1.5) / 2, 2: (f[2, 3] + 1.5) / 2, 3: (f[2, 3] + 1.5) / 2}
    assert {r["vid"]: r["depth"][0] for r in once.collect()} == pytest.approx(want, rel=1e-5)
    with pytest.raises(ValueError, match="no such samples"):
        apps.smooth(spark, g, ["z"])


def test_gates(spark):
    g = strains(spark)
    f = spark.createDataFrame([(0, 2, [1.0] * 4), (1, 2, [2.0] * 4), (2, 3, [1.0] * 4), (2, 4, [2.0] * 4)], "src long, dst long, flow array<double>")
    found = deconvolve.problems(g, f, spark.createDataFrame([(2,)], "vid long"))
    row = found.first()
    assert row["in_nb"] == [0, 1] and row["out_nb"] == [3, 4] and row["in_flows"][1] == [2.0] * 4
    solved = deconvolve.solve(spark, found, balance=False)
    assert solved.first()["left"] == [0, 1] and solved.first()["right"] == [3, 4]
    assert deconvolve.gated(solved, min_margin=0).count() == 1 and deconvolve.gated(solved, min_margin=1e9).count() == 0
    row = apps.benchmark(spark, found).first()
    assert row["accepted"] and row["identifiable"] and row["paths"] == "0>3,1>4" and row["rmse"] < 0.01 and row["num_params"] > 0
    assert apps.benchmark(spark, found, part=(0, 1)).count() == 1 and apps.benchmark(spark, found, part=(1, 5)).count() == 0
    assert {r["vid"]: r["kind"] for r in deconvolve.junction_classes(g).collect()} == {2: "canonical"}


def test_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 1 + i % 3, [f"{i % 5}+"], (np.array([1.0, 0.1, 0.0] if i % 2 else [0.0, 0.1, 1.0]) * rng.uniform(1, 3)).tolist()) for i in range(40)] + [(99, 1, ["x+"], [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vid long, length long, segments array<string>, depth array<double>")
    pre = cluster.precluster(v, 6, seed=1)
    assert pre.count() == 40
    merged = cluster.agglomerate(spark, cluster.mean_depth(v, pre), 0.5)
    assert len({r["merged"] for r in merged.collect()}) == 2
    shared = cluster.shared_segments(v, spark.createDataFrame([(i, i % 2) for i in range(40)], "vid long, cluster long")).first()
    assert (shared["shared"], shared["total_a"], shared["total_b"]) == (5, 5, 5)


def test_large_sets_and_blocks_give_the_same_flows(spark, monkeypatch):
    """Sets in one task, all sets round by round over the cluster, and both mixed: flows, losses and stops are those of plain numpy."""
    rng = np.random.default_rng(9)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (45, 2)) if a != b} | {(100 + i, 101 + i) for i in range(20)} | {(200, 201 + i) for i in range(9)})
    ids = sorted({v for e in edges for v in e})
    at = {v: i for i, v in enumerate(ids)}
    d, lengths = rng.uniform(1, 50, (len(ids), 2)), rng.integers(1, 9, len(ids))
    v = spark.createDataFrame([(x, int(lengths[i]), d[i].tolist()) for i, x in enumerate(ids)], "vid long, length long, depth array<double>").cache()
    e = spark.createDataFrame(edges, "src long, dst long").cache()
    sets = flow.connected_sets(spark, e).collect()
    parent = {x: x for a, b in edges for x in ((a, 0), (b, 1))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root((a, 0))] = root((b, 1))
    groups = {}
    for r in sets:
        groups.setdefault(root((r["src"], 0)), set()).add(r["set"])
    assert len(sets) == len(edges) and all(len(g) == 1 for g in groups.values()) and len({s for g in groups.values() for s in g}) == len(groups)
    monkeypatch.setattr(flow, "PASS", 4)
    results = []
    for large in (flow.LARGE, 0, 8):
        monkeypatch.setattr(flow, "LARGE", large)
        found, losses = flow.estimate(spark, e, v.select("vid", "length"), flow.long_depths(v), eps=2e-2, max_iter=11, if_not_converged="ignore")
        results.append(({(r["src"], r["dst"], r["sample"]): r["flow"] for r in found.collect()}, losses))
    for found, losses in results:
        assert found == pytest.approx(results[0][0]) and {s: len(x) for s, x in losses.items()} == {s: len(x) for s, x in results[0][1].items()}
    for s in (0, 1):  # plain numpy, with the same rule to stop
        src, dst = (np.array([at[x[k]] for x in edges]) for k in (0, 1))
        f, dd = np.ones(len(edges)), d[:, s]
        for alpha in (0, 1):
            share = lengths[src] ** alpha / (lengths[src] ** alpha + lengths[dst] ** alpha)
            for _ in range(11):
                out, into = np.bincount(src, f, len(ids))[src], np.bincount(dst, f, len(ids))[dst]
                delta = (dd[src] - out) * np.where(out == 0, 1, f / np.where(out == 0, 1, out)) * share + (dd[dst] - into) * np.where(into == 0, 1, f / np.where(into == 0, 1, into)) * (1 - share)
                f = np.maximum(0, f + delta)
                if np.sqrt(delta @ delta) / dd.sum() < 2e-2:
                    break
        assert [results[0][0][a, b, s] for a, b in edges] == pytest.approx(f.tolist())


def test_low_flow_edges_do_not_depend_on_the_order_of_a_sum(spark):
    parts = [(1, 2, i, x) for i, x in enumerate([0.1, 0.2, 0.3, 59.4])]  # 59.99999999999999 or 60, as they are added
    for rows in (parts, parts[::-1], [(1, 2, 0, 59.99999999999999)]):
        assert flow.low_flow_edges(spark.createDataFrame(rows, "src long, dst long, sample int, flow double").coalesce(1), 60).count() == 1
    assert flow.low_flow_edges(spark.createDataFrame([(1, 2, 0, 59.99999)], "src long, dst long, sample int, flow double"), 60).count() == 0


def test_a_pass_writes_one_table(spark, monkeypatch):
    """Samples that stop in different passes make their rounds once more within the others' next pass."""
    written, keep = [], flow.scratch.keep
    monkeypatch.setattr(flow.scratch, "keep", lambda spark, df, name: written.append(name) or keep(spark, df, name))
    monkeypatch.setattr(flow, "PASS", 4)
    edges, d, lengths = [(0, 2), (1, 2), (2, 3), (2, 4)], np.array([[10.0, 2], [1, 1], [5, 3], [2, 1], [1, 2]]), [1, 5, 2, 7, 3]
    big = 2**60 + 1  # ids that doubles cannot tell apart
    v = spark.createDataFrame([(big + i, lengths[i], d[i].tolist()) for i in range(5)], "vid long, length long, depth array<double>")
    e = spark.createDataFrame([(big + a, big + b) for a, b in edges], "src long, dst long")
    found, losses = flow.estimate(spark, e, v.select("vid", "length"), flow.long_depths(v), eps=0.0, max_iter=6, if_not_converged="ignore")
    got = {(r["src"] - big, r["dst"] - big, r["sample"]): r["flow"] for r in found.collect()}
    for s in (0, 1):
        want = plain_flow(edges, d[:, s], lengths, 6)
        assert [got[*k, s] for k in edges] == pytest.approx([want[k] for k in edges]) and len(losses[s]) == 12
    assert written.count("pass") == 4 and not {"flow", "state"} & set(written)  # 4 and 2 rounds with either weights


def test_edges_without_others_need_no_task(spark, monkeypatch):
    """Their flows lie between their depths, by length; a pass has only the others' rows and returns no flows."""
    seen, dealt = [], flow._Passes._dealt
    monkeypatch.setattr(flow._Passes, "_dealt", lambda self, samples: seen.append(self.small.count()) or dealt(self, samples))
    edges, d, lengths = [(0, 1), (1, 2), (3, 5), (4, 5)], [4.0, 1, 6, 3, 2, 9], [1, 3, 2, 1, 1, 1]
    v, e = parts(spark, edges, d, lengths)
    want = plain_flow(edges, np.array(d), lengths, 40)
    for how in (lambda **s: flow.estimate(spark, e, v.select("vid", "length"), flow.long_depths(v), **s), lambda **s: flow.estimate_vertices(spark, e, v, **s)):
        seen.clear()
        found, losses = how(eps=0.0, max_iter=40, if_not_converged="ignore")
        got = {(r["src"], r["dst"]): r["flow"] for r in found.collect()}
        assert set(seen) == {2} and [got[k] for k in edges] == pytest.approx([want[k] for k in edges])
        assert got[0, 1] == pytest.approx(4 / 4 + 3 / 4) and got[1, 2] == pytest.approx(3 / 5 + 6 * 2 / 5)
        between = [np.mean([d[a], d[b]]) for a, b in edges[:2]]
        assert losses[0][0] * sum(d) == pytest.approx(np.sqrt(sum((b - 1) ** 2 for b in between) + sum(((d[a] - 1) / 2 + (9 - 2) / 4) ** 2 for a in (3, 4))))


def test_the_least_twin_gives_its_depth(spark):
    """Of several twins the least counts, without a row for each pair of them."""
    rows = [(i, 1, ["a+", "b-"], [float(i)]) for i in range(3)] + [(10 + i, 1, ["b+", "a-"], [100.0 + i]) for i in range(4)] + [(20, 1, ["c+"], [7.0])]
    v = spark.createDataFrame(rows, "vid long, length long, segments array<string>, depth array<double>")
    out = apps.smooth(spark, AssemblyGraph(v, spark.createDataFrame([], "src long, dst long"), 3, ("x",)), symmetric=True, max_iter=1, if_not_converged="ignore").vertices
    half = {r[0]: r[3][0] / 2 for r in rows}  # a vertex of length 1 without edges
    assert {r["vid"]: r["depth"][0] for r in out.collect()} == pytest.approx({i: half[i] if i == 20 else (half[i] + half[10 if i < 10 else 0]) / 2 for i in half})


def test_edges_without_others_are_rounded_as_in_rounds(spark):
    """Halves of the sixth place fall as they do in the rounds' own arithmetic."""
    rng = np.random.default_rng(5)
    d, lengths = (rng.integers(0, 12000, 800) / 100).tolist(), rng.integers(1, 8, 800).tolist()
    edges = [(2 * i, 2 * i + 1) for i in range(400)]
    v, e = parts(spark, edges, d, lengths)
    ends = {c: np.array([x[i] for x in edges]) for i, c in enumerate(("src", "dst"))}
    block = pd.DataFrame({**ends, "sample": 0, "flow": 1.0, **{f"d_{c}": np.array(d)[x] for c, x in ends.items()}})
    size = np.array(lengths, float)
    block["w_src"] = size[ends["src"]] / (size[ends["src"]] + size[ends["dst"]])
    want = {(r.src, r.dst): r.flow for r in flow._in_rounds({0: [(False, 2), (True, 2)]}, True)(block).itertuples()}
    found, _ = flow.estimate_vertices(spark, e, v, eps=0.0, max_iter=2, if_not_converged="ignore")
    assert {(r["src"], r["dst"]): r["flow"] for r in found.collect()} == want
