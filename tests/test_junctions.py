"""Branch and bound over a junction's pathsets against enumeration."""

import itertools
import time

import numpy as np
import pytest

from graphloom import queries
from graphloom.operators import deconvolve
from graphloom.operators.branch import Search
from graphloom.operators.models import MODELS, criterion

SHAPES = list(itertools.product(range(1, 6), repeat=2))


def compared(into, out, model):
    """Best pathset, its score and margin, by search and by enumeration."""
    n, m = len(into), len(out)
    found = Search(into, out, model).run()
    k, size = model.n_params(max(n, m), into.shape[1]), (n + m) * into.shape[1]
    scores = [criterion("bic", v, k, size) for v, _ in found]
    every = deconvolve.exhaustive(into, out, model)
    return found[0][1], scores, every


@pytest.mark.parametrize("name", ["Default", "Normal", "NormalPooled", "Laplace", "StudentsT", "Huber"])
def test_search_equals_enumeration(name):
    model = MODELS[name]()
    for n, m in SHAPES if name == "Default" else [s for s in SHAPES if max(s) < 5]:
        rng = np.random.default_rng([n, m])
        if (n + m) % 2:
            into, out = rng.uniform(1, 90, (n, 2)), rng.uniform(1, 90, (m, 2))
        else:
            paths = deconvolve.random_pathset(n, m, 0, rng)
            y = deconvolve.design(paths, n, m) @ rng.uniform(1, 50, (len(paths), 2)) * np.exp(rng.normal(0, 0.05, (n + m, 2)))
            into, out = y[:n], y[n:]
        best, scores, every = compared(into, out, model)
        first, top, margin = deconvolve.best_of(every)
        assert scores[0] == pytest.approx(top, rel=1e-6)
        assert every[best] == pytest.approx(top, rel=1e-6) and (best == first or margin < 1e-6 * (1 + abs(top)))
        if len(every) > 1:
            assert scores[0] - scores[1] == pytest.approx(margin, rel=1e-4, abs=1e-5 * (1 + abs(top)))
        else:
            assert len(scores) == 1


def test_rows_of_work_hold_the_best_two_together():
    rng = np.random.default_rng(4)
    for n, m in ((4, 4), (3, 6), (5, 3)):
        into, out = rng.uniform(1, 90, (n, 3)), rng.uniform(1, 90, (m, 3))
        whole = Search(into, out, MODELS["Default"]()).run()
        parts = {p: v for first in range(min(n, m)) for v, p in Search(into, out, MODELS["Default"]()).run(first)}
        assert sorted(parts.items(), key=lambda x: -x[1])[:2] == [(p, pytest.approx(v)) for v, p in whole]


def test_a_large_junction_of_few_strains():
    """Ten edges by ten, three of them strains and the others nearly empty: 3.6 million candidates."""
    rng = np.random.default_rng(1)
    y, goes = np.zeros((20, 6)), rng.permutation(10)
    for i in range(3):
        depth = rng.uniform(5, 60, 6)
        y[i] += depth
        y[10 + goes[i]] += depth
    y = y * np.exp(rng.normal(0, 0.05, y.shape)) + rng.uniform(0, 0.3, y.shape)
    began = time.perf_counter()
    best, second = Search(y[:10], y[10:], MODELS["Default"]()).run()
    assert time.perf_counter() - began < 60
    assert {p for p in best[1] if p[0] < 3} == {(i, int(goes[i])) for i in range(3)} and best[0] >= second[0]
    # no exchange of two ends is better than the best, and at most one is as good as the second
    others = []
    for a, b in itertools.combinations(best[1], 2):
        p = tuple(sorted((set(best[1]) - {a, b}) | {(a[0], b[1]), (b[0], a[1])}))
        others.append(MODELS["Default"]().fit(y, deconvolve.design(p, 10, 10)).loglik)
    assert max(others) <= second[0] + 1e-6


def test_query_equals_enumeration_over_a_whole_table(spark):
    """Every junction of the smallest tables that has at most 500 candidates; the others are no worse than 200 random ones."""
    sf = "/root/testdata/sf0.001"
    rows = queries._problems(spark, sf, queries._converged).collect()
    solved = {r["junction"]: r for r in queries.QUERIES["dc_16_solve_junctions"](spark, sf).collect()}
    assert len(rows) == len(solved) > 0
    model, rng = MODELS["Default"](), np.random.default_rng(0)
    for r in rows:
        p = deconvolve.Problem(r.asDict(), True, True)
        n, m = map(len, p.names)
        short, long = sorted((n, m))
        count = np.prod(np.arange(1, short + 1.0)) * float(short) ** (long - short)
        got = solved[r["junction"]]
        y = np.concatenate(p.sides)
        if count > 500:
            picks = [deconvolve.nth_pathset(int(rng.integers(0, min(count, 2**62))), n, m) for _ in range(200)]
            assert got["loglik"] >= max(model.fit(y, deconvolve.design(c, n, m)).loglik for c in picks) - 1e-6
            continue
        every = deconvolve.exhaustive(*p.sides, model)
        _, top, margin = deconvolve.best_of(every)
        k = model.n_params(max(n, m), y.shape[1])
        assert criterion("bic", got["loglik"], k, y.size) == pytest.approx(top, rel=1e-6, abs=1e-6)
        if np.isfinite(margin):
            assert got["score_margin"] == pytest.approx(margin, rel=1e-4, abs=1e-5 * (1 + abs(top)))


@pytest.mark.parametrize("name", ["Default", "NormalPooled", "Laplace", "StudentsT"])
def test_junctions_of_equal_shape_are_fitted_together_as_by_themselves(name):
    rng, model = np.random.default_rng(5), MODELS[name]()
    for n, m in [(1, 2), (2, 2), (3, 2), (2, 4)]:
        rows = [{"in_nb": [*range(n)], "out_nb": [*range(m)], "in_flows": rng.gamma(1, 20, (n, 3)), "out_flows": rng.gamma(1, 20, (m, 3)), "depth": rng.gamma(2, 20, 3)} for _ in range(5)]
        problems = [deconvolve.Problem(r, True, True) for r in rows]
        for shape in {tuple(map(len, p.names)) for p in problems}:
            some = [p for p in problems if tuple(map(len, p.names)) == shape]
            alike = deconvolve.Alike(some, model)
            for i, (paths, margin) in enumerate(alike.best("bic")):
                every = deconvolve.exhaustive(*some[i].sides, model)
                best, top, lead = deconvolve.best_of(every)
                assert every[paths] == pytest.approx(top, rel=1e-6) and margin == pytest.approx(lead, rel=1e-4, abs=1e-5 * (1 + abs(top)))
                assert some[i].decide(paths, model, alike.betas(i, paths))["loglik"] == pytest.approx(some[i].decide(best, model)["loglik"], rel=1e-6)


def test_many_small_junctions_take_little_time_each():
    """4000 junctions, two edges by two and four samples: one by one they took over a minute."""
    rng, model = np.random.default_rng(6), MODELS["Default"]()
    begun = time.process_time()
    rows = [{"in_nb": [0, 1], "out_nb": [2, 3], "in_flows": rng.gamma(1, 20, (2, 4)), "out_flows": rng.gamma(1, 20, (2, 4)), "depth": rng.gamma(2, 20, 4)} for _ in range(4000)]
    problems = [deconvolve.Problem(r, True, True) for r in rows]
    alike = deconvolve.Alike(problems, model)
    decided = [p.decide(paths, model, alike.betas(i, paths)) for i, (p, (paths, _)) in enumerate(zip(problems, alike.best("bic"), strict=True))]
    assert len(decided) == 4000 and time.process_time() - begun < 20


@pytest.mark.parametrize("name", ["Default", "NormalPooled", "StudentsT", "Laplace"])
def test_decisions_made_together_are_those_made_one_by_one(name):
    """Columns of many junctions at once; one of them has an empty sample."""
    rng, model = np.random.default_rng(5), MODELS[name]()
    for n, m in ((2, 2), (1, 3), (3, 2)):
        rows = [{"in_nb": list(range(n)), "out_nb": list(range(9, 9 + m)), "in_flows": rng.uniform(0, 60, (n, 3)).tolist(), "out_flows": rng.uniform(0, 60, (m, 3)).tolist(), "depth": [9.0, 5.0, 30.0]} for _ in range(12)]
        for side in ("in_flows", "out_flows"):
            rows[3][side] = [[a, b, 0.0] for a, b, _ in rows[3][side]]
        every = [deconvolve.Problem(r, True, True) for r in rows]
        for shape in {tuple(map(len, p.names)) for p in every}:
            some = [p for p in every if tuple(map(len, p.names)) == shape]
            alike = deconvolve.Alike(some, model)
            one_by_one = [{"score_margin": margin, **p.decide(paths, model, alike.betas(i, paths))} for i, (p, (paths, margin)) in enumerate(zip(some, alike.best("bic"), strict=True))]
            seen = set()
            for at, columns in alike.decided("bic"):
                for k, i in enumerate(at.tolist()):
                    seen.add(i)
                    assert columns.keys() == one_by_one[i].keys()
                    for c, v in one_by_one[i].items():
                        assert np.allclose(np.array(v, float), np.array(columns[c][k], float), rtol=1e-9, atol=1e-9), c
            assert seen == set(range(len(some)))
