"""Which edge into a junction goes on as which edge out of it.

A junction's candidates are searched by branch and bound (``branch``). The first choice of the search makes
rows of work, so that one junction with many candidates is spread over the cluster; the best candidate
and the second best are aggregates over them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..model import AssemblyGraph
from .branch import TIE, Search
from .models import MODELS, Model, criterion
from .topology import blackbox_vertices, degrees, self_loops

Pathset = tuple[tuple[int, int], ...]


def designs(shapes: DataFrame) -> DataFrame:
    """(n, m, row, col, value) for shapes (n, m): 0/1 matrices with a column i * m + j for each path (i, j), rows i and n + j."""
    cells = shapes.select("n", "m", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") + F.col("m") - 1).cast("long"))).alias("row"))
    cells = cells.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") * F.col("m") - 1).cast("long"))))
    j = F.col("col") % F.col("m")
    hit = (raveled(F.col("row"), j, F.col("m")) == F.col("col")) | (j + F.col("n") == F.col("row"))
    return cells.withColumn("value", hit.cast("int"))


def design_all_paths(spark: SparkSession, n: int, m: int) -> DataFrame:
    """(row, col, value) of one shape."""
    return designs(spark.range(1).select(F.lit(n).alias("n"), F.lit(m).alias("m"))).select("row", "col", "value")


def raveled(i: Column, j: Column, m: Column) -> Column:
    return i * m + j


def n_minimal_pathsets(n: Column, m: Column) -> Column:
    """short! * short ** (long - short), as a double."""
    a, b = F.greatest(n, m), F.least(n, m)
    factorial = F.aggregate(F.sequence(F.lit(1), b.cast("int")), F.lit(1.0), lambda acc, x: acc * x)
    return factorial * F.pow(b.cast("double"), (a - b).cast("double"))


def minimal_pathsets(n: int, m: int) -> Iterator[Pathset]:
    """All candidates: a permutation of the shorter side meets the first of the longer one; the rest choose freely."""
    short, long = min(n, m), max(n, m)
    for head in itertools.permutations(range(short)):
        for rest in itertools.product(range(short), repeat=long - short):
            pairs = enumerate([*head, *rest])
            yield tuple(sorted(pairs if n >= m else ((b, a) for a, b in pairs)))


def nth_pathset(index: int, n: int, m: int) -> Pathset:
    """The candidate that ``minimal_pathsets`` gives at an index, without those before it."""
    short, long = min(n, m), max(n, m)
    order, rest = divmod(index, short ** (long - short))
    left, head = list(range(short)), []
    for i in range(short, 0, -1):
        at, order = divmod(order, math.factorial(i - 1))
        head.append(left.pop(at))
    tail = [rest // short**p % short for p in range(long - short - 1, -1, -1)]
    pairs = enumerate([*head, *tail])
    return tuple(sorted(pairs if n >= m else ((b, a) for a, b in pairs)))


def random_pathset(n: int, m: int, excess: int, rng: np.random.Generator) -> Pathset:
    """A random minimal pathset and some paths more."""
    short, long = min(n, m), max(n, m)
    picks = [*rng.permutation(short), *rng.integers(0, short, long - short)]
    paths = {(i, int(p)) if n >= m else (int(p), i) for i, p in zip(rng.permutation(long).tolist(), picks, strict=True)}
    others = [p for p in itertools.product(range(n), range(m)) if p not in paths]
    paths |= {others[i] for i in rng.permutation(len(others))[:excess]}
    return tuple(sorted(paths))


def design(paths: Pathset, n: int, m: int) -> np.ndarray:
    """A column for each path: ones at its edge in and its edge out."""
    x = np.zeros((n + m, len(paths)))
    for c, (i, j) in enumerate(paths):
        if not (0 <= i < n and 0 <= j < m):
            raise ValueError(f"no such path: {i, j}")
        x[i, c] = x[n + j, c] = 1
    return x


def near_pathsets(paths: Pathset, n: int, m: int) -> Iterator[Pathset]:
    """Pathsets with a path less, with two paths' ends swapped, with a path more."""
    own = set(paths)
    for p in paths:
        yield tuple(sorted(own - {p}))
    for a, b in itertools.combinations(paths, 2):
        if a[0] != b[0] and a[1] != b[1]:
            yield tuple(sorted((own - {a, b}) | {(a[0], b[1]), (b[0], a[1])}))
    for p in itertools.product(range(n), range(m)):
        if p not in own:
            yield tuple(sorted(own | {p}))


def _scored(y: np.ndarray, paths: Pathset, n: int, m: int, model: Model, score: str) -> float:
    value = model.fit(y, design(paths, n, m)).score(score)
    return -math.inf if math.isnan(value) else value


def exhaustive(into: np.ndarray, out: np.ndarray, model: Model, score: str = "bic", empty: bool = False) -> dict[Pathset, float]:
    """Scores of all candidates, in the order of their enumeration."""
    n, m, y = len(into), len(out), np.concatenate([into, out])
    candidates = itertools.chain([()] if empty else [], minimal_pathsets(n, m))
    return {p: _scored(y, p, n, m, model, score) for p in candidates}


def greedy(into: np.ndarray, out: np.ndarray, model: Model, score: str = "bic") -> dict[Pathset, float]:
    """Scores met on the way uphill from the pair of strongest edges."""
    n, m, y = len(into), len(out), np.concatenate([into, out])
    now: Pathset = ((int(np.argmax(into.sum(1))), int(np.argmax(out.sum(1)))),)
    scores = {now: _scored(y, now, n, m, model, score)}
    while True:
        for p in near_pathsets(now, n, m):
            if p not in scores:
                scores[p] = _scored(y, p, n, m, model, score)
        best = max(scores, key=scores.__getitem__)
        if scores[best] <= scores[now]:
            return scores
        now = best


def best_of(scores: dict[Pathset, float]) -> tuple[Pathset, float, float]:
    """The best pathset (the first of equals), its score and its margin to the second best."""
    order = sorted(scores, key=scores.__getitem__, reverse=True)
    top = scores[order[0]]
    second = scores[order[1]] if len(order) > 1 else -math.inf
    return order[0], top, top - second if math.isfinite(top) else -math.inf


def should_swap(into: np.ndarray, out: np.ndarray) -> bool:
    """Whether the canonical orientation has the sides swapped: more edges, then more flow, then more larger entries come second."""
    if len(into) != len(out):
        return len(into) > len(out)
    if into.sum() != out.sum():
        return bool(into.sum() > out.sum())
    return bool(np.sign(into - out).sum() > 0)


def balanced(flows: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Flows scaled to the junction's depth in each sample; samples without flow stay."""
    total = flows.sum(0)
    return flows * np.where(total > 0, depth / np.where(total > 0, total, 1), 1)


def problems(graph: AssemblyGraph, flows: DataFrame, junctions: DataFrame) -> DataFrame:
    """(junction, depth, in_nb, out_nb, in_flows, out_flows), neighbours in ascending order.

    ``flows`` has (src, dst, flow) with an array of the samples' flows.
    """
    take = lambda side, nb: flows.join(junctions.select(F.col("vid").alias(side)), side, "left_semi").groupBy(F.col(side).alias("vid")).agg(F.array_sort(F.collect_list(F.struct(F.col(nb).alias("nb"), "flow"))).alias(side))
    both = graph.vertices.select("vid", "depth").join(take("dst", "src"), "vid").join(take("src", "dst"), "vid")
    return both.select(
        F.col("vid").alias("junction"), "depth",
        F.col("dst.nb").alias("in_nb"), F.col("src.nb").alias("out_nb"), F.col("dst.flow").alias("in_flows"), F.col("src.flow").alias("out_flows"),
    )


class Problem:
    """One junction's flows in canonical orientation, balanced, with the neighbours' names."""

    def __init__(self, row, balance: bool, swap: bool) -> None:
        sides = [np.array([list(f) for f in row[c]], float) for c in ("in_flows", "out_flows")]
        names = [list(row["in_nb"]), list(row["out_nb"])]
        self.swapped = swap and should_swap(*sides)
        if self.swapped:
            sides, names = sides[::-1], names[::-1]
        if balance:
            sides = [balanced(f, np.asarray(row["depth"], float)) for f in sides]
        self.sides, self.names = sides, names

    def decide(self, paths: Pathset, model: Model, known: tuple[np.ndarray, bool] | None = None) -> dict:
        """The decision for some paths, with the numbers that the gates and reports ask for; with betas, if they are known."""
        n, m = map(len, self.names)
        x, y = design(paths, n, m), np.concatenate(self.sides)
        fit = model.fit(y, x) if known is None else model.fitted(y, x, *known)
        residual = y - x @ fit.beta
        ends = [(self.names[0][i], self.names[1][j]) for i, j in paths]
        return {
            "converged": bool(fit.converged), "completeness": float((x.sum(1) > 0).mean()), "excess_paths": len(paths) - max(n, m),
            "relative_stderr": (fit.stderr / (np.abs(fit.beta) + 1)).tolist(), "absolute_stderr": fit.stderr.tolist(),
            "left": [b if self.swapped else a for a, b in ends], "right": [a if self.swapped else b for a, b in ends],
            "path_depth": np.maximum(fit.beta, 0).tolist(), "loglik": float(fit.loglik), "num_params": int(fit.n_params),
            "rmse": float(np.sqrt(np.mean(residual**2))), "mae": float(np.mean(np.abs(residual))),
        }


class Alike:
    """Problems of equal shape, whose candidates are all fitted together, star by star."""

    def __init__(self, problems: list[Problem], model: Model) -> None:
        self.n, self.m = map(len, problems[0].names)
        self.problems, self.sides = problems, [np.stack([p.sides[s] for p in problems]) for s in (0, 1)]
        self.model, self.stars = model, {}
        self.candidates = sorted(minimal_pathsets(self.n, self.m))

    def groups(self, paths: Pathset) -> dict[int, list[int]]:
        """The longer side's edges of each edge of the shorter side."""
        out: dict[int, list[int]] = {}
        for i, j in paths:
            short, long = (j, i) if self.n >= self.m else (i, j)
            out.setdefault(short, []).append(long)
        return out

    def star(self, j: int, edges: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Betas of a group in all problems, which converged, and what it leaves unexplained."""
        if (j, edges) not in self.stars:
            long, short = self.sides if self.n >= self.m else self.sides[::-1]
            y, hub = long[:, list(edges)], short[:, j]
            beta, converged = self.model.star_betas(hub, y)
            rest = np.concatenate([self.model.statistic(y, beta), self.model.statistic(hub, beta.sum(1))[:, None]], axis=1)
            self.stars[j, edges] = beta, converged, rest.sum(1, keepdims=True) if self.model.additive else rest
        return self.stars[j, edges]

    def likelihoods(self) -> np.ndarray:
        """Problems x candidates."""
        rests = [np.concatenate([self.star(j, tuple(g))[2] for j, g in sorted(self.groups(c).items())], axis=1) for c in self.candidates]
        if not self.model.additive:  # a model with its own search for a scale looks at one problem at a time
            return np.array([[self.model.loglik_of(r[i : i + 1], self.n + self.m)[0] for r in rests] for i in range(len(rests[0]))])
        return np.stack([self.model.loglik_of(r, self.n + self.m) for r in rests], axis=1)

    def betas(self, rows: int | np.ndarray, paths: Pathset) -> tuple[np.ndarray, np.ndarray]:
        """Betas of a candidate's paths in one or some problems, and which of these converged."""
        at, ok = {p: i for i, p in enumerate(paths)}, np.ones(np.shape(rows), bool)
        out = np.zeros((*np.shape(rows), len(paths), self.sides[0].shape[2]))
        for j, edges in self.groups(paths).items():
            beta, converged, _ = self.star(j, tuple(edges))
            out[..., [at[(e, j) if self.n >= self.m else (j, e)] for e in edges], :] = beta[rows]
            ok = ok & converged[rows]
        return out, ok

    def best(self, score: str) -> Iterator[tuple[Pathset, float]]:
        """``chosen`` with the candidates themselves."""
        return ((self.candidates[at], float(margin)) for at, margin in zip(*self.chosen(score), strict=True))

    def chosen(self, score: str) -> tuple[np.ndarray, np.ndarray]:
        """Each problem's best candidate, by number, and its margin to the second best; of equal ones the last in order."""
        edges, samples = self.n + self.m, self.sides[0].shape[2]
        loglik = self.likelihoods()
        values = np.broadcast_to(criterion(score, loglik, self.model.n_params(max(self.n, self.m), samples), edges * samples), loglik.shape)
        values = np.where(np.isnan(values), -math.inf, values)
        top = values.max(1, keepdims=True)
        clear = np.isfinite(top)
        equal = np.where(clear, values >= top - TIE * (1 + np.abs(np.where(clear, top, 0))), values == top)
        at = values.shape[1] - 1 - np.argmax(equal[:, ::-1], axis=1)
        others = values.copy()
        others[np.arange(len(at)), at] = -math.inf
        margin = np.full(len(at), -math.inf)
        np.subtract(top[:, 0], others.max(1), out=margin, where=clear[:, 0])
        return at, margin

    def decided(self, score: str) -> Iterator[tuple[np.ndarray, dict[str, list]]]:
        """Rows of problems and their decisions' columns, the problems with equal candidates together."""
        chosen, margins = self.chosen(score)
        for c in np.unique(chosen):
            rows, paths = np.flatnonzero(chosen == c), self.candidates[c]
            beta, ok = self.betas(rows, paths)
            y = np.concatenate([s[rows] for s in self.sides], axis=1)
            x = design(paths, self.n, self.m)
            mu = x @ beta
            stderr, loglik = self.model.finished(y, x, beta, mu)
            residual = y - mu
            i, j = (list(k) for k in zip(*paths, strict=True))
            yield rows, {
                "score_margin": margins[rows].tolist(), "converged": ok.tolist(), "completeness": [float((x.sum(1) > 0).mean())] * len(rows), "excess_paths": [len(paths) - max(self.n, self.m)] * len(rows),
                "relative_stderr": (stderr / (np.abs(beta) + 1)).tolist(), "absolute_stderr": stderr.tolist(),
                "left": [[p.names[1][b] for b in j] if p.swapped else [p.names[0][a] for a in i] for p in (self.problems[r] for r in rows)],
                "right": [[p.names[0][a] for a in i] if p.swapped else [p.names[1][b] for b in j] for p in (self.problems[r] for r in rows)],
                "path_depth": np.maximum(beta, 0).tolist(), "loglik": loglik.tolist(), "num_params": [self.model.n_params(len(paths), y.shape[2])] * len(rows),
                "rmse": np.sqrt(np.mean(residual**2, axis=(1, 2))).tolist(), "mae": np.mean(np.abs(residual), axis=(1, 2)).tolist(),
            }


SOLVED = """junction long, score_margin double, converged boolean, completeness double, excess_paths int, relative_stderr array<array<double>>, absolute_stderr array<array<double>>,
left array<long>, right array<long>, path_depth array<array<double>>, loglik double, num_params int, rmse double, mae double"""

#: Candidates that one row of work has, and rows of work that are dealt out together.
BLOCK, DEALT = 64, 4096


def solve(spark: SparkSession, found: DataFrame, model: str = "Default", score: str = "bic", balance: bool = True, swap: bool = True, **settings) -> DataFrame:
    """The decision for each problem: the best of all minimal pathsets, and its margin to the second best.

    Both are exact. Junctions of few candidates are solved where they are, those of equal shape together; others by branch
    and bound, as many rows of work as the junction's larger edge has partners. A model that is fitted to all edges at once
    has no bound: its candidates are fitted one by one, in blocks. Candidates of equal scores are told apart by their order
    or that of the search, which are the same in every run.
    """
    separable = MODELS[model](**settings).separable

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = MODELS[model](**settings)
        for batch in batches:
            shapes: dict[tuple[int, ...], list[tuple[int, Problem]]] = {}
            for r in batch.to_dict("records"):
                p = Problem(r, balance, swap)
                shapes.setdefault((*map(len, p.names), p.sides[0].shape[1]), []).append((r["junction"], p))
            for rows in shapes.values():
                for some, columns in Alike([p for _, p in rows], fitted).decided(score):
                    yield pd.DataFrame({"junction": [rows[i][0] for i in some], **columns})

    def top_two(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = MODELS[model](**settings)
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                p = Problem(r, balance, swap)
                n, m = map(len, p.names)
                y = np.concatenate(p.sides)
                if separable:
                    k = fitted.n_params(max(n, m), y.shape[1])
                    top = [(criterion(score, ll, k, y.size), paths) for ll, paths in Search(*p.sides, fitted).run(int(r["work"]))]
                else:
                    some = range(int(r["work"]) * BLOCK, min((int(r["work"]) + 1) * BLOCK, int(r["candidates"])))
                    top = sorted(((_scored(y, c, n, m, fitted, score), c) for c in (nth_pathset(i, n, m) for i in some)), key=lambda t: -t[0])[:2]
                rows += [(r["junction"], float(-math.inf if math.isnan(v) else v), [list(x) for x in c]) for v, c in top]
            yield pd.DataFrame(rows, columns=["junction", "value", "paths"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = MODELS[model](**settings)
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                p = Problem(r, balance, swap)
                margin = r["best"] - r["second"] if math.isfinite(r["best"]) else -math.inf
                rows.append({"junction": r["junction"], "score_margin": float(margin), **p.decide(tuple((int(i), int(j)) for i, j in r["paths"]), fitted)})
            if rows:
                yield pd.DataFrame(rows)

    candidates = n_minimal_pathsets(F.size("in_nb"), F.size("out_nb"))
    solved = None
    if separable:
        found = scratch.keep(spark, found, "problems")
        few, found = found.where(candidates <= BLOCK), found.where(candidates > BLOCK)
        # as many tasks as there are cores, and more: rows are few bytes but much work
        solved = few.repartition(4 * spark.sparkContext.defaultParallelism, "junction").mapInPandas(together, SOLVED)
        if found.isEmpty():
            return solved
    sized = found.withColumn("candidates", candidates)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    if separable:
        work = sized.withColumn("work", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.size("in_nb"), F.size("out_nb")).cast("long") - 1)))
    else:  # in two steps, so that no row ever holds a list of all blocks
        blocks = F.ceil(F.col("candidates") / BLOCK)
        work = sized.withColumn("_some", upto(F.ceil(blocks / DEALT))).withColumn("work", F.explode(F.sequence(F.col("_some") * DEALT, F.least((F.col("_some") + 1) * DEALT, blocks.cast("long")) - 1))).drop("_some")
    work = work.repartition("junction", "work")
    fits = scratch.keep(spark, work.mapInPandas(top_two, "junction long, value double, paths array<array<int>>"), "fits").distinct()
    # two rows of a row of work at most reach a junction's aggregate, whose state is one struct
    top = fits.groupBy("junction").agg(F.max(F.struct("value", "paths")).alias("top")).select("junction", F.col("top.value").alias("best"), F.col("top.paths").alias("paths"))
    second = fits.join(top.withColumnRenamed("paths", "chosen"), "junction").where(F.col("paths") != F.col("chosen")).groupBy("junction").agg(F.max("value").alias("second"))
    searched = found.join(top, "junction").join(second, "junction", "left").fillna({"second": -math.inf}).mapInPandas(decide, SOLVED)
    return searched if solved is None else solved.union(searched)


def identifiable(relative: float, absolute: float) -> Column:
    """Whether each path's error is small, relatively or absolutely, in every sample."""
    rows = F.zip_with("relative_stderr", "absolute_stderr", lambda r, a: F.forall(F.zip_with(r, a, lambda x, y: (x <= relative) | (y <= absolute)), lambda ok: ok))
    return F.forall(rows, lambda ok: ok)


def gated(solved: DataFrame, min_margin: float = 10.0, relative: float = 0.1, absolute: float = 1.0, min_completeness: float = 1.0, max_excess: int = 0) -> DataFrame:
    """The decisions that are converged, clear, identifiable, complete and without excess paths."""
    return solved.where(F.col("converged") & (F.col("score_margin") >= min_margin) & identifiable(relative, absolute) & (F.col("completeness") >= min_completeness) & (F.col("excess_paths") <= max_excess))


def split_paths(solved: DataFrame) -> DataFrame:
    """(parent, path, left, right, path_depth) for ``rewrite.split``."""
    each = solved.select(F.col("junction").alias("parent"), F.posexplode(F.arrays_zip("left", "right", "path_depth")).alias("path", "p"))
    return each.select("parent", "path", "p.left", "p.right", "p.path_depth")


def junction_classes(graph: AssemblyGraph, extra_large: float = 100) -> DataFrame:
    """(vid, in_degree, out_degree, kind): safe, canonical, large or extralarge junctions."""
    i, o = F.col("in_degree"), F.col("out_degree")
    found = degrees(graph).where(((i > 1) & (o >= 1)) | ((i >= 1) & (o > 1)))
    kind = F.when((i == 1) | (o == 1), "safe").when((i == 2) & (o == 2), "canonical").when(n_minimal_pathsets(i, o) <= extra_large, "large").otherwise("extralarge")
    return found.withColumn("kind", kind)


def without_unidentifiable(graph: AssemblyGraph, found: DataFrame) -> DataFrame:
    """The junctions outside of bicliques and loops."""
    return found.join(blackbox_vertices(graph).union(self_loops(graph)).distinct(), "vid", "left_anti")
