"""The two best pathsets of a junction by branch and bound.

In a minimal pathset each edge of the longer side has one path, and each edge of the shorter side has
the paths of its group, one of them from the first edges of the longer side. Given the groups, paths of different groups
share no edge, so a group is fitted by itself, and the likelihood follows from what the groups leave unexplained.
Groups are chosen one after the other. Where those still open are taken to fit without any residual,
or with the least residual that any of their choices has, the likelihood is that of a relaxed fit, which no completion
exceeds; choices whose bound is not above the second best pathset known are left out. All pathsets have
equally many parameters, so the likelihood orders them as any criterion does.
"""

from __future__ import annotations

import numpy as np

from .models import Model

#: Choices that are weighed at once, and partial assignments that the first dive goes on with from one group to the next.
CHOICES, BEAM = 1 << 14, 32
#: Differences of likelihoods that do not count.
TIE = 1e-9


class Search:
    """Groups of the longer side's edges for each edge of the shorter side."""

    def __init__(self, into: np.ndarray, out: np.ndarray, model: Model) -> None:
        self.model, self.flipped = model, len(into) < len(out)
        self.long, self.short = (out, into) if self.flipped else (into, out)
        self.rows, self.samples = len(into) + len(out), into.shape[1]
        self.order = np.argsort(-self.short.sum(1), kind="stable").tolist()
        self.fitted: dict[tuple[int, tuple[int, ...]], np.ndarray] = {}
        self.best: list[tuple[float, tuple[tuple[int, ...], ...]]] = []
        self.square = len(self.long) == len(self.short)

    def group(self, j: int, edges: tuple[int, ...]) -> np.ndarray:
        """What a group leaves unexplained: a row of sums, or one row for each of its edges where sums do not suffice."""
        if (j, edges) not in self.fitted:
            y = np.concatenate([self.long[list(edges)], self.short[[j]]])
            x = np.concatenate([np.eye(len(edges)), np.ones((1, len(edges)))])
            rest = self.model.statistic(y, x @ self.model.betas(y, x)[0])
            self.fitted[j, edges] = rest.sum(0, keepdims=True) if self.model.additive else rest
        return self.fitted[j, edges]

    def likelihoods(self, rests: np.ndarray) -> np.ndarray:
        """Likelihoods of nodes x rows x samples of what is unexplained; rows that are missing have no residual."""
        return self.model.loglik_of(rests, self.rows)

    def floor(self, heads: tuple[int, ...], left: list[int]) -> np.ndarray | float:
        """The least that the open groups leave, whatever is chosen; known where each has one edge."""
        if not (self.square and self.model.additive and left):
            return 0.0
        return sum(np.min([self.group(j, (h,)) for h in heads], axis=0) for j in left)

    def choices(self, heads: tuple[int, ...], tails: tuple[int, ...], last: bool):
        """The groups that an edge can have: one head and some tails; what is left for the last one."""
        for h in heads:
            if last:
                yield [(h, *tails)]
                continue
            for lo in range(0, 1 << len(tails), CHOICES):
                yield [(h, *(t for b, t in enumerate(tails) if pick >> b & 1)) for pick in range(lo, min(1 << len(tails), lo + CHOICES))]

    def children(self, level: int, rest: np.ndarray, heads: tuple[int, ...], tails: tuple[int, ...], bar: float) -> list[tuple]:
        """The choices at a level whose bounds are above a bar, best first."""
        j, last = self.order[level], level + 1 == len(self.order)
        out = []
        for some in self.choices(heads, tails, last):
            if len(some) > 1:  # a cheap bound before anything is fitted
                sums = np.stack([self.long[list(g)].sum(0) for g in some])
                sizes = np.array([len(g) for g in some])[:, None]
                least = self.model.least(sums, sizes, self.short[j])
                quick = self.likelihoods(np.concatenate([np.broadcast_to(rest, (len(some), *rest.shape)), least[:, None]], axis=1))
                some = [g for g, b in zip(some, quick.tolist(), strict=True) if b > bar]
            for g in some:
                own = np.concatenate([rest, self.group(j, g)])
                if self.model.additive:
                    own = own.sum(0, keepdims=True)
                keep = tuple(h for h in heads if h != g[0])
                bound = float(self.likelihoods((own + self.floor(keep, self.order[level + 1 :]))[None])[0])
                if bound > bar:
                    out.append((bound, g, own, keep, tuple(t for t in tails if t not in g)))
        return sorted(out, key=lambda c: (-c[0], c[1]))

    def found(self, value: float, groups: tuple[tuple[int, ...], ...]) -> None:
        if all(groups != g for _, g in self.best):
            self.best = sorted([*self.best, (value, groups)], key=lambda b: (-b[0], b[1]))[:2]

    def bar(self) -> float:
        """What a bound must exceed: the second best likelihood known."""
        return self.best[1][0] + TIE * (1 + abs(self.best[1][0])) if len(self.best) > 1 else -np.inf

    def start(self) -> tuple:
        heads = tuple(range(len(self.short)))
        return np.zeros((1, self.samples)), heads, tuple(range(len(heads), len(self.long)))

    def dive(self) -> None:
        """Some good pathsets: only the best few partial assignments go on."""
        kept = [((), *self.start())]
        for level in range(len(self.order)):
            nodes = [(b, (*groups, g), rest, heads, tails) for groups, *at in kept for b, g, rest, heads, tails in self.children(level, *at, -np.inf if len(self.long) - len(self.short) < 5 else self.bar())]
            nodes.sort(key=lambda n: (-n[0], n[1]))
            kept = [n[1:] for n in nodes[:BEAM]]
            if level + 1 == len(self.order):
                for n in nodes:
                    self.found(n[0], n[1])

    def below(self, level: int, groups: tuple, rest: np.ndarray, heads: tuple[int, ...], tails: tuple[int, ...]) -> None:
        for bound, g, *at in self.children(level, rest, heads, tails, self.bar()):
            if bound <= self.bar():
                break
            if level + 1 == len(self.order):
                self.found(bound, (*groups, g))
            else:
                self.below(level + 1, (*groups, g), *at)

    def run(self, first: int | None = None) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
        """(likelihood, paths) of the two best pathsets; with ``first``, among those whose first group has that head and those of the dive."""
        self.dive()
        rest, heads, tails = self.start()
        if first is None:
            self.below(0, (), rest, heads, tails)
        else:
            for bound, g, *at in self.children(0, rest, heads, tails, self.bar()) if len(self.order) > 1 else []:
                if g[0] == first and bound > self.bar():
                    self.below(1, (g,), *at)
        pair = (lambda i, j: (j, i)) if self.flipped else (lambda i, j: (i, j))
        return [(v, tuple(sorted(pair(i, j) for j, g in zip(self.order, groups, strict=True) for i in g))) for v, groups in self.best]
