"""Regression models of edge depths, y = X beta plus noise, in numpy.

``y`` is edges x samples, ``X`` edges x paths. All objectives are sums over samples that share no
beta, so each sample is a small problem of its own; Hessians are block diagonal by sample and
have closed forms. ``converged`` means that fewer than ``max_iter`` iterations were made.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Least scale, so that an exact fit has a finite likelihood.
FLOOR = 1e-12
LOG_2PI = math.log(2 * math.pi)


def _softplus(t: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, t)


def _logistic(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -700, 700)))


@dataclass(frozen=True)
class Fit:
    """A fitted model: parameters, likelihood and what follows from it."""

    beta: np.ndarray
    scale: np.ndarray
    loglik: float
    n_params: int
    n_observations: int
    converged: bool
    stderr: np.ndarray

    def score(self, name: str = "bic") -> float:
        return criterion(name, self.loglik, self.n_params, self.n_observations)


def criterion(name: str, loglik: float, k: int, n: int) -> float:
    """The negative criterion for k parameters and n observations; higher is better. The BIC's penalty is 2 k ln n."""
    aic = -2 * loglik + 2 * k
    if name == "aic":
        return -aic
    if name == "bic":
        return -(-2 * loglik + 2 * k * math.log(n))
    if name == "aicc":
        return -(aic + (2 * k * k + 2 * k) / (n - k - 1)) if n != k + 1 else -math.inf
    raise ValueError(f"no such score: {name}")


def damped_fit(y: np.ndarray, x: np.ndarray, link: Callable, slope: Callable, value: Callable, derivative: Callable, loss: Callable, weight: Callable, max_iter: int) -> tuple[np.ndarray, int]:
    """Levenberg-Marquardt for one sample over raw parameters t with beta = link(t), from t = 1.

    Residuals are value(y) - value(X beta); ``weight`` reweights them for losses other than squares.
    """
    t = np.ones(x.shape[1])
    target, damping = value(y), 1e-3
    residual = target - value(x @ link(t))
    now, n = loss(residual).sum(), 0
    while n < max_iter:
        n += 1
        mu = x @ link(t)
        jacobian = -derivative(mu)[:, None] * x * slope(t)
        w = weight(residual)
        gradient, square = jacobian.T @ (w * residual), (jacobian * w[:, None]).T @ jacobian
        if np.abs(gradient).max(initial=0) < 1e-12 * (1 + now):
            break
        better = False
        for _ in range(30):
            step = np.linalg.solve(square + damping * (np.diag(np.diag(square)) + 1e-12 * np.eye(len(t))), -gradient)
            new = np.clip(t + np.clip(step, -20, 20), -60, 700)
            r = target - value(x @ link(new))
            then = loss(r).sum()
            if then < now:
                better = True
                break
            damping *= 4
        if not better:
            break
        small = now - then <= 1e-14 * (1 + abs(now))
        t, residual, now, damping = new, r, then, max(damping / 9, 1e-12)
        if small:
            break
    return t, n


def star_fit(hub: np.ndarray, leaves: np.ndarray, link: Callable, slope: Callable, value: Callable, derivative: Callable, loss: Callable, weight: Callable, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """``damped_fit`` of many stars at once: rows of leaves, each with a path of its own, and the hub that has all of a row's paths.

    The squared Jacobian of a star is a diagonal and one outer product, so steps need no solver.
    """
    t, damping, n = np.ones(leaves.shape), np.full(len(hub), 1e-3), np.zeros(len(hub), int)
    goals, goal = value(leaves), value(hub)

    def rest(t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        beta = link(t)
        mu = beta.sum(1)
        return beta, mu, goals[at] - value(beta), goal[at] - value(mu)

    every = np.arange(len(hub))
    _, _, own, shared = rest(t, every)
    now = loss(own).sum(1) + loss(shared)
    live = every if max_iter > 0 else every[:0]
    while live.size:
        n[live] += 1
        beta, mu, own, shared = rest(t[live], live)
        s = slope(t[live])
        a, c, w, v = derivative(beta) * s, derivative(mu)[:, None] * s, weight(own), weight(shared)
        gradient = a * w * own + c * (v * shared)[:, None]
        rows = np.flatnonzero(np.abs(gradient).max(1) >= 1e-12 * (1 + now[live]))
        live = live[rows]
        gradient, c, v = gradient[rows], c[rows], v[rows]
        diagonal = (w * a * a)[rows]
        square = diagonal + v[:, None] * c * c
        moved = np.zeros(live.size, bool)
        left = np.arange(live.size)
        for _ in range(30):
            if not left.size:
                break
            at = live[left]
            d = np.maximum(diagonal[left] + damping[at, None] * (square[left] + 1e-12), 1e-300)
            z, q = gradient[left] / d, c[left] / d
            step = z - q * (v[left] * (c[left] * z).sum(1) / (1 + v[left] * (c[left] * q).sum(1)))[:, None]
            new = np.clip(t[at] + np.clip(step, -20, 20), -60, 700)
            _, _, own, shared = rest(new, at)
            then = loss(own).sum(1) + loss(shared)
            better = then < now[at]
            good = at[better]
            moved[left[better]] = now[good] - then[better] > 1e-14 * (1 + np.abs(now[good]))
            t[good], now[good], damping[good] = new[better], then[better], np.maximum(damping[good] / 9, 1e-12)
            left = left[~better]
            damping[live[left]] *= 4
        live = live[moved & (n[live] < max_iter)]
    return link(t), n


def stars_of(x: np.ndarray) -> list[tuple[int, list[int], list[int]]] | None:
    """(hub, leaves, paths) of a design in which each path has an end that no other path has; None for other designs."""
    if not np.isin(x, (0, 1)).all() or (x.sum(0) != 2).any():
        return None
    degree, found = x.sum(1), {}
    for p in range(x.shape[1]):
        i, j = np.flatnonzero(x[:, p]).tolist()
        if degree[i] > 1 and degree[j] > 1:
            return None
        hub, leaf = (i, j) if degree[i] > 1 else (j, i)
        leaves, paths = found.setdefault(hub, ([], []))
        leaves.append(leaf)
        paths.append(p)
    return [(hub, *rest) for hub, rest in found.items()]


def standard_errors(x: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """Fits x paths x samples from curvatures (fits x edges x samples) of one design; infinite where they give none."""
    h = np.moveaxis(curvature, 2, 1)[..., None]
    square = x.T @ (h * x)
    with np.errstate(invalid="ignore"):
        try:
            inverse = np.linalg.inv(square)
        except np.linalg.LinAlgError:  # of one or more of them: one by one
            inverse = np.full_like(square, np.nan)
            for at in np.ndindex(square.shape[:2]):
                try:
                    inverse[at] = np.linalg.inv(square[at])
                except np.linalg.LinAlgError:
                    pass
        errors = np.sqrt(np.moveaxis(np.diagonal(inverse, axis1=2, axis2=3), 1, 2))
    return np.where(np.isnan(errors), np.inf, errors)


class Model:
    """Least squares with beta = softplus(t), and what subclasses change in it.

    Where ``separable``, paths that share no edge are fitted apart, and the likelihood is ``loglik_of`` what ``statistic``
    gives for each edge; where ``additive``, of its sums over edges. Where ``by_sample``, a sample's scale follows from that sample alone.
    """

    separable, additive, by_sample = True, True, True

    def __init__(self, max_iter: int = 10_000) -> None:
        self.max_iter = max_iter

    link, slope = staticmethod(_softplus), staticmethod(_logistic)

    def value(self, z):
        return z

    def derivative(self, mu):
        return np.ones_like(mu)

    def loss(self, r):
        return r * r / 2

    def weight(self, r):
        return np.ones_like(r)

    def scales(self, y: np.ndarray, mu: np.ndarray) -> np.ndarray:
        """Scale by sample: the root mean square of the residuals."""
        return np.maximum(np.sqrt(np.mean((self.value(y) - self.value(mu)) ** 2, axis=0, keepdims=True)), FLOOR)

    def n_params(self, paths: int, samples: int) -> int:
        return paths * samples + samples

    def logpdf(self, y: np.ndarray, mu: np.ndarray, scale: np.ndarray) -> np.ndarray:
        r = (self.value(y) - self.value(mu)) / scale
        return -r * r / 2 - np.log(scale) - LOG_2PI / 2

    def curvature(self, y: np.ndarray, mu: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Second derivative of -logpdf by mu."""
        return np.broadcast_to(1 / scale**2, mu.shape)

    def statistic(self, y: np.ndarray, mu: np.ndarray) -> np.ndarray:
        return (self.value(y) - self.value(mu)) ** 2

    def loglik_of(self, rest: np.ndarray, n: int) -> np.ndarray:
        """Likelihoods of n edges from nodes x edges x samples of the statistic; edges that are missing have none."""
        total = rest.sum(-2)
        square = np.maximum(total / n, FLOOR**2)
        return (-total / square / 2 - n * (np.log(square) + LOG_2PI) / 2).sum(-1)

    def least(self, sums: np.ndarray, sizes: np.ndarray, short: np.ndarray) -> np.ndarray:
        """No more than the sums of ``statistic`` of groups of so many edges with such sums, and one edge against them."""
        return (sums - short) ** 2 / (sizes + 1)

    def star_betas(self, hubs: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Betas (stars x leaves x samples) of stars whose paths share the hub alone, and which of them converged."""
        g, samples = leaves.shape[1:]
        beta, n = star_fit(hubs.ravel(), leaves.swapaxes(1, 2).reshape(-1, g), self.link, self.slope, self.value, self.derivative, self.loss, self.weight, self.max_iter)
        return beta.reshape(-1, samples, g).swapaxes(1, 2), (n < self.max_iter).reshape(-1, samples).all(1)

    def betas(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, bool]:
        if (stars := stars_of(x)) is not None:
            beta, ok = np.zeros((x.shape[1], y.shape[1])), True
            for hub, leaves, paths in stars:
                some, converged = self.star_betas(y[None, hub], y[None, leaves])
                beta[paths] = some[0]
                ok = ok and bool(converged[0])
            return beta, ok
        found = [damped_fit(y[:, s], x, self.link, self.slope, self.value, self.derivative, self.loss, self.weight, self.max_iter) for s in range(y.shape[1])]
        return np.stack([self.link(t) for t, _ in found], axis=1), all(n < self.max_iter for _, n in found)

    def fit(self, y: np.ndarray, x: np.ndarray) -> Fit:
        y, x = np.asarray(y, float), np.asarray(x, float)
        beta, converged = self.betas(y, x) if x.shape[1] else (np.zeros((0, y.shape[1])), True)
        return self.fitted(y, x, beta, converged)

    def fitted(self, y: np.ndarray, x: np.ndarray, beta: np.ndarray, converged: bool) -> Fit:
        """The fit that betas make."""
        mu = x @ beta
        return self._finish(y, x, beta, mu, self.scales(y, mu), converged)

    def _finish(self, y, x, beta, mu, scale, converged) -> Fit:
        errors = standard_errors(x, self.curvature(y, mu, scale)[None])[0]
        return Fit(beta, scale, float(self.logpdf(y, mu, scale).sum()), self.n_params(x.shape[1], y.shape[1]), y.size, converged, errors)

    def finished(self, y: np.ndarray, x: np.ndarray, beta: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Standard errors and likelihoods of many fits of one design, the first axis of all but ``x``."""
        if self.by_sample:  # samples of all fits side by side
            flat = lambda z: z.swapaxes(0, 1).reshape(z.shape[1], -1)
            back = lambda z: z.reshape(y.shape[1], len(y), -1).swapaxes(0, 1)
            a, b = flat(y), flat(mu)
            scale = self.scales(a, b)
            return standard_errors(x, back(self.curvature(a, b, scale))), back(self.logpdf(a, b, scale)).sum((1, 2))
        curvature, loglik = np.empty_like(mu), np.empty(len(y))
        for r in range(len(y)):
            scale = self.scales(y[r], mu[r])
            curvature[r], loglik[r] = self.curvature(y[r], mu[r], scale), self.logpdf(y[r], mu[r], scale).sum()
        return standard_errors(x, curvature), loglik


class Normal(Model):
    """Normal noise with a scale for each sample."""


class NormalPooled(Model):
    """Normal noise with one scale."""

    by_sample = False

    def scales(self, y, mu):
        return np.full((1, y.shape[1]), max(math.sqrt(np.mean((y - mu) ** 2)), FLOOR))

    def loglik_of(self, rest, n):
        total, n = rest.sum((-2, -1)), n * rest.shape[-1]
        square = np.maximum(total / n, FLOOR**2)
        return -total / square / 2 - n * (np.log(square) + LOG_2PI) / 2

    def n_params(self, paths, samples):
        return paths * samples + 1


class OffsetLogNormal(Model):
    """Normal noise of log(y + alpha) with a scale for each sample; beta is greater than -alpha."""

    def __init__(self, alpha: float = 1.0, max_iter: int = 10_000) -> None:
        super().__init__(max_iter)
        self.alpha = alpha

    def link(self, t):
        return np.exp(t) - self.alpha

    def slope(self, t):
        return np.exp(t)

    def value(self, z):
        return np.log(np.maximum(z + self.alpha, 1e-300))

    def derivative(self, mu):
        return 1 / np.maximum(mu + self.alpha, 1e-300)

    def least(self, sums, sizes, short):
        """The square of the least residual, if all edges of a group share it, that closes the gap between both sides."""
        a, own = self.alpha, short + self.alpha
        top, off = np.maximum(sums + sizes * a, 1e-300), (sizes - 1) * a
        root = np.sqrt(off**2 + 4 * top * own)
        return np.log(np.where(top - off > own, (root - off) / (2 * own), (root + off) / (2 * top))) ** 2

    def star_betas(self, hubs, leaves):
        beta, converged = super().star_betas(hubs, leaves)
        if leaves.shape[1] == 1:  # two edges with one path: what the rounds come near to, exactly
            beta = np.exp((self.value(hubs[:, None]) + self.value(leaves)) / 2) - self.alpha
        return beta, converged

    def curvature(self, y, mu, scale):
        r = self.value(y) - self.value(mu)
        return (1 + r) / (mu + self.alpha) ** 2 / scale**2


class Laplace(Model):
    """Laplace noise; its curvature is 0, so standard errors are infinite."""

    def loss(self, r):
        return np.abs(r)

    def weight(self, r):
        return 1 / np.maximum(np.abs(r), 1e-8)

    def scales(self, y, mu):
        return np.maximum(np.mean(np.abs(y - mu), axis=0, keepdims=True), FLOOR)

    def statistic(self, y, mu):
        return np.abs(y - mu)

    def loglik_of(self, rest, n):
        total = rest.sum(-2)
        scale = np.maximum(total / n, FLOOR)
        return (-total / scale - n * np.log(2 * scale)).sum(-1)

    def least(self, sums, sizes, short):
        return np.abs(sums - short)

    def logpdf(self, y, mu, scale):
        return -np.abs(y - mu) / scale - np.log(2 * scale)

    def curvature(self, y, mu, scale):
        return np.zeros_like(mu)


class LaplacePooled(Laplace):
    by_sample = False

    def scales(self, y, mu):
        return np.full((1, y.shape[1]), max(np.mean(np.abs(y - mu)), FLOOR))

    def loglik_of(self, rest, n):
        total, n = rest.sum((-2, -1)), n * rest.shape[-1]
        scale = np.maximum(total / n, FLOOR)
        return -total / scale - n * np.log(2 * scale)

    def n_params(self, paths, samples):
        return paths * samples + 1


class StudentsT(Model):
    """Least squares betas; then t noise whose scale maximises the likelihood."""

    additive = by_sample = False

    def __init__(self, df: float = 5.0, max_iter: int = 10_000) -> None:
        super().__init__(max_iter)
        self.df = df

    def scales(self, y, mu):
        return self._scale_of((y - mu) ** 2, len(y))

    def loglik_of(self, rest, n):
        scale = self._scale_of(rest, n)
        missing = (n - rest.shape[-2]) * (self.logpdf(0, 0, scale))
        return (self.logpdf(np.sqrt(rest), 0, scale).sum(-2, keepdims=True) + missing).sum((-2, -1))

    def least(self, sums, sizes, short):
        return np.zeros(np.broadcast_shapes(sums.shape, short.shape))

    def _scale_of(self, square: np.ndarray, n: int) -> np.ndarray:
        """Fixed point of the likelihood's scale equation for n edges; those that are missing have no residual."""
        s = np.maximum(square.sum(-2, keepdims=True) / n, FLOOR**2)
        for _ in range(500):
            new = np.maximum(((self.df + 1) * square / (self.df + square / s)).sum(-2, keepdims=True) / n, FLOOR**2)
            if np.allclose(new, s, rtol=1e-12, atol=0):
                break
            s = new
        return np.sqrt(s)

    def logpdf(self, y, mu, scale):
        v = self.df
        constant = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - math.log(v * math.pi) / 2
        return constant - np.log(scale) - (v + 1) / 2 * np.log1p(((y - mu) / scale) ** 2 / v)

    def curvature(self, y, mu, scale):
        a, r = self.df * scale**2, y - mu
        return (self.df + 1) * (a - r * r) / (a + r * r) ** 2


class Huber(Model):
    """Betas by the Huber loss; the likelihood is that of the standard normal."""

    def __init__(self, delta: float = 1.0, max_iter: int = 10_000) -> None:
        super().__init__(max_iter)
        self.delta = delta

    def loss(self, r):
        a = np.abs(r)
        return np.where(a <= self.delta, r * r / 2, self.delta * (a - self.delta / 2))

    def weight(self, r):
        return np.minimum(1, self.delta / np.maximum(np.abs(r), 1e-300))

    def scales(self, y, mu):
        return np.ones((1, y.shape[1]))

    def loglik_of(self, rest, n):
        return (-rest.sum(-2) / 2 - n * LOG_2PI / 2).sum(-1)

    def n_params(self, paths, samples):
        return paths * samples


class NormalScaled2(Model):
    """Normal noise whose scale grows with the mean: s0 + s1 mu**alpha.

    Betas and scales are fitted in turns, ten times, the betas by scoring steps. All edges share the scales.
    """

    separable = by_sample = False

    def __init__(self, alpha: float = 1.0, max_iter: int = 10_000) -> None:
        super().__init__(max_iter)
        self.alpha = alpha

    def n_params(self, paths, samples):
        return paths * samples + 2

    def _scale(self, mu, raw):
        return np.maximum(_softplus(raw[0]) + _softplus(raw[1]) * np.maximum(mu, 0) ** self.alpha, FLOOR)

    def logpdf(self, y, mu, scale):
        return -(((y - mu) / scale) ** 2) / 2 - np.log(scale) - LOG_2PI / 2

    def curvature(self, y, mu, scale):
        step = 1e-4 * (1 + np.abs(mu))
        f = [self.logpdf(y, m, self._scale(m, self._raw)) for m in (mu - step, mu, mu + step)]
        return -(f[0] - 2 * f[1] + f[2]) / step**2

    def fit(self, y, x):
        y, x = np.asarray(y, float), np.asarray(x, float)
        shape = (x.shape[1], y.shape[1])
        raw, t = np.ones(2), np.ones(shape)

        def cost(t, raw):
            mu = x @ _softplus(t)
            return -self.logpdf(y, mu, self._scale(mu, raw)).sum()

        converged = True
        for _ in range(10):
            t, first = _descend(lambda v, raw=raw: cost(v.reshape(shape), raw), t.ravel(), self.max_iter)
            t = t.reshape(shape)
            raw, second = _descend(lambda v, t=t: cost(t, v), raw, self.max_iter)
            converged = first and second
        self._raw = raw
        beta = _softplus(t)
        mu = x @ beta
        return self._finish(y, x, beta, mu, self._scale(mu, raw), converged)


def _descend(cost: Callable, at: np.ndarray, max_iter: int) -> tuple[np.ndarray, bool]:
    """BFGS with central differences and halved steps."""

    def slope(v):
        h = 1e-5
        return np.array([(cost(v + h * e) - cost(v - h * e)) / (2 * h) for e in np.eye(len(v))])

    n, inverse = 0, np.eye(len(at))
    now, g = cost(at), slope(at)
    while n < max_iter and np.abs(g).max(initial=0) > 1e-5:
        n += 1
        d = -inverse @ g
        if d @ g >= 0:
            inverse, d = np.eye(len(at)), -g
        size = 1.0
        while size > 1e-10 and not cost(at + size * d) < now + 1e-4 * size * (d @ g):
            size /= 2
        if size <= 1e-10:
            break
        new = at + size * d
        then, h = cost(new), slope(new)
        s, u = new - at, h - g
        if s @ u > 1e-12:
            rho = 1 / (s @ u)
            left = np.eye(len(at)) - rho * np.outer(s, u)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
        small = abs(now - then) < 1e-12 * (1 + abs(now))
        at, now, g = new, then, h
        if small:
            break
    return at, n < max_iter


#: By name, with the usual settings.
MODELS: dict[str, Callable[..., Model]] = {
    "Default": OffsetLogNormal, "OffsetLogNormal": OffsetLogNormal, "Normal": Normal, "NormalPooled": NormalPooled, "NormalScaled2": NormalScaled2,
    "Laplace": Laplace, "LaplacePooled": LaplacePooled, "StudentsT": StudentsT, "Huber": Huber,
}
