"""Distribution primitives (P1-P11) on numpy generators and counter-based uniforms.

A uniform is a hash of (seed, iteration, document, position), so a draw depends on what is drawn
and never on partitioning, order or retries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

TINY = np.finfo(float).tiny


_PART = np.uint64(0x632BE59BD9B4E019)


def mixed(x: np.ndarray) -> np.ndarray:
    """The last part of ``hashed``, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def part(p: np.ndarray | int) -> np.ndarray:
    """What a part of a hash is combined with: ``mixed(x ^ part(p))``."""
    with np.errstate(over="ignore"):
        return np.asarray(p).astype(np.uint64) + _PART


def hashed(seed: int, *parts: np.ndarray | int) -> np.ndarray:
    """64-bit hashes of the parts, broadcast against each other."""
    with np.errstate(over="ignore"):
        x = np.asarray(np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        for p in parts:
            x = mixed(np.atleast_1d(x ^ part(p)))
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def uniforms(seed: int, *parts: np.ndarray | int) -> np.ndarray:
    """Uniforms in (0, 1) from the parts, broadcast against each other."""
    x = unit(hashed(seed, *parts))
    return x if any(np.ndim(p) for p in parts) else x.reshape(())


def dirichlet(rng: np.random.Generator, weights: np.ndarray) -> np.ndarray:
    """Rows of Dirichlet draws by normalised gammas, floored at the smallest normal number; zero weights give zero."""
    g = rng.standard_gamma(np.maximum(weights, 0))
    g = np.where(weights > 0, np.maximum(g, TINY), 0.0)
    total = g.sum(-1, keepdims=True)
    return np.divide(g, total, out=np.zeros_like(g), where=total > 0)


def keep_mass(current: np.ndarray, fresh: np.ndarray, subset: np.ndarray) -> np.ndarray:
    """Rows of ``current`` whose coordinates in ``subset`` take the proportions of ``fresh`` and keep the mass that they had."""
    out = current.copy()
    new = fresh[..., subset]
    total = new.sum(-1, keepdims=True)
    mass = current[..., subset].sum(-1, keepdims=True)
    out[..., subset] = np.where(total > 0, new / np.where(total > 0, total, 1) * mass, current[..., subset])
    return out


def conditional_dirichlet(rng: np.random.Generator, current: np.ndarray, weights: np.ndarray, subset: np.ndarray) -> np.ndarray:
    """Redraw a subset of coordinates and keep the mass that it had."""
    fresh = np.zeros_like(current)
    fresh[..., subset] = dirichlet(rng, weights[..., subset])
    return keep_mass(current, fresh, subset)


def polya_urn(rng: np.random.Generator, counts: np.ndarray, beta: float) -> np.ndarray:
    """Rows of normalised Poisson(beta + n) draws, sparse where counts are; a row that draws nothing falls back to a Dirichlet."""
    x = rng.poisson(counts + beta).astype(float)
    total = x.sum(1, keepdims=True)
    out = np.divide(x, total, out=np.zeros_like(x), where=total > 0)
    for k in np.flatnonzero(total[:, 0] == 0):
        out[k] = dirichlet(rng, counts[k] + beta)
    return out


def spike_dirichlet(rng: np.random.Generator, counts: np.ndarray, beta: float, prior: float) -> np.ndarray:
    """Variable selection: types without a token of the topic stay out, except with the odds of prior times a Beta-function ratio."""
    out = np.zeros_like(counts, float)
    for k, n in enumerate(counts):
        used = n > 0
        active = used.sum() * beta + n.sum()
        # adding one absent type multiplies the marginal by B(active + beta) / B(active) of its Dirichlet
        ratio = np.exp(_lgamma(used.sum() * beta + beta) - _lgamma(max(used.sum(), 1) * beta) + _lgamma(active) - _lgamma(active + beta)) if n.sum() else 1.0
        p = prior * ratio / (prior * ratio + 1 - prior)
        keep = used | (rng.random(len(n)) < p)
        if not keep.any():
            keep[:] = True
        out[k] = dirichlet(rng, np.where(keep, n + beta, 0.0))
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: recurrence up to 6, then the asymptotic series."""
    x = np.asarray(x, float)
    add = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        add = np.where(low, add - 1 / np.where(low, x, 1), add)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return add + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def _lgamma(x: float) -> float:
    import math

    return math.lgamma(max(x, TINY))


def binomials(rng: np.random.Generator, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P7."""
    return rng.binomial(n, np.clip(p, 0, 1))


def multinomial(rng: np.random.Generator, n: int, p: np.ndarray) -> np.ndarray:
    return rng.multinomial(n, p / p.sum())


def alias_tables(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walker tables (threshold, alias) for each row of weights."""
    w = np.atleast_2d(np.asarray(weights, float))
    rows, k = w.shape
    total = w.sum(1, keepdims=True)
    p = np.where(total > 0, w / np.where(total > 0, total, 1), 1.0 / k) * k
    cut, alias = np.ones((rows, k)), np.tile(np.arange(k), (rows, 1))
    r, low, high = np.arange(rows), p.copy(), p.copy()  # low and high: what is left, closed cells at +inf and -inf
    for _ in range(k - 1):  # each step closes the smallest cell of every row and fills it from the largest
        s, g = low.argmin(1), high.argmax(1)
        q = np.minimum(low[r, s], 1.0)
        cut[r, s], alias[r, s] = q, g
        low[r, g] -= 1 - q
        high[r, g] = low[r, g]
        low[r, s], high[r, s] = np.inf, -np.inf
    return cut, alias


class AliasCache:
    """Tables of the rows of a weight matrix, built for a row when it is first asked for and kept for the sweep."""

    def __init__(self, weights: Callable[[np.ndarray], np.ndarray], rows: int) -> None:
        self.weights, self.place = weights, np.full(rows, -1)
        self.cut = self.alias = self.mass = None

    def at(self, rows: np.ndarray) -> None:
        """Build what is missing of these distinct rows."""
        new = rows[self.place[rows] < 0]
        if not len(new):
            return
        w = self.weights(new)
        cut, alias = alias_tables(w)
        have = 0 if self.cut is None else len(self.cut)
        self.place[new] = have + np.arange(len(new))
        join = lambda old, x: x if old is None else np.concatenate([old, x])
        self.cut, self.alias, self.mass = join(self.cut, cut), join(self.alias, alias), join(self.mass, w.sum(1))


def alias_draw(cut: np.ndarray, alias: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A draw from each row's table by one uniform."""
    k = cut.shape[1]
    i = np.minimum((u * k).astype(int), k - 1)
    r = np.arange(len(u))
    return np.where(u * k - i < cut[r, i], i, alias[r, i])


def without_replacement(rng: np.random.Generator, n: int, size: int) -> np.ndarray:
    """Distinct indices, sorted."""
    return np.sort(rng.permutation(n)[:size])


def search_cumulative(cumulative: np.ndarray, u: float) -> int:
    """P10: first index whose cumulative weight exceeds u times the total."""
    return int(np.searchsorted(cumulative, u * cumulative[-1], "right"))


#: How phi is drawn from counts, by name.
PHI_DRAWS: dict[str, Callable[..., np.ndarray]] = {
    "dirichlet": lambda rng, n, beta, **_: dirichlet(rng, n + beta),
    "polya_urn": lambda rng, n, beta, **_: polya_urn(rng, n, beta),
    "variable_selection": lambda rng, n, beta, prior=0.5, **_: spike_dirichlet(rng, n, beta, prior),
}
