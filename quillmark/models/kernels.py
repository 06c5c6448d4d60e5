"""Sweeps over the tokens of a batch of documents, vectorised over documents: step t visits token t of each.

Documents are independent given phi, so visiting them side by side is exact for the uncollapsed
samplers. The collapsed ones share word counts; a batch reads the counts of the last sweep with its
own changes so far, as the approximate distributed sampler does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillmark.models.draws import AliasCache, alias_draw, hashed, mixed, part, uniforms, unit


class Batch:
    """Token lists padded to a rectangle, longest documents first so that the active ones are a prefix."""

    def __init__(self, ids: np.ndarray, types: list[np.ndarray], z: list[np.ndarray] | None, k: int) -> None:
        length = np.array([len(t) for t in types], int)
        self.order = np.argsort(-length, kind="stable")
        self.ids, self.length, self.k = ids[self.order], length[self.order], k
        width = int(length.max(initial=0))
        self.types = np.zeros((len(ids), width), np.int64)
        self.z = np.full((len(ids), width), -1, np.int64)
        for i, j in enumerate(self.order):
            self.types[i, : length[j]] = types[j]
            if z is not None:
                self.z[i, : length[j]] = z[j]
        self.counts = np.zeros((len(ids), k))
        if z is not None:
            r, c = np.nonzero(self.z >= 0)
            np.add.at(self.counts, (r, self.z[r, c]), 1)

    def active(self, t: int) -> int:
        return int(np.searchsorted(-self.length, -t, "left"))

    def lists(self) -> list[np.ndarray]:
        """Topic lists in the order that the documents came in."""
        out: list = [None] * len(self.ids)
        for i, j in enumerate(self.order):
            out[j] = self.z[i, : self.length[i]].astype(np.int32)
        return out


def _pick(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    c = np.cumsum(p, 1)
    return np.minimum((c <= (u * c[:, -1])[:, None]).sum(1), p.shape[1] - 1)


def _pick_near(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The same draw, its cumulative sum taken from whichever end is nearer to ``u``."""
    k = p.shape[1]
    z = np.empty(len(u), np.int64)
    low = u < 0.5
    c = np.cumsum(p[low], 1)
    z[low] = (c <= (u[low] * c[:, -1])[:, None]).sum(1)
    c = np.cumsum(p[~low][:, ::-1], 1)
    z[~low] = k - 1 - (c < ((1 - u[~low]) * c[:, -1])[:, None]).sum(1)
    return np.clip(z, 0, k - 1)


def initialise(b: Batch, seed: int, allowed: np.ndarray | None = None) -> None:
    """Uniform topics, among the allowed ones of a document."""
    for t in range(b.types.shape[1]):
        n = b.active(t)
        mask = np.ones((n, b.k)) if allowed is None else allowed[:n]
        b.z[:n, t] = _pick(mask, uniforms(seed, 0, b.ids[:n], t))
    r, c = np.nonzero(b.z >= 0)
    np.add.at(b.counts, (r, b.z[r, c]), 1)


def sweep(b: Batch, phi: np.ndarray, alpha: np.ndarray, seed: int, iteration: int, allowed: np.ndarray | None = None, pick=_pick) -> None:
    """p(z = k) in proportion to (n_dk + alpha_k) phi_kw. ``phi``: types by topics; L2 picks by ``_pick_near``."""
    for t in range(b.types.shape[1]):
        n = b.active(t)
        r = np.arange(n)
        b.counts[r, b.z[:n, t]] -= 1
        p = (b.counts[:n] + alpha) * phi[b.types[:n, t]]
        if allowed is not None:
            p = p * allowed[:n]
        dead = p.sum(1) <= 0  # phi may be zero for a type in every topic that is left
        if dead.any():
            p[dead] = (b.counts[:n] + alpha)[dead] * (1.0 if allowed is None else allowed[:n][dead])
        b.z[:n, t] = pick(p, uniforms(seed, iteration, b.ids[:n], t))
        b.counts[r, b.z[:n, t]] += 1


def sparse_sweep(b: Batch, phi: np.ndarray, alpha: np.ndarray, seed: int, iteration: int, allowed: np.ndarray | None = None, tables: AliasCache | None = None) -> None:
    """L3, L4: the same target, split into a prior part, drawn from a table of the word, and the document's part.

    ``tables`` of phi times alpha are shared by the batches of a sweep.
    """
    if allowed is not None:
        return sweep(b, phi, alpha, seed, iteration, allowed)
    used = np.unique(b.types[b.z >= 0])
    if not len(used):
        return
    tables = tables or AliasCache(lambda rows: phi[rows] * alpha, phi.shape[0])
    tables.at(used)
    mass, cut, alias, place = tables.mass, tables.cut, tables.alias, tables.place
    for t in range(b.types.shape[1]):
        n = b.active(t)
        r, w = np.arange(n), place[b.types[:n, t]]
        b.counts[r, b.z[:n, t]] -= 1
        p = b.counts[:n] * phi[b.types[:n, t]]
        doc = p.sum(1)
        u = uniforms(seed, iteration, b.ids[:n], t)
        total = doc + mass[w]
        x = u * total
        from_prior = (x < mass[w]) | (doc <= 0)
        ua = np.clip(np.where(mass[w] > 0, x / np.where(mass[w] > 0, mass[w], 1), u), 0, 1 - 1e-12)
        ua = np.where(total > 0, ua, u)
        ud = np.clip((x - mass[w]) / np.where(doc > 0, doc, 1), 0, 1 - 1e-12)
        z = np.where(from_prior, alias_draw(cut[w], alias[w], ua), _pick(p + 1e-300, ud))
        b.z[:n, t] = z
        b.counts[r, z] += 1


def collapsed_sweep(b: Batch, word_topic: np.ndarray, totals: np.ndarray, alpha: np.ndarray, beta: float, seed: int, iteration: int, allowed: np.ndarray | None = None) -> None:
    """p(z = k) in proportion to (n_dk + alpha_k) (n_wk + beta) / (n_k + V beta); counts are the batch's own copy."""
    v = word_topic.shape[0]
    for t in range(b.types.shape[1]):
        n = b.active(t)
        r, w, old = np.arange(n), b.types[:n, t], b.z[:n, t]
        b.counts[r, old] -= 1
        np.add.at(word_topic, (w, old), -1)
        np.add.at(totals, old, -1)
        p = (b.counts[:n] + alpha) * (np.maximum(word_topic[w], 0) + beta) / (np.maximum(totals, 0) + v * beta)
        if allowed is not None:
            p = p * allowed[:n]
        z = _pick(p, uniforms(seed, iteration, b.ids[:n], t))
        b.z[:n, t] = z
        b.counts[r, z] += 1
        np.add.at(word_topic, (w, z), 1)
        np.add.at(totals, z, 1)


def proposal_sweep(b: Batch, phi: np.ndarray, word_proposal: np.ndarray, alpha: np.ndarray, seed: int, iteration: int, shared: tuple[np.ndarray, np.ndarray, float] | None = None, allowed: np.ndarray | None = None, tables: AliasCache | None = None) -> None:
    """Metropolis-Hastings with a word proposal (a table of ``word_proposal``) and then a document proposal.

    ``shared`` (word_topic, totals, beta) makes it collapsed: the target takes the place of ``phi`` from these
    counts without the token itself, and each move is added to them; ``word_proposal`` must be a copy.

    Unlike a shortcut that holds for symmetric alpha only (Q24), both topics use their own alpha.
    """
    used = np.unique(b.types[b.z >= 0])
    if not len(used):
        return
    tables = tables or AliasCache(lambda rows: word_proposal[rows], len(word_proposal))
    tables.at(used)
    cut, alias, place = tables.cut, tables.alias, tables.place
    a_sum = alpha.sum()
    a_cum = np.cumsum(alpha)
    for t in range(b.types.shape[1]):
        n = b.active(t)
        r, w, z = np.arange(n), b.types[:n, t], b.z[:n, t].copy()
        start = z.copy()
        if shared is None:
            word = lambda k: phi[w, k]  # noqa: E731, B023
        else:
            own, totals, beta = shared
            np.add.at(own, (w, start), -1)
            np.add.at(totals, start, -1)
            word = lambda k: (np.maximum(own[w, k], 0) + beta) / (np.maximum(totals[k], 0) + len(own) * beta)  # noqa: E731, B023
        may = (lambda k: 1.0) if allowed is None else (lambda k: allowed[r, k])  # noqa: E731, B023
        target = lambda k: (b.counts[r, k] - (k == start) + alpha[k]) * word(k) * may(k)  # noqa: E731, B023
        u = [uniforms(seed, iteration, b.ids[:n], t, i) for i in range(5)]
        new = alias_draw(cut[place[w]], alias[place[w]], u[0])
        ratio = target(new) * word_proposal[w, z] / np.maximum(target(z) * word_proposal[w, new], 1e-300)
        z = np.where(u[1] < ratio, new, z)
        length = b.length[:n]
        from_tokens = u[2] * (length + a_sum) < length
        at = np.minimum((u[3] * length).astype(int), length - 1)
        other = np.where(at == t, start, b.z[r, at])
        new = np.where(from_tokens, other, np.minimum(np.searchsorted(a_cum, u[3] * a_sum, "right"), b.k - 1))
        q = lambda k: b.counts[r, k] + alpha[k]  # noqa: E731, B023
        ratio = target(new) * q(z) / np.maximum(target(z) * q(new), 1e-300)
        z = np.where(u[4] < ratio, new, z)
        b.counts[r, start] -= 1
        b.counts[r, z] += 1
        b.z[:n, t] = z
        if shared is not None:
            np.add.at(own, (w, z), 1)
            np.add.at(totals, z, 1)


def left_to_right(types: np.ndarray, phi: np.ndarray, alpha: np.ndarray, doc_id: int, seed: int, particles: int = 100) -> float:
    """Log probability of a document by the left-to-right estimator without resampling."""
    n = np.zeros((particles, len(alpha)))
    total, a_sum = 0.0, alpha.sum()
    for t, w in enumerate(types):
        p = (n + alpha) / (t + a_sum) * phi[w]
        total += float(np.log(max(p.sum(1).mean(), 1e-300)))
        z = _pick(p + 1e-300, uniforms(seed, doc_id, t, np.arange(particles)))
        n[np.arange(particles), z] += 1
    return total


class Steps:
    """The tokens of a batch in the order of the sweep: token t of all documents that have one stand together, longest documents first.

    Nothing is padded, and ``counts`` is topics by documents, so each step works on rows as long as the documents it
    visits. The sweeps over it draw what those over ``Batch`` draw. ``types`` and ``z``: Arrow lists.
    """

    def __init__(self, ids: np.ndarray, types: pa.Array, z: pa.Array | None, k: int, seed: int = 0) -> None:
        self.size = types.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.order = np.argsort(-self.size, kind="stable")
        self.ids, self.k, n = ids[self.order], k, len(ids)
        length = self.size[self.order]
        self.start = np.append(0, np.cumsum(np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")))
        rank = np.empty(n, np.int64)
        rank[self.order] = np.arange(n)
        t = np.arange(self.size.sum()) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.place = self.start[t] + np.repeat(rank, self.size)
        self.types, self.who, self.z, at = (np.empty(len(t), np.int64) for _ in range(4))
        self.types[self.place], self.who[self.place], at[self.place] = types.flatten().to_numpy(zero_copy_only=False), np.repeat(rank, self.size), t
        self.at = part(at)
        if z is not None:
            self.z[self.place] = z.flatten().to_numpy(zero_copy_only=False)
        else:  # L20: uniform topics
            for a, b, u in self._uniforms(seed, 0):
                self.z[a:b] = np.minimum((u * k).astype(np.int64), k - 1)
        self.counts = np.bincount(self.z * n + self.who, minlength=k * n).reshape(k, n).astype(float)

    def _uniforms(self, seed: int, iteration: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """The uniforms of whole steps, some ten thousand tokens at a time."""
        x = hashed(seed, iteration, self.ids)
        a = 0
        while a < len(self.z):
            s = int(np.searchsorted(self.start, a + 30_000))
            b = int(self.start[min(s, len(self.start) - 1)])
            yield a, b, unit(mixed(x[self.who[a:b]] ^ self.at[a:b]))
            a = b

    def steps(self, seed: int, iteration: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """First token, number of documents and uniforms of each step."""
        t = 0
        for a, b, u in self._uniforms(seed, iteration):
            while self.start[t] < b:
                o, e = int(self.start[t]), int(self.start[t + 1])
                yield o, e - o, u[o - a : e - a]
                t += 1

    def columns(self, phi: np.ndarray) -> list[np.ndarray]:
        """phi of the tokens of each step, topics by documents, for many sweeps under one phi."""
        return [np.ascontiguousarray(phi[self.types[a:b]].T) for a, b in zip(self.start[:-1], self.start[1:])]

    def lists(self) -> pa.Array:
        """Topic lists in the order that the documents came in."""
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.size)), pa.int32()), pa.array(self.z[self.place], pa.int32()))


def _pick_column(c: np.ndarray, u: np.ndarray, below: np.ndarray) -> np.ndarray:
    """``_pick`` where the columns of ``c`` are cumulative sums."""
    if len(c) > 255:
        return (c[:-1] <= u * c[-1]).sum(0)
    np.less_equal(c[:-1], u * c[-1], out=below)
    return np.add.reduce(below.view(np.uint8), 0, dtype=np.uint8).astype(np.int64)


def step_sweep(b: Steps, phi: np.ndarray, alpha: np.ndarray, seed: int, iteration: int, columns: list[np.ndarray] | None = None) -> None:
    """``sweep`` without priors of documents; ``columns``: ``b.columns(phi)``."""
    k, n_docs = b.counts.shape
    flat, a, every = b.counts.reshape(-1), alpha[:, None], np.arange(n_docs)
    room, below = np.empty((k, n_docs)), np.empty((k - 1, n_docs), bool)
    for t, (o, n, u) in enumerate(b.steps(seed, iteration)):
        doc = every[:n]
        flat[b.z[o : o + n] * n_docs + doc] -= 1
        c = room[:, :n]
        np.add(b.counts[:, :n], a, out=c)
        c *= phi[b.types[o : o + n]].T if columns is None else columns[t]
        np.add.accumulate(c, 0, out=c)
        if c[-1].min() <= 0:  # phi may be zero for a type in every topic
            dead = c[-1] <= 0
            c[:, dead] = np.cumsum(b.counts[:, :n][:, dead] + a, 0)
        z = _pick_column(c, u, below[:, :n])
        b.z[o : o + n] = z
        flat[z * n_docs + doc] += 1


def step_sparse_sweep(b: Steps, phi: np.ndarray, alpha: np.ndarray, seed: int, iteration: int, tables: AliasCache) -> None:
    """``sparse_sweep`` without priors of documents: the alias tables are asked for the tokens only that are drawn from the prior part."""
    k, n_docs = b.counts.shape
    if not len(b.z):
        return
    tables.at(np.flatnonzero(np.bincount(b.types)))
    mass, cut, alias, place = tables.mass, tables.cut.reshape(-1), tables.alias.reshape(-1), tables.place
    flat, every = b.counts.reshape(-1), np.arange(n_docs)
    room, below = np.empty((k, n_docs)), np.empty((k - 1, n_docs), bool)
    for o, n, u in b.steps(seed, iteration):
        doc, types = every[:n], b.types[o : o + n]
        w = place[types]
        flat[b.z[o : o + n] * n_docs + doc] -= 1
        c = room[:, :n]
        np.multiply(b.counts[:, :n], phi[types].T, out=c)
        np.add.accumulate(c, 0, out=c)
        own, prior = c[-1], mass[w]
        total = own + prior
        x = u * total
        i = np.flatnonzero((x < prior) | (own <= 0))
        x -= prior
        x /= np.maximum(own, 1e-300)
        z = _pick_column(c, np.clip(x, 0, 1 - 1e-12, out=x), below[:, :n])
        if len(i):
            m, v = prior[i], u[i]
            v = np.clip(np.where(m > 0, v * total[i] / np.where(m > 0, m, 1), v), 0, 1 - 1e-12) * k
            j = np.minimum(v.astype(np.int64), k - 1)
            at = w[i] * k + j
            z[i] = np.where(v - j < cut[at], j, alias[at])
        b.z[o : o + n] = z
        flat[z * n_docs + doc] += 1


def step_collapsed_sweep(b: Steps, word_topic: np.ndarray, totals: np.ndarray, alpha: np.ndarray, beta: float, seed: int, iteration: int) -> None:
    """``collapsed_sweep`` without priors of documents. ``word_topic``: contiguous."""
    k, n_docs = b.counts.shape
    flat, cells, a, every = b.counts.reshape(-1), word_topic.reshape(-1), alpha[:, None], np.arange(n_docs)
    room, below, rest = np.empty((k, n_docs)), np.empty((k - 1, n_docs), bool), len(word_topic) * beta
    for o, n, u in b.steps(seed, iteration):
        doc, w, z = every[:n], b.types[o : o + n], b.z[o : o + n]
        base = w * k
        flat[z * n_docs + doc] -= 1
        np.add.at(cells, base + z, -1.0)
        totals -= np.bincount(z, minlength=k)
        c = room[:, :n]
        np.add(b.counts[:, :n], a, out=c)
        words = word_topic[w]
        np.maximum(words, 0, out=words)
        words += beta
        c *= words.T
        c /= (np.maximum(totals, 0) + rest)[:, None]
        np.add.accumulate(c, 0, out=c)
        z = _pick_column(c, u, below[:, :n])
        b.z[o : o + n] = z
        flat[z * n_docs + doc] += 1
        np.add.at(cells, base + z, 1.0)
        totals += np.bincount(z, minlength=k)


def left_to_right_all(ids: np.ndarray, types: pa.Array, phi: np.ndarray, alpha: np.ndarray, seed: int, particles: int = 100, cells: int = 50_000) -> np.ndarray:
    """``left_to_right`` of a batch of documents: the particles of some documents of like length, ``cells`` numbers, take each step together."""
    k, a_sum, a = len(alpha), alpha.sum(), alpha[:, None]
    order = np.argsort(-types.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), kind="stable")
    group, each = max(1, cells // (k * particles)), part(np.arange(particles))
    out = np.zeros(len(ids))
    for g in range(0, len(ids), group):
        at = order[g : g + group]
        b = Steps(ids[at], types.take(pa.array(at)), None, k)
        width = len(at) * particles
        counts, room, below, every = np.zeros((k, width)), np.empty((k, width)), np.empty((k - 1, width), bool), np.arange(width)
        flat, cube, x, total = counts.reshape(-1), room.reshape(k, len(at), particles), hashed(seed, b.ids), np.zeros(len(at))
        for t, (o, e) in enumerate(zip(b.start[:-1], b.start[1:])):
            n, m = e - o, (e - o) * particles
            c = room[:, :m]
            np.add(counts[:, :m], a, out=c)
            cube[:, :n] *= (phi[b.types[o:e]] / (t + a_sum)).T[:, :, None]
            np.add.accumulate(c, 0, out=c)
            total[:n] += np.log(np.maximum(c[-1].reshape(n, particles).mean(1), 1e-300))
            if c[-1].min() <= 0:  # a type that phi has in no topic tells nothing of its topic
                c[:, c[-1] <= 0] = np.arange(1.0, k + 1)[:, None]
            u = unit(mixed(mixed(x[:n] ^ part(t))[:, None] ^ each)).reshape(m)
            flat[_pick_column(c, u, below[:, :m]) * width + every[:m]] += 1
        out[at] = total
    return out
