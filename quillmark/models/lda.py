"""Topic models by parallel Gibbs sampling.

State is a table (doc_id, types, z), rewritten by each sweep in the shared folder. Sweeps run as Arrow
batches on the workers; counts are aggregated in Spark; phi (K by V, so bounded by the frozen
vocabulary, see ``MOST_CELLS``) is drawn on the driver and broadcast. Every draw is seeded by
(seed, iteration, document, position): the same seed gives the same model under any partitioning.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.models import draws, kernels
from quillmark.models.scan import Scan
from quillmark.operators.storage import Stored, exists, store
from quillmark.operators.topics import log_likelihood

MOST_CELLS = 200_000_000
#: Most cells that a task counts in one array.
MOST_COUNTED = 2_000_000
#: Most numbers of phi that are laid out for the tokens of a batch (8 bytes each); beyond it each sweep looks them up.
MOST_GATHERED = 20_000_000
# The names of the schemes, as configuration files write them; kernel and draw are ours.
SCHEMES = {
    "uncollapsed": ("dense", "dirichlet"), "efficient_uncollapsed": ("ends", "dirichlet"), "spalias": ("sparse", "dirichlet"), "polyaurn": ("sparse", "polya_urn"),
    "polyaurn_priors": ("dense", "polya_urn"), "spalias_priors": ("dense", "dirichlet"), "adlda": ("collapsed", None), "collapsed": ("serial", None), "lightcollapsed": ("light_counts", None),
    "lightpclda": ("light_phi", "dirichlet"), "lightpclda_proposal": ("light_types", "dirichlet"), "nzvsspalias": ("sparse", "variable_selection"), "ppu_hdplda_all_topics": ("hdp", "polya_urn"),
}
REFUSED = ("ppu_hdplda", "ppu_hlda")


@dataclass
class Settings:
    """Hyperparameters and run options; ``alpha`` is one number or one for each topic."""

    topics: int = 10
    alpha: float | list[float] = 5.0
    beta: float = 0.01
    iterations: int = 20
    scheme: str = "polyaurn"
    seed: int = 4711
    burn_in: float = 0.5
    thin: int = 1
    hyper_interval: int = 0
    symmetric_alpha: bool = True
    selection_prior: float = 0.5
    hdp_gamma: float = 1.0
    report_interval: int = 0
    start_topics: int = 0  # topics that the first assignment uses (L13); 0 for all
    phi_builder: str | None = None  # P11: another draw of phi than the scheme's own
    phi_types: Callable[[int], np.ndarray] | None = field(default=None, repr=False)
    scan: Scan | None = field(default=None, repr=False)

    def alphas(self) -> np.ndarray:
        a = np.asarray(self.alpha, float)
        return np.full(self.topics, float(a)) if a.ndim == 0 else a


def scheme(name: str) -> tuple[str, str | None]:
    """Kernel and phi draw of a scheme; refused and unknown ones raise."""
    if name in REFUSED:
        raise NotImplementedError(f"{name} isn't verified and doesn't run")
    if name not in SCHEMES:
        raise ValueError(f"unknown scheme {name}")
    return SCHEMES[name]


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _out(b: pa.RecordBatch, batch: kernels.Batch | kernels.Steps) -> pa.RecordBatch:
    z = batch.lists()
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), z if isinstance(z, pa.Array) else pa.array(z, pa.list_(pa.int32()))], names=["doc_id", "types", "z"])


def _numbers(largest: int) -> np.dtype:
    return np.dtype(np.uint8 if largest <= 1 << 8 else np.uint16 if largest <= 1 << 16 else np.int32)


def _packed(lists: pa.Array, kind: np.dtype) -> pa.Array:
    """Lists of numbers as one binary value each: it passes the JVM without a step for each token."""
    given = lists.flatten().to_numpy(zero_copy_only=False)
    flat = given.astype(kind)
    if (flat != given).any():
        raise ValueError("a type or topic is out of range")
    ends = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))) * kind.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: np.dtype) -> pa.Array:
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]) // kind.itemsize, pa.int32()), pa.array(flat))


class State:
    """The written state: ``packed`` (doc_id, types, z as binary) reads the file, ``df`` has the arrays."""

    def __init__(self, stored: Stored, kinds: tuple[np.dtype, np.dtype]) -> None:
        self.stored, self.packed = stored, stored.df

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), *(_unpacked(b.column(i + 1), x) for i, x in enumerate(kinds))], names=["doc_id", "types", "z"])

        self.df = self.packed.mapInArrow(run, SCHEMA)

    @classmethod
    def of(cls, arrays: DataFrame, kinds: tuple[np.dtype, np.dtype]) -> State:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pack(b, kinds)

        return cls(store(arrays.select("doc_id", "types", "z").mapInArrow(run, PACKED), "state"), kinds)

    def drop(self) -> None:
        self.stored.drop()


def pack(b: pa.RecordBatch, kinds: tuple[np.dtype, np.dtype]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), *(_packed(b.column(i + 1), x) for i, x in enumerate(kinds))], names=["doc_id", "types", "z"])


def _rows(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


SCHEMA = "doc_id long, types array<int>, z array<int>"
PACKED = "doc_id long, types binary, z binary"


class TopicModel:
    """A model over ``corpus`` (doc_id, types) with a frozen vocabulary of ``n_types`` types.

    Documents without tokens keep an empty topic list. ``topic_priors`` is a K x V array of 0 and 1;
    ``doc_priors`` a table (doc_id, allowed array<int>).
    """

    def __init__(self, corpus: DataFrame, n_types: int, settings: Settings, topic_priors: np.ndarray | None = None, doc_priors: DataFrame | None = None) -> None:
        self.kernel, self.phi_draw = scheme(settings.scheme)
        self.phi_draw = self.phi_draw and (settings.phi_builder or self.phi_draw)
        if n_types * settings.topics > MOST_CELLS:
            raise ValueError("topics x types is too large for one broadcast matrix: prune the vocabulary")
        if topic_priors is not None and (not topic_priors.any(1).all() or not topic_priors.any(0).all()):
            raise ValueError("topic priors rule out a whole topic or type")
        self.s, self.n_types, self.spark = settings, n_types, corpus.sparkSession
        self.alpha, self.beta = settings.alphas(), settings.beta
        self.priors = topic_priors
        self.iteration, self.aborted = 0, False
        self.phi: np.ndarray | None = None
        self._phi_sum, self._phi_n = None, 0
        self.history: list[dict] = []
        self.psi: np.ndarray | None = None
        self.n = self.changed = None
        self.visited: DataFrame | None = None
        if doc_priors is not None:
            corpus = corpus.join(doc_priors.select("doc_id", "allowed"), "doc_id", "left")
        else:
            corpus = corpus.withColumn("allowed", F.lit(None).cast("array<int>"))
        self.with_priors = doc_priors is not None
        k, seed, kinds = settings.topics, settings.seed, self.kinds()
        first = np.where(np.arange(k) < settings.start_topics, 1.0, 0.0) if 0 < settings.start_topics < k else None

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows and len(b.column(1).flatten()) and b.column(1).flatten().to_numpy(zero_copy_only=False).max() >= n_types:
                    raise ValueError("a type is outside the vocabulary")
                if b.num_rows and first is None and b.column(2).null_count == b.num_rows:
                    yield pack(_out(b, kernels.Steps(b.column(0).to_numpy(), b.column(1), None, k, seed)), kinds)
                elif b.num_rows:
                    x = kernels.Batch(b.column(0).to_numpy(), _lists(b.column(1)), None, k)
                    mask = _allowed(b.column(2), x, k)
                    if first is not None and mask is None:
                        mask = np.broadcast_to(first, (len(x.ids), k))
                    kernels.initialise(x, seed, mask)
                    yield pack(_out(b, x), kinds)

        self.doc_priors = store(corpus.where("allowed IS NOT NULL").select("doc_id", "allowed"), "doc-priors") if self.with_priors else None
        self.state = State(store(corpus.select("doc_id", "types", "allowed").mapInArrow(start, PACKED), "state"), kinds)
        self._draw_phi()

    def kinds(self) -> tuple[np.dtype, np.dtype]:
        """The numbers that types and topics are written as."""
        return _numbers(self.n_types), _numbers(self.s.topics)

    # counts -------------------------------------------------------------------------------------
    def assign(self) -> DataFrame:
        """doc_id, pos, type_id, topic."""
        return self.state.df.select("doc_id", F.posexplode(F.arrays_zip("types", "z")).alias("pos", "x")).select("doc_id", "pos", F.col("x.types").alias("type_id"), F.col("x.z").alias("topic"))

    def counts(self) -> np.ndarray:
        """K x V counts of the current state, counted inside the batches first."""
        v, cells, kinds = self.n_types, self.s.topics * self.n_types, self.kinds()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = lambda cell, n: pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])
            whole = np.zeros(cells, np.int64) if cells <= MOST_COUNTED else None
            for b in batches:
                types, z = (_unpacked(b.column(i), x).values.to_numpy() for i, x in enumerate(kinds))
                cell = z.astype(np.int64) * v + types
                if whole is None:
                    yield out(*np.unique(cell, return_counts=True))
                else:
                    whole += np.bincount(cell, minlength=cells)
            if whole is not None:
                yield out(np.flatnonzero(whole), whole[whole > 0])

        rows = self.state.packed.select("types", "z").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros(cells)
        n[rows["cell"].to_numpy(int)] = rows["n"]
        return n.reshape(self.s.topics, v)

    def _draw_phi(self) -> None:
        before, self.n = self.n, self.counts()
        self.changed = np.ones(self.n_types, bool) if before is None else (before != self.n).any(0)
        if self.phi_draw is None:
            self.phi = (self.n + self.beta) / (self.n + self.beta).sum(1, keepdims=True)
        else:
            rng = np.random.default_rng([self.s.seed, self.iteration, 1])
            new = draws.PHI_DRAWS[self.phi_draw](rng, self.n, self.beta, prior=self.s.selection_prior)
            if self.priors is not None:
                new = new * self.priors
                total = new.sum(1, keepdims=True)
                new = np.where(total > 0, new / np.where(total > 0, total, 1), self.priors / self.priors.sum(1, keepdims=True))
            self.phi = new if self.phi is None else self._scanned(new)
        if self.iteration >= self.s.burn_in * self.s.iterations and self.iteration % self.s.thin == 0:
            self._phi_sum = self.phi if self._phi_sum is None else self._phi_sum + self.phi
            self._phi_n += 1

    def _scanned(self, new: np.ndarray) -> np.ndarray:
        """What of a fresh phi the scan policies let in: some topics only, and some types only, which keep their mass."""
        scan = self.s.scan
        types = self.s.phi_types(self.iteration) if self.s.phi_types is not None else scan.types(self.iteration, self.n, self.changed) if scan else None
        out = new if types is None else draws.keep_mass(self.phi, new, types)
        topics = scan.topics(self.iteration) if scan else None
        if topics is None:
            return out
        kept = self.phi.copy()
        kept[topics] = out[topics]
        return kept

    # sweeps -------------------------------------------------------------------------------------
    def _sweep(self) -> None:
        spark, k, seed, it, kernel, beta, kinds = self.spark, self.s.topics, self.s.seed, self.iteration, self.kernel, self.beta, self.kinds()
        alpha = self.alpha if self.psi is None else self.alpha.sum() * self.psi
        shared = spark.sparkContext.broadcast((np.ascontiguousarray(self.phi.T), self.n.T.copy() if kernel in ("collapsed", "serial", "light_counts", "light_types") else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phi, n = shared.value
            own = n.copy() if n is not None else None
            totals = own.sum(0) if own is not None else None
            weights = {"light_counts": lambda rows: n[rows] + beta, "light_phi": lambda rows: phi[rows] + 1e-12, "light_types": lambda rows: n[rows] + beta}.get(kernel, lambda rows: phi[rows] * alpha)
            tables = draws.AliasCache(weights, len(phi))
            proposal = {"light_counts": lambda: n + beta, "light_phi": lambda: phi + 1e-12, "light_types": lambda: n + beta}.get(kernel, lambda: None)()
            for b in batches:
                if not b.num_rows:
                    continue
                b = pa.RecordBatch.from_arrays([b.column(0), *(_unpacked(b.column(i + 1), x) for i, x in enumerate(kinds)), b.column(3)], names=["doc_id", "types", "z", "allowed"])
                if kernel in ("dense", "sparse", "hdp", "collapsed", "serial") and b.column(3).null_count == b.num_rows:
                    x = kernels.Steps(b.column(0).to_numpy(), b.column(1), b.column(2), k)
                    if kernel in ("collapsed", "serial"):
                        kernels.step_collapsed_sweep(x, own, totals, alpha, beta, seed, it)
                    elif kernel == "dense":
                        kernels.step_sweep(x, phi, alpha, seed, it)
                    else:
                        kernels.step_sparse_sweep(x, phi, alpha, seed, it, tables)
                    yield pack(_out(b, x), kinds)
                    continue
                x = kernels.Batch(b.column(0).to_numpy(), _lists(b.column(1)), _lists(b.column(2)), k)
                allowed = _allowed(b.column(3), x, k)
                if kernel in ("collapsed", "serial"):
                    kernels.collapsed_sweep(x, own, totals, alpha, beta, seed, it, allowed)
                elif kernel == "light_counts":
                    kernels.proposal_sweep(x, phi, proposal, alpha, seed, it, (own, totals, beta), allowed, tables)
                elif kernel in ("light_phi", "light_types"):
                    kernels.proposal_sweep(x, phi, proposal, alpha, seed, it, None, allowed, tables)
                elif kernel in ("sparse", "hdp"):
                    kernels.sparse_sweep(x, phi, alpha, seed, it, allowed, tables)
                elif kernel == "ends":
                    kernels.sweep(x, phi, alpha, seed, it, allowed, kernels._pick_near)
                else:
                    kernels.sweep(x, phi, alpha, seed, it, allowed)
                yield pack(_out(b, x), kinds)

        src = self.state.packed
        src = src.join(self.doc_priors.df, "doc_id", "left") if self.with_priors else src.withColumn("allowed", F.lit(None).cast("array<int>"))
        src = src.select("doc_id", "types", "z", "allowed")
        visited = self.s.scan.documents(src.select("doc_id"), it) if self.s.scan else None
        rest = None
        if visited is not None:  # the other documents keep their topics
            seen = store(visited.select("doc_id"), "visited")
            src, rest, self.visited = src.join(seen.df, "doc_id", "left_semi"), src.join(seen.df, "doc_id", "left_anti").select("doc_id", "types", "z"), seen.df
        swept = (src.coalesce(1) if kernel == "serial" else src).mapInArrow(run, PACKED)
        new = State(store(swept if rest is None else swept.unionByName(rest), "state"), kinds)
        self.state.drop()
        self.state = new
        shared.unpersist()

    def sample(self, iterations: int | None = None, callback: Callable[[TopicModel], None] | None = None, abort_file: str | None = None) -> TopicModel:
        """Sweeps from where the model stands; stops early when aborted or when the file exists."""
        for _ in range(self.s.iterations if iterations is None else iterations):
            if self.aborted or (abort_file and exists(self.spark, abort_file)):
                self.aborted = True
                break
            self.iteration += 1
            self._sweep()
            if self.kernel == "hdp":
                self._draw_psi()
            self._draw_phi()
            if self.s.hyper_interval and self.iteration % self.s.hyper_interval == 0:
                self.optimise()
            if self.s.report_interval and self.iteration % self.s.report_interval == 0:
                self.history.append({"iteration": self.iteration, "log_likelihood": self.log_likelihood()})
            if callback:
                callback(self)
        return self

    def abort(self) -> None:
        self.aborted = True

    def _draw_psi(self) -> None:
        """How many groups each topic has over the documents, by binomials on the counts of documents with at least i tokens, then the sticks."""
        from quillmark.operators.diagnostics import reverse_cumulative
        from quillmark.operators.topics import doc_topic_counts

        rng = np.random.default_rng([self.s.seed, self.iteration, 2])
        psi = np.full(self.s.topics, 1 / self.s.topics) if self.psi is None else self.psi
        a = self.alpha.sum()
        groups = np.zeros(self.s.topics)
        for r in reverse_cumulative(doc_topic_counts(self.assign())).toLocalIterator():
            p = a * psi[r.topic] / (a * psi[r.topic] + r.at_least - 1)
            groups[r.topic] += rng.binomial(r.docs, min(max(p, 0.0), 1.0))
        rest = np.append(np.cumsum(groups[::-1])[::-1][1:], 0)
        v = rng.beta(1 + groups, self.s.hdp_gamma + rest)
        psi = v * np.append(1, np.cumprod(1 - v)[:-1])
        self.psi = np.maximum(psi / psi.sum(), 1e-12)

    # results ------------------------------------------------------------------------------------
    def phi_mean(self) -> np.ndarray:
        """The mean of phi after burn-in, thinned; the current phi if there is none yet."""
        return self.phi if not self._phi_n else self._phi_sum / self._phi_n

    def theta(self) -> DataFrame:
        """doc_id, theta, zbar arrays; z-bar of an empty document is all zeros."""
        k, alpha = self.s.topics, self.alpha

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    c = np.stack([np.bincount(x, minlength=k)[:k] for x in _lists(b.column(1))]).astype(float)
                    n = c.sum(1, keepdims=True)
                    theta, zbar = (c + alpha) / (n + alpha.sum()), c / np.maximum(n, 1)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(theta), pa.list_(pa.float64())), pa.array(list(zbar), pa.list_(pa.float64()))], names=["doc_id", "theta", "zbar"])

        return self.state.df.select("doc_id", "z").mapInArrow(run, "doc_id long, theta array<double>, zbar array<double>")

    def log_likelihood(self) -> float:
        return log_likelihood(self.assign(), self.s.topics, float(self.alpha.mean()), self.beta).first()[0]

    def optimise(self, rounds: int = 20) -> None:
        """Minka's fixed point for alpha (symmetric or not) and beta, from count histograms."""
        d = self.assign().groupBy("doc_id", "topic").count()
        per_topic = d.groupBy("topic", "count").agg(F.count(F.lit(1)).alias("docs")).toPandas()
        lengths = d.groupBy("doc_id").agg(F.sum("count").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("docs")).toPandas()
        gain = lambda a, n: draws.digamma(a + n) - draws.digamma(a)
        topic, n, m = (per_topic[c].to_numpy(int) for c in ("topic", "count", "docs"))
        for _ in range(rounds):
            below = (lengths["docs"].to_numpy(float) * gain(self.alpha.sum(), lengths["n"].to_numpy(float))).sum()
            above = np.bincount(topic, m * gain(self.alpha[topic], n), minlength=self.s.topics)
            if below <= 0:
                return
            if self.s.symmetric_alpha:
                a = self.alpha[0] * above.sum() / (below * self.s.topics)
                self.alpha = np.full(self.s.topics, max(a, 1e-6))
            else:
                self.alpha = np.maximum(self.alpha * above / below, 1e-6)
        values, times = np.unique(self.n[self.n > 0], return_counts=True)
        for _ in range(rounds):
            above = (times * gain(self.beta, values)).sum()
            below = self.n_types * gain(self.beta * self.n_types, self.n.sum(1)).sum()
            if below <= 0:
                return
            self.beta = max(self.beta * above / below, 1e-6)

    def set_phi(self, phi: np.ndarray) -> None:
        """Only a matrix over the same topics and vocabulary fits."""
        if phi.shape != (self.s.topics, self.n_types):
            raise ValueError("phi belongs to another vocabulary or number of topics")
        self.phi = phi.copy()

    def set_assignments(self, z: DataFrame) -> None:
        """Replace z (doc_id, z) and redraw phi; topic lists must be as long as the documents."""
        new = State.of(self.state.df.select("doc_id", "types").join(z.select("doc_id", "z"), "doc_id").where(F.size("z") == F.size("types")), self.kinds())
        if new.df.count() != self.state.df.count():
            new.drop()
            raise ValueError("topic lists don't fit the documents")
        self.state.drop()
        self.state = new
        self._draw_phi()

    def reorder(self) -> np.ndarray:
        """Topics by falling tokens; returns the old number of each new topic."""
        order = np.argsort(-self.n.sum(1), kind="stable")
        to = np.empty_like(order)
        to[order] = np.arange(len(order))
        m = F.array(*[F.lit(int(x)) for x in to])
        new = State.of(self.state.df.select("doc_id", "types", F.transform("z", lambda x: F.get(m, x)).alias("z")), self.kinds())
        self.state.drop()
        self.state, self.n, self.phi, self.alpha = new, self.n[order], self.phi[order], self.alpha[order]
        if self._phi_sum is not None:
            self._phi_sum = self._phi_sum[order]
        return order

    def save(self, folder: str) -> None:
        """Parquet and a manifest, under a folder named by the settings' hash (``run_key``).

        Everything that later sweeps depend on is kept: priors, psi, the running sum of phi and the
        history. Scan policies are functions and come from the configuration again.
        """
        self.state.df.write.mode("overwrite").parquet(f"{folder}/state")
        parts = {"phi": self.phi, "phi_sum": self._phi_sum, "barred": None if self.priors is None else 1.0 - self.priors}
        for name, m in parts.items():
            if m is not None:
                ks, vs = np.nonzero(m)
                rows = pa.table({"topic": ks.astype(np.int32), "type_id": vs.astype(np.int32), "p": m[ks, vs]})
                self.spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{folder}/{name}")
        if self.with_priors:
            self.doc_priors.df.write.mode("overwrite").parquet(f"{folder}/doc_priors")
        s = {k: v for k, v in asdict(replace(self.s, phi_types=None, scan=None)).items() if k not in ("phi_types", "scan")}
        note = {
            "settings": s, "n_types": self.n_types, "iteration": self.iteration, "alpha": self.alpha.tolist(), "beta": self.beta, "psi": None if self.psi is None else self.psi.tolist(),
            "phi_n": self._phi_n, "history": self.history, "topic_priors": self.priors is not None, "doc_priors": self.with_priors,
        }
        self.spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, scan: Scan | None = None) -> TopicModel:
        note = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
        m = cls.__new__(cls)
        m.s = Settings(**note["settings"], scan=scan)
        m.kernel, m.phi_draw = scheme(m.s.scheme)
        m.phi_draw = m.phi_draw and (m.s.phi_builder or m.phi_draw)
        m.n_types, m.spark, m.iteration, m.aborted = note["n_types"], spark, note["iteration"], False
        m.alpha, m.beta, m.history, m.visited = np.array(note["alpha"]), note["beta"], note["history"], None
        m.psi = None if note["psi"] is None else np.array(note["psi"])

        def matrix(name: str) -> np.ndarray:
            p = spark.read.parquet(f"{folder}/{name}").toPandas()
            out = np.zeros((m.s.topics, m.n_types))
            out[p["topic"].to_numpy(int), p["type_id"].to_numpy(int)] = p["p"]
            return out

        m.phi, m._phi_n = matrix("phi"), note["phi_n"]
        m._phi_sum = matrix("phi_sum") if m._phi_n else None
        m.priors = 1.0 - matrix("barred") if note["topic_priors"] else None
        m.with_priors = note["doc_priors"]
        m.doc_priors = store(spark.read.parquet(f"{folder}/doc_priors"), "doc-priors") if m.with_priors else None
        m.state = State.of(spark.read.parquet(f"{folder}/state"), m.kinds())
        m.n = m.counts()
        m.changed = np.ones(m.n_types, bool)
        return m


def _allowed(column: pa.Array, b: kernels.Batch, k: int) -> np.ndarray | None:
    if column.null_count == len(column):
        return None
    rows = column.to_pylist()
    m = np.ones((len(rows), k))
    for i, j in enumerate(b.order):
        if rows[j] is not None:
            m[i] = 0
            m[i, rows[j]] = 1
    return m


def run_key(settings: Settings, dataset: str) -> str:
    """The folder name of a saved model: a digest of its settings and data set."""
    import hashlib

    s = {k: v for k, v in asdict(replace(settings, phi_types=None, scan=None)).items() if k not in ("phi_types", "scan")}
    return hashlib.md5(json.dumps([s, dataset], sort_keys=True).encode()).hexdigest()


def infer(corpus: DataFrame, phi: np.ndarray, alpha: np.ndarray, sweeps: int = 100, seed: int = 0) -> DataFrame:
    """doc_id, types, z, theta under a fixed phi; all sweeps of a document run in one pass, without a shuffle.

    Types outside phi's vocabulary must have been dropped; an empty document gets the prior's theta.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(np.ascontiguousarray(phi.T))
    k = len(alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = kernels.Steps(b.column(0).to_numpy(), b.column(1), None, k, seed)
            columns = x.columns(shared.value) if len(x.z) * k <= MOST_GATHERED else None
            for i in range(sweeps):
                kernels.step_sweep(x, shared.value, alpha, seed, i + 1, columns)
            theta = np.empty((b.num_rows, k))
            theta[x.order] = ((x.counts + alpha[:, None]) / (x.counts.sum(0) + alpha.sum())).T
            z = _out(b, x)
            yield pa.RecordBatch.from_arrays([*z.columns, _rows(theta)], names=["doc_id", "types", "z", "theta"])

    return corpus.select("doc_id", "types").mapInArrow(run, SCHEMA + ", theta array<double>")


def held_out(corpus: DataFrame, phi: np.ndarray, alpha: np.ndarray, particles: int = 100, seed: int = 0) -> DataFrame:
    """doc_id, log_probability by the left-to-right estimator."""
    shared = corpus.sparkSession.sparkContext.broadcast(np.ascontiguousarray(phi.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = kernels.left_to_right_all(b.column(0).to_numpy(), b.column(1), shared.value, alpha, seed, particles)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.float64())], names=["doc_id", "log_probability"])

    return corpus.select("doc_id", "types").mapInArrow(run, "doc_id long, log_probability double")


def perplexity(held: DataFrame, corpus: DataFrame) -> float:
    """exp(-log probability per token) over all held-out documents."""
    r = held.join(corpus.select("doc_id", F.size("types").alias("n")), "doc_id").agg(F.sum("log_probability"), F.sum("n")).first()
    return math.exp(-r[0] / r[1]) if r[1] else float("nan")
