"""Problem 4: the most similar vectors for every vector, by NN-descent over Spark joins.

Equal vectors are one node. Inside the graph a node is a code of two bytes for each dimension; the best
edges are rescored with the doubles at the end. The graph starts from windows of consecutive nodes in
the leaf order of ``TREES`` trees, fitted on a sample of at most ``SAMPLE`` nodes and applied to all,
and is improved in rounds: every node brings its neighbours and reverse neighbours together, pairs of
which at least one is new are compared, and each node keeps its ``K`` best. Rounds end when fewer than
``STOP`` of the edges change. Queries are answered by greedy search in the graph; ``exact_nearest``
compares a stated query set with all rows.

Joins move packed blocks (``blocks``): codes are fetched for the members of a centre only, by two hops
of ids; of a hub's reverse edges at most ``REVERSE`` leave a batch. Shares of misses against brute
force are in the README.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.blocks import SCHEMA, Entries, best_per_key, bucket_of, by_bucket, pack
from quillmark.operators.skew import attach_group
from quillmark.operators.storage import Stored, materialize, store

K, REVERSE, TREES, WINDOW, KEEP, ROUNDS, STOP, SEED = 16, 16, 12, 2048, 10, 6, 0.05, 77
SAMPLE = 20_000
#: Different vector lengths that one table may hold; each is a graph of its own.
MOST_LENGTHS = 32
BUCKET_BYTES = 24 << 20
EDGE = "src long, dst long, sim float, new boolean"
EMPTY = "id long, neighbour long, sim double, rank int"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def _codes(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, dim)


def _unit32(code: np.ndarray) -> np.ndarray:
    v = code.astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def usable(vector: str) -> Column:
    """Vectors of finite numbers that are not all zero."""
    v = F.col(vector)
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~wrong & F.exists(v, lambda x: x != 0)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length one, and their codes: two bytes for each dimension, the largest at 32767."""
    for b in batches:
        if b.num_rows:
            m = _matrix(b.column(1))
            m = m / np.abs(m).max(1, keepdims=True)
            code = np.rint(m * 32767).astype(np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(m / np.linalg.norm(m, axis=1, keepdims=True)), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "vec", "code"])


NODE = "id long, vec array<double>, code binary"


def _rows(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """id, v: the usable vectors, one of each id."""
    return df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v")).dropDuplicates(["id"])


def _lengths(rows: DataFrame) -> list[int]:
    got = [r.d for r in rows.select(F.size("v").alias("d")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(got) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} different lengths")
    return sorted(got)


class Vectors:
    """Distinct vectors of one length as nodes. ``nodes``: id (smallest of its rows), vec, code; ``members``: node, id; ``firsts``: node and its ``keep`` smallest ids."""

    def __init__(self, rows: DataFrame, dim: int, keep: int) -> None:
        self.dim = dim
        hashed = rows.where(F.size("v") == dim).select("id", "v", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).alias("h"))
        keys = store(hashed.select("id", "h"), "vector-keys")
        self.groups = materialize(keys.df.groupBy("h").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "vector-groups")
        self.members = materialize(attach_group(keys.df, self.groups, "h", "id").select("node", "id", "n"), "members")
        self.nodes = materialize(hashed.join(self.groups.select(F.col("node").alias("id")), "id", "left_semi").select("id", "v").mapInArrow(_unit, NODE), "nodes")
        w = Window.partitionBy("node").orderBy("id")
        self.firsts = materialize(self.members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).select("node", "id"), "firsts")
        self.count = self.nodes.count()
        keys.drop()

    def buckets(self, entries: int, width: int) -> int:
        """How many buckets keep ``entries`` for each node, of ``width`` bytes, within ``BUCKET_BYTES``; a few at least, so that all cores work."""
        return max(12, -(-self.count * entries * width // BUCKET_BYTES))


# trees --------------------------------------------------------------------------------------------
class Tree:
    """A binary tree of hyperplanes between two means of a sample; ``leaf_of`` numbers the leaves from left to right."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.normal, self.at, self.left, self.right, self.leaf = [], [], [], [], []
        self.sizes: list[int] = []
        dim = sample.shape[1]

        def grow(rows: np.ndarray) -> int:
            me = len(self.at)
            for x, empty in ((self.normal, np.zeros(dim, np.float32)), (self.at, 0.0), (self.left, me), (self.right, me), (self.leaf, -1)):
                x.append(empty)
            part = sample[rows]
            if len(rows) > leaf:
                v, t = self._split(part, rng)
                side = part @ v > t
                if side.any() and not side.all():
                    self.normal[me], self.at[me] = v, t
                    self.left[me] = grow(rows[~side])
                    self.right[me] = grow(rows[side])
                    return me
            self.leaf[me] = len(self.sizes)
            self.sizes.append(len(rows))
            return me

        grow(np.arange(len(sample)))
        self.normal, self.at = np.stack(self.normal), np.array(self.at, np.float32)
        self.left, self.right, self.leaf = np.array(self.left), np.array(self.right), np.array(self.leaf)

    @staticmethod
    def _split(part: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        """Between the means of two halves that a few steps of two-means find; at the median where a half would be tiny."""
        some = part[rng.permutation(len(part))[:400]]
        c = some[rng.choice(len(some), 2, replace=False)]
        for _ in range(4):
            near = some @ c.T
            one = near[:, 1] > near[:, 0]
            if one.all() or not one.any():
                break
            c = np.stack([some[~one].mean(0), some[one].mean(0)])
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        v = (c[1] - c[0]).astype(np.float32)
        a = part @ v
        share = (a > 0).mean()
        return v, 0.0 if 0.05 < share < 0.95 else float(np.median(a))

    def leaf_of(self, v: np.ndarray) -> np.ndarray:
        at = np.zeros(len(v), np.int64)
        going = np.flatnonzero(self.left[at] != at)
        while len(going):
            here = at[going]
            right = np.einsum("ij,ij->i", v[going], self.normal[here]) > self.at[here]
            at[going] = np.where(right, self.right[here], self.left[here])
            going = going[self.leaf[at[going]] < 0]
        return self.leaf[at]


def _forest(v: Vectors) -> tuple[list[Tree], list[np.ndarray], list[int]]:
    """Trees, the bucket of each tree's leaves (runs of leaves of about eight windows by the sample), and the first bucket of each tree."""
    sample = v.nodes.select("id", "code").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("code").toPandas()["code"]
    m = _unit32(np.frombuffer(b"".join(bytes(x) for x in sample), np.int16).reshape(-1, v.dim))
    share = len(m) / max(v.count, 1)
    trees = [Tree(m, max(8, int(WINDOW * share / 4)), SEED + t) for t in range(TREES)]
    of_leaf, first, n = [], [], 0
    for t in trees:
        b = (np.cumsum(t.sizes) - t.sizes) // max(8, int(8 * WINDOW * share))
        b = np.unique(b, return_inverse=True)[1]
        first.append(n)
        of_leaf.append((b + n).astype(np.int32))
        n += int(b.max()) + 1
    return trees, of_leaf, [*first, n]


def _route(shared, dim: int, kind: int) -> Callable:
    """Blocks (x id, y leaf, v code) of rows (id, code): one entry for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, of_leaf, _ = shared.value
        for b in batches:
            if b.num_rows:
                code = _codes(b.column(1), dim)
                v, ids = _unit32(code), b.column(0).to_numpy()
                leaves = [t.leaf_of(v) for t in trees]
                bucket = np.concatenate([o[leaf] for o, leaf in zip(of_leaf, leaves)])
                yield pack(bucket, kind, x=np.tile(ids, len(trees)), y=np.concatenate(leaves), v=np.tile(code, (len(trees), 1)))

    return run


def _top(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of at least the k best of each row, few more: the k-th best of the maxima of eighths, taken side by side, is a bound."""
    n = s.shape[1]
    if n <= 8 * k:
        bound = np.full(len(s), -1.5, np.float32) if n <= k else np.partition(s, n - k, axis=1)[:, n - k]
    else:
        w = n // 8
        best = s[:, :w].copy()
        for g in range(1, 8):
            np.maximum(best, s[:, g * w : (g + 1) * w], out=best)
        bound = np.partition(best, w - k, axis=1)[:, w - k]
    hit = np.flatnonzero(s >= np.maximum(bound, np.float32(-1.5))[:, None])
    return hit // n, hit % n


def _in_windows(e: dict[int, Entries], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Best nodes of kind 0 inside windows of consecutive leaves: for every node, or for the queries of kind 1 if there are any."""
    nodes, asked = e.get(0), e.get(1)
    if nodes is None:
        return
    v = _unit32(nodes["v"])
    line = v @ np.random.default_rng(SEED).standard_normal(v.shape[1]).astype(np.float32)  # an order inside large leaves
    order = np.lexsort((nodes["x"], line, nodes["y"]))
    ids, v, leaf, line = nodes["x"][order], v[order], nodes["y"][order], line[order]
    cuts = np.arange(0, max(len(ids) - WINDOW, 0) + 1, WINDOW)
    if asked is not None:
        q = _unit32(asked["v"])
        q_line = q @ np.random.default_rng(SEED).standard_normal(v.shape[1]).astype(np.float32)
        place = np.array([np.searchsorted(leaf, y, "left") + np.searchsorted(line[slice(*np.searchsorted(leaf, [y, y + 1]))], x) for y, x in zip(asked["y"], q_line)], np.int64)
        window = np.searchsorted(cuts, np.minimum(place, len(ids) - 1), "right") - 1
    for w, a in enumerate(cuts):
        z = cuts[w + 1] if w + 1 < len(cuts) else len(ids)
        if asked is not None:
            mine = np.flatnonzero(window == w)
            src, rows = asked["x"][mine], q[mine]
        else:
            src, rows = ids[a:z], v[a:z]
        if not len(src):
            continue
        s = rows @ v[a:z].T
        if asked is None:
            np.fill_diagonal(s, -2)
        i, j = _top(s, k)
        src, dst, sim, _ = best_per_key(src[i], ids[a:z][j], s[i, j], k)
        yield pack(bucket_of(src, buckets), 0, x=src, y=dst, s=sim, f=np.ones(len(src)))


def _edge_batch(src: np.ndarray, dst: np.ndarray, sim: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(sim.astype(np.float32)), pa.array(new.astype(bool))], names=["src", "dst", "sim", "new"])


def _merge(e: dict[int, Entries], k: int) -> Iterator[pa.RecordBatch]:
    x = e[0]
    yield _edge_batch(*best_per_key(x["x"], x["y"], x["s"], k, x["f"]))


# rounds -------------------------------------------------------------------------------------------
def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(4))


def _known(buckets: int) -> Callable:
    """The edges as blocks by their source, old ones from now on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                src, dst, sim, _ = _flat(b)
                yield pack(bucket_of(src, buckets), 0, x=src, y=dst, s=sim, f=np.zeros(len(src)))

    return run


def _asks(buckets: int) -> Callable:
    """Both ends of every edge ask for each other: (x member, y centre), flag 1 for a new edge, 2 for a reverse one; at the source lies its worst similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            src, dst, sim, new = _flat(b)
            new = new.astype(np.uint8)
            order = np.lexsort((-sim, 1 - new, dst))
            d = dst[order]
            start = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            rank = np.arange(len(d)) - np.repeat(start, np.diff(np.append(start, len(d))))
            back = order[rank < REVERSE]  # of a hub's many reverse edges
            member, centre = np.concatenate([dst, src[back]]), np.concatenate([src, dst[back]])
            yield pack(bucket_of(member, buckets), 1, x=member, y=centre, s=np.concatenate([sim, sim[back]]), f=np.concatenate([new, new[back] | 2]))
            yield pack(bucket_of(src, buckets), 2, x=src, s=sim)

    return run


def _as_blocks(dim: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy()
                yield pack(bucket_of(ids, buckets), 0, x=ids, v=_codes(b.column(1), dim))

    return run


def _answer(e: dict[int, Entries], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Every ask gets the member's code and the similarity that a new neighbour of it must beat; it goes to the centre."""
    if 1 not in e:
        return
    nodes, asks = e[0], e[1]
    order = np.argsort(nodes["x"])
    ids, code = nodes["x"][order], nodes["v"][order]
    worst, count = np.full(len(ids), 2.0, np.float32), np.zeros(len(ids), np.int64)
    if 2 in e:
        at = np.searchsorted(ids, e[2]["x"])
        np.minimum.at(worst, at, e[2]["s"])
        np.add.at(count, at, 1)
    floor = np.where(count >= k, worst, np.float32(-2))
    step = 200_000
    for a in range(0, len(asks["x"]), step):
        at = np.searchsorted(ids, asks["x"][a : a + step])
        # the floor travels with the code, as a fixed-point number, rounded down
        fixed = np.floor(np.clip(floor[at], -2, 2) * 16000).astype(np.int16)[:, None]
        centre = asks["y"][a : a + step]
        yield pack(bucket_of(centre, buckets), 0, x=centre, y=asks["x"][a : a + step], s=asks["s"][a : a + step], f=asks["f"][a : a + step], v=np.concatenate([code[at], fixed], 1))


def _local_join(e: dict[int, Entries], k: int, dim: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs of members of one centre of which at least one is new, where they beat the worst edge of their node."""
    x = e[0]
    # a member both ways counts once; of the reverse ones a centre takes the best, new ones first
    order = np.lexsort((x["f"] >> 1, x["y"], x["x"]))
    c, m = x["x"][order], x["y"][order]
    once = order[np.r_[True, (c[1:] != c[:-1]) | (m[1:] != m[:-1])]]
    order = once[np.lexsort((-x["s"][once], 1 - (x["f"][once] & 1), x["f"][once] >> 1, x["x"][once]))]
    c, reverse = x["x"][order], x["f"][order] >> 1
    group = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (reverse[1:] != reverse[:-1])])
    rank = np.arange(len(c)) - np.repeat(group, np.diff(np.append(group, len(c))))
    order = order[(reverse == 0) | (rank < REVERSE)]
    c, m, new = x["x"][order], x["y"][order], (x["f"][order] & 1).astype(bool)
    vec = _unit32(x["v"][order][:, :dim])
    floor = x["v"][order][:, dim].astype(np.float32) / 16000
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    size = np.diff(np.append(first, len(c)))
    fresh = np.add.reduceat(new.astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
    held: list[tuple] = []
    n_held = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, n_held
        src, dst, sim = (np.concatenate(z) for z in zip(*held))
        held, n_held = [], 0
        src, dst, sim, _ = best_per_key(src, dst, sim, k)
        return pack(bucket_of(src, buckets), 0, x=src, y=dst, s=sim, f=np.ones(len(src)))

    for width in np.unique(size[fresh]):  # centres of one size are one batched product
        at = first[(size == width) & fresh][:, None] + np.arange(width)
        for a in range(0, len(at), 512):
            i = at[a : a + 512]
            v = vec[i]
            s = v @ v.transpose(0, 2, 1)
            ok = (new[i][:, :, None] | new[i][:, None, :]) & (s > floor[i][:, :, None])
            ok[:, np.arange(width), np.arange(width)] = False
            p, y, z = np.nonzero(ok)
            held.append((m[i][p, y], m[i][p, z], s[p, y, z]))
            n_held += len(p)
            if n_held > 2_000_000:
                yield flush()
    if n_held:
        yield flush()


def graph(v: Vectors, k: int = K, rounds: int = ROUNDS) -> tuple[Stored, object]:
    """(edges, trees): src, dst, sim by the codes, new, for the k best edges that were found of each node."""
    spark = v.nodes.sparkSession
    coded = v.nodes.select("id", "code")
    shared = spark.sparkContext.broadcast(_forest(v))
    dim = v.dim
    b_edges = v.buckets(TREES * KEEP, 21)
    routed = coded.mapInArrow(_route(shared, dim, 0), SCHEMA)
    found = by_bucket(routed, shared.value[2][-1], partial(_in_windows, k=KEEP, buckets=b_edges), SCHEMA, dim)
    edges = store(by_bucket(found, b_edges, partial(_merge, k=k), EDGE, dim), "edges")
    b_ask, b_wide = v.buckets(2 * k, 37), v.buckets(2 * k, 2 * dim + 23)
    for _ in range(rounds):
        asks = edges.df.mapInArrow(_asks(b_ask), SCHEMA).unionAll(coded.mapInArrow(_as_blocks(dim, b_ask), SCHEMA))
        wide = by_bucket(asks, b_ask, partial(_answer, k=k, buckets=b_wide), SCHEMA, dim)
        better = by_bucket(wide, b_wide, partial(_local_join, k=KEEP, dim=dim, buckets=b_edges), SCHEMA, dim + 1)
        both = edges.df.mapInArrow(_known(b_edges), SCHEMA).unionAll(better)
        after = store(by_bucket(both, b_edges, partial(_merge, k=k), EDGE, dim), "edges")
        changed = after.df.where("new").count()
        edges.drop()
        edges = after
        if changed <= STOP * k * max(v.count, 1):
            break
    return edges, shared


# exact similarities -------------------------------------------------------------------------------
def _vector_blocks(buckets: int, kind: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy()
                yield pack(bucket_of(ids, buckets), kind, x=ids, v=_matrix(b.column(1)))

    return run


def _pair_blocks(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                src, dst = b.column(0).to_numpy(), b.column(1).to_numpy()
                yield pack(bucket_of(dst, buckets), 1, x=src, y=dst)

    return run


def _bring(e: dict[int, Entries], buckets: int) -> Iterator[pa.RecordBatch]:
    if 1 not in e or 0 not in e:
        return
    order = np.argsort(e[0]["x"])
    ids, vec = e[0]["x"][order], e[0]["v"]
    for a in range(0, len(e[1]["x"]), 50_000):
        src, dst = e[1]["x"][a : a + 50_000], e[1]["y"][a : a + 50_000]
        yield pack(bucket_of(src, buckets), 1, x=src, y=dst, v=vec[order[np.searchsorted(ids, dst)]])


def _cosines(e: dict[int, Entries]) -> Iterator[pa.RecordBatch]:
    if 1 not in e or 0 not in e:
        return
    order = np.argsort(e[0]["x"])
    at = order[np.searchsorted(e[0]["x"][order], e[1]["x"])]
    for a in range(0, len(at), 50_000):
        # rounded, so that similarities that are equal but for the order of summation tie
        s = np.round(np.einsum("ij,ij->i", e[0]["v"][at[a : a + 50_000]], e[1]["v"][a : a + 50_000]), 12)
        yield pa.RecordBatch.from_arrays([pa.array(e[1]["x"][a : a + 50_000]), pa.array(e[1]["y"][a : a + 50_000]), pa.array(s)], names=["src", "dst", "sim"])


def _exact(pairs: DataFrame, left: DataFrame, right: DataFrame, dim: int, count: int, per_node: int) -> DataFrame:
    """src, dst, sim in doubles for pairs of a row of ``left`` and one of ``right`` (id, vec): vectors meet in two hops of blocks."""
    buckets = max(12, -(-count * per_node * (8 * dim + 16) // BUCKET_BYTES))
    first = pairs.select("src", "dst").mapInArrow(_pair_blocks(buckets), SCHEMA).unionAll(right.select("id", "vec").mapInArrow(_vector_blocks(buckets, 0), SCHEMA))
    second = by_bucket(first, buckets, partial(_bring, buckets=buckets), SCHEMA, dim, "float64").unionAll(left.select("id", "vec").mapInArrow(_vector_blocks(buckets, 0), SCHEMA))
    return by_bucket(second, buckets, _cosines, "src long, dst long, sim double", dim, "float64")


def _expand(v: Vectors, scored: DataFrame, k: int) -> DataFrame:
    """node, near (at most k + 1 of (id, sim), best first) from the scored edges and the node's own copies."""
    own = v.firsts.select("node", "id", F.lit(1.0).alias("sim"))
    other = scored.select(F.col("src").alias("node"), F.col("dst").alias("other"), "sim").join(v.firsts.withColumnRenamed("node", "other"), "other").select("node", "id", "sim")
    w = Window.partitionBy("node").orderBy(F.desc("sim"), "id")
    top = own.unionAll(other).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    return top.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("r", "id", "sim"))).alias("near"))


def _candidates(edges: DataFrame, k: int, least: float | None) -> DataFrame:
    """The edges whose doubles are looked at: three more than k, as codes may swap near ties, and none clearly under ``least``."""
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    e = edges if least is None else edges.where(F.col("sim") >= least - 0.02)
    return e.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 3)


def nearest(df: DataFrame, row_id: str = "doc_id", vector: str = "theta", k: int = 5, least: float | None = None) -> DataFrame:
    """id, neighbour, sim, rank: the k most similar other rows of every row, at least ``least`` similar.

    Null and all-zero vectors and those with a null, NaN or infinity have no neighbours and are none;
    vectors meet those of their own length only. Equal vectors are each other's first neighbours;
    among equal similarities the smaller id goes first. Rows of one id count once. Fewer than k others
    give fewer rows; an empty table gives none.
    """
    rows = _rows(df, row_id, vector)
    out: DataFrame | None = None
    for dim in _lengths(rows):
        v = Vectors(rows, dim, k + 1)
        edges, shared = graph(v, max(K, k + 6))
        scored = _exact(_candidates(edges.df, k, least), v.nodes, v.nodes, dim, v.count, k + 3)
        if least is not None:
            scored = scored.where(F.col("sim") >= least)
        e = materialize(_expand(v, scored, k), "lists")
        shared.unpersist()
        edges.drop()
        near = attach_group(v.members.drop("n"), v.groups.select("node", "n").join(e, "node"), "node", "id")
        mine = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
        part = near.select("id", F.posexplode(mine).alias("p", "x")).select("id", F.col("x.id").alias("neighbour"), F.col("x.sim").alias("sim"), (F.col("p") + 1).alias("rank"))
        out = part if out is None else out.unionAll(part)
    return df.sparkSession.createDataFrame([], EMPTY) if out is None else out


def close_pairs(df: DataFrame, row_id: str = "doc_id", vector: str = "theta", k: int = 5, least: float = 0.97) -> DataFrame:
    """doc_id_a < doc_id_b with a cosine of ``least`` or more where one is among the k most similar of the other."""
    n = nearest(df, row_id, vector, k, least)
    return n.select(F.least("id", "neighbour").alias("doc_id_a"), F.greatest("id", "neighbour").alias("doc_id_b")).distinct()


# search -------------------------------------------------------------------------------------------
def _scores(dim: int) -> Callable:
    """(q, node, sim) of rows with both codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.einsum("ij,ij->i", _unit32(_codes(b.column(2), dim)), _unit32(_codes(b.column(3), dim)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["q", "node", "sim"])

    return run


def _beams(e: dict[int, Entries], k: int) -> Iterator[pa.RecordBatch]:
    src, dst, sim, _ = best_per_key(e[0]["x"], e[0]["y"], e[0]["s"], k)
    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(sim)], names=["q", "node", "sim"])


def search(df: DataFrame, queries: DataFrame, row_id: str = "doc_id", vector: str = "theta", k: int = 5, beam: int = 32, width: int = 8, steps: int = 20) -> DataFrame:
    """id, neighbour, sim, rank for query rows by greedy search in the graph of all rows.

    A query starts from its windows in the trees; in each step the ``width`` best nodes of its beam that
    aren't expanded yet bring all their neighbours and reverse neighbours, and the best ``beam`` stay. It
    ends when all of every beam is expanded, or after ``steps``. A row with the query's own id is
    left out. Nulls, zeros and lengths as in ``nearest``.
    """
    rows, asked = _rows(df, row_id, vector), _rows(queries, row_id, vector)
    out: DataFrame | None = None
    for dim in _lengths(rows):
        v = Vectors(rows, dim, k + 1)
        q = store(asked.where(F.size("v") == dim).mapInArrow(_unit, NODE), "queries")
        part = _greedy(v, q.df, k, beam, width, steps)
        out = part if out is None else out.unionAll(part)
    return df.sparkSession.createDataFrame([], EMPTY) if out is None else out


def _greedy(v: Vectors, q: DataFrame, k: int, beam: int, width: int, steps: int) -> DataFrame:
    edges, shared = graph(v)
    dim = v.dim
    routed = v.nodes.select("id", "code").mapInArrow(_route(shared, dim, 0), SCHEMA).unionAll(q.select("id", "code").mapInArrow(_route(shared, dim, 1), SCHEMA))
    asked_only = partial(_windows_of_queries, k=beam, buckets=v.buckets(1, 21))
    found = by_bucket(routed, shared.value[2][-1], asked_only, SCHEMA, dim)
    start = by_bucket(found, v.buckets(1, 21), partial(_beams, k=beam), "q long, node long, sim float", dim)
    state = store(start.select("q", "node", F.col("sim").cast("float").alias("sim"), F.lit(False).alias("done")), "beam")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "node")
    links = materialize(edges.df.select("src", "dst").unionAll(edges.df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    q_code, n_code = q.select(F.col("id").alias("q"), F.col("code").alias("qc")), v.nodes.select(F.col("id").alias("node"), F.col("code").alias("nc"))
    for _ in range(steps):
        ask = state.df.where("NOT done").withColumn("w", F.row_number().over(w)).where(F.col("w") <= width).select("q", "node")
        cand = ask.join(links, ask.node == links.src).select("q", F.col("dst").alias("node")).distinct().join(state.df.select("q", "node"), ["q", "node"], "left_anti")
        scored = cand.join(n_code, "node").join(q_code, "q").select("q", "node", "qc", "nc").mapInArrow(_scores(dim), "q long, node long, sim float").withColumn("done", F.lit(False))
        old = state.df.join(ask.withColumn("now", F.lit(True)), ["q", "node"], "left").select("q", "node", "sim", (F.col("done") | F.col("now").isNotNull()).alias("done"))
        nxt = store(old.unionAll(scored).withColumn("r", F.row_number().over(w)).where(F.col("r") <= beam).drop("r"), "beam")
        state.drop()
        state = nxt
        if not state.df.where("NOT done").limit(1).count():
            break
    best = state.df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 4).select(F.col("q").alias("src"), F.col("node").alias("dst"))
    scored = materialize(_exact(best, q, v.nodes, dim, q.count(), k + 4), "scored")
    state.drop()
    edges.drop()
    shared.unpersist()
    ids = scored.join(v.firsts.withColumnRenamed("node", "dst"), "dst").where("id <> src").select("src", "id", "sim")
    w5 = Window.partitionBy("src").orderBy(F.desc("sim"), "id")
    return ids.withColumn("rank", F.row_number().over(w5)).where(F.col("rank") <= k).select(F.col("src").alias("id"), F.col("id").alias("neighbour"), "sim", "rank")


def _windows_of_queries(e: dict[int, Entries], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    if 1 in e:
        yield from _in_windows(e, k, buckets)


# brute force --------------------------------------------------------------------------------------
def exact_nearest(df: DataFrame, queries: DataFrame, row_id: str = "doc_id", vector: str = "theta", k: int = 5, block: int = 2_000) -> DataFrame:
    """id, neighbour, sim, rank: the k most similar rows of each of a stated query set, exactly.

    Queries are broadcast in blocks of about ``block`` vectors; each batch of rows gives at most k rows a
    query to the shuffle. Nulls, zeros and lengths as in ``nearest``.
    """
    rows, asked = _rows(df, row_id, vector), _rows(queries, row_id, vector)
    out: DataFrame | None = None
    for dim in _lengths(asked):
        nodes = materialize(rows.where(F.size("v") == dim).mapInArrow(_unit, NODE).select("id", "vec"), "rows")
        mine = store(asked.where(F.size("v") == dim).mapInArrow(_unit, NODE).select("id", "vec"), "queries")
        parts = max(1, -(-mine.df.count() // block))
        for i in range(parts):
            got = mine.df.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).collect()
            shared = df.sparkSession.sparkContext.broadcast((np.array([r.id for r in got], np.int64), np.array([r.vec for r in got]).reshape(-1, dim)))
            part = nodes.mapInArrow(_all_rows(shared, k), "src long, dst long, sim double")
            out = part if out is None else out.unionAll(part)
    if out is None:
        return df.sparkSession.createDataFrame([], EMPTY)
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "sim", "rank")


def _all_rows(shared, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for b in batches:
            if b.num_rows and len(ids):
                rows = b.column(0).to_numpy()
                s = np.round(q @ _matrix(b.column(1)).T, 12)
                s[ids[:, None] == rows[None, :]] = -2
                order = np.lexsort((np.broadcast_to(rows, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, 1)
                ok = best > -1.5
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best.shape)[ok]), pa.array(rows[order][ok]), pa.array(best[ok])], names=["src", "dst", "sim"])

    return run
