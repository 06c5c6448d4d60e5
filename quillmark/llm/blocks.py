"""Rows of a shuffle as packed numpy arrays: one Spark row holds what one batch sends to one bucket.

A block is (bucket, kind, x, y, f, s, v): ids x and y, flags f, floats s and fixed-width codes v of its
entries as raw bytes, each empty where a kind has no use for it. Spark moves and sorts a few large rows
instead of many small ones; all work on entries is vectorised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.codepoints import mix

SCHEMA = "bucket int, kind int, x binary, y binary, f binary, s binary, v binary"
NAMES = ("bucket", "kind", "x", "y", "f", "s", "v")
_TYPES = {"x": np.dtype(np.int64), "y": np.dtype(np.int64), "f": np.dtype(np.uint8), "s": np.dtype(np.float32)}
Entries = dict[str, np.ndarray]


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def pack(bucket: np.ndarray, kind: int, **cols: np.ndarray) -> pa.RecordBatch:
    """Blocks of one batch; ``v`` is a two-dimensional array of int16 or float64."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    cuts = np.append(first, len(b))
    arrays = [pa.array(b[first], pa.int32()), pa.array(np.full(len(first), kind), pa.int32())]
    for name in NAMES[2:]:
        if name in cols:
            c = cols[name]
            c = np.ascontiguousarray((c if name == "v" else c.astype(_TYPES[name]))[order])
            width = c.dtype.itemsize * (c.shape[1] if c.ndim == 2 else 1)
            offsets = (cuts * width).astype(np.int32)
            arrays.append(pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(c.tobytes())]))
        else:
            arrays.append(pa.array([b""] * len(first), pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=list(NAMES))


def _joined(parts: list[dict[str, bytes]], code: np.dtype, dim: int) -> Entries:
    out = {n: np.frombuffer(b"".join(p[n] for p in parts), t) for n, t in _TYPES.items()}
    v = np.frombuffer(b"".join(p["v"] for p in parts), code)
    out["v"] = v.reshape(-1, dim) if len(v) else v.reshape(0, dim)
    return out


def by_bucket(blocks: DataFrame, buckets: int, work: Callable[[dict[int, Entries]], Iterator[pa.RecordBatch]], schema: str, dim: int, code: str = "int16") -> DataFrame:
    """``work`` on the entries of each bucket, by kind; a bucket is held in memory, so their number must follow the size of the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        now = None
        t = np.dtype(code)
        for b in batches:
            for row in b.to_pylist():
                if row["bucket"] != now:
                    if held:
                        yield from work({k: _joined(p, t, dim) for k, p in held.items()})
                    held, now = {}, row["bucket"]
                held.setdefault(row["kind"], []).append(row)
        if held:
            yield from work({k: _joined(p, t, dim) for k, p in held.items()})

    parts = max(1, min(buckets, 20_000))
    return blocks.repartition(parts, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(run, schema)


def best_per_key(src: np.ndarray, dst: np.ndarray, sim: np.ndarray, k: int, new: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(src, dst, sim, new) of the k best distinct pairs of each src, best first; a pair known before isn't new."""
    if not len(src):
        return src, dst, sim, np.zeros(0, np.uint8)
    new = np.zeros(len(src), np.uint8) if new is None else new
    pos, ids = pd.factorize(np.concatenate([src, dst]))
    a, b = pos[: len(src)].astype(np.int64), pos[len(src) :].astype(np.int64)
    order = np.argsort(a << 33 | b << 1 | new)
    a, b, sim, new = a[order], b[order], sim[order], new[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    a, b, sim, new = a[first], b[first], sim[first], new[first]
    falling = np.uint32(0xFFFFFFFF) - ((sim.astype(np.float32) + np.float32(3)).view(np.uint32))  # positive floats sort as their bits
    order = np.argsort(a << 32 | falling.astype(np.int64))
    a, b, sim, new = a[order], b[order], sim[order], new[order]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    ok = rank < k
    return ids[a[ok]], ids[b[ok]], sim[ok], new[ok]
