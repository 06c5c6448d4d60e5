"""Problem 7: evaluation texts that leak into training text, by greedy string tiling.

Seeds are runs of ``min_match`` words: the runs of the evaluation items are hashed by Karp-Rabin,
every document's runs are looked up among them (or joined with them, where the items are many), and a
document and item that share a seed are tiled: the longest common run of unmarked words is found by Karp-Rabin and marked, again and again. The
share of the item's words under tiles is its coverage, which also sees passages put in another order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.codepoints import Words, mix, pieces, range_hash
from quillmark.operators.skew import salted_join
from quillmark.operators.storage import store

#: Most words of evaluation text that are sent to the workers (4 MB of text and about 64 bytes a word).
BLOCK_WORDS = 1_000_000


def _codes(doc: list | np.ndarray, item: list | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both word sequences as numbers that are equal where the words are; uint64 arrays are taken as they are."""
    if isinstance(doc, np.ndarray) and doc.dtype == np.uint64:
        return doc, item
    number: dict = {}
    x, y = (np.array([number.setdefault(w, len(number) + 1) for w in words], np.uint64) for words in (doc, item))
    return mix(x), mix(y)


def _runs_of(words: np.ndarray, taken: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, Karp-Rabin hash) of the runs of n words of which none is taken."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    used = np.concatenate([[0], np.cumsum(taken)])
    at = np.flatnonzero(used[n:] == used[:-n])
    return at, range_hash(words, at, at + n)


def tile(doc: list | np.ndarray, item: list | np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (start in doc, start in item, length), longest first.

    Running Karp-Rabin over falling lengths: the longest common run of free words is found by bisection
    on its length, and all runs of that length are marked in one pass, so there are no more passes than
    different lengths. Among equally long matches the one that starts first in the document, then in
    the item, is taken.
    """
    d, i = _codes(doc, item)
    taken_d, taken_i = np.zeros(len(d), bool), np.zeros(len(i), bool)
    tiles: list[tuple[int, int, int]] = []
    top = min(len(d), len(i))

    def common(n: int) -> bool:
        x, y = _runs_of(d, taken_d, n)[1], _runs_of(i, taken_i, n)[1]
        return bool(len(x) and len(y) and np.isin(y, x).any())

    while top >= min_match and common(min_match):
        low, high = min_match, top  # a common run of n words holds one of n - 1
        step = min_match
        while low < high:  # short matches are the rule: doubling first, bisection then
            n = min(high, max(low + 1, min(low + step, (low + high + 1) // 2)))
            if common(n):
                low, step = n, 2 * step
            else:
                high, step = n - 1, max(1, (high - low) // 2)
        n = low
        at_d, h_d = _runs_of(d, taken_d, n)
        at_i, h_i = _runs_of(i, taken_i, n)
        order = np.argsort(h_i, kind="stable")
        h_i, at_i = h_i[order], at_i[order]
        lo, hi = np.searchsorted(h_i, h_d, "left"), np.searchsorted(h_i, h_d, "right")
        end_d = 0
        skip = {}  # the first place of each hash whose run may still be free
        for k in np.flatnonzero(hi > lo).tolist():
            a = int(at_d[k])
            if a < end_d:  # runs of one length in order: only the tile before can be in the way
                continue
            first = skip.get(lo[k], lo[k])
            while first < hi[k] and taken_i[at_i[first] : at_i[first] + n].any():
                first += 1
            skip[lo[k]] = first
            if first < hi[k]:
                j = int(at_i[first])
                taken_d[a : a + n], taken_i[j : j + n] = True, True
                end_d = a + n
                tiles.append((a, j, n))
        top = n - 1
    return tiles


def _scan(min_match: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        items = Words(pa.array(texts, pa.large_string()))
        at, h = items.windows(min_match)
        order = np.argsort(h, kind="stable")
        h, item_row = h[order], items.row[at[order]]
        seed = np.unique(h)
        table = np.zeros(1 << 20, bool)
        table[seed & np.uint64((1 << 20) - 1)] = True
        words_of_item = lambda i: items.hash[items.first[i] : items.first[i + 1]]
        for batch in (x for b in batches for x in pieces(b)):
            docs = Words(batch.column(1))
            pos, g = docs.windows(min_match)
            maybe = np.flatnonzero(table[g & np.uint64((1 << 20) - 1)])
            where = np.searchsorted(seed, g[maybe])
            where[where == len(seed)] = 0
            hit = maybe[seed[where] == g[maybe]] if len(seed) else maybe[:0]
            lo, hi = np.searchsorted(h, g[hit], "left"), np.searchsorted(h, g[hit], "right")
            many = hi - lo
            row = np.repeat(docs.row[pos[hit]], many)
            k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            pairs = np.unique(np.stack([row, item_row[k]], 1), axis=0) if len(row) else np.zeros((0, 2), int)
            out: list[tuple[int, int, int, int, int, int]] = []
            doc_ids = batch.column(0).to_pylist()
            for r, i in pairs.tolist():
                out += _tiled(ids[i], doc_ids[r], words_of_item(i), docs.hash[docs.first[r] : docs.first[r + 1]], min_match)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(6)], names=["item_id", "doc_id", "tiles", "longest", "covered", "item_words"])

    return run


def _tiled(item_id: int, doc_id: int, item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int, int, int, int]]:
    tiles = tile(doc, item, min_match)
    return [(item_id, doc_id, len(tiles), max(t[2] for t in tiles), sum(t[2] for t in tiles), len(item))] if tiles else []


def _seeds(min_match: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(seed, row number) of the distinct runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b)):
            w = Words(batch.column(1))
            at, h = w.windows(min_match)
            one = np.unique(np.stack([w.row[at], h.view(np.int64)], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(one[:, 1])), batch.column(0).take(pa.array(one[:, 0]))], names=["seed", "id"])

    return run


def _pairs(min_match: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, 3)):
            items, docs = Words(batch.column(2)), Words(batch.column(3))
            i, d = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [t for r in range(len(i)) for t in _tiled(i[r], d[r], items.hash[items.first[r] : items.first[r + 1]], docs.hash[docs.first[r] : docs.first[r + 1]], min_match)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(6)], names=["item_id", "doc_id", "tiles", "longest", "covered", "item_words"])

    return run


SCHEMA = "item_id long, doc_id long, tiles long, longest long, covered long, item_words long"


def _joined(docs: DataFrame, stated: DataFrame, min_match: int) -> DataFrame:
    """Items of any number: their seeds meet those of the documents in a join, and only the pairs found are tiled.

    Rows are numbered, so repeated ids keep their own texts.
    """
    d = store(docs.select(F.col("id").alias("d"), F.col("low").alias("dt"), F.monotonically_increasing_id().alias("dn")), "documents")
    i = store(stated.select("i", "t", F.monotonically_increasing_id().alias("n")), "items")
    a = d.df.select("dn", "dt").mapInArrow(_seeds(min_match), "seed long, dn long")
    b = i.df.select("n", "t").mapInArrow(_seeds(min_match), "seed long, n long")
    met = store(salted_join(a, b, "seed", "dn").select("dn", "n").distinct(), "met")
    return met.df.join(i.df, "n").join(d.df, "dn").select("i", "d", "t", "dt").mapInArrow(_pairs(min_match), SCHEMA)


def leaks(documents: DataFrame, items: DataFrame, min_match: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, doc_id, tiles, longest, covered, item_words, coverage of each pair that shares a run of ``min_match`` words.

    The items' words are counted: up to ``BLOCK_WORDS`` of them are broadcast and the documents scanned once,
    without a shuffle; beyond it the seeds of items and documents are joined. Both give the same rows. Null or
    empty texts, and texts under ``min_match`` words, match nothing; repeated items and documents give a
    row each; empty tables an empty result.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.lower(text).alias("low"))
    stated = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.lower(item_text).alias("t"))
    # a word takes two characters at least, with what ends it
    size = stated.agg(F.coalesce(F.sum(F.ceil((F.length("t") + 1) / 2)), F.lit(0))).first()[0]
    if size <= 2 * BLOCK_WORDS:
        rows = stated.orderBy("i", "t").collect()
        shared = spark.sparkContext.broadcast(([r.i for r in rows], [r.t for r in rows]))
        out = docs.mapInArrow(_scan(min_match, shared), SCHEMA) if rows else spark.createDataFrame([], SCHEMA)
    else:
        out = _joined(docs, stated, min_match)
    return out.withColumn("coverage", F.col("covered") / F.col("item_words"))
