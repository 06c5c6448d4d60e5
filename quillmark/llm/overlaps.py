"""Problem 2: records of evaluation splits that also stand, exactly or almost, in the training split.

Equal word sequences are one unit. Every unit gets a 256-bit similarity hash: each distinct word
votes with the square root of its count, and as the hash is built from words alone, edits move few
bits, mostly those whose votes were close. ``TABLES`` permutations of the bits each give a block.
A training unit stands in the bucket of its block; a test unit looks into the buckets of the ``P``
likeliest blocks, in which some of its least certain bits are turned. Units that meet and lie within
the Hamming radius are candidates, and each candidate pair is verified on its words by bit-parallel
edit distance.

The width of a block follows the number N of training units, 2**bits being N or a little less, and P is
2**(bits / 2 - 4): a test unit meets about sqrt(N) others by chance, in place of a fixed share of all.
A pair at the limit of 15 % edits is then found by one table with a chance of 0.28 or more, and missed
by all with less than 0.006.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import words
from quillmark.llm.codepoints import Words, mix, pieces
from quillmark.llm.formatting import exact_key
from quillmark.operators.skew import digest, salted_join
from quillmark.operators.storage import materialize, store

BITS, TABLES, RADIUS, SEED = 256, 16, 72, 20240301
#: Radius in the first 128 bits, looked at where units meet; at the limit of edits 4 in 100,000 pairs lie beyond.
FIRST_RADIUS = 40
MOST_EDITS = 0.15


def block_bits(units: int) -> int:
    """Even width of a block for so many training units."""
    bits = int(np.log2(max(units, 2)))
    return int(np.clip(bits - bits % 2, 14, 40))


@lru_cache(None)
def _blocks(bits: int) -> np.ndarray:
    """Bit positions of each table: the first bits of as many seeded permutations."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(BITS)[:bits] for _ in range(TABLES)])


@lru_cache(None)
def _turns(bits: int) -> list[tuple[int, ...]]:
    """The likeliest sets of turned bits, as places in the order of rising certainty.

    The chances come from a seeded simulation of votes that correlate by 0.85, as those of texts with
    15 % edits do.
    """
    rng = np.random.default_rng(SEED)
    x = rng.standard_normal((20_000, bits))
    y = 0.85 * x + np.sqrt(1 - 0.85**2) * rng.standard_normal(x.shape)
    flip = np.take_along_axis((x > 0) != (y > 0), np.argsort(np.abs(x), 1), 1).mean(0)
    odds = np.log(flip / (1 - flip))
    sets = [s for k in range(6) for s in combinations(range(min(bits, 16)), k)]
    score = np.array([odds[list(s)].sum() for s in sets])
    return [sets[i] for i in np.argsort(-score, kind="stable")[: 1 << (bits // 2 - 4)]]


def votes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(votes, number of words): ``BITS`` sums of votes for each text (lower-cased already); texts without words give zeros."""
    w = Words(column)
    n = len(w.off) - 1
    votes = np.zeros((n, BITS), np.float32)
    order = np.lexsort((w.hash, w.row))
    row, h = w.row[order], w.hash[order]
    length = np.bincount(row, minlength=n)
    if not len(h):
        return votes, length
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    weight = np.sqrt(np.diff(np.append(at, len(h)))).astype(np.float32)
    row, h = row[at], h[at]
    words, place = np.unique(h, return_inverse=True)  # a word of many texts is hashed once
    part = np.stack([mix(words + np.uint64(k * 0x51ED270B + 1)) for k in range(BITS // 64)], 1)
    signs = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
    step = 20_000
    for a in range(0, len(h), step):
        bits = signs[place[a : a + step]] * weight[a : a + step, None]
        r = row[a : a + step]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        votes[r[first]] += np.add.reduceat(bits, first, axis=0)
    return votes, length


def fingerprints(column: pa.Array) -> np.ndarray:
    """One row of ``BITS`` booleans for each text."""
    return votes_of(column)[0] > 0


def _probes(votes: np.ndarray, bits: int) -> np.ndarray:
    """The block of each table with every set of ``_turns`` turned, TABLES * P numbers a row."""
    out = []
    scale = (1 << np.arange(bits)).astype(np.int64)
    turns = _turns(bits)
    for t, p in enumerate(_blocks(bits)):
        v = votes[:, p]
        sure = np.argsort(np.abs(v), 1)[:, :16]
        block = (v > 0) @ scale + (np.int64(t) << bits)
        mask = scale[sure]
        out.append(np.stack([block ^ (mask[:, list(s)].sum(1) if s else 0) for s in turns], 1))
    return np.concatenate(out, 1)


def _hash(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """unit, code, words, keys (training units) and probes (test units) of rows (unit, low, in training, in test)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = (1 << np.arange(bits)).astype(np.int64)
        lists = lambda m, on: pa.array([r if k else None for r, k in zip(m, on)], pa.list_(pa.int64()))
        for b in (x for y in batches for x in pieces(y)):
            votes, n = votes_of(b.column(1))
            f = votes > 0
            code = np.packbits(f, axis=1, bitorder="little").view(np.int64).reshape(len(f), BITS // 64)
            keys = np.stack([f[:, p] @ scale + (np.int64(t) << bits) for t, p in enumerate(_blocks(bits))], 1)
            test = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            probes = np.zeros((len(f), TABLES * len(_turns(bits))), np.int64)
            probes[test] = _probes(votes[test], bits)
            cols = [b.column(0), *[pa.array(np.ascontiguousarray(code[:, k])) for k in range(BITS // 64)], pa.array(n.astype(np.int32)), lists(keys, b.column(2).to_pylist()), lists(probes, test)]
            yield pa.RecordBatch.from_arrays(cols, names=["unit", "c0", "c1", "c2", "c3", "n", "keys", "probes"])

    return run


def edit_distance(a: list, b: list, most: int) -> int:
    """Fewest insertions, deletions and replacements of list items, by Myers' bit vectors; ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = mask, 0, len(a)
    for j, y in enumerate(b):
        eq = where.get(y, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        score += bool(ph & top) - bool(mh & top)
        if score - (len(b) - 1 - j) > most:
            return most + 1
        ph = (ph << 1 | 1) & mask
        mh = mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
    return score


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = []
        for x, y in zip(pdf["wa"], pdf["wb"]):
            longest = max(len(x), len(y))
            most = int(MOST_EDITS * longest + 1e-9)
            ok.append(edit_distance(x.tolist(), y.tolist(), most) <= most)
        yield pdf.loc[ok, ["ua", "ub"]]


def overlap_pairs(docs: DataFrame, configs: DataFrame, doc_id: str = "doc_id", data: str = "data", file_name: str = "file_name") -> DataFrame:
    """test_file, train_file, test_id, train_id of every overlap between a run's test and training file.

    Two rows overlap where they are the same but for formatting, or where at most 15 % of the words
    of the longer one must be inserted, deleted or replaced. Null texts and texts without a letter,
    mark or digit overlap with nothing. Copies are compared once, as one unit, and joined to the
    rows at the end; a file in several runs gives its pairs once; a run without a test file none.
    """
    runs = materialize(
        configs.where("dataset_filename IS NOT NULL AND test_dataset_filename IS NOT NULL").select(F.col("dataset_filename").alias("train_file"), F.col("test_dataset_filename").alias("test_file")).distinct(), "runs"
    )
    parts = runs.select(F.col("train_file").alias("file")).union(runs.select("test_file")).distinct()
    w = words("text")
    rows = (
        docs.where(F.col(data).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(file_name).alias("file"), F.col(data).alias("text")).join(parts, "file", "left_semi")
        .withColumn("low", F.array_join(w, " ")).where("low <> ''")
    )
    keyed = store(rows.select("doc_id", "file", digest(F.col("low")).alias("d"), digest(exact_key("text")).alias("key"), "low"), "rows")
    # one unit for each word sequence, in the files where it stands
    per_file = keyed.df.groupBy("d", "file").agg(F.min("doc_id").alias("first"))
    ids = store(per_file.groupBy("d").agg(F.min("first").alias("unit")), "units")
    unit_rows = keyed.df.join(ids.df, (keyed.df.d == ids.df.d) & (keyed.df.doc_id == ids.df.unit), "left_semi").select(F.col("doc_id").alias("unit"), "low")
    texts = store(unit_rows, "texts")
    places = materialize(per_file.join(ids.df, "d").select("unit", "file"), "places")
    train = places.join(runs.select("train_file").distinct(), places.file == F.col("train_file")).select("unit", F.col("train_file").alias("run"))
    test = places.join(runs, places.file == F.col("test_file")).select("unit", F.col("train_file").alias("run")).distinct()
    train, test = materialize(train, "train"), materialize(test, "test")
    bits = block_bits(train.groupBy("run").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    flag = lambda t, name: t.select("unit").distinct().withColumn(name, F.lit(True))
    both = texts.df.join(flag(train, "tr"), "unit", "left").join(flag(test, "te"), "unit", "left").select("unit", "low", F.coalesce("tr", F.lit(False)).alias("tr"), F.coalesce("te", F.lit(False)).alias("te"))
    hashed = store(both.mapInArrow(_hash(bits), "unit long, c0 long, c1 long, c2 long, c3 long, n int, keys array<long>, probes array<long>"), "hashes")

    def side(which: DataFrame, tag: str, blocks: str) -> DataFrame:
        one = which.join(hashed.df.select("unit", "c0", "c1", "n", blocks), "unit").select("unit", "run", "c0", "c1", "n", F.explode(blocks).alias("block"))
        return one.select(F.xxhash64("run", "block").alias("k"), F.col("unit").alias(f"u{tag}"), F.col("c0").alias(f"{tag}0"), F.col("c1").alias(f"{tag}1"), F.col("n").alias(f"n{tag}"))

    lengths = F.abs(F.col("na") - F.col("nb")) <= MOST_EDITS * F.greatest("na", "nb") + 1e-9
    first = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) <= FIRST_RADIUS
    met = salted_join(side(train, "a", "keys"), side(test, "b", "probes"), "k", "ua").where(F.col("ua") != F.col("ub")).where(lengths & first)
    met = store(met.select(F.least("ua", "ub").alias("ua"), F.greatest("ua", "ub").alias("ub")).distinct(), "met")
    code = lambda tag: hashed.df.select(F.col("unit").alias(f"u{tag}"), *[F.col(f"c{k}").alias(f"{tag}{k}") for k in range(BITS // 64)])
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(1, BITS // 64)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    candidates = met.df.join(code("a"), "ua").join(code("b"), "ub").where(apart <= RADIUS).select("ua", "ub")
    numbers = F.transform(F.split("low", " "), lambda x: F.xxhash64(x))
    wa = texts.df.select(F.col("unit").alias("ua"), numbers.alias("wa"))
    wb = texts.df.select(F.col("unit").alias("ub"), numbers.alias("wb"))
    close = candidates.join(wa, "ua").join(wb, "ub").select("ua", "ub", "wa", "wb").mapInPandas(_verify, "ua long, ub long")

    # units whose texts are the same but for formatting
    key_of = keyed.df.join(ids.df.select("d", "unit"), "d").select("key", "unit").distinct()
    keys = store(key_of, "keys")
    several = keys.df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    company = materialize(keys.df.join(several, "key", "left_semi"), "company")
    alike = salted_join(company.select("key", F.col("unit").alias("ua")), company.select("key", F.col("unit").alias("ub")), "key", "ua").where("ua < ub").select("ua", "ub")

    links = materialize(close.union(alike).distinct(), "links")
    both = links.union(links.select(F.col("ub"), F.col("ua")))
    same = ids.df.select(F.col("unit").alias("ua"), F.col("unit").alias("ub"))
    related = materialize(both.union(same), "related")
    members = materialize(keyed.df.join(ids.df, "d").select("unit", "doc_id", "file"), "members")
    te = members.join(runs, members.file == F.col("test_file")).select(F.col("unit").alias("ua"), F.col("doc_id").alias("test_id"), "test_file", "train_file")
    tr = members.select(F.col("unit").alias("ub"), F.col("doc_id").alias("train_id"), F.col("file").alias("train_file"))
    out = salted_join(te.join(related, "ua").withColumn("k", F.xxhash64("ub", "train_file")).drop("train_file").withColumnRenamed("ub", "ub0"), tr.withColumn("k", F.xxhash64("ub", "train_file")), "k", "test_id")
    return out.where(F.col("ub") == F.col("ub0")).where("test_id <> train_id").select("test_file", "train_file", "test_id", "train_id").distinct()


def overlaps(docs: DataFrame, configs: DataFrame, **cols: str) -> DataFrame:
    """doc_id_a < doc_id_b of every overlapping pair, once."""
    p = overlap_pairs(docs, configs, **cols)
    return p.select(F.least("test_id", "train_id").alias("doc_id_a"), F.greatest("test_id", "train_id").alias("doc_id_b")).distinct()


def overlap_report(docs: DataFrame, configs: DataFrame) -> DataFrame:
    """test_file, train_file, source, pairs, test_rows: overlaps by test file and source of the test row.

    A null source is a source of its own.
    """
    p = overlap_pairs(docs, configs)
    src = docs.select(F.col("doc_id").cast("long").alias("test_id"), "source")
    return p.join(src, "test_id").groupBy("test_file", "train_file", "source").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("test_id").alias("test_rows"))
