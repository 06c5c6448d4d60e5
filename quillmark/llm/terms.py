"""Problem 1: frequency of every distinct term, by a range-partitioned external sort and a run-length scan.

(collection, term, record) triples are range-partitioned and sorted, spilling as needed. Equal
triples lie in one partition, so a scan of each partition counts, run by run, the occurrences and
the distinct records of a term; a term whose run is cut by a partition border, as that of a very
frequent term, is added up from its pieces afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import tokens
from quillmark.operators.storage import materialize


def _changes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """True where a value differs from the one before; nulls are equal to nulls."""
    n = len(column)
    out = np.ones(n, bool)
    if n > 1:
        a, b = column.slice(1), column.slice(0, n - 1)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False).copy()
        if column.null_count:
            same |= (pc.is_null(a).to_numpy(zero_copy_only=False)) & (pc.is_null(b).to_numpy(zero_copy_only=False))
        out[1:] = ~same
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (collection, term) in sorted (collection, term, record, count) rows; runs may go on over batches."""
    held: tuple | None = None  # collection, term, occurrences, records, last record

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*parts)) if parts else [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["collection", "term", "occurrences", "records"])

    for b in batches:
        if not b.num_rows:
            continue
        key = _changes(b.column(0)) | _changes(b.column(1))
        record = key | _changes(b.column(2))
        at = np.flatnonzero(key)
        occurrences = np.add.reduceat(b.column(3).to_numpy(zero_copy_only=False), at).astype(np.int64)
        records = np.add.reduceat(record.astype(np.int64), at)
        first, last = b.slice(0, 1).to_pylist()[0], b.slice(b.num_rows - 1, 1).to_pylist()[0]
        names = b.schema.names
        if held is not None:
            if (held[0], held[1]) == (first[names[0]], first[names[1]]):
                occurrences[0] += held[2]
                records[0] += held[3] - (held[4] == first[names[2]])
            else:
                yield rows([held[:4]])
        take = pa.array(at[:-1])
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(occurrences[:-1]), pa.array(records[:-1])], names=["collection", "term", "occurrences", "records"])
        held = (last[names[0]], last[names[1]], int(occurrences[-1]), int(records[-1]), last[names[2]])
    if held is not None:
        yield rows([held[:4]])


def within_record(ordered: str) -> Column:
    """Run lengths of a sorted token array: what is counted inside a record needs no shuffle."""
    t = F.col(ordered)
    starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
    ends = F.concat(F.slice(starts, 2, F.size(t)), F.array(F.size(t) + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(F.get(t, a - 1).alias("term"), (b - a).cast("long").alias("times")))
    return F.when(F.size(t) > 0, runs)


def term_frequencies(docs: DataFrame, collection: str, record: str, text: str) -> DataFrame:
    """collection, term, occurrences, records: counts of every distinct term of every collection.

    Rows with a null text have no term; a null collection is one of its own; rows that share a
    record id count as one record. Texts without terms give no row, empty tables an empty result.
    """
    texts = docs.where(F.col(text).isNotNull()).select(F.col(collection).cast("string").alias("collection"), F.col(record).cast("long").alias("record"), F.array_sort(tokens(text)).alias("t"))
    # written once: the range partitioning reads its input twice, and would cut all texts into terms twice
    counted = materialize(texts.select("collection", "record", F.explode(within_record("t")).alias("_")).select("collection", "_.term", "record", "_.times"), "counted")
    ordered = counted.repartitionByRange("collection", "term", "record").sortWithinPartitions("collection", "term", "record")
    pieces = ordered.mapInArrow(_scan, "collection string, term string, occurrences long, records long")
    return pieces.groupBy("collection", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _training(docs: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    files = configs.where(F.col("dataset_filename").isNotNull()).select(F.col("dataset_filename").alias("file_name")).distinct()
    mine = docs.where(F.col("data").isNotNull()).select("file_name", "doc_id", "data").join(files, "file_name", "left_semi")
    return mine, mine.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"))


def marked_terms(docs: DataFrame, configs: DataFrame) -> DataFrame:
    """config_name, term, occurrences, records, rare, common for every term of each run's training file.

    ``rare``: fewer than rare_threshold occurrences; ``common``: in more than common_doc_pct percent
    of the file's rows with data, empty ones included. A null threshold marks nothing; runs without
    a training file, or whose file has no rows, give no row. A file of several runs is counted once.
    """
    mine, sizes = _training(docs, configs)
    counts = term_frequencies(mine, "file_name", "doc_id", "data").withColumnRenamed("collection", "file_name")
    runs = configs.select("config_name", F.col("dataset_filename").alias("file_name"), "rare_threshold", "common_doc_pct").join(sizes, "file_name")
    runs = materialize(runs, "runs")
    out = counts.join(runs, "file_name")
    rare = F.coalesce(F.col("occurrences") < F.col("rare_threshold"), F.lit(False))
    common = F.coalesce(100 * F.col("records") > F.col("common_doc_pct") * F.col("n_rows"), F.lit(False))
    return out.select("config_name", "term", "occurrences", "records", rare.alias("rare"), common.alias("common"))


def useless_terms(docs: DataFrame, configs: DataFrame) -> DataFrame:
    """config_name, term, mark: one row for each mark, ``rare`` or ``common``, that a term gets."""
    m = marked_terms(docs, configs)
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return m.where("rare OR common").select("config_name", "term", F.explode(marks).alias("mark"))
