"""Structured Streaming: running corpus statistics and inference of arriving documents.

Counts form a monoid, so term frequencies run in update mode; documents are independent given phi,
so inference is a stateless map. Windowed counts use a watermark: later rows are dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.functions import text as T
from quillmark.models import lda


def running_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """Term, tf over all that has arrived (output mode ``update`` or ``complete``)."""
    return docs.where(F.col(text).isNotNull()).select(F.explode(T.tokens(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))


def windowed_terms(docs: DataFrame, time: str, width: str = "1 day", late: str = "3 days", text: str = "text") -> DataFrame:
    """window, term, tf by event time; rows later than the watermark are left out."""
    tokens = docs.withWatermark(time, late).where(F.col(text).isNotNull()).select(F.col(time), F.explode(T.tokens(text)).alias("term"))
    return tokens.groupBy(F.window(time, width), "term").agg(F.count(F.lit(1)).alias("tf"))


def with_types(docs: DataFrame, vocabulary: DataFrame, text: str = "text", most: int = 1_000_000) -> DataFrame:
    """doc_id, types over a frozen vocabulary, as one map expression; the vocabulary's size is checked, as it becomes a literal map."""
    rows = vocabulary.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the vocabulary is too large for a streaming lookup: prune it")
    table = docs.sparkSession.sparkContext.broadcast({r.term: r.type_id for r in rows})

    @F.pandas_udf("array<int>")
    def look_up(tokens):  # noqa: ANN001, ANN202
        m = table.value
        return tokens.map(lambda a: [m[t] for t in a if t in m])

    return docs.where(F.col(text).isNotNull()).select("doc_id", look_up(T.tokens(text)).alias("types"))


def infer_stream(docs: DataFrame, vocabulary: DataFrame, phi: np.ndarray, alpha: np.ndarray, sweeps: int = 50, seed: int = 0) -> DataFrame:
    """doc_id, types, z, theta of each arriving document."""
    return lda.infer(with_types(docs, vocabulary), phi, alpha, sweeps, seed)


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream as parquet, all that is available now and then stop."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
