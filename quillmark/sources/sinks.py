"""Sinks (O1-O8, K20): everything is written by Spark's writers, in as many files as the data needs."""

from __future__ import annotations

import json
import time
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import topics, vectors
from quillmark.operators.storage import exists, write_bytes


def _text(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).alias("value")).write.mode("overwrite").text(path)


def write_matrix(df: DataFrame, path: str, row: str = "row", values: str = "values", sep: str = ", ") -> None:
    """O1: one line for each row of an array column, in row order."""
    lines = df.orderBy(row).select(F.array_join(F.transform(values, lambda x: x.cast("string")), sep).alias("value"))
    _text(lines, path)


def matrix_bytes(m: np.ndarray, kind: str = "double") -> bytes:
    """O1: the big-endian binary form of a small matrix (K by V at most)."""
    return np.ascontiguousarray(m).astype(">i4" if kind == "int" else ">f8").tobytes()


def write_indicators(assign: DataFrame, path: str, style: str = "standard", vocab: DataFrame | None = None, sources: DataFrame | None = None) -> None:
    """O2: topics of each document as a comma-separated line, or one ``#doc source pos typeindex type topic`` line for each token."""
    if style == "standard":
        docs = assign.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "topic"))).alias("z"))
        _text(docs.orderBy("doc_id").select(F.array_join(F.transform("z", lambda x: x["topic"].cast("string")), ",").alias("value")), path)
        return
    x = assign.join(vocab, "type_id")
    x = x.join(sources, "doc_id", "left") if sources is not None else x.withColumn("source", F.lit("NA"))
    line = F.concat_ws(" ", "doc_id", F.coalesce("source", F.lit("NA")), "pos", "type_id", "term", "topic")
    _text(x.orderBy("doc_id", "pos").select(line.alias("value")), path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """O3: one term for each line in order of the type id."""
    _text(vocab.orderBy("type_id").select("term"), path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Term frequencies, document lengths, tokens per topic, theta, z-bar, diagnostics."""
    df.write.mode("overwrite").option("header", header).csv(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, partitioned by the stated columns."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_svmlight(corpus: DataFrame, path: str) -> None:
    """``n id:1 id:1 ...`` for each document."""
    _text(corpus.orderBy("doc_id").select(vectors.svmlight(F.col("types")).alias("value")), path)


def diagnostics_text(wide: DataFrame, kind: str = "csv") -> str:
    """One line for each topic as csv or aligned text, or xml; K rows at most are read."""
    cols = wide.columns
    rows = [list(r) for r in wide.orderBy("topic").collect()]
    if kind == "csv":
        return "\n".join([",".join(cols)] + [",".join("" if v is None else str(v) for v in r) for r in rows])
    if kind == "text":
        show = lambda v: "-" if v is None else vectors.scientific(v) if isinstance(v, float) else str(v)
        return "\n".join("\t".join(x) for x in [cols] + [[show(v) for v in r] for r in rows])
    body = "".join("  <topic " + " ".join(f"{c}={quoteattr(str(v))}" for c, v in zip(cols, r) if v is not None) + "/>\n" for r in rows)
    return f"<?xml version=\"1.0\"?>\n<model>\n{body}</model>\n" if rows else f"<model>{escape('')}</model>"


def write_log(spark: SparkSession, rows: list[dict], path: str) -> None:
    """One tab-separated file with a header: iteration first, then the other figures; nothing without rows."""
    if rows:
        cols = ["iteration"] + sorted({k for r in rows for k in r} - {"iteration"})
        body = "\n".join("\t".join("" if r.get(c) is None else str(r[c]) for c in cols) for r in rows)
        write_bytes(spark, path, ("\t".join(cols) + "\n" + body + "\n").encode())


def write_delta(before: DataFrame, after: DataFrame, path: str, iteration: int) -> None:
    """The counts that changed in an iteration (L27), under a folder of their own."""
    write_table(topics.count_delta(before, after), f"{path}/iteration={iteration}")


class Run:
    """A run directory named by time, on any file system, with a manifest (settings, commit, Spark version) and timings."""

    def __init__(self, spark: SparkSession, base: str, name: str, settings: dict) -> None:
        self.spark, self.path = spark, f"{base.rstrip('/')}/{name}-{time.strftime('%Y-%m-%d--%H_%M_%S')}"
        while exists(spark, self.path):
            self.path += "+"
        self.started, self.times = time.time(), {}
        note = {"settings": settings, "commit": commit(), "spark": spark.version, "application": spark.sparkContext.applicationId}
        write_bytes(spark, f"{self.path}/manifest.json", json.dumps(note, indent=1, sort_keys=True, default=str).encode())

    def timed(self, what: str, seconds: float) -> None:
        self.times[what] = self.times.get(what, 0.0) + seconds

    def finish(self) -> None:
        write_bytes(self.spark, f"{self.path}/timings.json", json.dumps(self.times | {"total": time.time() - self.started}, indent=1).encode())


def commit() -> str | None:
    """The commit of the code's checkout, if it is one."""
    git = Path(__file__).resolve().parents[2] / ".git"
    try:
        head = (git / "HEAD").read_text().strip()
        return (git / head.removeprefix("ref: ")).read_text().strip() if head.startswith("ref: ") else head
    except OSError:
        return None
