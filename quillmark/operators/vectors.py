"""Document vectors and their text forms (F1-F6, F11), sparse as maps and long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequency_map(tokens: DataFrame) -> DataFrame:
    """doc_id, vector: term -> count, entries in order of the term."""
    n = tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "n")))).alias("vector"))


def occurrence_terms(tokens: DataFrame) -> DataFrame:
    """doc_id, term, value 1 for every term of a document."""
    return tokens.select("doc_id", "term").distinct().withColumn("value", F.lit(1))


def tfidf_vector(tokens: DataFrame, weighted: DataFrame) -> DataFrame:
    """doc_id, term, value (corpus tf-idf of each distinct term), rounded (the integer form)."""
    return tokens.select("doc_id", "term").distinct().join(weighted.select("term", "tfidf"), "term").select("doc_id", "term", F.col("tfidf").alias("value"), F.round("tfidf").cast("long").alias("rounded"))


def annotated(vector: Column, least: float = 0.00005) -> Column:
    """``term:value`` entries joined by blanks; values under ``least`` are left out."""
    kept = F.filter(F.map_entries(vector), lambda e: e["value"] >= least)
    return F.array_join(F.transform(kept, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), " ")


def sort_indices(values: Column) -> Column:
    """indices (from 0) by falling value; ties keep their order."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def svmlight(types: Column) -> Column:
    """``n id:1 id:1 ...`` with one entry for each token, not aggregated."""
    return F.concat_ws(" ", F.size(types).cast("string"), F.array_join(F.transform(types, lambda t: F.concat(t.cast("string"), F.lit(":1"))), " "))


def index_string(types: Column) -> Column:
    """the type ids joined by blanks."""
    return F.array_join(F.transform(types, lambda t: t.cast("string")), " ")


def scientific(x: float) -> str:
    """four decimals; tiny numbers as ``00.###E0``; zero as ``<0.0>``."""
    if x == 0:
        return "<0.0>"
    if abs(x) >= 0.0001:
        return f"{x:.4f}"
    exponent = -5
    mantissa = abs(x)
    e = 0
    while mantissa < 10:
        mantissa *= 10
        e -= 1
    digits = f"{mantissa:.3f}".rstrip("0").rstrip(".")
    return f"{'-' if x < 0 else ''}{digits}E{min(e, exponent) if e > exponent else e}"


def matrix_text(rows: list[list[float]], width: int | None = None, sep: str = ", ") -> str:
    """a matrix as lines, values as they are or right-aligned to ``width``."""
    one = (lambda v: f"{v:>{width}}") if width else str
    return "\n".join(sep.join(one(v) for v in r) for r in rows)
