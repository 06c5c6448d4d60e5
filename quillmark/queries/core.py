"""All queries outside the subpackage for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.queries import checks, files, lines, models, text, topic, vector

_MODULES = [lines, text, vector, topic, files, checks, models]


def flagship(spark: SparkSession, where: str) -> DataFrame:
    """Tokens, a pruned vocabulary, a few sweeps of the default sampler, and the top words of its topics."""
    return models.QUERIES["lda_polyaurn"](spark, where)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}
