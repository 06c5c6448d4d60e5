"""Reading the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.session import ship


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    """A table of the folder ``where``, in one file or a folder of parts."""
    ship(spark)
    return spark.read.parquet(f"{where}/{name}.parquet")
