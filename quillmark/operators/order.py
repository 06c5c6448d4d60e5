"""Row numbers and running sums over a whole table without a window of one task.

Rows are range-partitioned and sorted, written with their partition and place in it, counted for each
partition, and shifted by what the partitions before them hold. Only one row for each partition goes
through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators.storage import materialize

_PLACE = (1 << 33) - 1  # the part of monotonically_increasing_id that counts inside a partition


def in_order(df: DataFrame, *order: Column | str, index: str = "index", total: str | None = None, running: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``index`` from 0 in the stated order.

    ``total`` names a column for the number of rows, ``running`` maps columns to names for their running
    sums, the own row included. The order should tell all rows apart; rows that tie in it get any of
    their places. An empty table gives an empty result.
    """
    running = running or {}
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy("_part").orderBy("_place")
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    t = materialize(sorted_.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33)).withColumn("_place", F.col("_m").bitwiseAND(_PLACE)).drop("_m"), "ordered")
    sums = [F.sum(c).alias(f"_s_{c}") for c in running]
    parts = t.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *sums)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = parts.select("_part", zero("_n").alias("_off"), F.sum("_n").over(Window.partitionBy()).alias("_all"), *[zero(f"_s_{c}").alias(f"_s_{c}") for c in running])
    x = t.join(F.broadcast(offsets), "_part").withColumn(index, F.col("_off") + F.col("_place"))
    for c, name in running.items():
        x = x.withColumn(name, F.sum(c).over(w) + F.col(f"_s_{c}"))
    if total:
        x = x.withColumn(total, F.col("_all"))
    return x.select(*df.columns, index, *([total] if total else []), *running.values())
