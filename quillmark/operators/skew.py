"""Joins that stay balanced when one key holds a large part of all rows.

Every key with more than ``CHUNK`` rows is split. The split table (key, number of salts) is counted:
up to ``MOST`` keys it is broadcast whole. Beyond that its ``MOST`` largest keys are broadcast, and the
rest, each of which then holds less than one row in ``MOST``, are looked up by a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.storage import materialize

#: Most keys of a broadcast split table (a digest and a number each: about 10 MB).
MOST = 100_000
CHUNK = 20_000


def _look_up(rows: DataFrame, table: DataFrame, key: str, n: str, most: int) -> DataFrame:
    """Left join of rows with a small-row table by key, in ``_hit``; ``table`` is written, with a size column ``n``."""
    rest = [c for c in table.columns if c != key]
    one = lambda t, name: t.select(F.col(key), F.struct(*rest).alias(name))
    if table.count() <= most:
        return rows.join(F.broadcast(one(table, "_hit")), key, "left")
    top = table.orderBy(F.col(n).desc(), key).limit(most)
    tagged = rows.join(F.broadcast(one(top, "_top")), key, "left")
    found = tagged.where("_top IS NOT NULL").withColumnRenamed("_top", "_hit")
    return found.unionByName(tagged.where("_top IS NULL").drop("_top").join(one(table, "_hit"), key, "left"))


def attach_group(rows: DataFrame, groups: DataFrame, key: str, row_id: str, n: str = "n", chunk: int = CHUNK, most: int = MOST) -> DataFrame:
    """Inner join of rows with one-row-per-key ``groups`` (which has a count column ``n``).

    Rows of keys above ``chunk`` meet their group through the split table, so they are never shuffled by
    key; the others go through a shuffle. Rows with a null key have no group and are dropped.
    """
    rest = [c for c in groups.columns if c != key]
    hot = materialize(groups.where(F.col(n) > chunk), "hot")
    tagged = _look_up(rows, hot, key, n, most)
    keep = [c for c in rows.columns if c != key]
    out = tagged.where("_hit IS NOT NULL").select(key, *keep, *[F.col("_hit")[c].alias(c) for c in rest])
    cold = tagged.where("_hit IS NULL").drop("_hit").join(groups.where(F.col(n) <= chunk), key)
    return out.unionByName(cold.select(key, *keep, *rest))


def salted_join(left: DataFrame, right: DataFrame, key: str, left_id: str, how: str = "inner", chunk: int = CHUNK, most: int = MOST) -> DataFrame:
    """Equi-join of two many-row sides on ``key``; every key with more than ``chunk`` rows on the left is cut into chunks.

    Left rows of such a key get one of S salts, right rows of that key are repeated S times, where
    S = ceil(rows / chunk). No row is dropped. Both sides may share no column but ``key``.
    """
    counted = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(counted.where(F.col("_n") > chunk).withColumn("_s", F.ceil(F.col("_n") / F.lit(chunk)).cast("long")), "hot")
    salts = F.coalesce(F.col("_hit._s"), F.lit(1).cast("long"))
    a = _look_up(left, hot, key, "_n", most).withColumn("_salt", F.pmod(F.xxhash64(left_id), salts)).drop("_hit")
    b = _look_up(right, hot, key, "_n", most).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_hit")
    return a.join(b, [key, "_salt"], how).drop("_salt")


def semi_join_checked(rows: DataFrame, keys: DataFrame, key: str, row_id: str, n: str = "n", most: int = 500_000) -> DataFrame:
    """Keep the rows whose key is in ``keys`` (distinct, stored, with a count column ``n``).

    The keys are counted: up to ``most`` (about 40 MB of hashed longs) they are broadcast and the
    rows are not shuffled; beyond it ``attach_group`` joins them by a balanced shuffle. Both give the same rows.
    """
    if keys.count() <= most:
        return rows.join(F.broadcast(keys.select(key)), key, "left_semi")
    return attach_group(rows, keys.select(key, n), key, row_id, n).select(*rows.columns)


def digest(c: Column) -> Column:
    """256-bit digest of a string as 32 bytes."""
    return F.unhex(F.sha2(c, 256))
