"""Problem 3: records that differ only in white space, case, punctuation or the order of their fields.

Progressive partition refinement: all rows are partitioned by cheap invariants (stripped length and
counts of a few letters, which no reordering changes); classes with several members are refined by
the whole letter histogram; what is left in company is refined by the exact key, the sorted items.
Only the last stage cuts texts into items, and it sees only rows that have passed the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import WORD_CHARS, col, stripped
from quillmark.operators.skew import attach_group, digest, semi_join_checked
from quillmark.operators.storage import materialize, store

FIELD_NAMES = ("title", "venue", "keywords", "summary")
_LETTERS = "eatnoиоεα"


def exact_key(text: Column | str, fields: tuple[str, ...] = FIELD_NAMES) -> Column:
    """What two texts have in common when they are the same but for formatting: what stands before the first item, and the sorted items, all stripped.

    An item starts at a field name that no letter, mark or digit precedes and that optional white
    space and a colon follow. A text without such a place has no item. A field name with a character
    without width inside is no field name, so its text belongs to what stands before.
    """
    field = rf"(?:{'|'.join(fields)})[\s\p{{Z}}]*:"
    parts = F.split(F.lower(col(text)), rf"(?<![{WORD_CHARS}])(?={field})")
    strip = lambda x: F.regexp_replace(x, rf"[^{WORD_CHARS}]", "")
    begins = F.element_at(parts, 1).rlike(rf"^{field}")
    head = F.when(begins, F.lit("")).otherwise(strip(F.element_at(parts, 1)))
    items = F.when(begins, parts).otherwise(F.slice(parts, 2, 2_000_000_000))
    stripped_items = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.concat(head, F.lit("\u0002"), F.concat_ws("\u0001", F.array_sort(stripped_items)))


def _cheap(clean: Column) -> Column:
    counts = [F.length(clean) - F.length(F.replace(clean, F.lit(c), F.lit(""))) for c in _LETTERS]
    return F.xxhash64(F.length(clean), *counts)


def _histogram(clean: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(F.split(clean, "")), ""))


def format_classes(docs: DataFrame, doc_id: str = "doc_id", data: str = "data") -> tuple[DataFrame, DataFrame]:
    """(members, groups): doc_id and key of the rows in company; key, kept_doc_id and n of each group of two or more.

    Rows without a letter, mark or digit, or with null data, belong to no group.
    """
    base = docs.where(F.col(data).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(data).alias("text"))
    clean = stripped("text")
    rows = base.withColumn("k", _cheap(clean)).where(clean != "")
    n = F.count(F.lit(1)).alias("n")
    first = store(rows.groupBy("k").agg(n).where("n > 1"), "cheap")
    some = store(semi_join_checked(rows, first.df, "k", "doc_id").select("doc_id", "text", F.xxhash64("k", _histogram(clean)).alias("k2")), "in-company")
    second = store(some.df.groupBy("k2").agg(n).where("n > 1"), "histogram")
    fewer = semi_join_checked(some.df, second.df, "k2", "doc_id")
    members = materialize(fewer.select("doc_id", digest(exact_key("text")).alias("key")), "members")
    for t in (first, some, second):
        t.drop()
    groups = materialize(members.groupBy("key").agg(F.min("doc_id").alias("kept_doc_id"), n).where("n > 1"), "groups")
    return members, groups


def same_but_format(docs: DataFrame, doc_id: str = "doc_id", data: str = "data") -> DataFrame:
    """kept_doc_id, doc_id: one row for each member of a group beyond the smallest id.

    Byte-identical copies are members too. A group may hold any share of the rows: it is reduced
    by partial aggregation and met again by a salted join. Rows with a repeated id give one row.
    """
    return _others(*format_classes(docs, doc_id, data))


def _others(members: DataFrame, groups: DataFrame) -> DataFrame:
    return attach_group(members, groups, "key", "doc_id").where("doc_id > kept_doc_id").select("kept_doc_id", "doc_id").distinct()


def collapsed(docs: DataFrame, doc_id: str = "doc_id", data: str = "data") -> DataFrame:
    """doc_id, copies: one record for each group and the number of its copies, and every record in no group with 1.

    Rows with null data or without a letter, mark or digit are left out.
    """
    members, groups = format_classes(docs, doc_id, data)
    alone = docs.where(F.col(data).isNotNull() & (stripped(data) != "")).select(F.col(doc_id).cast("long").alias("doc_id"))
    extra = _others(members, groups).select("doc_id").distinct()
    kept = groups.select(F.col("kept_doc_id").alias("doc_id"), "n")
    return alone.join(extra, "doc_id", "left_anti").join(kept, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(1).cast("long")).alias("copies"))
