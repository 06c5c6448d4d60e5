"""Queries of the operators for training text and vectors, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import encoding, formatting, leaks, lookalikes, mixing, neighbours, overlaps, terms
from quillmark.queries.base import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return terms.useless_terms(table(s, d, "docs"), table(s, d, "lda_configs"))


def p1_term_frequency(s: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(s, d, "docs"), table(s, d, "lda_configs"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return overlaps.overlaps(table(s, d, "docs"), table(s, d, "lda_configs"))


def p2_overlap_report(s: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_report(table(s, d, "docs"), table(s, d, "lda_configs"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return formatting.same_but_format(table(s, d, "docs"))


def p3_copies(s: SparkSession, d: str) -> DataFrame:
    return formatting.collapsed(table(s, d, "docs"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(table(s, d, "doc_topics"))


def p4_search(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "doc_topics")
    r = neighbours.search(t, t.where(F.col("doc_id") % 50 == 0))
    return r.select("id", "neighbour", F.round("sim", 9).alias("sim"), "rank")


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return lookalikes.alike_pairs(table(s, d, "docs"))


def p6_classes(s: SparkSession, d: str) -> DataFrame:
    return lookalikes.alike_classes(table(s, d, "docs"))


def p6_consistent(s: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent_form(table(s, d, "docs")).select("doc_id", "form")


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(s, d, "documents"), table(s, d, "eval_items")).select("item_id", "doc_id")


def p7_coverage(s: SparkSession, d: str) -> DataFrame:
    """Also passages that were cut up or put in another order: tiles of five words, a third of the item."""
    return leaks.leaks(table(s, d, "documents"), table(s, d, "eval_items"), min_match=5).where("coverage >= 0.33")


def p8_mixture(s: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(table(s, d, "documents"), table(s, d, "mix_targets")).selection


def p8_shares(s: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(table(s, d, "documents"), table(s, d, "mix_targets")).shares


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(s, d, "documents")).select("doc_id")


def p9_restored(s: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(s, d, "documents"))


def queries() -> dict[str, Query]:
    found = [p1_found, p1_term_frequency, p2_found, p2_overlap_report, p3_found, p3_copies, p4_found, p4_search, p6_found, p6_classes, p6_consistent, p7_found, p7_coverage, p8_mixture, p8_shares, p9_found, p9_restored]
    return {f.__name__: f for f in found}


_TERMS = r"""
WITH kept AS (
  SELECT file_name, doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(data), '[\r\n\t]+', ' ', 'g'), '[^\p{L}\p{M}\p{Z}\p{P}]', '', 'g'), '[\p{L}\p{M}]+') AS t
  FROM docs WHERE data IS NOT NULL),
sizes AS (SELECT file_name, count(*) AS n_rows FROM kept GROUP BY 1),
each AS (SELECT file_name, doc_id, unnest(t) AS term FROM kept),
counts AS (SELECT file_name, term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM each GROUP BY 1, 2),
marked AS (
  SELECT config_name, term, occurrences, records, occurrences < rare_threshold AS rare, 100 * records > common_doc_pct * n_rows AS common
  FROM lda_configs c JOIN counts k ON k.file_name = c.dataset_filename JOIN sizes s ON s.file_name = c.dataset_filename)
"""

_STRIP = r"'[^\p{L}\p{M}\p{Nd}]', '', 'g'"
_KEYS = rf"""
WITH marked AS (
  SELECT doc_id, lower(data) AS low,
    regexp_replace(lower(data), '(^|[^\p{{L}}\p{{M}}\p{{Nd}}])((?:title|venue|keywords|summary)[\s\p{{Z}}]*:)', '\1' || chr(1) || '\2', 'g') AS cut
  FROM docs WHERE data IS NOT NULL),
keyed AS (
  SELECT doc_id, p[1] || chr(2) || array_to_string(list_sort(list_filter(p[2:], lambda x: x <> '')), chr(1)) AS key FROM (SELECT doc_id, list_transform(string_split(cut, chr(1)), lambda x: regexp_replace(x, {_STRIP})) AS p FROM marked)),
grouped AS (SELECT doc_id, key, min(doc_id) OVER (PARTITION BY key) AS kept, count(*) OVER (PARTITION BY key) AS n FROM keyed WHERE key <> chr(2))
"""


_COSINES = """
WITH v AS (SELECT doc_id, list_transform(theta, lambda x: x / sqrt(list_sum(list_transform(theta, lambda y: y * y)))) AS u FROM doc_topics WHERE theta IS NOT NULL AND list_max(theta) > 0),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, list_dot_product(a.u, b.u) AS s FROM v a JOIN v b ON a.doc_id <> b.doc_id WHERE {0}),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 12) DESC, b)::INT AS r FROM c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _COSINES.format("TRUE") + "SELECT DISTINCT least(a, b) AS doc_id_a, greatest(a, b) AS doc_id_b FROM r WHERE r <= 5 AND s >= 0.97",
        "p4_search": _COSINES.format("a.doc_id % 50 = 0") + "SELECT a AS id, b AS neighbour, round(s, 9) AS sim, r AS rank FROM r WHERE r <= 5",
        "p1_found": _TERMS + "SELECT config_name, term, 'rare' AS mark FROM marked WHERE rare UNION ALL SELECT config_name, term, 'common' FROM marked WHERE common",
        "p1_term_frequency": _TERMS + "SELECT * FROM marked",
        "p3_found": _KEYS + "SELECT kept AS kept_doc_id, doc_id FROM grouped WHERE doc_id > kept",
        "p3_copies": _KEYS + "SELECT doc_id, n AS copies FROM grouped WHERE doc_id = kept",
        "p7_found": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}]+') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}]+') AS t FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(t[p:p + 12], ' ') AS run FROM (SELECT doc_id, t, unnest(range(1, len(t) - 11)) AS p FROM w)),
iw AS (SELECT item_id, array_to_string(t[p:p + 12], ' ') AS run FROM (SELECT item_id, t, unnest(range(1, len(t) - 11)) AS p FROM i))
SELECT DISTINCT item_id, doc_id FROM dw JOIN iw USING (run)""",
    }
