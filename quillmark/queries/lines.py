"""Queries of the line parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.operators import reject_lines
from quillmark.queries.base import table


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return reject_lines.rejected(table(s, d, "raw_lines"), table(s, d, "label_set"))


def p5_loaded(s: SparkSession, d: str) -> DataFrame:
    return reject_lines.loaded(table(s, d, "raw_lines"), table(s, d, "label_set"))


QUERIES = {"p5_found": p5_found, "p5_loaded": p5_loaded}

_F = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_G = r'("(?:[^"]|"")*"|[^"\t][^\t]*|)'
_UN = """trim(CASE WHEN {0} LIKE '"%' THEN replace({0}[2:len({0}) - 1], '""', '"') ELSE {0} END, ' ')"""
_PARSED = rf"""
WITH cut AS (SELECT line_id, file_name, line_no, CASE WHEN line LIKE '%' || chr(13) THEN line[:len(line) - 1] ELSE coalesce(line, '') END AS x FROM raw_lines),
kind AS (SELECT *, regexp_full_match(x, '{_F}(\t{_F})*', 's') AS sound, regexp_full_match(x, '{_F}\t{_F}\t{_F}', 's') AS three, regexp_extract(x, '^{_G}\t{_G}\t{_G}$', ['a', 'b', 'c'], 's') AS f FROM cut),
parts AS (SELECT *, {_UN.format("f.a")} AS name, {_UN.format("f.b")} AS label, {_UN.format("f.c")} AS data FROM kind),
judged AS (SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN NOT three THEN 'columns'
  WHEN NOT regexp_full_match(name, '(docno|msg|abs):[0-9]+') OR label NOT IN (SELECT label FROM label_set WHERE label IS NOT NULL) OR NOT regexp_matches(data, '\p{{L}}') THEN 'value' END AS reason FROM parts)
"""

SQL = {
    "p5_found": _PARSED + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_loaded": _PARSED + "SELECT line_id, file_name, line_no, name, label, data FROM judged WHERE reason IS NULL",
}
