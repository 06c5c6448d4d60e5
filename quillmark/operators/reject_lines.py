"""Problem 5: separate the input lines that do not parse from the valid ones.

DuckDB's CSV reader runs on the workers over one in-memory file per input file and batch, with
reject tables. Lines go in as ``index TAB line`` followed by a sentinel line that holds a single
quote: an unclosed quote therefore ends in the sentinel of its own line and never swallows the next
one. A line whose sentinel is missing from the reject table had an open quote.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = r"^(docno|msg|abs):[0-9]+\z"
FIELDS = ("name", "label", "data")
_SENTINEL = '#"\n'
_CHUNK_BYTES = 8 << 20


def _placeholders(text: str, n: int) -> list[str]:
    """Private-use characters that the text does not hold."""
    out, c = [], 0xE000
    while len(out) < n:
        c = 0xF0000 if c == 0xF8FF else c + 1
        if chr(c) not in text:
            out.append(chr(c))
    return out


def parse_fields(lines: list[str | None]) -> tuple[list[str | None], list[list[str] | None]]:
    """(reason, fields) of each line: reason None with three fields, else ``quoting`` or ``columns``.

    Null lines have no field and get ``columns``.
    """
    import duckdb

    lines = [x[:-1] if x is not None and x.endswith("\r") else x for x in lines]
    whole = "".join(x for x in lines if x)
    space, cr, lf, nul, none = _placeholders(whole, 5)
    swap = {ord(" "): space, ord("\r"): cr, ord("\n"): lf, 0: nul}
    back = {ord(space): " ", ord(cr): "\r", ord(lf): "\n", ord(nul): "\0"}
    records = [f"{i}\t{(x or none).translate(swap)}\n".encode("utf-8", "surrogatepass") for i, x in enumerate(lines)]
    sent = _SENTINEL.encode()
    body = b"".join(r + sent for r in records)
    starts = np.concatenate([[0], np.cumsum([len(r) + len(sent) for r in records])]).astype(np.int64)
    sentinels = starts[1:] - len(sent)
    fd = os.memfd_create("lines")
    try:
        with os.fdopen(os.dup(fd), "wb") as f:
            f.write(body)
        con = duckdb.connect(config={"threads": 1})
        room = max(1 << 16, max(map(len, records)) + 64)
        ok = con.execute(
            f"""SELECT i, a, b, c FROM read_csv('/proc/{os.getpid()}/fd/{fd}', delim='\t', quote='"', escape='"', header=false,
            auto_detect=false, columns={{'i': 'BIGINT', 'a': 'VARCHAR', 'b': 'VARCHAR', 'c': 'VARCHAR'}}, store_rejects=true,
            rejects_limit=0, null_padding=false, strict_mode=true, new_line='\\n', comment='', parallel=false,
            max_line_size={room}, buffer_size={max(room * 2, 1 << 20)}, nullstr='{none}')"""
        ).fetchall()
        bad = con.execute("SELECT line_byte_position - 1, error_type FROM reject_errors").fetchall()
        con.close()
    finally:
        os.close(fd)
    seen = np.zeros(len(lines), bool)
    unquoted, failed = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    for at, kind in bad:
        i = int(np.searchsorted(starts, at, "right")) - 1
        if at == sentinels[i]:
            seen[i] = True
        else:
            failed[i] = True
            unquoted[i] |= "QUOTE" in kind
    reasons: list[str | None] = ["quoting" if u or not s else "columns" for u, s in zip(unquoted, seen)]
    fields: list[list[str] | None] = [None] * len(lines)
    for i, *got in ok:
        if seen[i] and not failed[i]:
            reasons[i], fields[i] = None, [("" if x is None else x).translate(back) for x in got]
    return reasons, fields


def _chunks(lines: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, x in enumerate(lines):
        size += len(x or "") * 4 + 32
        if size > _CHUNK_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(lines):
        yield start, len(lines)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for _, part in pdf.groupby("_file", dropna=False, sort=False):
            lines = [x if isinstance(x, str) else None for x in part["_line"]]
            for a, b in _chunks(lines):
                reasons, fields = parse_fields(lines[a:b])
                out = part.iloc[a:b][["_id", "_file", "_no"]].copy()
                out["reason"] = reasons
                for k, name in enumerate(FIELDS):
                    out[name] = [f[k] if f else None for f in fields]
                yield out


def parse_lines(raw: DataFrame, labels: DataFrame, line_id: str = "line_id", file_name: str = "file_name", line_no: str = "line_no", line: str = "line", label: str = "label") -> DataFrame:
    """One row per input row: line_id, file_name, line_no, reason, name, label, data.

    ``reason`` is null for a valid line, which then has its three fields without spaces around them;
    otherwise ``quoting``, ``columns`` or ``value`` and the fields are null. A null line counts as
    ``columns``, an empty one too; repeated lines give a row each; extra columns of the input are not
    read; an empty table gives an empty result. ``labels`` is joined as a set: null labels in it match nothing.
    """
    src = raw.select(F.col(line_id).cast("long").alias("_id"), F.col(file_name).alias("_file"), F.col(line_no).cast("long").alias("_no"), F.col(line).alias("_line"))
    got = src.mapInPandas(_parse, "_id long, _file string, _no long, reason string, name string, label string, data string")
    got = got.select("_id", "_file", "_no", "reason", *[F.trim(c).alias(c) for c in FIELDS])
    valid = labels.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct().withColumn("_known", F.lit(True))
    got = got.join(valid, "label", "left")
    wrong = ~F.col("name").rlike(NAME) | F.col("_known").isNull() | ~F.col("data").rlike(r"\p{L}")
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(wrong, F.lit("value"))
    fine = reason.isNull()
    return got.select(F.col("_id").alias("line_id"), F.col("_file").alias("file_name"), F.col("_no").alias("line_no"), reason.alias("reason"), *[F.when(fine, F.col(c)).alias(c) for c in FIELDS])


def rejected(raw: DataFrame, labels: DataFrame, **cols: str) -> DataFrame:
    """line_id and reason of each line that isn't valid."""
    return parse_lines(raw, labels, **cols).where(F.col("reason").isNotNull()).select("line_id", "reason")


def loaded(raw: DataFrame, labels: DataFrame, **cols: str) -> DataFrame:
    """The valid lines as typed records."""
    return parse_lines(raw, labels, **cols).where(F.col("reason").isNull()).select("line_id", "file_name", "line_no", *FIELDS)
