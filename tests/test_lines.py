"""The line parser against a character-by-character reading of the rules."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.operators.reject_lines import loaded, parse_fields, parse_lines, rejected


def by_hand(line):
    if line is None:
        return "columns", None
    line = line.removesuffix("\r")
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, field = i + 1, ""
            while True:
                if j >= len(line):
                    return "quoting", None
                if line[j : j + 2] == '""':
                    field += '"'
                    j += 2
                elif line[j] == '"':
                    j += 1
                    break
                else:
                    field += line[j]
                    j += 1
            if j < len(line) and line[j] != "\t":
                return "quoting", None
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            field = line[i:j]
        out.append(field)
        if j >= len(line):
            return (None, out) if len(out) == 3 else ("columns", None)
        i = j + 1


PIECES = ['"', '""', "\t", "\t", "a", " ", "#", "\r", "\n", "\\", "é", "'", ",", "\0", "", "😀"]


def test_random_lines():
    rng = random.Random(5)
    lines = [None, ""] + ["".join(rng.choices(PIECES, k=rng.randrange(14))) for _ in range(6000)]
    reasons, fields = parse_fields(lines)
    assert list(zip(reasons, fields)) == [by_hand(x) for x in lines]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=30))
def test_any_lines(lines):
    reasons, fields = parse_fields(lines)
    assert list(zip(reasons, fields)) == [by_hand(x) for x in lines]


def test_long_line():
    long = "docno:1\tmisc\t" + "word " * 400_000
    assert parse_fields(["x", long, '"'])[0] == ["columns", None, "quoting"]


@pytest.fixture
def tables(spark):
    lines = ["docno:1\tmisc\ttext", ' msg:2 \t "misc" \tx', '"abs:3"\t"misc"\t"a ""b"" c\td"', "docno:x\tmisc\tx", "docno:4\tMisc\tx", "docno:5\tmisc\t123", "", None, 'docno:6\tmisc\t"x', "docno:7\tmisc\tx\r", "docno:7\tmisc\tx\r", "docno:8\n\tmisc\tx"]
    raw = spark.createDataFrame([(i, "f", i, x, "extra") for i, x in enumerate(lines)], "line_id long, file_name string, line_no long, line string, reason string")
    return raw, spark.createDataFrame([(0, "misc"), (1, None), (2, "misc")], "label_id int, label string")


def test_reasons(tables):
    got = {r.line_id: r.reason for r in rejected(*tables).collect()}
    assert got == {1: "value", 3: "value", 4: "value", 5: "value", 6: "columns", 7: "columns", 8: "quoting", 11: "value"}


def test_loaded(tables):
    got = {r.line_id: (r.name, r.label, r.data) for r in loaded(*tables).collect()}
    assert got == {0: ("docno:1", "misc", "text"), 2: ("abs:3", "misc", 'a "b" c\td'), 9: ("docno:7", "misc", "x"), 10: ("docno:7", "misc", "x")}


def test_empty_table(tables):
    raw, labels = tables
    assert parse_lines(raw.where("false"), labels).count() == 0
    assert rejected(raw, labels.where("false")).count() == raw.count()
