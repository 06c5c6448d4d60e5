"""Problem 6: one form for texts that look alike.

Arrow text is copied to code-point arrays; lookup tables map single characters, decompositions are
expanded through offsets, characters without width are dropped inside words, look-alike letters
are moved to the script of their word, marks are put in canonical order and composed, all for a
whole batch at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.codepoints import N_CODES, category_table, code_points, pieces, rows_of, spans, to_strings, word_table
from quillmark.operators.skew import attach_group, digest, salted_join, semi_join_checked
from quillmark.operators.storage import materialize

# Characters without width.
WIDTHLESS = (0x00AD, 0x034F, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF)
# Letters that look alike, one line for each pair of scripts, letter by letter.
CYRILLIC_LATIN = ("аеорсухіѕјһԁԛԝүАВЕЗКМНОРСТУХІЅЈҺԚԜҮ", "aeopcyxisjhdqwyABE3KMHOPCTYXISJHQWY")
GREEK_LATIN = ("οναιρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovaipukABEZHIKMNOPTYX")
GREEK_CYRILLIC = ("οαρΑΒΕΗΚΜΟΡΤΧΓΠΦ", "оарАВЕНКМОРТХГПФ")
LATIN, GREEK, CYRILLIC, ARMENIAN, CHEROKEE, COPTIC, LISU = range(1, 8)
NAMES = {"LATIN": LATIN, "GREEK": GREEK, "CYRILLIC": CYRILLIC, "ARMENIAN": ARMENIAN, "CHEROKEE": CHEROKEE, "COPTIC": COPTIC, "LISU": LISU}
# Where the letters of the further scripts are; which of them look alike is asked of the Unicode confusables.
FURTHER = ((0x531, 0x588), (0x13A0, 0x13FE), (0x2C80, 0x2CE5), (0xA4D0, 0xA4F8), (0xAB70, 0xABC0))
Extra = tuple[tuple[int, str], ...]


@lru_cache(1)
def confusables(spark: SparkSession) -> Extra:
    """(code point, skeleton) of the letters of the further scripts and of basic Latin, Greek and Cyrillic that the Unicode confusables (in the ICU library of Spark) map to one character."""
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    basic = ((0x41, 0x5B), (0x61, 0x7B), (0x386, 0x3CF), (0x400, 0x460))
    out = []
    for a, z in (*basic, *FURTHER):
        for c in range(a, z):
            if unicodedata.category(chr(c))[0] == "L":
                skeleton = checker.getSkeleton(chr(c))
                if len(skeleton) == 1:
                    out.append((c, skeleton))
    return tuple(out)


@lru_cache(None)
def _single() -> np.ndarray:
    """Character by character: full-width forms to ordinary ones, fixed-width and non-breaking spaces to a space."""
    t = np.arange(N_CODES, dtype=np.uint32)
    t[0xFF01:0xFF5F] = np.arange(0x21, 0x7F)
    for wide, plain in zip(range(0xFFE0, 0xFFE7), (0xA2, 0xA3, 0xAC, 0xAF, 0xA6, 0xA5, 0x20A9)):
        t[wide] = plain
    for c in range(0xFF61, 0xFFDD):  # half-width Katakana and Hangul; the voiced marks compose with what they follow
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1:
            t[c] = ord(plain)
    for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000):
        t[c] = 0x20
    return t


@lru_cache(None)
def _decompositions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start, code points) of the canonical decomposition of every code point; length 1 for itself."""
    length, start, flat = np.ones(N_CODES, np.int64), np.zeros(N_CODES, np.int64), []
    for c in [*range(0xC0, 0x3100), *range(0xA000, 0x30000)]:
        ch = chr(c)
        d = unicodedata.decomposition(ch)
        if (d and d[0] != "<") or 0xAC00 <= c <= 0xD7A3:
            full = unicodedata.normalize("NFD", ch)
            length[c], start[c] = len(full), len(flat)
            flat += map(ord, full)
    return length, start, np.array(flat, np.uint32)


@lru_cache(None)
def _classes() -> np.ndarray:
    """Canonical combining class."""
    return np.fromiter((unicodedata.combining(chr(i)) for i in range(N_CODES)), np.uint8, N_CODES)


@lru_cache(None)
def _pairs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (first << 21 | second) of the primary composites, the composites, and a table of possible seconds."""
    found = {}
    for c in [*range(0xC0, 0x3100), *range(0xA000, 0x30000)]:
        d = unicodedata.decomposition(chr(c))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(c)) == chr(c):
            a, b = (int(x, 16) for x in d.split())
            found[a << 21 | b] = c
    for c in range(0xAC00, 0xD7A4):
        i = c - 0xAC00
        if i % 28:
            found[(0xAC00 + i - i % 28) << 21 | (0x11A7 + i % 28)] = c
        else:
            found[(0x1100 + i // 588) << 21 | (0x1161 + i % 588 // 28)] = c
    keys = np.array(sorted(found), np.int64)
    second = np.zeros(N_CODES, bool)
    second[keys & 0x1FFFFF] = True
    return keys, np.array([found[k] for k in keys.tolist()], np.uint32), second


def _composite(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The composite of each pair, 0 where there is none."""
    keys, out, _ = _pairs()
    k = first.astype(np.int64) << 21 | second.astype(np.int64)
    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    return np.where(keys[at] == k, out[at], 0).astype(np.uint32)


@lru_cache(4)
def _scripts(extra: Extra = ()) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Script of each letter (0: none of those known) and, for each script, the look-alike of a foreign letter (0: none)."""
    script = np.zeros(N_CODES, np.uint8)
    for c in [*range(0x41, 0x1F00), *range(0xA720, 0xA800), *(x for a, z in FURTHER for x in range(a, z))]:
        if unicodedata.category(chr(c))[0] == "L":
            script[c] = NAMES.get(unicodedata.name(chr(c), "").split(" ")[0], 0)
    to = {s: np.zeros(N_CODES, np.uint32) for s in NAMES.values()}
    for (a, b), sa, sb in ((CYRILLIC_LATIN, CYRILLIC, LATIN), (GREEK_LATIN, GREEK, LATIN), (GREEK_CYRILLIC, GREEK, CYRILLIC)):
        for x, y in zip(a, b):
            if y.isalpha():
                to[sb][ord(x)] = ord(y)
                basic = 0x386 <= ord(x) <= 0x3CE or 0x410 <= ord(x) <= 0x44F  # rarer letters are never a word's own
                if basic and not to[sa][ord(y)]:
                    to[sa][ord(y)] = ord(x)
    alike: dict[str, list[int]] = {}
    for c, skeleton in extra:
        alike.setdefault(skeleton, []).append(c)
    for group in alike.values():
        for x in group:
            for y in group:
                sx, sy = script[x], script[y]
                # pairs of the first three scripts are stated above
                if sx and sy and sx != sy and max(sx, sy) >= ARMENIAN and not to[sy][x]:
                    to[sy][x] = y
    return script, to


@lru_cache(None)
def _touched() -> np.ndarray:
    """Characters whose presence can change a row."""
    script, _ = _scripts()
    length, _, _ = _decompositions()
    t = (_single() != np.arange(N_CODES)) | (_classes() > 0) | _pairs()[2] | (script >= GREEK)
    t[list(WIDTHLESS)] = True
    t |= (length > 1) & np.fromiter((unicodedata.normalize("NFC", chr(i)) != chr(i) if length[i] > 1 else False for i in range(N_CODES)), bool, N_CODES)
    one = np.flatnonzero(length > 1)
    t[one[length[one] == 1]] = True
    for c in range(0x300, 0x30000):
        d = unicodedata.decomposition(chr(c)) if c < 0x3100 or 0xF900 <= c < 0xFB00 or c >= 0x2F800 else ""
        if d and d[0] != "<" and " " not in d:
            t[c] = True
    return t


def _drop_widthless(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the characters of no width that have a word character on both sides, others of their kind left out of account."""
    thin = np.zeros(N_CODES, bool)
    thin[list(WIDTHLESS)] = True
    is_thin = thin[cps]
    if not is_thin.any():
        return cps, off
    n = len(cps)
    at = np.arange(n)
    prev = np.maximum.accumulate(np.where(is_thin, -1, at))
    nxt = np.minimum.accumulate(np.where(is_thin, n, at)[::-1])[::-1]
    row = rows_of(at, off)
    word = word_table()
    thin_at = np.flatnonzero(is_thin)
    p, q = prev[thin_at], nxt[thin_at]
    ok = (p >= 0) & (q < n)
    p, q = np.maximum(p, 0), np.minimum(q, n - 1)
    ok &= (row[p] == row[thin_at]) & (row[q] == row[thin_at]) & word[cps[p]] & word[cps[q]]
    keep = np.ones(n, bool)
    keep[thin_at[ok]] = False
    before = np.concatenate([[0], np.cumsum(keep)])
    return cps[keep], before[off]


def _expand(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical decomposition by lookup and expansion offsets, marks in canonical order."""
    length, start, flat = _decompositions()
    n = length[cps]
    many = np.flatnonzero((n > 1) | (start[cps] > 0) | ((n == 1) & (cps == (flat[0] if len(flat) else 0))))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.repeat(cps, n)
    k = n[many]
    inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    out[np.repeat(at[many], k) + inner] = flat[np.repeat(start[cps[many]], k) + inner]
    off = at[off]
    ccc = _classes()[out]
    if (ccc[1:] * (ccc[:-1] > ccc[1:])).any():
        cluster = np.cumsum(ccc == 0)
        cluster += rows_of(np.arange(len(out)), off)  # a row that begins with a mark is its own cluster
        order = np.lexsort((np.arange(len(out)), ccc, cluster))
        out = out[order]
    return out, off


def _own_script(cps: np.ndarray, off: np.ndarray, extra: Extra = ()) -> np.ndarray:
    """Foreign look-alike letters replaced by the letters of their word's own script.

    The own script is one into which all foreign letters of the word can be moved; where several
    qualify, the script with most letters in the row that have no look-alike in the others, then in the word.
    A word whose own letters aren't in the majority moves only where other words of the row speak for
    that script, and none with fewer than two such letters of its own moves against the row's
    prevailing script (a capital delta before a Latin T stays). Small Greek letters among Latin
    capitals only are symbols and stay, as in names of proteins and units.
    """
    script_of, to = _scripts(extra)
    script = script_of[cps]
    if not (script >= GREEK).any():
        return cps
    present = [k for k in NAMES.values() if (script == k).any()]
    s, e = spans(word_table()[cps] | (cps == 0x27) | (cps == 0x2019), off)  # an apostrophe doesn't end a word here
    running = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    total = {k: running(script == k) for k in present}
    count = {k: v[e] - v[s] for k, v in total.items()}
    mixed = np.flatnonzero(sum((c > 0).astype(int) for c in count.values()) > 1)
    if not len(mixed):
        return cps
    s, e = s[mixed], e[mixed]
    row = rows_of(s, off)
    letters = sum(count[k][mixed] for k in present)
    in_row, in_word = {}, {}  # letters of k that have no look-alike in o
    for k in present:
        for o in present:
            if o != k:
                sure = running((script == k) & (to[o][cps] == 0))
                in_row[k, o], in_word[k, o] = (sure[off[1:]] - sure[off[:-1]])[row], sure[e] - sure[s]
    upper = category_table("", ("Lu",))
    small_greek = running((script == GREEK) & ~upper[cps])
    small_latin = running((script == LATIN) & ~upper[cps])
    symbol = (small_greek[e] > small_greek[s]) & (small_latin[e] == small_latin[s])
    score = np.full((max(NAMES.values()) + 1, len(mixed)), -1.0)
    for k in present:
        foreign = (script > 0) & (script != k)
        stuck = running(foreign & (to[k][cps] == 0))
        own = count[k][mixed]
        ok = (stuck[e] == stuck[s]) & (own > 0)
        most = np.full(len(mixed), np.inf)
        for o in present:
            if o != k:
                here = count[o][mixed] > 0
                ok &= ~here | (2 * own > letters) | (in_row[k, o] > in_word[k, o])
                ok &= ~here | (in_word[k, o] >= 2) | (in_row[k, o] >= in_row[o, k])
                most = np.where(here, np.minimum(most, in_row[k, o]), most)
        if k == LATIN:
            ok &= ~symbol
        score[k] = np.where(ok, most + own / 1e6, -1.0)
    best = score.argmax(0)
    best[score.max(0) < 0] = 0
    out = cps.copy()
    size = e - s
    idx = np.repeat(s, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    target = np.repeat(best, size)
    for k in present:
        here = idx[(target == k)]
        here = here[(script[here] > 0) & (script[here] != k)]
        out[here] = to[k][cps[here]]
    return out


def _compose(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition: in each round, the next mark of every cluster meets its starter."""
    n = len(cps)
    second = _pairs()[2]
    if n == 0 or not second[cps].any():
        return cps, off
    ccc = _classes()[cps]
    row = rows_of(np.arange(n), off)
    cps = cps.copy()
    keep = np.ones(n, bool)
    starter = np.flatnonzero(ccc == 0)
    if len(starter):
        cluster = np.cumsum(ccc == 0) - 1
        mark = np.flatnonzero((ccc > 0) & (cluster >= 0))
        mark = mark[row[starter[cluster[mark]]] == row[mark]]
        base = starter[cluster[mark]]
        rank = mark - base
        last = np.zeros(n, np.uint8)  # class of the last mark that stayed, by starter
        for k in range(1, int(rank.max(initial=0)) + 1):
            m, b = mark[rank == k], base[rank == k]
            free = last[b] < ccc[m]
            got = np.where(free, _composite(cps[b], cps[m]), 0)
            done = got > 0
            cps[b[done]] = got[done]
            keep[m[done]] = False
            last[b[~done]] = ccc[m[~done]]
        while True:  # starters that follow each other without a mark between, as in Hangul
            left = np.flatnonzero(keep)
            x, y = left[:-1], left[1:]
            pair = np.flatnonzero((ccc[y] == 0) & (ccc[x] == 0) & second[cps[y]] & (row[x] == row[y]))
            if not len(pair):
                break
            got = _composite(cps[x[pair]], cps[y[pair]])
            hit = pair[got > 0]
            if not len(hit):
                break
            first = np.ones(len(hit), bool)
            first[1:] = hit[1:] != hit[:-1] + 1
            hit = hit[first]
            cps[x[hit]] = _composite(cps[x[hit]], cps[y[hit]])
            keep[y[hit]] = False
    before = np.concatenate([[0], np.cumsum(keep)])
    return cps[keep], before[off]


def consistent(column: pa.Array | pa.ChunkedArray, extra: Extra = ()) -> pa.LargeStringArray:
    """The consistent form of every row; nulls stay null. ``extra``: ``confusables``."""
    valid = np.asarray(column.is_valid())
    cps, off = code_points(column)
    hit = np.concatenate([[0], np.cumsum(_touched()[cps])])
    dirty = hit[off[1:]] > hit[off[:-1]]
    if not dirty.any():
        return to_strings(cps, off, valid)
    rows = np.repeat(dirty, np.diff(off))
    size = np.where(dirty, np.diff(off), 0)
    part, at = cps[rows], np.concatenate([[0], np.cumsum(size[dirty])])
    part = _single()[part]
    part, at = _drop_widthless(part, at)
    part, at = _expand(part, at)
    part = _own_script(part, at, extra)
    part, at = _compose(part, at)
    # put the rows back in place
    length = np.diff(off)
    length[dirty] = np.diff(at)
    new = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(new[-1], np.uint32)
    where = np.repeat(dirty, length)
    out[where] = part
    out[~where] = cps[~rows]
    return to_strings(out, new, valid)


def _run(extra: Extra) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b)):
            form = consistent(batch.column(1), extra)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), form.cast(pa.string())], names=["doc_id", "stored", "form"])

    return run


def consistent_form(docs: DataFrame, doc_id: str = "doc_id", data: str = "data") -> DataFrame:
    """doc_id, stored, form: every row with its text in the consistent form.

    Null texts stay null and empty ones empty; every row comes out once, repeated rows too; whole
    texts are converted; an empty table gives an empty result.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(data).alias("stored")).mapInArrow(_run(confusables(docs.sparkSession)), "doc_id long, stored string, form string")


def _alike(docs: DataFrame, doc_id: str, data: str) -> tuple[DataFrame, DataFrame]:
    """(rows, forms): doc_id, form, spelling of the rows whose form has two spellings or more; these forms with n, kinds and the smallest doc_id."""
    base = consistent_form(docs, doc_id, data).where(F.col("stored").rlike(r"[\p{L}\p{N}]"))
    keyed = materialize(base.select("doc_id", digest(F.col("form")).alias("form"), digest(F.col("stored")).alias("spelling")), "forms")
    spellings = keyed.groupBy("form", "spelling").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("low"))
    forms = spellings.groupBy("form").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min("low").alias("low")).where("kinds > 1")
    forms = materialize(forms, "alike")
    return materialize(semi_join_checked(keyed, forms.select("form", "n"), "form", "doc_id"), "members"), forms


def alike_classes(docs: DataFrame, doc_id: str = "doc_id", data: str = "data") -> DataFrame:
    """doc_id, class_id, members, spellings: one row for each row that ``alike_pairs`` links, with the smallest doc_id of its class.

    Its size is that of the rows, however large a class is.
    """
    rows, forms = _alike(docs, doc_id, data)
    met = attach_group(rows.select("form", "doc_id"), forms, "form", "doc_id")
    return met.select("doc_id", F.col("low").alias("class_id"), F.col("n").alias("members"), F.col("kinds").alias("spellings"))


def alike_pairs(docs: DataFrame, doc_id: str = "doc_id", data: str = "data") -> DataFrame:
    """doc_id_a < doc_id_b: rows with a letter or digit that differ as stored and agree in the consistent form.

    Rows are first reduced to (form, spelling) classes. Only forms with two spellings or more go on;
    of these, a row meets the rows of its form's other spellings, in chunks of every form with many rows.
    """
    rows, _ = _alike(docs, doc_id, data)
    a = rows.select("form", F.col("doc_id").alias("doc_id_a"), F.col("spelling").alias("sa"))
    b = rows.select("form", F.col("doc_id").alias("doc_id_b"), F.col("spelling").alias("sb"))
    return salted_join(a, b, "form", "doc_id_a", chunk=1000).where("doc_id_a < doc_id_b AND sa <> sb").select("doc_id_a", "doc_id_b")
