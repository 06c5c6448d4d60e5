"""Problem 9: text that was decoded with a wrong encoding, found and restored span by span.

Characters are mapped back to the bytes of a legacy encoding; an automaton over these bytes finds
the maximal well-formed UTF-8 multibyte sequences, which alone are decoded. Lead and continuation
bytes are disjoint, so the automaton's runs are found for a whole batch by comparing shifted arrays.
Correct text can hold such a sequence by chance (a capital with an accent before a closing quote),
so a sequence counts only where what it decodes to fits its neighbours.

Text of one single-byte alphabet read as another has no multibyte sequence, so no automaton can see it.
It counts only on positive evidence: the letters and the case of its words must be far likelier under
the other alphabet than as they stand, by letter frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.codepoints import category_table, code_points, pieces, rows_of, spans, to_strings

# The legacy encodings UTF-8 is most often mistaken for, in the order they are tried.
LEGACY = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp866")
# Single-byte alphabets that are mistaken for Latin-1 or cp1252.
ALPHABETS = ("cp1251", "koi8_r", "iso8859_5", "cp866", "iso8859_7", "cp1253")
# Cyrillic alphabets that are mistaken for each other, as (read as, written in).
SWAPS = (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "iso8859_5"), ("iso8859_5", "cp1251"), ("iso8859_5", "koi8_r"), ("koi8_r", "iso8859_5"), ("cp1251", "mac_cyrillic"), ("mac_cyrillic", "cp1251"))
# Letter frequencies in per mille of running text, from public counts: Russian, Greek, and
# the accented letters of Western European text among each other.
RUSSIAN = {
    "о": 109.7, "е": 84.5, "а": 80.1, "и": 73.5, "н": 67.0, "т": 62.6, "с": 54.7, "р": 47.3, "в": 45.4, "л": 44.0, "к": 34.9, "м": 32.1, "д": 29.8, "п": 28.1, "у": 26.2, "я": 20.1, "ы": 19.0,
    "ь": 17.4, "г": 17.0, "з": 16.5, "б": 15.9, "ч": 14.4, "й": 12.1, "х": 9.7, "ж": 9.4, "ш": 7.3, "ю": 6.4, "ц": 4.8, "щ": 3.6, "э": 3.2, "ф": 2.6, "ё": 2.0, "ъ": 0.4,
}
GREEK = {
    "α": 105, "ο": 85, "τ": 85, "ι": 72, "ε": 68, "ν": 65, "σ": 45, "η": 45, "ρ": 42, "π": 41, "κ": 41, "υ": 40, "ς": 35, "μ": 34, "λ": 28, "ω": 17, "γ": 17, "δ": 17, "θ": 12, "χ": 12, "φ": 9,
    "β": 7, "ξ": 5, "ζ": 4, "ψ": 2, "ί": 25, "ά": 22, "ό": 22, "έ": 18, "ή": 16, "ύ": 12, "ώ": 8, "ϊ": 1, "ΐ": 0.5, "ϋ": 0.5,
}
WESTERN = {
    "é": 180, "ä": 90, "ü": 90, "à": 75, "á": 70, "è": 65, "ó": 60, "ö": 60, "í": 60, "ç": 45, "ã": 45, "ß": 40, "å": 40, "ñ": 30, "ê": 30, "ø": 25, "ú": 20, "æ": 12, "õ": 10, "ô": 10, "â": 10,
    "ý": 8, "î": 8, "ò": 8, "ì": 8, "ù": 8, "û": 6, "ë": 6, "ï": 4, "ð": 3, "þ": 2, "ÿ": 1,
}
#: Log odds that a stretch needs to count as another alphabet, and the weights of a word's letter case.
ODDS_CYRILLIC, ODDS_LATIN = 20.0, 14.0
REGULAR, CAPITALS, IRREGULAR = np.log(0.9), np.log(0.1), np.log(0.001)
# Marks that may follow a capital in correct text.
CLOSERS = "’”»›…–—•‘“ "
# Letters beyond Latin-1 that Western texts use.
EXTENDED = "ŒœŠšŽžŸĄąĆćČčĎďĘęĚěĞğİıŁłŃńŇňŐőŘřŚśŞşŤťŮůŰűŹźŻż"
_TOP = 0x10000


@lru_cache(None)
def byte_table(name: str) -> np.ndarray:
    """Legacy byte (0x80 and up) of each code point under U+10000, 0 where it has none."""
    t = np.zeros(_TOP, np.uint8)
    for b in range(0x80, 0x100):
        try:
            t[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            pass
    if name == "cp1252":  # readers often pass undefined bytes, or all of Latin-1, as they are
        t[0x80:0x100] = np.arange(0x80, 0x100)
    elif name in ("cp1251", "mac_roman"):
        free = [b for b in range(0x80, 0xA0) if b not in t]
        t[free] = free
    return t


@lru_cache(None)
def _lead_bits() -> np.ndarray:
    bits = np.zeros(_TOP, np.uint8)
    for e, name in enumerate(LEGACY):
        t = byte_table(name)
        bits |= np.where((t >= 0xC2) & (t <= 0xF4), np.uint8(1 << e), np.uint8(0))
    return bits


@lru_cache(None)
def _classes() -> dict[str, np.ndarray]:
    cut = lambda *a: category_table(*a)[:_TOP]
    closers, extended = np.zeros(_TOP, bool), np.zeros(_TOP, bool)
    closers[[ord(c) for c in CLOSERS]] = True
    extended[[ord(c) for c in EXTENDED]] = True
    return {"letter": cut("L"), "upper": cut("", ("Lu",)), "lower": cut("", ("Ll",)), "closer": closers, "extended": extended}


def _low(x: np.ndarray) -> np.ndarray:
    return np.where(x < _TOP, x, 0)


def _sequences(cps: np.ndarray, row: np.ndarray, at: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, decoded code point) of the well-formed multibyte sequences that begin at ``at``."""
    t = byte_table(name)
    n = len(cps)
    b = [t[_low(cps[np.minimum(at + k, n - 1)])].astype(np.int64) * ((at + k < n) & (row[np.minimum(at + k, n - 1)] == row[at])) for k in range(4)]
    more = [(x >= 0x80) & (x <= 0xBF) for x in b]
    lead = b[0]
    two = (lead >= 0xC2) & (lead <= 0xDF) & more[1]
    three = (lead >= 0xE0) & (lead <= 0xEF) & more[1] & more[2] & ~((lead == 0xE0) & (b[1] < 0xA0)) & ~((lead == 0xED) & (b[1] > 0x9F))
    four = (lead >= 0xF0) & (lead <= 0xF4) & more[1] & more[2] & more[3] & ~((lead == 0xF0) & (b[1] < 0x90)) & ~((lead == 0xF4) & (b[1] > 0x8F))
    length = two * 2 + three * 3 + four * 4
    low = [x & 0x3F for x in b]
    d = np.where(two, (lead & 0x1F) << 6 | low[1], np.where(three, (lead & 0xF) << 12 | low[1] << 6 | low[2], (lead & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3]))
    ok = length > 0
    return at[ok], length[ok], d[ok]


def _block(d: np.ndarray) -> np.ndarray:
    """1 Latin letters, 2 Greek, 3 Cyrillic, 4 Latin-1 signs, 5 punctuation, currency and emoji, 6 marks, 7 other signs of cp1252, 0 others."""
    c = _classes()
    lo = _low(d)
    latin = ((d >= 0xC0) & (d <= 0xFF)) | c["extended"][lo]
    out = np.zeros(len(d), np.int64)
    out[latin] = 1
    out[(d >= 0x370) & (d <= 0x3FF)] = 2
    out[(d >= 0x400) & (d <= 0x45F)] = 3
    out[(d >= 0x80) & (d <= 0xBF)] = 4
    out[(byte_table("cp1252")[lo] > 0) & (byte_table("cp1252")[lo] < 0xA0) & (out == 0)] = 7
    out[((d >= 0x2010) & (d <= 0x203A)) | ((d >= 0x20A0) & (d <= 0x20BF)) | (d == 0x2116) | (d == 0x2122) | (d == 0xFEFF) | (d == 0xFFFD) | (d >= 0x1F300)] = 5
    out[(d >= 0x300) & (d <= 0x36F)] = 6
    return out


def _judge(cps: np.ndarray, row: np.ndarray, s: np.ndarray, length: np.ndarray, d: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(certain, possible) for each sequence, by its neighbours."""
    c = _classes()
    n = len(cps)
    e = s + length
    inside = lambda i: (i >= 0) & (i < n) & (row[np.clip(i, 0, n - 1)] == row[s])
    prev = np.where(inside(s - 1), _low(cps[np.clip(s - 1, 0, n - 1)]), 32)
    nxt = np.where(inside(e), _low(cps[np.clip(e, 0, n - 1)]), 32)
    after_seq = np.isin(s, e)
    before_seq = np.isin(e, s)
    block, lo = _block(d), _low(d)
    pl, nl = c["letter"][prev] | after_seq, c["letter"][nxt] | before_seq
    up, low = c["upper"][prev] & ~after_seq, c["lower"][prev] & ~after_seq
    last = _low(cps[e - 1])
    closing = c["closer"][last] & pl & ~nl & ~after_seq & up
    lower_d, upper_d = c["lower"][lo], c["upper"][lo]
    clash = (lower_d & up & ~(c["lower"][nxt] | before_seq)) | (upper_d & low & ~before_seq)
    letter = (block == 1) & ~clash
    certain = letter & ~closing & (pl | nl | (name == "cp1252") | (name in ("cp437", "cp850", "cp866")))
    possible = letter | (block == 6)
    sign = block == 4
    certain |= sign & ~up
    possible |= sign
    certain |= (block == 5) & (length >= 3)
    nested = (block == 7) & (after_seq | before_seq)  # text that was damaged twice
    certain |= nested
    possible |= nested
    if name == "mac_roman":  # a root or not sign may stand before a mathematical sign
        maths = np.isin(last, [ord(x) for x in "π∞Ω≠±≤≥∂∑∏∫√≈∆"])
        certain &= ~(maths & ~pl & ~nl & (length == 2))
    if name in ("cp1251", "cp866"):
        cyr = lambda x: (x >= 0x400) & (x <= 0x4FF)
        native = (cyr(prev) & ~after_seq) | (cyr(nxt) & ~before_seq)
        alone = ~((prev < 0x400) & c["letter"][prev]) & ~((nxt < 0x400) & c["letter"][nxt]) & ~after_seq & ~before_seq
        western = (block == 1) | (block == 4)
        certain &= ~(western & (native | alone))
        possible &= ~(western & native)
    if name == "cp866":  # its three-byte leads are ordinary small letters
        certain &= length == 2
        possible &= (length == 2) | ~native
        block = np.where(length == 2, block, -1)
    run = after_seq | before_seq
    same_prev, same_next = np.zeros(len(s), bool), np.zeros(len(s), bool)
    if len(s) > 1:
        touch = (e[:-1] == s[1:]) & (block[:-1] == block[1:])
        same_next[:-1], same_prev[1:] = touch, touch
    alphabet = (block == 2) | (block == 3)
    certain |= alphabet & (same_prev | same_next)
    possible |= alphabet & (run | ~(pl | nl))
    three_more = (block == 0) & same_prev & same_next & (lo > 0x4FF)
    certain |= three_more
    possible |= (block == 0) & (same_prev | same_next) & (lo > 0x4FF)
    return certain, possible | certain


def _multibyte(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Accepted sequences of each row's best encoding: start, length, decoded, row, encoding number."""
    bits = _lead_bits()[_low(cps)]
    lead = np.flatnonzero(bits)
    none = np.zeros(0, np.int64)
    if not len(lead):
        return none, none, none, none, none
    row = rows_of(np.arange(len(cps)), off)
    n_rows = len(off) - 1
    found = []
    for e, name in enumerate(LEGACY):
        at = lead[(bits[lead] >> e) & 1 == 1]
        if not len(at):
            continue
        s, length, d = _sequences(cps, row, at, name)
        if not len(s):
            continue
        certain, possible = _judge(cps, row, s, length, d, name)
        sure = np.bincount(row[s[certain]], minlength=n_rows)
        keep = possible & (sure[row[s]] > 0)
        if keep.any():
            found.append((sure * 1000 - e, s[keep], length[keep], d[keep], np.full(keep.sum(), e)))
    if not found:
        return none, none, none, none, none
    best = np.max([x[0] for x in found], axis=0)
    parts = []
    for score, s, length, d, e in found:
        mine = (score == best)[row[s]]
        parts.append((s[mine], length[mine], d[mine], row[s[mine]], e[mine]))
    s, length, d, r, e = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(s, kind="stable")
    return s[order], length[order], d[order], r[order], e[order]


def _log_odds(freq: dict[str, float], rare: float = 0.02) -> np.ndarray:
    """Log frequency of every code point under _TOP, capitals as their small letters, others as ``rare`` per mille."""
    t = np.full(_TOP, np.log(rare / 1000))
    for c, f in freq.items():
        for x in (c, c.upper()):
            if len(x) == 1:
                t[ord(x)] = np.log(f / 1000)
    return t


@lru_cache(None)
def _readings(kind: str) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(alphabet, map, gain, is capital) of each other reading of a character: the map of code points, the log odds that it gains, and its case."""
    upper = _classes()["upper"]
    russian, greek, western = _log_odds(RUSSIAN), _log_odds(GREEK), _log_odds(WESTERN, 1.0)
    out = []
    for read, true in SWAPS if kind == "cyrillic" else [("cp1252", x) for x in ALPHABETS]:
        m = np.arange(_TOP, dtype=np.uint32)
        gain = np.full(_TOP, -8.0)
        t = byte_table(read)
        for c in np.flatnonzero(t).tolist():
            x = bytes([t[c]]).decode(true, "replace")
            m[c] = ord(x)
            if x != "\ufffd":
                now = russian[c] if kind == "cyrillic" else western[c]
                gain[c] = (greek if true in ("iso8859_7", "cp1253") else russian)[ord(x)] - now
        out.append((true, m, gain, upper[_low(m)]))
    return out


def _case(n: np.ndarray, capitals: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weight of the case of words with n letters: small or with one capital in front, capitals only, or neither."""
    regular = (capitals == 0) | ((capitals == 1) & first)
    return np.where(regular, REGULAR, np.where(capitals == n, CAPITALS, IRREGULAR))


def _word_odds(cps: np.ndarray, s: np.ndarray, e: np.ndarray, reading: tuple, own_case: bool) -> np.ndarray:
    """Log odds of each word cps[s:e] for another reading against the one it has."""
    _, _, gain, capital = reading
    lo = _low(cps)
    total = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[e] - c[s]
    n = e - s
    odds = total(gain[lo]) + _case(n, total(capital[lo]), capital[lo[s]])
    if own_case:
        upper = _classes()["upper"]
        odds -= _case(n, total(upper[lo]), upper[lo[s]])
    return odds


def _best_stretch(odds: np.ndarray) -> tuple[float, int, int]:
    """The run of words with the highest sum: (sum, first, last + 1)."""
    best, start, now = (0.0, 0, 0), 0, 0.0
    for i, x in enumerate(odds.tolist()):
        if now <= 0:
            start, now = i, 0.0
        now += x
        if now > best[0]:
            best = (now, start, i + 1)
    return best


def _swapped(cps: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, str, np.ndarray]]:
    """(row, start, end, alphabet, text) of stretches in which one Cyrillic alphabet was read as another.

    A stretch is the run of words with the highest log odds for another alphabet; words that read well as
    they are count against it, so abbreviations in correct text never make a stretch.
    """
    cyr = (cps >= 0x400) & (cps <= 0x4FF)
    if not cyr.any():
        return []
    s, e = spans(cyr, off)
    r = rows_of(s, off)
    best: dict[int, tuple[float, int, int, int]] = {}
    for k, reading in enumerate(_readings("cyrillic")):
        odds = _word_odds(cps, s, e, reading, True)
        hope = np.bincount(r, np.maximum(odds, 0), minlength=len(off) - 1)
        for i in np.flatnonzero(hope >= ODDS_CYRILLIC).tolist():
            a, z = np.searchsorted(r, [i, i + 1])
            gain, seen = odds[a:z].copy(), set()
            for w in np.flatnonzero(gain > 0).tolist():  # a word that speaks for the other alphabet does so once
                word = cps[s[a + w] : e[a + w]].tobytes()
                gain[w] = 0.0 if word in seen else gain[w]
                seen.add(word)
            sum_, x, y = _best_stretch(gain)
            if sum_ >= ODDS_CYRILLIC and sum_ > best.get(i, (0.0,))[0]:
                while a + x > a and e[a + x - 1] - s[a + x - 1] == 1:  # one letter says nothing and goes with its neighbours
                    x -= 1
                while a + y < z and e[a + y] - s[a + y] == 1:
                    y += 1
                best[i] = (sum_, int(s[a + x]), int(e[a + y - 1]), k)
    out = []
    for i, (_, a, z, k) in sorted(best.items()):
        while a > off[i] and cps[a - 1] > 0x7F and chr(cps[a - 1]).isalpha():
            a -= 1
        while z < off[i + 1] and cps[z] > 0x7F and chr(cps[z]).isalpha():
            z += 1
        name, m, _, _ = _readings("cyrillic")[k]
        part = cps[a:z]
        out.append((i, a, z, name, np.where(part < _TOP, m[_low(part)], part)))
    return out


def _as_latin(cps: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, str, np.ndarray, int]]:
    """(row, start, end, alphabet, text, words) of stretches in which a Greek or Cyrillic alphabet was read as Latin.

    Judged are the row's distinct words of three and more letters, all of them in U+00C0 to U+00FF: they
    must be far likelier under the other alphabet, a letter beyond the third counting on top, as no
    Latin word is made of accented letters only. Lists of accented letters stay as they are.
    """
    high = ((cps >= 0xC0) & (cps <= 0xFF)) | (cps == 0xB8) | (cps == 0xA8)
    if not high.any():
        return []
    letter = category_table("L")
    s, e = spans(high | letter[cps], off)
    many = np.concatenate([[0], np.cumsum(high)])
    ok = (e - s >= 3) & (many[e] - many[s] == e - s)
    s, e = s[ok], e[ok]
    if not len(s):
        return []
    r = rows_of(s, off)
    odds = [_word_odds(cps, s, e, x, False) + 1.5 * (e - s - 3) for x in _readings("latin")]
    out = []
    for i in np.unique(r).tolist():
        a, z = np.searchsorted(r, [i, i + 1])
        seen: dict[str, int] = {}
        for w in range(a, z):
            seen.setdefault(cps[s[w] : e[w]].tobytes().decode("utf-32-le").lower(), w)
        once = list(seen.values())
        sums = [float(x[once].sum()) for x in odds]
        k = int(np.argmax(sums))
        if sums[k] < ODDS_LATIN:
            continue
        x, y = int(s[a]), int(e[z - 1])
        while y < off[i + 1] and 0x80 <= cps[y] <= 0xFF:
            y += 1
        name, m, _, _ = _readings("latin")[k]
        part = cps[x:y]
        out.append((i, x, y, name, np.where(part < _TOP, m[_low(part)], part), int(z - a)))
    return out


def repair(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[str | None], pa.LargeStringArray]:
    """(damaged, spans decoded, encoding, restored text) of each row; undamaged rows come back unchanged."""
    cps, off = code_points(column)
    n = len(off) - 1
    control = (cps >= 0x80) & (cps <= 0x9F) & (cps != 0x85)  # U+0085 alone is a line break
    damaged, count = np.zeros(n, bool), np.zeros(n, np.int64)
    damaged[rows_of(np.flatnonzero((cps == 0xFFFD) | control), off)] = True
    names: list[str | None] = [None] * n
    while True:  # text may be damaged several times over, or by several encodings; each round makes it shorter
        s, length, d, r, e = _multibyte(cps, off)
        if not len(s):
            break
        damaged[r] = True
        count += np.bincount(r, minlength=n)
        for i, k in dict(zip(r.tolist(), e.tolist())).items():
            names[i] = names[i] or LEGACY[k]
        keep = np.ones(len(cps), bool)
        for k in range(1, 4):
            keep[s[length > k] + k] = False
        cps = cps.copy()
        cps[s] = d
        before = np.concatenate([[0], np.cumsum(keep)])
        cps, off = cps[keep], before[off]
    for i, a, z, name, text in _swapped(cps, off):
        cps = cps.copy() if not cps.flags.writeable else cps
        cps[a:z] = text
        damaged[i], names[i], count[i] = True, names[i] or name, count[i] + 1
    for i, a, z, name, text, many in _as_latin(cps, off):
        cps = cps.copy() if not cps.flags.writeable else cps
        cps[a:z] = text
        damaged[i], names[i], count[i] = True, names[i] or name, count[i] + many
    c1 = (cps >= 0x80) & (cps <= 0x9F)
    if c1.any():
        m = np.array([ord(bytes([x]).decode("cp1252", "ignore") or chr(x)) for x in range(0xA0)], np.uint32)
        at = np.flatnonzero(c1)
        at = at[damaged[rows_of(at, off)]]
        for i in np.unique(rows_of(at, off)).tolist():
            names[i] = names[i] or "cp1252"
        cps = cps.copy()
        cps[at] = m[cps[at]]
    return damaged, count, names, to_strings(cps, off)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for b in batches for x in pieces(b)):
        damaged, count, names, text = repair(batch.column(1))
        hit = pa.array(damaged)
        lost = np.zeros(len(damaged), bool)
        cps, off = code_points(text)
        lost[rows_of(np.flatnonzero(cps == 0xFFFD), off)] = True
        cols = [batch.column(0), pa.array(names, pa.string()), pa.array(count), pa.array(~lost), text.cast(pa.string())]
        yield pa.RecordBatch.from_arrays([c.filter(hit) for c in cols], names=["doc_id", "encoding", "spans", "complete", "restored"])


def garbled(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, encoding, spans, complete, restored of each document that was decoded wrongly, in whole or in part.

    ``encoding`` is what the bytes were wrongly read as (or the alphabet they belong to); ``spans``
    counts the decoded sequences; ``complete`` is false where characters are lost for good. Null and
    empty texts are no case; whole texts are read, however long; rows are independent, so repeated
    documents give a row each; an empty table gives an empty result.
    """
    return documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_run, "doc_id long, encoding string, spans long, complete boolean, restored string")
