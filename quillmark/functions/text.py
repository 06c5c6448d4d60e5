"""Tokenisers and text filters (T0-T9) as Column expressions that stay in the JVM.

All functions give null for a null text and an empty array for a text without tokens.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAKS = r"[\r\n\t]+"
WORD_CHARS = r"\p{L}\p{M}\p{Nd}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def breaks_to_space(c: Column | str) -> Column:
    """Tab, CR and LF as spaces, so that they end a token instead of gluing two (Q29)."""
    return F.regexp_replace(col(c), LINE_BREAKS, " ")


def _classes(c: Column, token: str) -> Column:
    kept = F.regexp_replace(c, rf"[^{token}\p{{Z}}\p{{P}}]", "")
    return F.regexp_extract_all(kept, F.lit(rf"[{token}]+"), F.lit(0))


def tokens(c: Column | str, keep_numbers: bool = False, keep_connectors: bool = False, lower: bool = True) -> Column:
    """Letters and marks (and decimal digits, and connector punctuation) form tokens.

    Separators and punctuation end a token; every other character is dropped without ending it (Q1).
    """
    x = breaks_to_space(c)
    x = F.lower(x) if lower else x
    if keep_connectors:
        x = F.regexp_replace(x, r"[^\p{L}\p{M}\p{Z}\p{P}%s]" % (r"\p{Nd}" if keep_numbers else ""), "")
        return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{M}\p{Pc}%s]+" % (r"\p{Nd}" if keep_numbers else "")), F.lit(0))
    return _classes(x, r"\p{L}\p{M}" + (r"\p{Nd}" if keep_numbers else ""))


def raw_tokens(c: Column | str) -> Column:
    """Split at space and line separators only; case and everything else is kept."""
    return F.filter(F.split(breaks_to_space(c), r"[\p{Zs}\p{Zl}]+"), lambda x: x != "")


def directory_tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, numbers and underscore without ``--`` or ``__``."""
    found = F.regexp_extract_all(F.lower(breaks_to_space(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda x: ~x.contains("--") & ~x.contains("__"))


def choose_tokenizer(raw: bool = False, keep_numbers: bool = False, keep_connectors: bool = False):
    """The tokeniser that a configuration asks for."""
    if raw:
        return raw_tokens
    return lambda c: tokens(c, keep_numbers, keep_connectors)


def keep_tokens(arr: Column | str, predicate) -> Column:
    """Tokens that satisfy ``predicate`` (a Column function)."""
    return F.filter(col(arr), predicate)


def drop_stopwords(arr: Column | str, words: Iterable[str]) -> Column:
    """T8 for a literal list; repeated tokens and their order are kept."""
    stop = F.array(*[F.lit(w) for w in sorted(set(words))]).cast("array<string>")
    return F.filter(col(arr), lambda x: ~F.array_contains(stop, x))


def check_token_length(arr: Column | str, longest: int = 10_000) -> Column:
    """The array, or an error where a token is longer than the buffer."""
    a = col(arr)
    return F.when(F.exists(a, lambda x: F.length(x) > longest), F.raise_error(F.lit(f"a token is longer than {longest}")).cast("array<string>")).otherwise(a)


def words(c: Column | str) -> Column:
    """Maximal runs of letters, marks and decimal digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(rf"[{WORD_CHARS}]+"), F.lit(0))


def stripped(c: Column | str) -> Column:
    """The lower-cased text without anything but letters, marks and decimal digits."""
    return F.regexp_replace(F.lower(col(c)), rf"[^{WORD_CHARS}]", "")
