"""Text normalisation as column expressions: folding, words, shingles, percent-encoding."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _marks() -> tuple[str, str]:
    """Every letter that decomposes to one base character and marks, with its base; built from the Unicode tables."""
    source, target = [], []
    for i in range(0x80, 0x30000):
        c = chr(i)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1:
            base = [x for x in d if unicodedata.category(x) != "Mn"]
            if len(base) == 1:
                source.append(c)
                target.append(base[0])
    return "".join(source), "".join(target)


_WITH, _WITHOUT = _marks()


def strip_accents(c: Column) -> Column:
    """Decompose and drop non-spacing marks, inside code generation.

    Letters outside the one-base rule (Hangul syllables) stay composed; ``strip_accents_exact`` decomposes them.
    """
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(c, _WITH, _WITHOUT), r"\p{Mn}", "")).otherwise(c)


@F.pandas_udf(T.StringType())
def strip_accents_exact(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFD", x) if unicodedata.category(ch) != "Mn"))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Lower case, no accents, single blanks; null becomes empty."""
    return collapse(strip_accents(F.lower(F.coalesce(c, F.lit("")))))


def non_empty(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def slug(c: Column) -> Column:
    """Folded runs of letters and digits, joined by blanks."""
    return F.array_join(F.regexp_extract_all(strip_accents(F.lower(F.coalesce(c, F.lit("")))), F.lit("([a-z0-9]+)"), 1), " ")


def fold_label(c: Column) -> Column:
    """Form labels: only letters, slash and blank stay."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z/ ]", ""))


def words(c: Column) -> Column:
    """Words of a note: letters, digits and underscore; a heading block and table rows are left out."""
    body = F.regexp_replace(c, r"(?s)\A---\n.*?\n---\n", "")
    body = F.regexp_replace(body, r"(?m)^\|.*$", "")
    return F.regexp_extract_all(F.lower(body), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def shingles(w: Column, size: int) -> Column:
    """Arrays of ``size`` neighbouring words, joined by a blank, in order. The words are computed once: a lambda over an array of one."""

    def of(x: Column) -> Column:
        n = F.size(x) - (size - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(x, i, size), " "))).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(w), of), 1)


def percent_encode(c: Column) -> Column:
    """UTF-8 percent-encoding with ``/`` kept and a blank as ``%20``."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def percent_encode_plus(c: Column) -> Column:
    """The form variant: a blank as ``+``, nothing else kept."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_term(c: Column, accents: bool = False) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return percent_encode(t if accents else strip_accents(t))


def strip_tags(c: Column) -> Column:
    """Tags become line ends, then entities are decoded and blanks collapsed."""
    return collapse(unescape(F.regexp_replace(c, r"<[^>]*>", "\n")))


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def unescape_all(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else [html.unescape(y) if "&" in y else y for y in x])


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrap(s: pd.Series, width: pd.Series) -> pd.Series:
    """Words packed into lines of at most ``width`` characters; a longer word has its own line."""

    def lines(text: str | None, limit: int) -> list[str]:
        out: list[str] = []
        for word in (text or "").split():
            if out and len(out[-1]) + 1 + len(word) <= limit:
                out[-1] += " " + word
            else:
                out.append(word)
        return out

    return pd.Series([lines(t, n) for t, n in zip(s, width, strict=True)])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; the argument order matters. Give it distinct pairs that pass ``ratio_bound``."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from the lengths alone."""
    return 2.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))


def first_integer(c: Column) -> Column:
    """First whole number, thousands points removed."""
    return F.regexp_extract(F.replace(c, F.lit(".")), r"(\d+)", 1).try_cast("int")
