"""Partial dates kept as text: years, approximation, scores and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that qualify a date.
QUALIFIERS = "ABT|EST|CAL|BEF|AFT|ANTES|DESPUES|APROXIMADAMENTE|CALCULADO|ESTIMADO|ABOUT|BEFORE|AFTER|CIRCA|CA"
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def parse_year(c: Column) -> Column:
    """First year 1000-2099 behind one leading qualifier."""
    text = F.regexp_replace(F.trim(c), rf"(?i)^\s*(?:{QUALIFIERS}|FROM|TO)\b\.?\s*", "")
    return F.regexp_extract(text, r"\b(1[0-9]{3}|20[0-9]{2})\b", 1).try_cast("int")


def is_approximate(c: Column) -> Column:
    return F.coalesce(c.rlike(rf"(?i)\b(?:{QUALIFIERS})\b"), F.lit(False))


def year_match(a: Column, b: Column, tolerance: int = 2) -> Column:
    """1 for the same year, falling to 0 beyond the tolerance; 0 if either is unknown."""
    gap = F.abs(a - b)
    return F.when(a.isNull() | b.isNull() | (gap > tolerance), 0.0).when(gap == 0, 1.0).otherwise(1.0 - gap / (tolerance + 1.0))


def render_date(c: Column) -> Column:
    """ISO dates as ``D MMM YYYY``; an approximate one gets ``ABT``; other text stays."""
    text = F.trim(c)
    about = is_approximate(text)
    body = F.when(about, F.regexp_replace(text, r"^[A-Za-z]+\s+", "")).otherwise(text)
    month = lambda pattern: F.try_element_at(F.array(*map(F.lit, MONTHS)), F.nullif(F.regexp_extract(body, pattern, 2), F.lit("")).try_cast("int"))
    full, part = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{4})-(\d{2})$"
    out = (
        F.when(body.rlike(full), F.concat(F.regexp_extract(body, full, 3).try_cast("int").cast("string"), F.lit(" "), month(full), F.lit(" "), F.regexp_extract(body, full, 1)))
        .when(body.rlike(part), F.concat(month(part), F.lit(" "), F.regexp_extract(body, part, 1)))
        .otherwise(body)
    )
    return F.when(non_null(c), F.concat(F.when(about, F.lit("ABT ")).otherwise(F.lit("")), out))


def non_null(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def marriage_year(birth: Column, eldest_child: Column, spouse_birth: Column, age: int = 24) -> Column:
    """The earlier of birth plus ``age`` and a year before the eldest child; without a birth, the spouse's plus two less."""
    return F.least(F.coalesce(birth + age, spouse_birth + (age - 2)), eldest_child - 1)
