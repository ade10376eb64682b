"""Records in the house style of a line file, as arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import render_date
from ..functions.text import collapse, wrap


def _one(template: str, value: Column) -> Column:
    """A line if the value is there, as an array of none or one."""
    return F.when(value.isNotNull() & (value != ""), F.array(F.concat(F.lit(template), value))).otherwise(F.array().cast("array<string>"))


def _each(before: str, values: Column, after: str = "") -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.concat(F.lit(before), x, F.lit(after)))


def name_lines(given: Column, surname: Column) -> Column:
    g, s = collapse(F.coalesce(given, F.lit(""))), F.upper(collapse(F.coalesce(surname, F.lit(""))))
    head = F.when(s != "", F.concat(F.lit("1 NAME "), g, F.lit(" /"), s, F.lit("/"))).otherwise(F.concat(F.lit("1 NAME "), g))
    return F.concat(F.array(head), _one("2 GIVN ", g), _one("2 SURN ", s))


def event_lines(tag: str, date: Column, place_lines: Column) -> Column:
    d = render_date(date)
    some = (d.isNotNull() & (d != "")) | (F.size(place_lines) > 0)
    return F.when(some, F.concat(F.array(F.lit(f"1 {tag}")), _one("2 DATE ", d), place_lines)).otherwise(F.array().cast("array<string>"))


def individual(xref: Column, given: Column, surname: Column, sex: Column, birth: Column, birth_place: Column, death: Column, death_place: Column, famc: Column, fams: Column, sources: Column, external: Column) -> Column:
    """A person's record; places come as lines from the place dictionary."""
    at = lambda before, value: F.when(value.isNotNull() & (value != ""), F.array(F.concat(F.lit(before), value, F.lit("@")))).otherwise(F.array().cast("array<string>"))
    return F.concat(
        F.array(F.concat(F.lit("0 @"), xref, F.lit("@ INDI"))), name_lines(given, surname), F.when(sex.isin("M", "F"), F.array(F.concat(F.lit("1 SEX "), sex))).otherwise(F.array().cast("array<string>")),
        event_lines("BIRT", birth, birth_place), event_lines("DEAT", death, death_place), at("1 FAMC @", famc), _each("1 FAMS @", fams, "@"), _each("1 SOUR @", sources, "@"), _one("1 _FSFTID ", external),
    )


def family(xref: Column, husband: Column, wife: Column, children: Column, date: Column, place_lines: Column, sources: Column) -> Column:
    at = lambda before, value: F.when(value.isNotNull() & (value != ""), F.array(F.concat(F.lit(before), value, F.lit("@")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.concat(F.lit("0 @"), xref, F.lit("@ FAM"))), at("1 HUSB @", husband), at("1 WIFE @", wife), event_lines("MARR", date, place_lines), _each("1 CHIL @", children, "@"), _each("1 SOUR @", sources, "@"))


def source(xref: Column, title: Column, page: Column, text: Column, url: Column, width: int = 200) -> Column:
    chunks = wrap(F.coalesce(text, F.lit("")), F.lit(width))
    body = F.transform(chunks, lambda x, i: F.concat(F.when(i == 0, F.lit("1 TEXT ")).otherwise(F.lit("2 CONT ")), x))
    return F.concat(F.array(F.concat(F.lit("0 @"), xref, F.lit("@ SOUR")), F.concat(F.lit("1 TITL "), title)), _one("1 PAGE ", page), body, _one("1 PUBL ", url))
