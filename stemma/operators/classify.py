"""Ordered rule cascades: the first rule that matches decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .contains import contained


def first_rule(df: DataFrame, rules: DataFrame, match: Column, key: list[str], value: str, order: str = "ord") -> DataFrame:
    """Adds ``value`` of the first rule that matches each row; rules are a table given in code. No rule: null.

    Rows are told apart by ``key``; only the distinct values that rules look at should be handed in.
    """
    hits = df.join(F.broadcast(rules), match).groupBy(*key).agg(F.min_by(value, order).alias(value))
    return df.join(hits, key, "left")


def frontier_status(live: Column, live_parents: Column, snapshot_id: Column, snapshot_status: Column, own_id: Column) -> Column:
    """``ready`` or ``stuck`` from the live tree, else from a snapshot of the same id, else ``unknown`` or ``unlinked``."""
    return (
        F.when(own_id.isNull(), "unlinked")
        .when(live & (live_parents > 0), "ready")
        .when(live, "stuck")
        .when(snapshot_id == own_id, snapshot_status)
        .otherwise("unknown")
    )


def region(df: DataFrame, towns: DataFrame, fallbacks: DataFrame, town: str = "town", place: str = "place", many: bool = False) -> DataFrame:
    """Adds ``region``: a listed town equal to or contained in the town, then a needle in the folded place, else ``unknown``.

    ``towns (region, ord, needle)`` and ``fallbacks (region, ord, needle)`` are tables in their order: short ones, held
    against every place, or with ``many`` of any length, found through an index of their letters.
    """
    keys = df.select(town, place).distinct().withColumn("__place", fold(F.col(place)))
    by_town = _first_needle(keys, F.col(town), towns, [town, place], "r1", many)
    by_need = _first_needle(keys, F.col("__place"), fallbacks, [town, place], "r2", many)
    found = keys.drop("__place").join(by_town, [town, place], "left").join(by_need, [town, place], "left").select(F.col(town).alias("__t"), F.col(place).alias("__p"), F.coalesce("r1", "r2", F.lit("unknown")).alias("region"))
    return df.join(found, F.col(town).eqNullSafe(F.col("__t")) & F.col(place).eqNullSafe(F.col("__p")), "left").drop("__t", "__p").na.fill("unknown", ["region"])


def _first_needle(keys: DataFrame, text: Column, rules: DataFrame, by: list[str], name: str, many: bool) -> DataFrame:
    """``by, name``: the region of the first rule whose needle is in the text."""
    rules = rules.toDF("n_region", "n_ord", "n_needle")
    if not many:
        hit = keys.join(F.broadcast(rules), F.contains(text, F.col("n_needle")))
    else:
        named = keys.withColumn("__text", text)
        found = contained(named.select(F.col("__text").alias("text")), rules.select(F.col("n_needle").alias("needle")))
        # An empty needle is in every text.
        every = named.select(F.col("__text").alias("text"), F.lit("").alias("needle")).where("text IS NOT NULL").distinct()
        best = found.unionByName(every).join(rules, F.col("needle") == F.col("n_needle")).groupBy("text").agg(F.min_by("n_region", "n_ord").alias("n_region"), F.min("n_ord").alias("n_ord"))
        hit = named.join(best, F.col("__text") == F.col("text"))
    return hit.groupBy(*by).agg(F.min_by("n_region", "n_ord").alias(name))


def archive_hint(df: DataFrame, guides: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds ``archive_score, archive_note``: the town's own, else the region's, else 0."""
    g, o = guides.toDF("region", "g_score", "g_note"), overrides.toDF("town", "o_score", "o_note")
    return df.join(F.broadcast(g), "region", "left").join(F.broadcast(o), "town", "left").select(*df.columns, F.coalesce("o_score", "g_score", F.lit(0.0)).alias("archive_score"), F.coalesce("o_note", "g_note").alias("archive_note"))


def parish_of(df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Parish of each id from places in order of priority; a rule may send years before a bound elsewhere.

    ``df (id, priority, place, year)``; ``rules (ord, needle, parish, before, then_parish)``.
    """
    hit = df.join(F.broadcast(rules), F.contains(fold(F.col("place")), F.col("needle")))
    choice = F.when(F.col("before").isNotNull() & (F.col("year") < F.col("before")), F.col("then_parish")).otherwise(F.col("parish"))
    best = hit.groupBy("id").agg(F.min_by(choice, F.struct("priority", "ord")).alias("parish"))
    return df.select("id").distinct().join(best, "id", "left").na.fill(default, ["parish"])


def access_kind(c: Column) -> Column:
    """How a book can be read, from the wording of its conditions."""
    t = fold(c)
    has = lambda *needles: F.greatest(*[F.contains(t, F.lit(n)) for n in needles], F.lit(False))
    return F.when(has("tancat", "no consultable", "restring"), "closed").when(has("parcial"), "partial").when(has("sala", "presencial"), "onsite").when(has("lliure", "obert"), "open").otherwise("unknown")


def readable_from_home(digitised: Column, access: Column) -> Column:
    return digitised & access.isin("open", "partial", "unknown")


def why_not(digitised: Column, access: Column) -> Column:
    """What keeps a book from being read from home, which decides what to do instead; null for a readable one."""
    return (
        F.when(readable_from_home(digitised, access), F.lit(None).cast("string"))
        .when(~digitised & (access == "onsite"), "no images, to be read on site")
        .when(~digitised, "no images")
        .when(access == "closed", "digitised but closed")
        .otherwise("digitised, on site only")
    )


def book_line(title: Column, start: Column, end: Column, identity: Column, code: Column, reason: Column) -> Column:
    """A book in a list: title with its years, struck out if it can't be read, then id, code and what state it is in."""
    both = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    years = F.coalesce(both, start.cast("string"), end.cast("string"), F.lit("?"))
    mark = F.when(reason.isNull(), "").otherwise("~~")
    return F.concat(mark, F.lit("**"), title, F.lit("** ("), years, F.lit(")"), mark, F.lit(" id "), identity, F.lit(" | "), F.coalesce(F.nullif(code, F.lit("")), F.lit("no code")), F.lit(" | "), F.coalesce(reason, F.lit("online")))


def find(df: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows whose column contains the needle, accents and case ignored; an empty needle finds nothing."""
    return df.where(F.contains(fold(F.col(column)), fold(F.lit(needle))) & (fold(F.lit(needle)) != ""))


def covers_year(start: Column, end: Column, year: Column) -> Column:
    """Open bounds are allowed, but not both; an unknown year is never covered."""
    known = start.isNotNull() | end.isNotNull()
    return F.coalesce(known & year.isNotNull() & (F.coalesce(start, year) <= year) & (year <= F.coalesce(end, year)), F.lit(False))


def kin_role(label: Column, stems: dict[str, str]) -> Column:
    """Role by the longest stem with which the folded label begins."""
    t = fold(label)
    out = F.lit(None).cast("string")
    for stem in sorted(stems, key=len):
        out = F.when(F.startswith(t, F.lit(stem)), F.lit(stems[stem])).otherwise(out)
    return out


def confidence(n_parents: Column, n_mine: Column, n_documents: Column, all_dated: Column) -> Column:
    """Of a proposed parent link: entered by the user or named by a document is high, part of it or full dates medium."""
    return F.when((n_mine > 0) & (n_mine == n_parents), "high").when(n_documents > 0, "high").when(n_mine > 0, "medium").when((n_parents == 2) & all_dated, "medium").otherwise("low")
