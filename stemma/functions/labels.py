"""How people, lookups and accounts are named in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def person(given: Column, surname: Column, year: Column, sosa: Column, xref: Column) -> Column:
    """Name, year or a question mark, the first word of the number if there is one, and the id."""
    number = F.when(F.coalesce(sosa, F.lit("")) != "", F.concat(F.lit(", Sosa "), F.substring_index(F.trim(sosa), " ", 1))).otherwise("")
    return F.concat(F.coalesce(given, F.lit("")), F.lit(" "), F.coalesce(surname, F.lit("")), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("?")), number, F.lit(") @"), xref, F.lit("@"))


def lookup(who: Column, sacrament: Column, year: Column, parish: Column, possible: Column, note: Column, url: Column) -> Column:
    """A planned lookup in three lines, struck out if it can't be made."""
    mark = F.when(possible, "").otherwise("~~")
    head = F.concat(mark, F.lit("**"), who, F.lit("**: "), sacrament, F.lit(" "), F.coalesce(year.cast("string"), F.lit("?")), F.lit(", "), F.coalesce(parish, F.lit("?")), mark)
    return F.concat_ws("\n    ", head, note, F.concat(F.lit("<"), url, F.lit(">")))


def account(requests: Column, hits: Column, seconds: Column, naps: Column) -> Column:
    """What a run asked for: requests, answers already held, the server's time and naps."""
    return F.format_string("%d requests, %d held already, %.1f s server time, %d naps", requests.cast("long"), hits.cast("long"), seconds.cast("double"), naps.cast("long"))


def quota(used: Column, limit: Column, day: Column, server: Column, hard: Column) -> Column:
    """How much of a day's quota is used, what the server counted, and whose limit it is."""
    said = F.when(server.isNotNull(), F.concat(F.lit(", server said "), server.cast("string"))).otherwise("")
    return F.concat(used.cast("string"), F.lit("/"), limit.cast("string"), F.lit(" lookups ("), day.cast("string"), said, F.lit("), "), F.when(hard, "the archive's limit").otherwise("our own pace"))
