"""The dictionary of places that a tree already knows, and lookups in it that never move a person."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import BROAD, place_components, six_levels


def place_book(lines: DataFrame) -> DataFrame:
    """``key, plac, map_lines``: first place of each town, one with coordinates before one without.

    ``map_lines`` are the deeper lines right below it, with levels relative to it.
    """
    order = Window.partitionBy("path").orderBy("idx")
    below = F.collect_list(F.struct("level", "raw")).over(order.rowsBetween(1, 5))
    p = lines.withColumn("below", below).where("tag = 'PLAC' AND trim(value) <> ''")
    # The prefix of deeper lines: its length is where the first line that is not deeper stands.
    stop = F.array_position(F.transform("below", lambda x: x["level"] <= F.col("level")), True)
    deeper = F.when(stop > 0, F.slice("below", 1, (stop - 1).cast("int"))).otherwise(F.col("below"))
    rel = F.transform(deeper, lambda x: F.struct((x["level"] - F.col("level")).alias("depth"), F.regexp_replace(x["raw"], r"^\S+ ", "").alias("rest")))
    keyed = p.select("path", "idx", F.col("value").alias("plac"), rel.alias("map_lines"), F.get(place_components(F.col("value")), F.lit(0)).alias("key")).where("key IS NOT NULL")
    best = keyed.groupBy("key").agg(F.min_by(F.struct("plac", "map_lines"), F.struct((F.size("map_lines") == 0).alias("bare"), "path", "idx")).alias("b"))
    return best.select("key", "b.plac", "b.map_lines")


def lookup(rows: DataFrame, book: DataFrame, place: str = "place", level: int = 2) -> DataFrame:
    """Adds ``place_lines`` and ``known``: by the first component, or the second unless it is broad; else a best effort."""
    parts = rows.select(place).distinct().select(place, F.posexplode(F.slice(place_components(F.col(place)), 1, 2)).alias("pos", "key")).where((F.col("pos") == 0) | ~F.col("key").isin(*BROAD))
    hit = parts.join(book, "key").groupBy(place).agg(F.min_by(F.struct("plac", "map_lines"), "pos").alias("hit"))
    found = rows.join(hit, place, "left")
    line = lambda c: F.concat(F.lit(f"{level} PLAC "), c)
    known = F.concat(F.array(line(F.col("hit.plac"))), F.transform("hit.map_lines", lambda x: F.concat((x["depth"] + level).cast("string"), F.lit(" "), x["rest"])))
    empty = F.size(place_components(F.col(place))) == 0
    lines = F.when(F.col(place).isNull() | empty, F.array().cast("array<string>")).when(F.col("hit").isNotNull(), known).otherwise(F.array(line(six_levels(F.col(place)))))
    return found.select(*rows.columns, lines.alias("place_lines"), F.col("hit").isNotNull().alias("known"))
