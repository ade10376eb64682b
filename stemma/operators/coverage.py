"""Interval coverage: is a parish, sacrament and year in the index, why not, and what else is; and the lookup planner."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, dimension
from .contains import contained
from .order import scan

#: Years covered, by parish and sacrament, and years under embargo.
COVERAGE = (
    ("fontanars", "bateig", ((1755, 1902),)),
    ("fontanars", "matrimoni", ((1784, 1803), (1849, 1914))),
    ("fontanars", "defuncio", ((1851, 1901),)),
    ("ontinyent", "bateig", ((1616, 1744), (1755, 1780))),
    ("ontinyent", "matrimoni", ((1560, 1900),)),
    ("ontinyent", "defuncio", ((1722, 1728), (1734, 1744), (1756, 1780), (1851, 1904))),
    ("agres", "bateig", ((1564, 1915),)),
    ("agres", "matrimoni", ((1565, 1925),)),
    ("agres", "defuncio", ((1623, 1925),)),
    ("albaida", "bateig", ((1573, 1915),)),
    ("albaida", "matrimoni", ((1564, 1925),)),
    ("albaida", "defuncio", ((1872, 1925),)),
    ("font de la figuera", "bateig", ((1853, 1898),)),
    ("font de la figuera", "matrimoni", ((1564, 1922),)),
    ("font de la figuera", "defuncio", ((1579, 1919),)),
    ("moixent", "bateig", ((1567, 1575), (1892, 1901))),
    ("moixent", "matrimoni", ()),
    ("moixent", "defuncio", ()),
    ("bocairent", "bateig", ((1725, 1834),)),
    ("bocairent", "matrimoni", ((1725, 1870),)),
    ("bocairent", "defuncio", ((1725, 1870),)),
)
EMBARGO = (("bateig", 110), ("matrimoni", 100), ("defuncio", 100))
#: Order in which alternatives are offered.
OFFERED = ("matrimoni", "bateig", "defuncio")


def ranges(spark: SparkSession, coverage=COVERAGE) -> DataFrame:
    rows = [(p, s, i, a, b) for p, s, spans in coverage for i, (a, b) in enumerate(spans)]
    return dimension(spark, rows, "parish string, sacrament string, ord int, y_from int, y_to int")


def parishes(spark: SparkSession, coverage=COVERAGE) -> DataFrame:
    return dimension(spark, [(p, i) for i, p in enumerate(dict.fromkeys(p for p, _, _ in coverage))], "parish string, p_ord int")


def parish_key(df: DataFrame, spark: SparkSession, column: str = "place", coverage=COVERAGE, names: DataFrame | None = None) -> DataFrame:
    """Adds ``parish``: the first one of the table whose name is in the text, or has the text in it. Unmatched: null.

    ``names (parish, p_ord)`` stands for the table in code, and may be long: names then meet texts through an index of
    their letters, not each text.
    """
    named = df.withColumn("__text", F.lower(F.trim(F.coalesce(column, F.lit("")))))
    if names is None:
        match = (F.col("__text") != "") & (F.contains("__text", "k") | F.contains("k", "__text"))
        keys = F.broadcast(parishes(spark, coverage).select(F.col("parish").alias("k"), "p_ord"))  # as long as the table in code
        distinct = named.select("__text").distinct().join(keys, match).groupBy("__text").agg(F.min_by("k", "p_ord").alias("parish"))
        return named.join(distinct, "__text", "left").drop("__text")
    texts, keys = named.select(F.col("__text").alias("text")).where("text <> ''").distinct(), names.select(F.col("parish").alias("needle"), "p_ord")
    inside = contained(texts, keys)
    around = contained(keys.select(F.col("needle").alias("text")), texts.select(F.col("text").alias("needle"))).select(F.col("needle").alias("text"), F.col("text").alias("needle"))
    distinct = inside.unionByName(around).join(keys, "needle").groupBy(F.col("text").alias("__text")).agg(F.min_by("needle", "p_ord").alias("parish"))
    return named.join(distinct, "__text", "left").drop("__text")


def _against_code(keys: DataFrame, spans: DataFrame) -> DataFrame:
    """``parish, sacrament, year, n, hit, near`` by holding every lookup against all ranges of its parish, a table that is broadcast."""
    gap = F.least(F.abs(F.col("year") - F.col("y_from")), F.abs(F.col("year") - F.col("y_to")))
    hit = F.col("year").between(F.col("y_from"), F.col("y_to"))
    found = keys.join(F.broadcast(spans), ["parish", "sacrament"], "left")
    return found.groupBy("parish", "sacrament", "year").agg(F.count("y_from").alias("n"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"), F.min_by(F.struct("y_from", "y_to", gap.alias("gap")), F.struct(gap.alias("g"), "ord")).alias("near"))


#: Years of a bin in which ranges and lookups meet.
BIN = 32


def covered(keys: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """Lookups (``parish, sacrament, year``) inside some range of theirs: ranges are dealt into bins of years, and lookups look in their own."""
    bins = F.explode(F.sequence(F.floor(F.col("y_from") / width), F.floor(F.col("y_to") / width))).alias("bin")
    dealt = spans.where("y_from <= y_to").select("parish", "sacrament", "y_from", "y_to", bins)
    asked = keys.withColumn("bin", F.floor(F.col("year") / width))
    return asked.join(dealt, ["parish", "sacrament", "bin"]).where(F.col("year").between(F.col("y_from"), F.col("y_to"))).select("parish", "sacrament", "year").distinct()


def _carry(state: tuple, batch: pa.RecordBatch, wanted: bool) -> tuple[tuple, list[pa.Array]]:
    """The last edge at or before each row of its parish and sacrament."""
    key, edge = state
    out = []
    for p, s, one in zip(*(batch.column(c).to_pylist() for c in ("parish", "sacrament", "edge")), strict=True):
        if (p, s) != key:
            key, edge = (p, s), None
        edge = one if one is not None else edge
        out.append(edge)
    return (key, edge), [pa.array(out, batch.schema.field("edge").type)] if wanted else []


def _carried(a: tuple, b: tuple) -> tuple:
    return a if b[0] is None else (a if b[1] is None and a[0] == b[0] else b)


def nearest(keys: DataFrame, spans: DataFrame) -> DataFrame:
    """``parish, sacrament, year, near``: the range with the edge nearest to the year, of equal ones the first; null if there is none.

    Edges and lookups are put in one order and the last edge is carried along it, upwards and downwards.
    """
    edge = lambda at: spans.select("parish", "sacrament", F.col(at).alias("at"), F.struct("ord", "y_from", "y_to").alias("edge"))
    edges = edge("y_from").unionByName(edge("y_to")).groupBy("parish", "sacrament", "at").agg(F.min("edge").alias("edge"))
    asked = keys.select("parish", "sacrament", F.col("year").alias("at"), F.lit(None).cast(edges.schema["edge"].dataType).alias("edge"), F.lit(1).alias("turn"))
    both = edges.withColumn("turn", F.lit(0)).unionByName(asked)
    sides = []
    for sign in (1, -1):
        line = both.withColumn("place", F.col("at") * sign)
        sides.append(scan(line, ["parish", "sacrament", "place", "turn"], (None, None), _carry, _carried, "side struct<ord:int,y_from:int,y_to:int>").where("turn = 1").select("parish", "sacrament", F.col("at").alias("year"), "side"))
    gap = lambda x: F.least(F.abs(F.col("year") - x["y_from"]), F.abs(F.col("year") - x["y_to"]))
    ranked = sides[0].unionByName(sides[1]).where("side IS NOT NULL").withColumn("gap", gap(F.col("side")))
    best = ranked.groupBy("parish", "sacrament", "year").agg(F.min_by(F.struct("side.y_from", "side.y_to", "gap"), F.struct("gap", "side.ord")).alias("near"))
    return best


def _against_table(keys: DataFrame, spans: DataFrame) -> DataFrame:
    """As ``_against_code``, for a table of ranges of any size."""
    keys, spans = cut(keys), cut(spans.select("parish", "sacrament", F.col("ord").cast("int").alias("ord"), F.col("y_from").cast("int").alias("y_from"), F.col("y_to").cast("int").alias("y_to")))
    dated = keys.where("parish IS NOT NULL AND sacrament IS NOT NULL AND year IS NOT NULL").withColumn("year", F.col("year").cast("int"))
    n = spans.groupBy("parish", "sacrament").agg(F.count("*").alias("n"))
    out = keys.join(n, ["parish", "sacrament"], "left").join(covered(dated, spans).withColumn("hit", F.lit(True)), ["parish", "sacrament", "year"], "left").join(nearest(dated, spans), ["parish", "sacrament", "year"], "left")
    return out.select("parish", "sacrament", "year", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hit", F.lit(False)).alias("hit"), "near")


def verdicts(lookups: DataFrame, spark: SparkSession, today: int = 2026, coverage=COVERAGE, embargo=EMBARGO, spans: DataFrame | None = None) -> DataFrame:
    """Adds ``possible, why, nearest_from, nearest_to, distance`` to ``lookups (id, parish, sacrament, year)``.

    ``why`` is a code: ``parish``, ``none``, ``no_year``, ``embargo``, ``inside``, ``before``, ``after``, ``between``.
    ``spans (parish, sacrament, ord, y_from, y_to)`` stands for the table in code; it is not broadcast.
    """
    limits = F.broadcast(dimension(spark, list(embargo), "sacrament string, closed int"))
    keys = lookups.select("parish", "sacrament", "year").distinct()
    found = _against_code(keys, ranges(spark, coverage)) if spans is None else _against_table(keys, spans)
    joined = lookups.alias("l").join(found.alias("f"), F.col("l.parish").eqNullSafe(F.col("f.parish")) & F.col("l.sacrament").eqNullSafe(F.col("f.sacrament")) & F.col("l.year").eqNullSafe(F.col("f.year")), "left").select("l.*", "n", "hit", "near").join(limits, "sacrament", "left")
    closed = F.col("year") > F.lit(today) - F.col("closed")
    why = (
        F.when(F.col("parish").isNull(), "parish")
        .when(F.coalesce("n", F.lit(0)) == 0, "none")
        .when(F.col("year").isNull(), "no_year")
        .when(closed, "embargo")
        .when(F.col("hit"), "inside")
        .when(F.col("year") < F.col("near.y_from"), "before")
        .when(F.col("year") > F.col("near.y_to"), "after")
        .otherwise("between")
    )
    out = joined.withColumn("why", why)
    return out.select(*[f"`{c}`" for c in lookups.columns], (F.col("why") == "inside").alias("possible"), "why", F.col("near.y_from").alias("nearest_from"), F.col("near.y_to").alias("nearest_to"), F.col("near.gap").alias("distance"))


def alternatives(lookups: DataFrame, spark: SparkSession, today: int = 2026, coverage=COVERAGE) -> DataFrame:
    """``id, others``: sacraments of the parish that do cover the year, in the offered order."""
    each = lookups.select("id", "parish", "year", F.posexplode(F.array(*map(F.lit, OFFERED))).alias("o", "sacrament"))
    fine = verdicts(each, spark, today, coverage).where("possible")
    return fine.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "sacrament"))), lambda x: x["sacrament"]).alias("others"))


def plan(people: DataFrame, spark: SparkSession, today: int = 2026, marriage_span: int = 8, baptism_span: int = 2) -> DataFrame:
    """Lookups for a line of people, possible ones first, then by depth, marriages before baptisms.

    ``people (id, depth, parish, birth_year, marriage_year)``: one row for each marriage; a person without any
    has one row with a null year.
    """
    marriages = people.select("id", "depth", "parish", F.lit("matrimoni").alias("sacrament"), F.col("marriage_year").alias("year"), (F.col("depth") * 10).alias("rank"), F.lit(marriage_span).alias("span"))
    baptisms = people.select("id", "depth", "parish", F.lit("bateig").alias("sacrament"), F.col("birth_year").alias("year"), (F.col("depth") * 10 + 1).alias("rank"), F.lit(baptism_span).alias("span")).distinct()
    judged = verdicts(marriages.unionByName(baptisms), spark, today)
    return judged.select("id", "sacrament", "parish", "year", (F.col("year") - F.col("span")).alias("year_from"), (F.col("year") + F.col("span")).alias("year_to"), "rank", "possible", "why")
