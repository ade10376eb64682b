"""Reports as ordered lines of Markdown: matches, open ends, work by archive, counters, planned lookups.

Each function gives ``section, rank, key, nth, line``; rows are exploded into their lines in Spark, and ``text_of``
puts a report of bounded size in order. Wording is ours; grouping, order and what each line tells are those of the job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

SCHEMA = "section int, rank double, key string, nth int, line string"


def _fixed(spark: SparkSession, section: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(section, 0.0, "", i, x) for i, x in enumerate(lines)], SCHEMA)


def _rows(df: DataFrame, section: int, rank: Column, key: Column, *lines: Column) -> DataFrame:
    """Lines of each row, those that are null left out; by rank, then key."""
    return df.select(F.lit(section).alias("section"), rank.cast("double").alias("rank"), key.cast("string").alias("key"), F.posexplode(F.filter(F.flatten(F.array(*lines)), lambda x: x.isNotNull())).alias("nth", "line"))


def _one(c: Column) -> Column:
    return F.array(c)


def _cells(*cells: Column) -> Column:
    return _one(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("?")) for c in cells]), F.lit(" |")))


def _counted(df: DataFrame, section: int, title: str) -> DataFrame:
    """A heading with the number of rows, also where there are none."""
    return df.agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), F.lit(-1.0).alias("rank"), F.lit("").alias("key"), F.lit(0).alias("nth"), F.concat(F.lit(f"## {title} ("), F.col("n").cast("string"), F.lit(")")).alias("line"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _items(values: Column, before: str) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.concat(F.lit(before), x))


def text_of(lines: DataFrame) -> str:
    """The report as text; refused where it is none of a report's size."""
    found = sinks._small(lines)
    return "\n".join(r.line for r in sorted(found, key=lambda r: (r.section, r.rank, r.key, r.nth))) + "\n"


def match_report(matches: DataFrame, right_only: DataFrame) -> DataFrame:
    """Sure matches and those to look at by score, lefts without a match with the best that was turned down, rights alone by their sources.

    ``matches (bucket, left, left_birth, right, right_birth, total, reasons array)``, ``right_only (right, birth_year, sources)``.
    """
    spark = matches.sparkSession
    parts = [_fixed(spark, 0, "# Matches of two trees"), _rows(matches.groupBy("bucket").agg(F.count("*").alias("n")), 1, F.lit(0), F.col("bucket"), _cells(F.col("bucket"), F.col("n")))]
    for section, (bucket, title) in enumerate((("confident", "Sure"), ("review", "To be looked at")), 2):
        some = matches.where(F.col("bucket") == bucket)
        parts += [_counted(some, section, title), _rows(some, section, -F.col("total"), F.col("left"), _cells(F.col("left"), F.col("left_birth"), F.col("right"), F.col("right_birth"), F.col("total"), F.array_join("reasons", "; ")))]
    none = matches.where("bucket = 'unmatched'")
    near = F.when(F.col("right").isNotNull(), F.concat("right", F.lit(" ("), F.col("total").cast("string"), F.lit(")"))).otherwise("")
    parts += [_counted(none, 4, "Only in the first tree"), _rows(none, 4, F.lit(0), F.col("left"), _cells(F.col("left"), F.col("left_birth"), near))]
    parts += [_counted(right_only, 5, "Only in the second tree"), _rows(right_only, 5, -F.col("sources") * 10000 + F.coalesce("birth_year", F.lit(9999)), F.col("right"), _cells(F.col("right"), F.col("birth_year"), F.col("sources")))]
    return _all(*parts)


def frontier_report(entries: DataFrame, provenance: DataFrame) -> DataFrame:
    """Open ends by status: those whose parents are known with all that is known of them, the others as tables, by score.

    ``entries (xref, name, status, score, birth, town, parents array<struct<name,documents array>>, upstream, oldest, documents array, archive)``.
    """
    spark = entries.sparkSession
    ready = entries.where("status = 'ready'")
    sums = ready.agg(F.coalesce(F.sum("upstream"), F.lit(0)).alias("n")).select(F.lit(1).alias("section"), F.lit(1.0).alias("rank"), F.lit("").alias("key"), F.lit(0).alias("nth"), F.concat(F.lit("New ancestors above them: "), F.col("n").cast("string")).alias("line"))
    said = provenance.select(F.lit(1).alias("section"), F.lit(0.0).alias("rank"), F.lit("").alias("key"), F.lit(0).alias("nth"), "line")
    parents = F.flatten(F.transform(F.coalesce("parents", F.from_json(F.lit("[]"), "array<struct<name:string,documents:array<string>>>")), lambda p: F.concat(F.array(F.concat(F.lit("- Parent: "), p["name"])), _items(p["documents"], "  - Named by our own: "))))
    above = F.when(F.col("upstream") > 0, F.concat(F.lit("- Above: "), F.col("upstream").cast("string"), F.when(F.col("oldest").isNotNull(), F.concat(F.lit(", back to "), F.col("oldest").cast("string"))).otherwise("")))
    head = F.concat(F.lit("### "), "xref", F.lit(" "), "name", F.lit(" "), F.col("score").cast("string"))
    parts = [_fixed(spark, 0, "# Open ends"), said, sums, _counted(ready, 2, "Ready")]
    parts.append(_rows(ready, 2, -F.col("score"), F.col("xref"), _one(head), _one(F.concat(F.lit("- Birth: "), F.coalesce("birth", F.lit("unknown")))), parents, _one(above), _items(F.col("documents"), "- Document: "), _one(F.concat(F.lit("- Archive: "), "archive"))))
    for section, (status, title) in enumerate((("stuck", "Stuck"), ("unknown", "Not asked"), ("unlinked", "Not linked")), 3):
        some = entries.where(F.col("status") == status)
        parts += [_counted(some, section, title), _rows(some, section, -F.col("score"), F.col("xref"), _cells(F.concat("xref", F.lit(" "), "name"), F.col("birth"), F.col("town"), F.array_join("documents", ", "), F.col("archive")))]
    return _all(*parts)


def worklist_report(entries: DataFrame, guides: DataFrame) -> DataFrame:
    """Open entries by region in the order of the guides, regions without a guide last; in each by score, with links to start from.

    ``entries (region, xref, name, status, score, birth, town, documents array, links array)``, ``guides (region, ord, title, links array)``.
    """
    spark = entries.sparkSession
    todo = entries.where("status <> 'ready'").join(F.broadcast(guides.select("region", "ord", "title", F.col("links").alias("starts"))), "region", "left")
    rank = F.coalesce(F.col("ord"), F.lit(1 << 20))
    by = todo.groupBy("region").agg(F.count("*").alias("n"), F.min(rank).alias("rank"), F.min("title").alias("title"), F.min("starts").alias("starts"))
    name = F.coalesce("title", "region")
    why = F.when(F.col("status") == "stuck", "- parents are not known there either").when(F.col("status") == "unknown", "- linked, not asked yet").otherwise("- not found there yet")
    facts = F.concat(F.lit("- "), F.coalesce(F.nullif(F.concat_ws(", ", F.concat(F.lit("born "), "birth"), F.concat(F.lit("at "), "town")), F.lit("")), F.lit("no date and no place")))
    # Regions stand one after another: their place, then the score within.
    heads = by.select(F.lit(2).alias("section"), (F.col("rank") * 1e6).alias("rank"), F.concat("region", F.lit(" ")).alias("key"), F.posexplode(F.concat(F.array(F.concat(F.lit("## "), name, F.lit(" ("), F.col("n").cast("string"), F.lit(")"))), _items(F.col("starts"), "- Start: "))).alias("nth", "line"))
    rows = _rows(todo, 2, rank * 1e6 + 1e5 - F.col("score"), F.concat_ws(" ", "region", "xref"), _one(F.concat(F.lit("### "), "name", F.lit(" "), "xref")), _one(facts), _one(why), _items(F.col("documents"), "- Document: "), _items(F.col("links"), "- "))
    return _all(_fixed(spark, 0, "# Work by archive"), _rows(by, 1, F.col("rank"), F.col("region"), _cells(name, F.col("n"))), heads, rows)


def counters_report(metrics: DataFrame, generations: DataFrame, foster: DataFrame, folders: DataFrame, broken: DataFrame) -> DataFrame:
    """``metrics (ord, label, value)``; slots by generation beside the full number; foster generations; notes by folder; broken routes."""
    spark = metrics.sparkSession
    return _all(
        _fixed(spark, 0, "# State of the tree"), _rows(metrics, 1, F.col("ord"), F.col("label"), _cells(F.col("label"), F.col("value"))),
        _rows(generations, 2, F.col("gen"), F.lit(""), _cells(F.concat(F.lit("G"), F.col("gen").cast("string")), F.col("n"), F.col("of"))),
        _rows(foster, 3, F.col("gen"), F.lit(""), _one(F.concat(F.lit("- foster: G"), F.col("gen").cast("string"), F.lit(" by "), F.col("delta").cast("string")))),
        _rows(folders, 4, F.lit(0), F.col("folder"), _cells(F.col("folder"), F.col("n"))), _rows(broken, 5, F.lit(0), F.col("route"), _one(F.concat(F.lit("- broken: "), "route"))),
    )


def verification_report(lookups: DataFrame, coverage: DataFrame, quota: str) -> DataFrame:
    """Lookups that can be asked for, in order and numbered; those that can't and why; the years that books of their parishes cover.

    ``lookups (id, who, sacrament, year, parish, rank, possible, why)``, ``coverage (parish, sacrament, ord, y_from, y_to)``.
    """
    spark = lookups.sparkSession
    year = F.coalesce(F.col("year").cast("string"), F.lit("?"))
    shown = F.concat(F.col("who"), F.lit(": "), F.col("sacrament"), F.lit(" "), year, F.lit(", "), F.coalesce("parish", F.lit("?")))
    span = F.concat(F.col("y_from").cast("string"), F.lit("-"), F.col("y_to").cast("string"))
    by = coverage.join(lookups.select("parish").distinct(), "parish", "left_semi").groupBy("parish", "sacrament").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", span.alias("s")))), lambda x: x["s"]), ", ").alias("s"))
    return _all(
        _fixed(spark, 0, "# Planned lookups", quota), _counted(lookups.where("possible"), 1, "Can be asked for"), _rows(lookups.where("possible"), 1, F.col("rank"), F.col("id"), _one(F.concat(F.lit("- "), shown))),
        _counted(lookups.where("NOT possible"), 2, "Can't be asked for"), _rows(lookups.where("NOT possible"), 2, F.col("rank"), F.col("id"), _one(F.concat(F.lit("- "), shown, F.lit(": "), F.col("why")))),
        _rows(by, 3, F.lit(0), F.concat_ws(" ", "parish", "sacrament"), _cells(F.col("parish"), F.col("sacrament"), F.col("s"))),
    )
