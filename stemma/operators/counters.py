"""Counters of a tree and of its notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order as ordered


def summary(people: DataFrame, by: str) -> DataFrame:
    """Rows, distinct external ids, open ends, and the years spanned by births and deaths, (0, 0) if none."""
    first, last = F.least("birth_year", "death_year"), F.greatest("birth_year", "death_year")
    return people.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("external_id").alias("with_id"), F.count_if("open").alias("n_open"), F.coalesce(F.min(first), F.lit(0)).alias("first_year"), F.coalesce(F.max(last), F.lit(0)).alias("last_year"))


def bucket_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Adds ``n``, the place of a row in its group, from one; a group may be as large as the table."""
    return ordered.numbered(rows, [by], [order], "n")


def notes_by_folder(notes: DataFrame) -> DataFrame:
    """Notes by their first folder; folders that begin with ``00 `` are left out."""
    folder = F.substring_index("path", "/", 1)
    return notes.select(folder.alias("folder")).where(~F.startswith("folder", F.lit("00 "))).groupBy("folder").agg(F.count("*").alias("n"))


def file_classes(files: DataFrame) -> DataFrame:
    """Files that are not reading copies, notes, and reading copies."""
    copy = F.endswith("name", F.lit("_lectura.jpg"))
    return files.agg(F.count_if(~copy).alias("files"), F.count_if(F.endswith("name", F.lit(".md"))).alias("notes"), F.count_if(copy).alias("reading_copies"))


def cited_routes(lines: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """Routes named in lines: how often, on how many lines, and whether the file is there."""
    said = lines.select("path", "idx", F.explode(F.regexp_extract_all("raw", F.lit(pattern), 0)).alias("route"))
    known = files.select(F.col("name").alias("route"), F.lit(True).alias("found")).distinct()
    return said.groupBy("route").agg(F.count("*").alias("n"), F.countDistinct("path", "idx").alias("lines")).join(known, "route", "left").withColumn("broken", F.col("found").isNull()).drop("found")


def exit_code(routes: DataFrame) -> int:
    """What a report of counters ends with: 1 if a cited route is broken."""
    return 0 if routes.where("broken").isEmpty() else 1


def labelled(lines: DataFrame, tag: str = "_SOSADABOVILLE") -> DataFrame:
    return lines.where(F.col("tag") == tag).agg(F.countDistinct("path", "rec_id").alias("people"), F.count("*").alias("lines"))


def last_wins(rows: DataFrame, key: str, item: str, value: str, order: str) -> DataFrame:
    """One map a key; of repeated items the last value stays."""
    each = rows.groupBy(key, item).agg(F.max_by(value, order).alias("v"))
    return each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(item, "v"))).alias("items"))


def ordered_lists(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(name)).alias("names"))


def oldest_first(year: Column) -> Column:
    return F.coalesce(year, F.lit(9999))
