"""Data-quality rules as tables of violations, manifests, freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def violations(rules: list[tuple[str, DataFrame]]) -> DataFrame:
    """``rule, id`` over all rules; each rule is a table of the ids that break it."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("rule"), "id") for name, df in rules])


def missing(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose ``key`` does not exist."""
    return rows.where("key IS NOT NULL").join(known.select("key").distinct(), "key", "left_anti")


def outside(rows: DataFrame, domain: tuple[str, ...]) -> DataFrame:
    return rows.where(~F.col("value").isin(*domain))


def repeated(rows: DataFrame) -> DataFrame:
    """Second and later rows of a ``key``, which is moved as a hash of 256 bits."""
    order = Window.partitionBy("h").orderBy("id")
    return rows.where("key IS NOT NULL").select("id", F.sha2(F.col("key").cast("string"), 256).alias("h")).withColumn("nth", F.row_number().over(order)).where("nth > 1").select("id")


def not_unique(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References that do not resolve to exactly one target."""
    n = targets.groupBy("key").agg(F.count("*").alias("n"))
    return references.join(n, "key", "left").where("coalesce(n, 0) <> 1").select("id")


def required(rows: DataFrame) -> DataFrame:
    return rows.where("value IS NULL OR trim(value) = ''").select("id")


def malformed(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.where(~F.col("value").rlike(pattern)).select("id")


def manifest_diff(known: DataFrame, disk: DataFrame) -> DataFrame:
    """``path, size, state``: ``missing``, ``new``, ``changed`` or ``same``; both have ``path, digest, size``."""
    k, d = (df.select("path", F.col("digest").alias(f"{x}_digest"), F.col("size").alias(f"{x}_size"), F.lit(True).alias(x)) for df, x in ((known, "k"), (disk, "d")))
    state = F.when(F.col("d").isNull(), "missing").when(F.col("k").isNull(), "new").when((F.col("k_digest") != F.col("d_digest")) | (F.col("k_size") != F.col("d_size")), "changed").otherwise("same")
    return k.join(d, "path", "full_outer").select("path", F.coalesce("k_size", "d_size").alias("size"), state.alias("state"))


def first_difference(committed: DataFrame, fresh: DataFrame) -> DataFrame:
    """``report, line``: the first line in which two versions (``report, n, line``) differ; equal ones give no row."""
    a, b = committed.toDF("report", "n", "a"), fresh.toDF("report", "n", "b")
    return a.join(b, ["report", "n"], "full_outer").where("NOT (a <=> b)").groupBy("report").agg(F.min("n").alias("line"))


def stale_counts(claims: DataFrame, actual: DataFrame) -> DataFrame:
    """Claims (``metric, said``) that differ from computed values (``metric, value``)."""
    return claims.join(actual, "metric").where("said <> value")


def longest_existing_prefix(routes: DataFrame, folders: DataFrame) -> DataFrame:
    """``route, folder``: the longest of a route's own leading folders that exists; null if none does.

    ``routes (route)``, ``folders (folder)``, both with ``/`` between parts.
    """
    parts = F.split("route", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = routes.select("route").distinct().select("route", F.explode(prefixes).alias("folder")).join(folders.select("folder").distinct(), "folder", "left_semi")
    best = each.groupBy("route").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    return routes.join(best, "route", "left")


def table_claims(lines: DataFrame) -> DataFrame:
    """``metric, said``: label and first whole number of two-cell table rows in Markdown ``lines (raw)``."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("raw"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.where(F.startswith(F.trim("raw"), F.lit("|"))).select(cells.alias("c")).where("size(c) = 2")
    number = F.regexp_extract(F.replace(F.get("c", F.lit(1)), F.lit(".")), r"(\d+)", 1).try_cast("int")
    return rows.select(F.get("c", F.lit(0)).alias("metric"), number.alias("said")).where("said IS NOT NULL")


def review_kind(rows: DataFrame) -> str:
    """What a review file holds, from its columns: ``corrections`` (edits), ``parents``, ``records``, ``children`` or ``ids``."""
    names = set(rows.columns)
    if "edits" in names:
        return "corrections"
    kinds = {r.kind for r in rows.select("kind").distinct().limit(2).collect()} if "kind" in names else set()
    if len(kinds) == 1 and kinds <= {"parents", "records", "children"}:
        return kinds.pop()
    if {"target", "fsftid"} <= names:
        return "ids"
    raise ValueError("entries of one known kind are expected")


def forbidden_keys(texts: DataFrame, key: str) -> DataFrame:
    """Notes (``id, text``) whose heading block has a key that must not be there."""
    block = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)
    return texts.where(block.rlike(rf"(?m)^{key}\s*:")).select("id")


def public_binaries(tracked: DataFrame, extensions: tuple[str, ...], private: bool) -> DataFrame:
    """Tracked files (``id, name``) with a binary extension, which only a private place may hold."""
    found = tracked.where(F.lower(F.substring_index("name", ".", -1)).isin(*extensions)).select("id")
    return found.where(F.lit(not private))
