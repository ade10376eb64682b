"""Ranking of open ends: the frontier score and its report order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frontier_score(generation: Column, direct: Column, status: Column, upstream: Column, town: Column, year: Column, archive: Column, documents: Column, parent_documents: Column) -> Column:
    """Higher is more promising; the terms are fixed values."""
    one = lambda c, v: F.when(c, F.lit(v)).otherwise(0.0)
    total = (
        F.when(generation.isNotNull(), F.greatest(F.lit(0), 12 - generation) * 1.5).otherwise(0.0)
        + one(direct, 3.0)
        + F.when(status == "ready", 10.0 + F.least(upstream, F.lit(120)) * 0.08).when(status == "unlinked", -2.0).otherwise(0.0)
        + one(town, 2.0)
        + one(year, 2.0)
        + one(~town & ~year, -3.0)
        + archive * 0.6
        + documents * 2.0
        + parent_documents * 3.0
    )
    return F.round(total, 2)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows: one TakeOrdered, no global sort."""
    return df.orderBy(*order).limit(k)


def worklist(entries: DataFrame, regions: DataFrame) -> DataFrame:
    """Open entries with their region's place in the report: configured order, then regions without a guide."""
    last = F.lit(1 << 20)
    return entries.where("status <> 'ready'").join(F.broadcast(regions.toDF("region", "r_ord")), "region", "left").withColumn("r_ord", F.coalesce("r_ord", last))
