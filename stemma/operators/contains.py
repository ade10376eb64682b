"""Which of many needles stand in which of many texts, without holding every needle against every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Letters of the pieces through which texts and needles meet; shorter needles are pieces of their own length.
PIECE = 3


def _pieces(c: Column, size: int) -> Column:
    """Distinct pieces of ``size`` letters."""
    n = F.length(c) - (size - 1)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(size)))
    return F.when(n > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """``text, needle``: each distinct text with each distinct needle that it contains. Null and empty needles are in none.

    A needle is looked for through that of its pieces that the fewest texts have, so a needle joins no more texts
    than hold its rarest piece, and those are searched for the whole of it. Case and accents count: fold them first.
    """
    t = cut(texts.select("text").where("text IS NOT NULL").distinct())
    n = cut(needles.select("needle").where("needle <> ''").distinct().withColumn("size", F.least(F.length("needle"), F.lit(PIECE))))
    sizes = [r.size for r in n.select("size").distinct().collect()]  # three at most
    if not sizes:
        return t.where("false").select("text", F.lit("").alias("needle"))
    grams = None
    for size in sorted(sizes):
        some = t.select("text", F.explode(_pieces(F.col("text"), size)).alias("piece"))
        grams = some if grams is None else grams.unionByName(some)
    asked = None
    for size in sorted(sizes):
        some = n.where(F.col("size") == size).select("needle", F.explode(_pieces(F.col("needle"), size)).alias("piece"))
        asked = some if asked is None else asked.unionByName(some)
    # Only pieces that some needle has matter, and of those how many texts have them.
    grams = cut(grams.join(asked.select("piece").distinct(), "piece", "left_semi"))
    often = grams.groupBy("piece").agg(F.count("*").alias("often"))
    rarest = asked.join(often, "piece", "left").groupBy("needle").agg(F.min_by("piece", F.struct(F.coalesce("often", F.lit(0)).alias("o"), "piece")).alias("piece"))
    return grams.join(rarest, "piece").where(F.contains("text", "needle")).select("text", "needle")
