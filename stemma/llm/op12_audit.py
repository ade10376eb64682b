"""Audit of filters that run one after another: what each removes, repeats, and costs, in every order.

Documents become mask cells: how many of a part fail which filters. Cells are unpivoted against the steps of
all orders; a running bit-or window over an order's steps tells which filters ran before, and so which rows
were gone; conditional sums give a step's figures, and a window over a filter's rows its total of all orders.

The corpus is read once and leaves one small row a document; after that only cells move, at most
``2 ** filters`` a part, so hot parts and groups of copies weigh no more than others.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import content_key, cut, spread, table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 2
#: Filters whose orders are all listed; seven have 5,040.
MOST = 7
COUNTS = ("n", "good", "toxic")


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """``filter_order, step, filter, bit``: the steps of every order; their number follows from the filters alone."""
    if len(filters) > MOST or len(set(filters)) != len(filters):
        raise ValueError(f"at most {MOST} different filters")
    every = spark.createDataFrame([("".join(p),) for p in permutations(filters)], "filter_order string")
    steps = every.select("filter_order", F.explode(F.sequence(F.lit(1), F.length("filter_order"))).alias("step"))
    name = F.expr("substring(filter_order, step, 1)")
    return steps.select("filter_order", "step", name.alias("filter"), F.expr(f"shiftleft(1, instr('{filters}', substring(filter_order, step, 1)) - 1)").alias("bit"))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Figures of every part, order and step from ``cells (part, mask, n, good, toxic)``.

    ``mask`` has a bit for each filter that fails, the first filter's the lowest; ``n`` counts a cell's rows,
    ``good`` and ``toxic`` those of them that carry the label. Cells of one part and mask add up. Every part gets
    all its rows, zeros included; no cells give no rows.
    """
    spark = cells.sparkSession
    cells = cells.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])
    masks = spark.range(1 << len(filters)).select(F.col("id").cast("int").alias("mask"))
    # A row a mask, order and step, whatever the corpus: the size is given by the filters.
    long = orders(spark, filters).join(F.broadcast(masks))
    before = Window.partitionBy("mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    ran = F.coalesce(F.bit_or("bit").over(before), F.lit(0))
    flags = long.select("filter_order", "step", "filter", "mask", (F.col("mask").bitwiseAND(ran) != 0).alias("gone"), (F.col("mask").bitwiseAND(F.col("bit")) != 0).alias("fails"), (F.col("mask") == F.col("bit")).alias("alone"))
    flags = flags.withColumn("removed", F.col("fails") & ~F.col("gone"))
    total = lambda test, of="n": F.coalesce(F.sum(F.when(test, F.col(of))), F.lit(0)).cast("long")
    figures = cells.join(F.broadcast(flags), "mask").groupBy("part", "filter_order", "step", "filter").agg(
        total(~F.col("gone") & ~F.col("fails")).alias("kept"), total(F.col("removed")).alias("removed"), total(F.col("fails") & F.col("gone")).alias("redundant"),
        total(F.col("alone")).alias("unique_fails"), total(F.col("removed"), "good").alias("good_lost"), total(F.col("removed"), "toxic").alias("toxic_lost"),
    )
    return figures.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long")).drop("filter")


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def failures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """``doc_id, part, mask`` of every row: the five filters of the audit.

    A null text counts as empty, a null part as the empty string. A row without an id is never the later copy of
    a text; repeated rows are copies of each other only where a smaller id has their text. Texts are compared by
    128 bits of SHA-256.
    """
    t = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(part_column, F.lit("")).alias("part"), F.coalesce(text_column, F.lit("")).alias("t"))
    t = t.select("doc_id", "part", *content_key(F.col("t")), "t", _words(F.col("t")).alias("w"))
    upper = F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))
    fails = [F.size("w") < MIN_WORDS, 100 * F.size(F.array_distinct("w")) < MIN_DISTINCT * F.size("w"), 100 * upper.cast("long") > MAX_UPPER * F.length("t").cast("long"), F.col("t").rlike(r"[#$%&*|]")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    rows = cut(t.select("doc_id", "part", "k1", "k2", mask.alias("mask")))
    # The first id of a text is a sum of rows combined before they move; rows meet it by text and id, so a text with many copies is spread.
    first = rows.where("doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << len(fails)).otherwise(0)
    return rows.join(first, ["k1", "k2", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask"))


def labelled_cells(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells of ``failures``, with the rows whose label says good (``quality`` 1) or toxic; of repeated labels any counts."""
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")])
    each = found.join(said.where("quality + toxic > 0"), "doc_id", "left")
    return each.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` with all of ``labels``; nulls, repeated rows and empty tables as in ``failures`` and ``audit``, texts of any length whole."""
    return audit(labelled_cells(failures(spread(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "labels")))


ORACLE_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), f AS (
  SELECT doc_id, part, len(w) < {MIN_WORDS} AS a, 100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g'))) > {MAX_UPPER} * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM t
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) AS failing, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5
), st AS (
  SELECT filter_order, step, filter_order[step] AS x, string_split(filter_order[1:step - 1], '') AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)
), g AS (
  SELECT part, filter_order, step, x, n, good, toxic, failing, list_has_any(failing, earlier) AS gone, list_contains(failing, x) AS fails FROM m, st
), sums AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, x, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE failing = [x]), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM g GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM sums"""
