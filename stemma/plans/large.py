"""Queries on forms for large tables: state in streams, chained answers, needles, tables of ranges: q74 to q77."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, graph
from ..operators.contains import contained
from ..session import shared_folder, table
from ..streaming import rate


def q74_budget_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling budget as a stream with state and timers, over all events up to the watermark: what may be spent, and how long to nap."""
    kinds = table(spark, sf_dir, "events").schema
    # A pattern, since a stream takes a plain path to be a folder.
    e = spark.readStream.schema(kinds).parquet(f"{sf_dir}/events.parque?").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 10).alias("seconds"))
    found = rate.rolling_stream(e, 10.0, 60, "1 minute")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/rows").select("id", F.round("spent", 4).alias("spent"), "n", "allowed", F.round("nap", 3).alias("nap"))


Q74 = f"""
WITH w AS (SELECT event_id, ts, sum(value / 10) OVER w AS spent, count(*) OVER w AS n, min(ts) OVER w AS oldest FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW))
SELECT event_id AS id, round(spent, 4) AS spent, n, spent < 10.0 AS allowed, round(CASE WHEN spent < 10.0 THEN 0.0::DOUBLE ELSE greatest({rate.LEAST_NAP}::DOUBLE, 60 - (epoch_us(ts) - epoch_us(oldest)) / 1e6) END, 3) AS nap
FROM w WHERE (epoch_us(ts) + 999) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - 60000"""


#: Generations in one answer, and rounds of asking.
GENERATIONS, ROUNDS = 3, 4


def q75_chained_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three generations about every customer (above ``k`` stand ``2k`` and ``2k + 1``), asked for from 1 on in four rounds: people, the call that gave them, what they stand under."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")).where("k > 0")
    n = F.explode(F.sequence(F.lit(1), F.lit((1 << GENERATIONS) - 1))).alias("n")
    each = c.select("k", n).withColumn("g", F.floor(F.log2("n") + 1e-9).cast("int")).withColumn("p", F.expr("shiftleft(k, g) + n - shiftleft(1, g)"))
    there = each.join(c.select(F.col("k").alias("p")), "p")
    answers = there.select(F.concat(F.lit("P"), "k").alias("root"), F.concat(F.lit("P"), "p").alias("pid"), F.col("n").cast("string").alias("sosa"), F.when((F.col("p") + F.col("k")) % 3 == 0, F.concat(F.lit("17"), F.col("k") % 90 + 10)).alias("birth_date"))
    got = graph.chained(answers, "P1", ROUNDS, None, GENERATIONS)
    calls = got["calls"].groupBy().agg(F.count("*").alias("n")).select(F.lit("calls").alias("pid"), F.col("n").cast("string").alias("birth_date"), F.lit("").alias("parents"))
    up = got["edges"].groupBy(F.col("child").alias("pid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "parent"))), lambda x: x["parent"]), ",").alias("parents"))
    return got["people"].join(up, "pid", "left").select("pid", "birth_date", F.coalesce("parents", F.lit("")).alias("parents")).unionByName(calls)


Q75 = f"""
WITH RECURSIVE c AS (SELECT c_custkey::BIGINT AS k FROM customer WHERE c_custkey > 0),
asked(k, turn) AS (SELECT 1::BIGINT, 1 UNION ALL SELECT c.k, turn + 1 FROM asked JOIN c ON c.k >> {GENERATIONS - 1} = asked.k WHERE turn < {ROUNDS}),
a AS (SELECT asked.k, turn, c.k AS p FROM asked JOIN (SELECT unnest(range({GENERATIONS})) AS g) ON true JOIN c ON c.k >> g = asked.k),
f AS (SELECT p, arg_min(CASE WHEN (p + k) % 3 = 0 THEN '17' || (k % 90 + 10) END, CASE WHEN (p + k) % 3 = 0 THEN 0 ELSE 1000000000 END + turn * 10000000 + k) FILTER (WHERE (p + k) % 3 = 0) AS born FROM a GROUP BY p),
e AS (SELECT DISTINCT a.p AS child, b.p AS parent FROM a JOIN a b ON a.k = b.k AND b.p >> 1 = a.p),
u AS (SELECT child, string_agg('P' || parent, ',' ORDER BY parent) AS parents FROM e GROUP BY 1)
SELECT 'P' || p AS pid, born AS birth_date, coalesce(parents, '') AS parents FROM f LEFT JOIN u ON child = p UNION ALL SELECT 'calls', CAST(count(*) AS STRING), '' FROM asked"""


def q76_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word of documents that holds words of benchmark items (four letters and more): how many, and the longest."""
    split = lambda name: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w")).distinct()
    found = contained(split("documents").select(F.col("w").alias("text")), split("benchmark").where("length(w) >= 4").select(F.col("w").alias("needle")))
    return found.groupBy("text").agg(F.count("*").alias("n"), F.min_by("needle", F.struct((-F.length("needle")).alias("l"), "needle")).alias("longest"))


Q76 = """
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
h AS (SELECT t.w AS text, n.w AS needle FROM t JOIN n ON contains(t.w, n.w) WHERE length(n.w) >= 4)
SELECT text, count(*) AS n, (list(needle ORDER BY length(needle) DESC, needle))[1] AS longest FROM h GROUP BY text"""


def q77_range_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of orders as lookups, by a table of ranges made of all customers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("ord"), F.concat(F.lit("n"), "c_nationkey").alias("parish"), F.expr("element_at(array('bateig', 'matrimoni', 'defuncio'), cast(c_custkey % 3 AS int) + 1)").alias("sacrament"), F.expr("cast(1500 + (c_custkey * 37) % 400 AS int)").alias("y_from"))
    spans = c.withColumn("y_to", F.col("y_from") + (F.col("ord") * 13) % 9)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("n"), F.col("o_custkey") % 27).alias("parish"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'bateig' WHEN 'O' THEN 'matrimoni' ELSE 'defuncio' END").alias("sacrament"), F.expr("CASE WHEN o_orderkey % 17 <> 0 THEN cast(1480 + (o_orderkey * 7) % 500 AS int) END").alias("year"))
    return coverage.verdicts(o, spark, spans=spans).select("id", "why", "nearest_from", "nearest_to", "distance")


Q77 = """
WITH s AS (SELECT c_custkey AS ord, 'n' || c_nationkey AS parish, ['bateig', 'matrimoni', 'defuncio'][c_custkey % 3 + 1] AS sacrament, (1500 + (c_custkey * 37) % 400)::INT AS a, ((1500 + (c_custkey * 37) % 400) + (c_custkey * 13) % 9)::INT AS z FROM customer),
l AS (SELECT o_orderkey AS id, 'n' || (o_custkey % 27) AS parish, CASE o_orderstatus WHEN 'F' THEN 'bateig' WHEN 'O' THEN 'matrimoni' ELSE 'defuncio' END AS sacrament, CASE WHEN o_orderkey % 17 <> 0 THEN (1480 + (o_orderkey * 7) % 500)::INT END AS year FROM orders),
v AS (SELECT id, l.sacrament, year, count(s.a) AS n, coalesce(bool_or(year BETWEEN s.a AND s.z), false) AS hit, arg_min({'a': s.a, 'z': s.z}, least(abs(year - s.a), abs(year - s.z))::BIGINT * 10000000000 + ord) AS near, min(least(abs(year - s.a), abs(year - s.z)))::INT AS distance
  FROM l LEFT JOIN s ON l.parish = s.parish AND l.sacrament = s.sacrament GROUP BY 1, 2, 3)
SELECT id, CASE WHEN n = 0 THEN 'none' WHEN year IS NULL THEN 'no_year' WHEN year > 2026 - CASE sacrament WHEN 'bateig' THEN 110 ELSE 100 END THEN 'embargo' WHEN hit THEN 'inside' WHEN year < near.a THEN 'before' WHEN year > near.z THEN 'after' ELSE 'between' END AS why,
  near.a AS nearest_from, near.z AS nearest_to, distance FROM v"""

QUERIES = {f.__name__: f for f in (q74_budget_stream, q75_chained_answers, q76_needles, q77_range_tables)}
SQL = {"q74_budget_stream": Q74, "q75_chained_answers": Q75, "q76_needles": Q76, "q77_range_tables": Q77}
