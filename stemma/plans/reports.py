"""Queries on splits, rates, hierarchies, edits, counters, links and freshness: q23 to q33."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links, places
from ..operators import counters, edit, quality, resolve
from ..session import dimension, table
from ..sources import gedcom
from ..streaming import rate


def q23_three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders split into accepted, rejected and pending; the split is checked to lose nothing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("accept"))
    yes, no, open_ = edit.three_way(o)
    parts = yes.withColumn("part", F.lit("accepted")).unionByName(no.withColumn("part", F.lit("rejected"))).unionByName(open_.withColumn("part", F.lit("pending")))
    lost = edit.lost(o, yes, no, open_).agg(F.count("*").alias("lost"))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 0).cast("long").alias("total")).crossJoin(F.broadcast(lost))


Q23 = "SELECT CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'pending' END AS part, count(*) AS n, CAST(round(sum(o_totalprice), 0) AS BIGINT) AS total, 0::BIGINT AS lost FROM orders GROUP BY 1"


def q24_rolling_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds spent by each user in the last minute, the oldest sample at exactly sixty seconds included, and the nap needed."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 10).alias("seconds"))
    return rate.rolling(e, budget=10.0, window=60).select("event_id", F.round("spent", 4).alias("spent"), "n", "allowed")


Q24 = """
SELECT event_id, round(spent, 4) AS spent, n, spent < 10.0 AS allowed FROM (SELECT event_id, sum(value / 10) OVER w AS spent, count(*) OVER w AS n FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW))"""


def q25_daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups a day against a soft limit, reconciled with what the server counted."""
    e = table(spark, sf_dir, "events")
    ours = e.select(F.to_date("ts").alias("day"))
    server = e.where("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg((F.count("*") * 6).cast("long").alias("server_used"))
    return rate.daily(ours, limit=40, server=server).withColumn("day", F.col("day").cast("string"))


Q25 = """
WITH o AS (SELECT ts::DATE AS day, count(*) AS used FROM events GROUP BY 1), s AS (SELECT ts::DATE AS day, count(*) * 6 AS su FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT day::VARCHAR AS day, greatest(used, coalesce(su, 0)) AS used, greatest(0, 40 - greatest(used, coalesce(su, 0))) AS remaining FROM o LEFT JOIN s USING (day)"""


def q26_same_attr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Couples (customer 2k with 2k + 1) whose partners share a year."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.lit(1800) + F.col("c_nationkey")).alias("birth_year"), (F.lit(1850) + F.floor(F.abs("c_acctbal")) % 40).alias("death_year"))
    couples = c.where("id % 2 = 0").select(F.col("id").alias("husband"), (F.col("id") + 1).alias("wife"))
    return resolve.same_year_couples(couples, c).select("husband", "wife", "hb", "wb", "hd", "wd")


Q26 = """
WITH c AS (SELECT c_custkey AS id, 1800 + c_nationkey AS b, 1850 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 40 AS d FROM customer)
SELECT h.id AS husband, w.id AS wife, h.b AS hb, w.b AS wb, h.d AS hd, w.d AS wd FROM c h JOIN c w ON w.id = h.id + 1 WHERE h.id % 2 = 0 AND (h.b = w.b OR h.d = w.d)"""


def q27_hierarchy_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as numbered lines: records by running count, parents by nearest smaller level, first values by tag, last label kept."""
    c = table(spark, sf_dir, "conversations")
    level = F.when(F.col("turn") == 0, 0).when(F.col("role") == "user", 1).otherwise(2)
    lines = c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("int").alias("idx"), level.alias("level"), F.upper("role").alias("tag"), F.length("text").cast("string").alias("value"))
    full = gedcom.nested(lines)
    kept, _ = gedcom.without_repeated_tag(full, "ASSISTANT")
    last = kept.where("tag = 'ASSISTANT'").select("path", F.col("idx").alias("last_answer"))
    first = full.groupBy("path").agg(F.count("*").alias("n_lines"), F.max("rec_id").alias("n_records"), F.sum(F.coalesce("parent_idx", F.lit(-1))).alias("parents"), F.min_by("value", F.when(F.col("tag") == "USER", F.col("idx"))).alias("first_user"))
    return first.join(last, "path", "left")


Q27 = """
WITH l AS (SELECT conv_id::VARCHAR AS path, turn, CASE WHEN turn = 0 THEN 0 WHEN role = 'user' THEN 1 ELSE 2 END AS level, role, text FROM conversations),
p AS (SELECT a.path, a.turn, max(b.turn) AS parent FROM l a LEFT JOIN l b ON a.path = b.path AND b.turn < a.turn AND b.level < a.level GROUP BY 1, 2)
SELECT l.path, count(*) AS n_lines, 1::BIGINT AS n_records, sum(coalesce(p.parent, -1))::BIGINT AS parents, arg_min(length(text)::VARCHAR, l.turn) FILTER (WHERE role = 'user') AS first_user, max(l.turn) FILTER (WHERE role = 'assistant') AS last_answer
FROM l JOIN p ON l.path = p.path AND l.turn = p.turn GROUP BY l.path"""


def q28_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations patched: lines replaced, inserted before a place, deleted; the result's lines, numbered anew."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("int").alias("idx"), F.col("role").alias("raw"))
    replace = c.where("idx = 1 AND cast(path AS int) % 3 = 0").select("path", "idx", F.lit("edited").alias("raw"))
    insert = c.where("idx = 1 AND cast(path AS int) % 2 = 0").select("path", F.col("idx").alias("at"), F.lit(0).alias("seq"), F.lit("note").alias("raw"))
    delete = c.where("idx = 2 AND cast(path AS int) % 5 = 0").select("path", "idx")
    return edit.patch(c, replace, insert, delete).groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "raw"))), lambda x: x["raw"]), ",").alias("lines"))


Q28 = """
WITH c AS (SELECT conv_id, turn, role FROM conversations),
u AS (SELECT conv_id, turn AS pos, 1 AS kind, CASE WHEN turn = 1 AND conv_id % 3 = 0 THEN 'edited' ELSE role END AS raw FROM c WHERE NOT (turn = 2 AND conv_id % 5 = 0)
  UNION ALL SELECT conv_id, turn, 0, 'note' FROM c WHERE turn = 1 AND conv_id % 2 = 0)
SELECT conv_id::VARCHAR AS path, count(*) AS n, string_agg(raw, ',' ORDER BY pos, kind) AS lines FROM u GROUP BY 1"""


def q29_period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of orders by priority: rows, distinct customers, those open, first and last year, by rows."""
    o = table(spark, sf_dir, "orders")
    people = o.select(F.col("o_orderpriority").alias("folder"), F.col("o_custkey").alias("external_id"), (F.col("o_orderstatus") == "O").alias("open"), F.year("o_orderdate").alias("birth_year"), F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate") + 1).alias("death_year"))
    return counters.summary(people, "folder")


Q29 = """
SELECT o_orderpriority AS folder, count(*) AS n, count(DISTINCT o_custkey) AS with_id, count_if(o_orderstatus = 'O') AS n_open, min(year(o_orderdate)) AS first_year,
       max(CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END) AS last_year FROM orders GROUP BY 1"""


def q30_place_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place strings of customers: components, key, match with a fixed place, six-level layout and its flat form."""
    c, n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    p = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    town = F.when(F.col("c_custkey") % 3 == 0, "Onteniente").when(F.col("c_custkey") % 3 == 1, "L'Alcúdia").otherwise("Vila-Sacra")
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(town, F.lit(", "), F.col("n_name"), F.lit(", "), F.col("r_name"), F.lit(", España"))).otherwise(F.concat(town, F.lit(", , "), F.col("r_name")))
    d = p.select("c_custkey", raw.alias("raw"))
    parts = places.place_components(F.col("raw"))
    six = places.six_levels(F.col("raw"))
    other = F.array(F.lit("ontinyent"), F.lit("espanya"))
    return d.select("c_custkey", F.array_join(parts, "|").alias("parts"), places.place_key(F.col("raw")).alias("key"), places.place_match(parts, other).alias("score"), six.alias("six"), places.flattened(six).alias("flat"))


Q30 = """
WITH d AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Onteniente' WHEN 1 THEN 'L''Alcúdia' ELSE 'Vila-Sacra' END AS town, CASE c_custkey % 3 WHEN 0 THEN 'ontinyent' WHEN 1 THEN 'l alcudia' ELSE 'vila sacra' END AS t, n_name, r_name, c_custkey % 2 = 0 AS long
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, CASE WHEN long THEN t || '|' || lower(n_name) || '|' || lower(r_name) || '|espanya' ELSE t || '|' || lower(r_name) END AS parts, t AS key, CASE WHEN t = 'ontinyent' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
  CASE WHEN long THEN ', ' || town || ', , ' || n_name || ', ' || r_name || ', España' ELSE ', ' || town || ', , , , ' || r_name END AS six,
  CASE WHEN long THEN town || ', ' || n_name || ', ' || r_name || ', España' ELSE town || ', ' || r_name END AS flat
FROM d"""


def q31_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search and record links of customers."""
    c = table(spark, sf_dir, "customer")
    year = F.when(F.col("c_custkey") % 4 != 0, (F.lit(1800) + F.col("c_nationkey")).cast("int"))
    form = links.search_url("https://index.example/search", {"surname": F.concat(F.lit("Pagès "), F.col("c_custkey").cast("string")), "sacrament": F.lit("1"), "event_from": year})
    record = links.record_link("https://records.example/search", F.col("c_name"), F.lit("Anna, Maria"), F.lit("la Font"), year)
    return c.select("c_custkey", form.alias("form"), record.alias("record"))


_FORM = "&".join(f"{f}=" + {"pagina": "1", "a1": "pages%20' || c_custkey || '", "tipus": "1", "filtre": "P", "orden": "evento", "principio_evento": "' || coalesce(y::VARCHAR, '') || '"}.get(f, "") for f in links.FIELDS)
Q31 = f"""
WITH d AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 <> 0 THEN 1800 + c_nationkey END AS y FROM customer)
SELECT c_custkey, 'https://index.example/search?{_FORM}' AS form,
  'https://records.example/search?q.surname=' || replace(c_name, '#', '%23') || '&q.givenName=Anna&q.birthLikePlace=la+Font' || CASE WHEN y IS NULL THEN '' ELSE '&q.birthLikeDate.from=' || (y - 3) || '&q.birthLikeDate.to=' || (y + 3) END AS record FROM d"""


def q32_pages_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page lists written for documents, read back as numbers, and two-digit segments."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 50
    spec = F.concat((k + 3).cast("string"), F.lit(","), k.cast("string"), F.lit("-"), (k + 4).cast("string"), F.lit(", 1"))
    return d.select("doc_id", F.array_join(F.transform(links.page_list(spec), lambda x: x.cast("string")), ",").alias("pages"), links.page_segment(F.col("doc_id") % 200).alias("segment"))


Q32 = """
SELECT doc_id, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(list_append(range(doc_id % 50, doc_id % 50 + 5), 1)) AS x)) AS pages, CASE WHEN doc_id % 200 >= 1 THEN format('{:02d}', doc_id % 200) END AS segment FROM documents"""


def q33_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports (one a nation: a line for each customer) against a fresh version: first differing line; and stale counts."""
    c = table(spark, sf_dir, "customer")
    nth = counters.numbered(c.select(F.col("c_nationkey").alias("report"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("line")), "report", "ord")
    fresh = nth.withColumn("line", F.when((F.col("report") % 3 == 0) & (F.col("n") == 5), F.lit("changed")).otherwise(F.col("line")))
    differ = quality.first_difference(nth.select("report", "n", "line"), fresh.select("report", "n", "line"))
    claims = dimension(spark, [(i, 60) for i in range(25)], "metric int, said int")
    stale = quality.stale_counts(claims, c.groupBy(F.col("c_nationkey").alias("metric")).agg(F.count("*").cast("int").alias("value")))
    return differ.join(stale.withColumnRenamed("metric", "report"), "report", "full_outer").select("report", "line", "value")


Q33 = """
WITH n AS (SELECT c_nationkey AS report, count(*) AS k FROM customer GROUP BY 1)
SELECT report, CASE WHEN report % 3 = 0 AND k >= 5 THEN 5 END AS line, CASE WHEN k <> 60 THEN k END AS value FROM n WHERE (report % 3 = 0 AND k >= 5) OR k <> 60"""

QUERIES = {f.__name__: f for f in (q23_three_way_split, q24_rolling_budget, q25_daily_quota, q26_same_attr_pairs, q27_hierarchy_pivot, q28_patch, q29_period_counts, q30_place_normalise, q31_urls, q32_pages_spec, q33_freshness)}
SQL = {"q23_three_way_split": Q23, "q24_rolling_budget": Q24, "q25_daily_quota": Q25, "q26_same_attr_pairs": Q26, "q27_hierarchy_pivot": Q27, "q28_patch": Q28, "q29_period_counts": Q29, "q30_place_normalise": Q30, "q31_urls": Q31, "q32_pages_spec": Q32, "q33_freshness": Q33}
