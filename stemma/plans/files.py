"""Queries on files that are written and read again, older pages, branches, and what reports say: q78 to q84."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fiche, labels
from ..operators import classify, graph, note_rules, proposals, quality, settings, sinks
from ..session import cut, dimension, shared_folder, spread, table
from ..sources import gedcom, linefiles, notes, payloads


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_nationkey").cast("long").alias("n"))


_C = "c AS (SELECT c_custkey::BIGINT AS k, c_nationkey::BIGINT AS n FROM customer)"

#: A note of a document row that names people by id, right or wrong, in the SQL that both engines read.
SAID = """'# Note ' || CAST(k AS STRING) || chr(10) || 'Vegeu @I' || lpad(CAST(k % 300 AS STRING), 5, '0') || '@ ' || CASE k % 5 WHEN 0 THEN CASE k % 3 WHEN 0 THEN 'Anna Rosa' WHEN 1 THEN 'Joan' ELSE 'Vicent' END || ' Ferràndiz i Mas, nat'
 WHEN 1 THEN 'Pere Tarrats, o' WHEN 2 THEN 'Bernat (àlies)' WHEN 3 THEN '**Quirze Bonastre** mort' ELSE 'del segle XIX' END || CASE WHEN k % 7 = 0 THEN '; i @I00007@ Gil Abad' ELSE '' END || chr(10) || 'fi'"""


def q78_names_beside_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in notes with the name of somebody else, or of nobody, behind them."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("k")).select(F.concat(F.lit("n"), "k").alias("path"), F.expr(SAID).alias("text"))
    people = spark.range(0, 250).select(F.format_string("I%05d", "id").alias("xref"), F.expr("split(concat(CASE id % 3 WHEN 0 THEN 'anna rosa' WHEN 1 THEN 'joan' ELSE 'vicent' END, CASE WHEN id % 2 = 0 THEN ' ferrandis' ELSE ' soler' END), ' ')").alias("tokens"))
    return note_rules.names_beside_ids(texts, people)


# In the first case the name is right, or, by its surname alone, near enough; for odd ids the given name must be theirs.
Q78 = """
WITH d AS (SELECT doc_id::BIGINT AS k, doc_id::BIGINT % 300 AS i FROM documents),
m AS (SELECT k, i, CASE k % 5 WHEN 0 THEN CASE k % 3 WHEN 0 THEN 'Anna Rosa' WHEN 1 THEN 'Joan' ELSE 'Vicent' END || ' Ferràndiz i Mas' WHEN 1 THEN 'Pere Tarrats' WHEN 2 THEN 'Bernat' WHEN 3 THEN 'Quirze Bonastre' END AS name,
  k % 5 IN (1, 3) OR (k % 5 = 0 AND i % 2 = 1 AND k % 3 <> i % 3) AS other, k % 5 <> 4 AS named FROM d)
SELECT 'n' || k AS path, 2 AS line, 'I' || lpad(CAST(i AS VARCHAR), 5, '0') AS xref, name, CASE WHEN i >= 250 THEN 'unknown_id' ELSE 'other_person' END AS rule FROM m WHERE named AND (i >= 250 OR other)
UNION ALL SELECT 'n' || k, 2, 'I00007', 'Gil Abad', 'other_person' FROM d WHERE k % 7 = 0"""


OLDER = """CASE WHEN k % 3 = 0 THEN '<small>Identificador</small><br/><b>X' || CAST(k AS STRING) || '</b>' ELSE '' END || '<TABLE class=x><tr><th>Sagrament</th><th> Identificador </th><th>Llibre</th><th>Foli</th><th>Apunt</th><th>Sexe</th></tr>' || chr(10)
 || '<tr bgcolor="#fff"><td>' || CASE WHEN k % 2 = 0 THEN 'Bateig' ELSE '<i>Matrimoni</i>' END || '</td><td>' || CAST(k AS STRING) || '</td><td>B-' || CAST(k % 9 AS STRING) || '</td><td>' || CASE WHEN k % 4 = 0 THEN ' ' ELSE CAST(k % 40 AS STRING) || 'v' END || '</td><td>' || CAST(k % 7 AS STRING)
 || '</td>' || CASE WHEN k % 5 = 0 THEN '' ELSE '<td>M</td>' END || '</tr><tr><td>Altres</td><td>dades</td></tr></TABLE>'"""


def q79_older_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of older saved pages: the row behind a row of labels, for pages that do not say who they are about otherwise."""
    pages = cut(spread(_customers(spark, sf_dir)).select(F.col("k").alias("id"), F.expr(OLDER).alias("html")))
    names = dimension(spark, [("sagrament", "sacrament"), ("identificador", "identificador"), ("llibre", "book"), ("foli", "folio"), ("apunt", "entry"), ("sexe", "sex")], "label string, key string")
    known = cut(fiche.pairs(pages, names))
    return known.unionByName(fiche.legacy(pages, known))


Q79 = f"""
WITH {_C}
SELECT k AS id, 'identificador' AS key, CASE WHEN k % 3 = 0 THEN 'X' ELSE '' END || k AS value FROM c
UNION ALL SELECT k, key, value FROM (SELECT k, unnest(['sacrament', 'book', 'folio', 'entry', 'sex']) AS key, unnest([CASE WHEN k % 2 = 0 THEN 'Bateig' ELSE 'Matrimoni' END, 'B-' || (k % 9), CASE WHEN k % 4 <> 0 THEN (k % 40) || 'v' END, CAST(k % 7 AS VARCHAR), CASE WHEN k % 5 <> 0 THEN 'M' END]) AS value FROM c WHERE k % 3 <> 0) WHERE value IS NOT NULL"""


def q80_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches above every 64th customer as people and families to be added, known people in their places; and a depth-limited walk down a catalogue."""
    c = _customers(spark, sf_dir).where("k > 0")
    pid = lambda x: F.format_string("P%07d", x)
    # Above k stand 2k, a man or of unknown sex, and 2k + 1, a woman.
    edges = c.where("k > 1").select(pid(F.shiftright("k", 1)).alias("child"), pid(F.col("k")).alias("parent"), F.expr("CASE WHEN k % 2 = 1 THEN 'F' WHEN k % 3 = 0 THEN 'M' END").alias("sex"))
    start = c.where("k % 64 = 1").select(pid(F.col("k")).alias("pid"), F.format_string("I%06d", F.col("k")).alias("xref"))
    known = c.where("k % 7 = 0 AND k % 64 <> 1").select(pid(F.col("k")).alias("pid"), F.format_string("K%06d", F.col("k")).alias("xref"))
    got = proposals.branch_imports(start, cut(edges), known, 30, 100_000, 200_000)
    people = got["people"].select(F.lit("person").alias("what"), F.col("pid").alias("id"), F.col("xref").alias("value"))
    families = got["families"].select(F.lit("family").alias("what"), F.col("family").alias("id"), F.concat_ws(",", "child", F.coalesce("husband", F.lit("-")), F.coalesce("wife", F.lit("-"))).alias("value"))
    nodes = c.where("k > 1").select(F.col("k").cast("string").alias("id"), F.floor((F.col("k") + 1) / 3).cast("string").alias("parent"))
    circle = spark.createDataFrame([("1", "2")], "id string, parent string")
    walk = graph.catalogue_walk(cut(nodes.unionByName(circle)), "1", 4).select(F.lit("node").alias("what"), "id", F.col("level").cast("string").alias("value"))
    return people.unionByName(families).unionByName(walk)


Q80 = f"""
WITH RECURSIVE {_C.replace('FROM customer', 'FROM customer WHERE c_custkey > 0')},
w(p, level) AS (SELECT k, 0 FROM c WHERE k % 64 = 1 UNION ALL SELECT c.k, level + 1 FROM w JOIN c ON c.k >> 1 = w.p AND c.k > 1 WHERE c.k % 7 <> 0 AND c.k % 64 <> 1 AND level < 30),
x AS (SELECT p, level, 'I' || (99999 + row_number() OVER (ORDER BY level, p)) AS xref FROM w WHERE level > 0),
a AS (SELECT p, xref FROM x UNION ALL SELECT k, 'I' || lpad(CAST(k AS VARCHAR), 6, '0') FROM c WHERE k % 64 = 1 UNION ALL SELECT k, 'K' || lpad(CAST(k AS VARCHAR), 6, '0') FROM c WHERE k % 7 = 0 AND k % 64 <> 1),
f AS (SELECT w.p, w.level, a.xref AS child, h.xref AS husband, m.xref AS wife FROM w JOIN a USING (p) LEFT JOIN a h ON h.p = 2 * w.p AND h.p IN (SELECT k FROM c) LEFT JOIN a m ON m.p = 2 * w.p + 1 AND m.p IN (SELECT k FROM c) WHERE h.p IS NOT NULL OR m.p IS NOT NULL),
n AS (SELECT CAST(k AS VARCHAR) AS id, CAST((k + 1) // 3 AS VARCHAR) AS parent FROM c WHERE k > 1), v(id, level) AS (SELECT '1', 0 UNION ALL SELECT n.id, level + 1 FROM v JOIN n ON n.parent = v.id WHERE level < 4)
SELECT 'person' AS what, 'P' || lpad(CAST(p AS VARCHAR), 7, '0') AS id, xref AS value FROM x
UNION ALL SELECT 'family', 'F' || (199999 + row_number() OVER (ORDER BY level, child)), child || ',' || coalesce(husband, '-') || ',' || coalesce(wife, '-') FROM f
UNION ALL SELECT 'node', id, CAST(level AS VARCHAR) FROM v WHERE level > 0"""


def q81_pedigree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pedigrees of up to 64 customers as JSON, written and read again: people, edges, couples."""
    c = _customers(spark, sf_dir).withColumn("root", F.concat(F.lit("R"), F.shiftright("k", 6)))
    p = lambda x: F.concat(F.lit("P"), x)
    none = F.lit(None).cast("string")
    people = c.select("root", F.col("k").alias("ord"), p(F.col("k")).alias("pid"), F.expr("CASE WHEN k % 3 = 0 THEN 'Àngela \"Nina\"' ELSE 'Joan' END").alias("given"), F.lit("Puig, Mas").alias("surname"), F.expr("CASE k % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END").alias("sex"), F.expr("CASE WHEN k % 2 = 0 THEN '1800' END").alias("birth_date"), none.alias("birth_place"), F.lit("").alias("death_date"), none.alias("death_place"), F.col("n").cast("string").alias("sosa"))
    up = c.where("k % 64 > 1").select("root", p(F.shiftright("k", 6) * 64 + F.shiftright(F.col("k") % 64, 1)).alias("child"), p(F.col("k")).alias("parent"), (F.col("k") % 2).cast("int").alias("role"))
    pairs = c.where("k % 16 = 3").select("root", p(F.col("k") - 1).alias("a"), p(F.col("k")).alias("b"))
    calls = c.groupBy("root").agg(F.count("*").cast("int").alias("calls"), F.array_sort(F.collect_list(F.when(F.col("k") % 40 == 0, p(F.col("k"))))).alias("skipped_leaves"))
    folder = f"{shared_folder(spark)}/pedigrees-{uuid.uuid4().hex}"
    payloads.pedigree_json(people, up, pairs, calls).select("value").write.text(folder)
    got = payloads.pedigree(spark, folder, lines=True)
    a = got["people"].select(F.lit("person").alias("what"), F.col("pid").alias("id"), F.concat_ws("|", F.col("ord").cast("string"), "given", "surname", F.coalesce("sex", F.lit("-")), F.coalesce("birth_date", F.lit("-")), F.coalesce("death_date", F.lit("-")), "sosa").alias("value"))
    b = got["edges"].select(F.lit("edge").alias("what"), F.col("child").alias("id"), F.concat_ws("|", "parent", F.col("role").cast("string")).alias("value"))
    return a.unionByName(b).unionByName(got["couples"].select(F.lit("couple").alias("what"), F.col("a").alias("id"), F.col("b").alias("value")))


Q81 = f"""
WITH {_C}
SELECT 'person' AS what, 'P' || k AS id, concat_ws('|', CAST(row_number() OVER (PARTITION BY k >> 6 ORDER BY k) - 1 AS VARCHAR), CASE WHEN k % 3 = 0 THEN 'Àngela "Nina"' ELSE 'Joan' END, 'Puig, Mas', CASE k % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE '-' END, CASE WHEN k % 2 = 0 THEN '1800' ELSE '-' END, '', CAST(n AS VARCHAR)) AS value FROM c
UNION ALL SELECT 'edge', 'P' || ((k >> 6) * 64 + ((k % 64) >> 1)), 'P' || k || '|' || (k % 2) FROM c WHERE k % 64 > 1
UNION ALL SELECT 'couple', 'P' || (k - 1), 'P' || k FROM c WHERE k % 16 = 3"""


#: A line of a review file, and the entry it belongs to, by key.
REVIEW = """CASE WHEN k % 32 = 0 THEN '# Review' || chr(10) || '# made by hand' || chr(10) || chr(10) || '# ---- first' || chr(10) ELSE '' END || CASE WHEN k % 4 = 1 THEN chr(10) || '# about ' || CAST(k AS STRING) || chr(10) ELSE '' END
 || '- target: "I' || CAST(k AS STRING) || '"' || chr(10) || '  kind: parents' || CASE WHEN k % 5 = 0 THEN chr(10) || '  documents:' || chr(10) || '    - a.pdf' || chr(10) || '    - "b: c.pdf"' ELSE '' END || chr(10)
 || CASE k % 4 WHEN 0 THEN '  accept: true' WHEN 1 THEN '  accept: false' WHEN 2 THEN '  accept:' ELSE '  why: none' END || CASE WHEN k % 1024 = 700 THEN chr(10) || '  accept: perhaps' ELSE '' END"""


def q82_review_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review files of 32 entries, written, read whole and split: verdicts, data, remarks kept, nothing lost; files with a bad verdict are named."""
    c = _customers(spark, sf_dir)
    lines = c.select(F.concat(F.lit("r"), F.shiftright("k", 5), F.lit(".yaml")).alias("path"), F.col("k"), F.posexplode(F.split(F.expr(REVIEW), "\n")).alias("at", "raw")).select("path", (F.col("k") * 64 + F.col("at")).alias("idx"), "raw")
    meta = spark.createDataFrame([], "path string, has_bom boolean, newline string, trailing_newline boolean")
    root = linefiles.stage(cut(lines), meta, shared_folder(spark))
    texts = cut(linefiles.whole(spark, root, every=True))
    whole = notes.split_without_loss(texts).select("path", F.lit(-1).cast("long").alias("ord"), F.concat_ws("|", F.col("same").cast("string"), F.col("entries").cast("string")).alias("value"))
    e = notes.reviews(texts)
    data = lambda key: F.get_json_object("data", key)
    said = F.concat_ws("|", data("$.target"), F.coalesce(F.col("accept").cast("string"), F.lit("open")), F.coalesce(data("$.documents[1]"), F.lit("-")), F.contains("entry", F.lit("# about")).cast("string"))
    return whole.unionByName(e.select("path", F.coalesce("ord", F.lit(0)).alias("ord"), F.when(F.col("error").isNotNull(), "refused").otherwise(said).alias("value")))


Q82 = f"""
WITH {_C}, r AS (SELECT k, 'r' || (k >> 5) || '.yaml' AS path FROM c), b AS (SELECT DISTINCT path FROM r WHERE k % 1024 = 700)
SELECT path, -1::BIGINT AS ord, 'true|' || count(*) AS value FROM r GROUP BY path UNION ALL SELECT path, 0, 'refused' FROM b
UNION ALL SELECT path, row_number() OVER (PARTITION BY path ORDER BY k) - 1, concat_ws('|', 'I' || k, CASE k % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'open' END, CASE WHEN k % 5 = 0 THEN 'b: c.pdf' ELSE '-' END, CASE WHEN k % 4 = 1 THEN 'true' ELSE 'false' END) FROM r WHERE path NOT IN (SELECT path FROM b)"""


def q83_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of notes, documents and images of all customers, written and listed: notes, names as documents, assets against their manifest."""
    c = _customers(spark, sf_dir)
    name = F.expr("CASE k % 5 WHEN 0 THEN 'n' || CAST(k AS STRING) || '.md' WHEN 1 THEN 'Bateig de Joan Puig ' || CAST(k AS STRING) || '.JPG' WHEN 2 THEN 'x' || CAST(k AS STRING) || '_lectura.jpg' WHEN 3 THEN '.h' || CAST(k AS STRING) || '.pdf' ELSE 'Expedient ' || CAST(k AS STRING) || '.txt' END")
    # A folder for every 1,024 customers: no listing grows with their number.
    lines = cut(c.select(F.concat_ws("/", F.shiftright("k", 10).cast("string"), name).alias("path"), "k").select("path", F.lit(0).cast("long").alias("idx"), F.concat(F.lit("contingut "), "k").alias("raw")))
    meta = spark.createDataFrame([], "path string, has_bom boolean, newline string, trailing_newline boolean")
    folder = f"{shared_folder(spark)}/folder-{uuid.uuid4().hex}"
    sinks.write_lines(lines, meta, folder, parts=2)
    found = cut(notes.files(spark, folder))
    plain = lambda df, column: df.withColumn(column, F.element_at(F.split(column, "/"), -1))
    listed = plain(notes.notes(spark, folder, found), "path").select(F.lit("note").alias("what"), "path", F.trim(F.col("text"), F.lit("\n")).alias("value"))
    documents = plain(notes.document_tokens(found), "document").select(F.lit("document").alias("what"), F.col("document").alias("path"), F.array_join("tokens", " ").alias("value"))
    there = cut(plain(notes.assets(spark, folder, found=found), "path"))
    manifest = cut(notes.manifest(sinks.manifest_lines(there.where("path NOT LIKE '%7%'").withColumn("size", F.when(F.col("path").like("%9%"), 1).otherwise(F.col("size"))))))
    states = quality.manifest_diff(manifest.where("path NOT LIKE '% %'"), there.where("path NOT LIKE '% %'")).groupBy("state").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select(F.lit("manifest").alias("what"), F.col("state").alias("path"), F.concat_ws("|", F.col("n").cast("string"), F.col("bytes").cast("string")).alias("value"))
    digests = there.select(F.lit("asset").alias("what"), "path", F.concat_ws("|", "digest", F.col("size").cast("string")).alias("value"))
    return listed.unionByName(documents).unionByName(digests).unionByName(states)


# Names with a blank are left out of the manifest's comparison; Spark shows them percent-encoded in some listings and plain in others.
Q83 = f"""
WITH {_C}, f AS (SELECT k, 'contingut ' || k || chr(10) AS t, CASE k % 5 WHEN 0 THEN 'n' || k || '.md' WHEN 1 THEN 'Bateig de Joan Puig ' || k || '.JPG' WHEN 2 THEN 'x' || k || '_lectura.jpg' WHEN 3 THEN '.h' || k || '.pdf' ELSE 'Expedient ' || k || '.txt' END AS name FROM c),
a AS (SELECT *, sha256(t) AS d, length(t) AS size FROM f WHERE k % 5 IN (1, 2)), m AS (SELECT *, CASE WHEN name LIKE '%9%' THEN 1 ELSE size END AS said FROM a WHERE k % 5 = 2)
SELECT 'note' AS what, name AS path, trim(t, chr(10)) AS value FROM f WHERE k % 5 = 0
UNION ALL SELECT 'document', name, CASE WHEN k % 5 = 0 THEN 'n' || k WHEN k % 5 = 1 THEN concat_ws(' ', 'joan', 'puig', CASE WHEN k > 99 THEN CAST(k AS VARCHAR) END) ELSE CAST(k AS VARCHAR) END FROM f WHERE (k % 5 = 0 AND k > 9) OR k % 5 = 1 OR (k % 5 = 4 AND k > 99)
UNION ALL SELECT 'asset', name, d || '|' || size FROM a
UNION ALL SELECT 'manifest', s, count(*) || '|' || sum(size)::BIGINT FROM (SELECT CASE WHEN name LIKE '%7%' THEN 'new' WHEN said <> size THEN 'changed' ELSE 'same' END AS s, CASE WHEN name LIKE '%7%' THEN size ELSE said END AS size FROM m) GROUP BY s"""


def q84_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reports call people, lookups and accounts; spouses in the order in which families name them; who edited what, parents' surnames, people of snapshots, regions by settings, ends of books."""
    c = spread(_customers(spark, sf_dir))
    x = lambda e: F.expr(e)
    shown = labels.person(x("CASE WHEN k % 6 = 0 THEN 'Anna' ELSE 'Joan' END"), F.lit("Puig"), x("CASE WHEN k % 4 <> 0 THEN 1700 + k % 90 END"), x("CASE k % 3 WHEN 0 THEN concat(k, ' G3') WHEN 1 THEN '' END"), x("concat('I', k)"))
    ask = labels.lookup(x("concat('I', k)"), F.lit("bateig"), x("CASE WHEN k % 5 <> 0 THEN 1700 END"), x("CASE WHEN k % 7 <> 0 THEN 'Agres' END"), x("k % 2 = 0"), F.lit("note"), x("concat('u', k)"))
    spent = labels.account(F.col("k"), F.col("n"), F.col("k") / 8, F.lit(2))
    quota = labels.quota(F.col("k") % 40, F.lit(40), F.lit("2024-05-01"), x("CASE WHEN k % 2 = 0 THEN k % 60 END"), x("k % 3 = 0"))
    edited = settings.edited_by(x("CASE WHEN k % 9 <> 0 THEN map(concat('u', k % 4), 1) END"), "u2")
    # Only keys are joined and sorted; texts are made of what the joins give.
    base = ("k", shown.alias("person"), F.replace(ask, F.lit("\n    "), F.lit(" / ")).alias("lookup"), spent.alias("account"), quota.alias("quota"), edited.alias("mine"), settings.source_label(F.col("n"), F.lit("a.ged")).alias("source"))
    # A person's families name their spouses out of order, and one of them twice.
    people = c.select(x("concat('I', k)").alias("xref"), x("array(concat('F', k, 'c'), concat('F', k, 'a'), concat('F', k, 'b'))").alias("fams"))
    families = c.select(F.explode(x("array(named_struct('x', concat('F', k, 'a'), 'w', concat('W', k + 1)), named_struct('x', concat('F', k, 'b'), 'w', concat('W', k)), named_struct('x', concat('F', k, 'c'), 'w', concat('W', k)))")).alias("f"), x("concat('I', k)").alias("husband")).select(F.col("f.x").alias("xref"), "husband", F.col("f.w").alias("wife"))
    order = gedcom.spouses_in_order(people, families).groupBy("xref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "spouse"))), lambda s: s["spouse"]), ",").alias("spouses"))
    kin = settings.surnames(c.where("k > 0").select(F.shiftright("k", 1).alias("person"), x("CASE WHEN k % 4 = 0 THEN '' ELSE concat('s', k % 3) END").alias("surname_norm"))).select(F.col("person").alias("k"), F.array_join("kin", ",").alias("kin"))
    snap = settings.snapshot_person(c.where("k % 8 = 0").select(F.col("k").alias("xref"), x("array(named_struct('pid', concat('A', k), 'given', 'Joan', 'surname', 'Mas', 'sex', 'M', 'birth_date', '1700', 'birth_place', 'Ibi'))").alias("parents"))).select(F.col("child").alias("k"), F.concat_ws("|", "pid", "given", F.coalesce("death_date", F.lit("-"))).alias("snapshot"))
    config = {"regions": {"north": ["Onteniente"], "south": ["Ibi"]}, "fallbacks": {"ALACANT": "south"}, "guides": {"north": {"score": 3, "note": "go"}}}
    placed = classify.region(c.select("k", x("CASE k % 4 WHEN 0 THEN 'ontinyent' WHEN 1 THEN 'ibi' ELSE 'x' END").alias("town"), x("CASE WHEN k % 3 = 0 THEN 'Prop d’Alacant' ELSE 'lluny' END").alias("place")), settings.towns(spark, config), settings.fallbacks(spark, config))
    hinted = placed.join(F.broadcast(settings.guides(spark, config).select("region", "score")), "region", "left").select("k", F.concat_ws("|", "region", F.coalesce(F.col("score").cast("int").cast("string"), F.lit("-"))).alias("region"))
    ends = graph.last_page(c.select(F.col("n").alias("book"), (F.col("k") % 50).alias("page"))).select(F.col("book").alias("n"), F.col("last").alias("end"))
    out = c.join(order.withColumn("k", F.substring("xref", 2, 20).cast("long")).select("k", "spouses"), "k").join(kin, "k", "left").join(snap, "k", "left").join(hinted, "k").join(ends, "n", "left")
    return out.select(*base, "spouses", "kin", "snapshot", "region", "end")


Q84 = f"""
WITH {_C}, s AS (SELECT person, string_agg(DISTINCT x, ',' ORDER BY x) AS kin FROM (SELECT k >> 1 AS person, CASE WHEN k % 4 <> 0 THEN 's' || (k % 3) END AS x FROM c WHERE k > 0) GROUP BY 1), e AS (SELECT n, max(k % 50) AS last FROM c GROUP BY n)
SELECT k, CASE WHEN k % 6 = 0 THEN 'Anna' ELSE 'Joan' END || ' Puig (' || CASE WHEN k % 4 <> 0 THEN CAST(1700 + k % 90 AS VARCHAR) ELSE '?' END || CASE WHEN k % 3 = 0 THEN ', Sosa ' || k ELSE '' END || ') @I' || k || '@' AS person,
  CASE WHEN k % 2 = 0 THEN '' ELSE '~~' END || '**I' || k || '**: bateig ' || CASE WHEN k % 5 <> 0 THEN '1700' ELSE '?' END || ', ' || CASE WHEN k % 7 <> 0 THEN 'Agres' ELSE '?' END || CASE WHEN k % 2 = 0 THEN '' ELSE '~~' END || ' / note / <u' || k || '>' AS lookup,
  printf('%d requests, %d held already, %.1f s server time, 2 naps', k, n, round(k / 8 + 1e-9, 1)) AS account, (k % 40) || '/40 lookups (2024-05-01' || CASE WHEN k % 2 = 0 THEN ', server said ' || (k % 60) ELSE '' END || '), ' || CASE WHEN k % 3 = 0 THEN 'the archive''s limit' ELSE 'our own pace' END AS quota,
  k % 9 <> 0 AND k % 4 = 2 AS mine, 'a.ged (' || n || CASE WHEN n = 1 THEN ' person)' ELSE ' people)' END AS source, 'W' || k || ',W' || (k + 1) AS spouses, CASE WHEN person IS NOT NULL THEN coalesce(kin, '') END AS kin, CASE WHEN k % 8 = 0 THEN 'A' || k || '|Joan|-' END AS snapshot,
  CASE WHEN k % 4 = 0 THEN 'north|3' WHEN k % 4 = 1 THEN 'south|-' WHEN k % 3 = 0 THEN 'south|-' ELSE 'unknown|0' END AS region, last AS "end"
FROM c LEFT JOIN s ON s.person = k LEFT JOIN e USING (n)"""

QUERIES = {f.__name__: f for f in (q78_names_beside_ids, q79_older_pages, q80_branches, q81_pedigree_files, q82_review_files, q83_folder, q84_said)}
SQL = {"q78_names_beside_ids": Q78, "q79_older_pages": Q79, "q80_branches": Q80, "q81_pedigree_files": Q81, "q82_review_files": Q82, "q83_folder": Q83, "q84_said": Q84}
