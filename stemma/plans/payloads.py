"""Queries on saved pages, payloads, notes and file lists made of driver rows: q54 to q69."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, fiche, links, names, text
from ..operators import classify, counters, edit, link, note_rules, proposals, quality, render, reports, settings
from ..session import cut, dimension, spread, table
from ..sources import notes, payloads


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_nationkey").cast("long").alias("n"), F.col("c_name").alias("name"))


_C = "c AS (SELECT c_custkey::BIGINT AS k, c_nationkey::BIGINT AS n, c_name AS name FROM customer)"
#: A saved index page of a customer, in the SQL that both engines read.
PAGE = """'<html><small class="l">Nom:</small><br/><b>Anna &amp; Rosa ' || CAST(k AS STRING) || '</b>'
 || CASE WHEN k % 3 = 0 THEN '<b>Data:</b> ' || CAST(1700 + k % 90 AS STRING) || ' ' ELSE '<b>Data</b> ... ' END || '<table><tr><th>Nom</th><th>Lloc</th><th>Data</th></tr>'
 || '<tr><td>Lloc</td><td> Agres  ' || CAST(k % 7 AS STRING) || '</td><td>Data</td><td>9999</td></tr>'
 || '<tr><td>Pare</td><td>Joan</td><td>Puig</td><td>Mas</td><td>Agres</td></tr><tr><td>Abuela materna</td><td>Rosa ' || CAST(k % 5 AS STRING) || '</td><td>Soler</td></tr><tr><td>Altres</td></tr>'
 || CASE WHEN k % 2 = 0 THEN '<tr><td>B-' || CAST(k % 9 AS STRING) || ' (1700_1750) Folio ' || CAST(k % 40 AS STRING) || 'v</td><td>Registro num. ' || CAST(k AS STRING) || '</td></tr>' ELSE '' END
 || '</table><p>Ya ha realizado ' || CAST(k % 30 AS STRING) || ' consultas de un m&aacute;ximo; <i>máximo de 40</i></p> ark:/61903/3:1:AB-' || CAST(k % 4 AS STRING) || ' DGS 00' || CAST(k % 3 AS STRING) || ' ark:/61903/3:1:AB-' || CAST(k % 4 AS STRING) || '</html>'"""


def q54_fiche(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, kin, hit references, quota and image references of saved pages."""
    pages = cut(spread(_customers(spark, sf_dir)).select(F.col("k").alias("id"), F.expr(PAGE).alias("html")))
    rows = cut(fiche.table_rows(pages))
    labels = dimension(spark, [("nom", "name"), ("data", "date"), ("lloc", "place")], "label string, key string")
    fields = fiche.pairs(pages, labels, rows=rows).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "key", "value"))), "|").alias("fields"))
    kin = fiche.kin(pages, rows=rows).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws("/", "role", "given", "surname1", "surname2", "birthplace").alias("x")))), lambda x: x["x"]), "|").alias("kin"))
    hits = fiche.results(pages, rows=rows).select("id", F.concat_ws("/", "book", "from", "to", "folio", "registro").alias("hit"))
    base = pages.select("id", fiche.quota(F.col("html")).alias("q"), F.array_join(fiche.references(F.col("html")), ",").alias("refs"))
    return base.join(fields, "id", "left").join(kin, "id", "left").join(hits, "id", "left").select("id", F.col("q.used").cast("long").alias("used"), F.col("q.limit").cast("long").alias("most"), "refs", "fields", "kin", "hit")


Q54 = f"""
WITH {_C}
SELECT k AS id, k % 30 AS used, 40::BIGINT AS most, 'DGS 00' || (k % 3) || ',ark:/61903/3:1:AB-' || (k % 4) AS refs,
  'date=' || CASE WHEN k % 3 = 0 THEN CAST(1700 + k % 90 AS STRING) ELSE '9999' END || '|name=Anna & Rosa ' || k || '|place=Agres ' || (k % 7) AS fields,
  'Pare/Joan/Puig/Mas/Agres|Àvia Materna/Rosa ' || (k % 5) || '/Soler//' AS kin, CASE WHEN k % 2 = 0 THEN 'B-' || (k % 9) || '/1700/1750/' || (k % 40) || 'v/' || k END AS hit FROM c"""


PERSON = """'{"id":"P' || CAST(k AS STRING) || '","display":{"name":"' || CASE k % 3 WHEN 0 THEN 'Joan Puig Mas' WHEN 1 THEN 'Rosa Soler' ELSE 'Pere' END || '"' || CASE WHEN k % 4 = 0 THEN ',"gender":"Male"' WHEN k % 4 = 1 THEN ',"gender":"Female"' ELSE '' END
 || CASE WHEN k % 5 = 0 THEN ',"birthDate":"about 1700"' ELSE '' END || ',"deathPlace":"Alacant","ascendancyNumber":"' || CAST(k AS STRING) || '"},'
 || CASE WHEN k % 2 = 0 THEN '"names":[{"nameForms":[{"parts":[{"type":"http://x/Given","value":"Anna"},{"type":"http://x/Surname","value":"Mas ' || CAST(k % 9 AS STRING) || '"}]}]}],' ELSE '' END
 || '"facts":[{"type":"http://x/Christening","date":{"formal":"+1801"},"place":{"original":"","normalized":[{"value":"Agres"}]}}' || CASE WHEN k % 7 = 0 THEN ',{"type":"http://x/Birth","date":{"original":"May 1800"},"place":{"original":"Ibi"}},{"type":"http://x/Birth","date":{"original":"1999"}}' ELSE '' END || ']}'"""
NODES = """'[{"id":"a' || CAST(k AS STRING) || '","titol":"Llibre Àlbum ' || CAST(k % 6 AS STRING) || '","udocs":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',"path":[["r","Arrel"],["s","Sèrie"]]},{"id":"b' || CAST(k AS STRING) || '"}]'"""
BOOK = """'{"udoc":{"_idudocsimple":"' || CASE WHEN k % 3 = 0 THEN '' ELSE 'u' || CAST(k AS STRING) END || '","id":"i' || CAST(k AS STRING) || '","titol":"Baptismes","any_inici":"' || CASE WHEN k % 4 = 0 THEN 's/d' ELSE CAST(1600 + k % 100 AS STRING) END || '","any_fi":"' || CASE WHEN k % 5 = 0 THEN '' ELSE CAST(1650 + k % 100 AS STRING) END
 || '","condicions_acces":"' || CASE k % 6 WHEN 0 THEN 'No consultable' WHEN 1 THEN 'Accés parcial' WHEN 2 THEN 'Només a la sala' WHEN 3 THEN 'Lliure accés' WHEN 4 THEN 'Accés restringit' ELSE '' END || '","bucket":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || '}}'"""


def q55_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person records from JSON: first fact of a type, names from parts or the display name."""
    raw = _customers(spark, sf_dir).select(F.from_json(F.expr(PERSON), payloads.GEDCOMX).alias("p")).select("p.*")
    return payloads.persons(raw)


Q55 = f"""
WITH {_C}
SELECT 'P' || k AS pid, CASE WHEN k % 2 = 0 THEN 'Anna' ELSE CASE k % 3 WHEN 0 THEN 'Joan' WHEN 1 THEN 'Rosa' ELSE 'Pere' END END AS given,
  CASE WHEN k % 2 = 0 THEN 'Mas ' || (k % 9) ELSE CASE k % 3 WHEN 0 THEN 'Puig Mas' WHEN 1 THEN 'Soler' ELSE '' END END AS surname, CASE k % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS sex,
  CASE WHEN k % 7 = 0 THEN 'May 1800' WHEN k % 5 = 0 THEN 'about 1700' ELSE '1801' END AS birth_date, CASE WHEN k % 7 = 0 THEN 'Ibi' ELSE 'Agres' END AS birth_place,
  NULL::STRING AS death_date, 'Alacant' AS death_place, CAST(k AS STRING) AS sosa FROM c"""


def q56_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and books of catalogue answers: search in titles, access, why a book can't be read, years that it covers, its line in a list."""
    c = _customers(spark, sf_dir)
    nodes = payloads.catalogue_nodes(c.select(F.expr(NODES).alias("value")))
    found = classify.find(nodes, "title", "album 3").select("id", F.lit("found").alias("what"), F.concat_ws("/", F.col("has_documents").cast("string"), F.size("path").cast("string")).alias("value"))
    books = payloads.catalogue_books(c.select(F.expr(BOOK).alias("value")))
    kind = classify.access_kind(F.col("access"))
    b = books.withColumn("kind", kind)
    why = classify.why_not(F.col("digitised"), F.col("kind"))
    value = F.concat_ws("/", "scans", "kind", classify.readable_from_home(F.col("digitised"), F.col("kind")).cast("string"), classify.covers_year(F.col("year_from"), F.col("year_to"), F.lit(1660)).cast("string"), classify.book_line(F.col("title"), F.col("year_from"), F.col("year_to"), F.col("id"), F.col("code"), why))
    return found.unionByName(b.select("id", F.lit("book").alias("what"), value.alias("value")))


Q56 = f"""
WITH {_C}, b AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'i' || k ELSE 'u' || k END AS id, CASE WHEN k % 3 = 0 THEN '' ELSE 'u' || k END AS scans, CASE WHEN k % 4 = 0 THEN NULL ELSE 1600 + k % 100 END AS a, CASE WHEN k % 5 = 0 THEN NULL ELSE 1650 + k % 100 END AS z,
  CASE k % 6 WHEN 0 THEN 'closed' WHEN 4 THEN 'closed' WHEN 1 THEN 'partial' WHEN 2 THEN 'onsite' WHEN 3 THEN 'open' ELSE 'unknown' END AS kind, k % 2 = 0 AS dig FROM c)
SELECT 'a' || k AS id, 'found' AS what, CASE WHEN k % 2 = 0 THEN 'true/2' ELSE 'false/2' END AS value FROM c WHERE k % 6 = 3
UNION ALL SELECT id, 'book', concat_ws('/', scans, kind, CAST(dig AND kind IN ('open', 'partial', 'unknown') AS STRING), CAST((a IS NOT NULL OR z IS NOT NULL) AND coalesce(a, 1660) <= 1660 AND coalesce(z, 1660) >= 1660 AS STRING),
  m || '**Baptismes** (' || coalesce(a || '-' || z, CAST(a AS STRING), CAST(z AS STRING), '?') || ')' || m || ' id ' || id || ' | no code | ' || coalesce(why, 'online')) FROM
  (SELECT *, CASE WHEN why IS NULL THEN '' ELSE '~~' END AS m FROM (SELECT *, CASE WHEN dig AND kind IN ('open', 'partial', 'unknown') THEN NULL WHEN NOT dig AND kind = 'onsite' THEN 'no images, to be read on site' WHEN NOT dig THEN 'no images'
    WHEN kind = 'closed' THEN 'digitised but closed' ELSE 'digitised, on site only' END AS why FROM b))"""


def q57_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical records of search answers: the principal person and up to six others."""
    c = _customers(spark, sf_dir)
    answer = F.expr("""'{"entries":[{"title":"R","id":"https://familysearch.org/ark:/1/' || CAST(k AS STRING) || '","content":{"gedcomx":{"persons":[{"principal":false,"display":{"name":"First ' || CAST(k % 3 AS STRING) || '"}},{"principal":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',"display":{"name":"Main","birthDate":"1700","birthPlace":"Agres"}},{"display":{"name":""}},{"display":{"name":"Last"}}]}}},{"title":"none","content":{"gedcomx":{"persons":[]}}}]}'""")
    found = proposals.record_candidates(c.select(F.col("k").alias("id"), answer.alias("value")))
    return found.select("id", "record", "name", "birth", "place", F.array_join("others", "|").alias("others"), "url")


Q57 = f"""
WITH {_C}
SELECT k AS id, 'R' AS record, CASE WHEN k % 2 = 0 THEN 'Main' ELSE 'First ' || (k % 3) END AS name, CASE WHEN k % 2 = 0 THEN '1700' END AS birth, CASE WHEN k % 2 = 0 THEN 'Agres' END AS place,
  CASE WHEN k % 2 = 0 THEN 'First ' || (k % 3) || '|Last' ELSE 'Main|Last' END AS others, 'https://www.familysearch.org/ark:/1/' || k AS url FROM c"""


def q58_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot files of up to 64 people of a nation, some of them broken: people with status, what stands above, and their parents."""
    each = F.concat(F.lit('"I'), "k", F.lit('":{"fsftid":"FS'), "k", F.lit('","estat":"'), F.when(F.col("k") % 2 == 0, "ready").otherwise("stuck"), F.lit('","amunt":'), F.col("k") % 9, F.lit(',"pares":[{"pid":"A'), "k", F.lit('","given":"Joan"}]}'))
    files = _customers(spark, sf_dir).groupBy("n", F.shiftright("k", 6)).agg(F.array_join(F.array_sort(F.collect_list(each)), ",").alias("x")).select(F.concat(F.lit('{"data":"2024-01-01","arrel":"I1","persones":{'), "x", F.when(F.col("n") % 5 == 4, "").otherwise("}}")).alias("value"))
    found = payloads.snapshot(files)
    return found.select("xref", "fsftid", "status", F.col("upstream").cast("long").alias("upstream"), F.col("oldest").cast("long").alias("oldest"), F.get("parents", F.lit(0))["pid"].alias("parent"))


Q58 = f"""
WITH {_C}
SELECT 'I' || k AS xref, 'FS' || k AS fsftid, CASE WHEN k % 2 = 0 THEN 'ready' ELSE 'stuck' END AS status, k % 9 AS upstream, NULL::BIGINT AS oldest, 'A' || k AS parent FROM c WHERE n % 5 <> 4"""


#: A note of a document row, in the SQL that both engines read.
NOTE = """CASE WHEN k % 11 = 0 THEN 'no heading, [[Other]]' WHEN k % 11 = 1 THEN '---' || chr(10) || 'tipus: cas' || chr(10) || 'never closed' ELSE
 '---' || chr(10) || 'tipus: ' || CASE WHEN k % 4 = 0 THEN 'transcripcio' WHEN k % 4 = 1 THEN 'cas' WHEN k % 4 = 2 THEN 'oddity' ELSE 'recerca' END || chr(10) || CASE WHEN k % 3 = 0 THEN 'titol: "Title ' || CAST(k % 20 AS STRING) || '"' || chr(10) ELSE '' END
 || CASE WHEN k % 8 = 0 THEN 'classe: original' || chr(10) ELSE '' END || CASE WHEN k % 6 = 0 THEN 'confianca: alta' || chr(10) WHEN k % 6 = 1 THEN 'confianca: gran' || chr(10) ELSE '' END
 || 'xrefs:' || chr(10) || '  - "@I' || lpad(CAST(k % 300 AS STRING), 5, '0') || '@"' || chr(10) || CASE WHEN k % 10 = 0 THEN '  - "@X1@"' || chr(10) ELSE '' END || CASE WHEN k % 7 = 0 THEN 'cr_id: 5' || chr(10) ELSE '' END
 || 'meta:' || chr(10) || '  lang: ca' || chr(10) || '  parts:' || chr(10) || '    - un' || chr(10) || '    - ' || CAST(k % 3 AS STRING) || chr(10)
 || '---' || chr(10) || '# Head ' || CAST(k % 5 AS STRING) || chr(10) || 'See [[n' || CAST(k + 1 AS STRING) || '|next]] and ![[n' || CAST((k >> 1) AS STRING) || '#Head ' || CAST(k % 4 AS STRING) || ']]' || chr(10) || 'Fonts/a b' || CAST(k % 6 AS STRING) || '.jpg and Fonts/c.pdf' || chr(10) || '| Notes | 1.2' || CAST(k % 10 AS STRING) || '0 |' END"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("k"))
    folder = F.when(F.col("k") % 9 == 0, "00 Old").when(F.col("k") % 2 == 0, "Fonts").otherwise("Persones")
    return d.select("k", F.concat(folder, F.lit("/n"), "k", F.lit(".md")).alias("path"), F.expr(NOTE).alias("text"))


_N = f"d AS (SELECT doc_id::BIGINT AS k FROM documents), n AS (SELECT k, CASE WHEN k % 9 = 0 THEN '00 Old' WHEN k % 2 = 0 THEN 'Fonts' ELSE 'Persones' END AS folder, k % 11 > 1 AS fine FROM d), p AS (SELECT *, folder || '/n' || k || '.md' AS path FROM n)"


def q59_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading blocks of notes, nested ones too: known fields, keys, what is wrong, declared people, links."""
    n = _notes(spark, sf_dir)
    h = cut(notes.headings(n))
    who = notes.declared(h).groupBy(F.col("document").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("person")), ",").alias("people"))
    to = notes.wikilinks(n).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("links"))
    into = notes.section_embeds(n).select("path", F.concat_ws("#", "target", "section").alias("embed"))
    nested = n.select("path", notes.heading("text").alias("h")).select("path", F.get_json_object("h.data", "$.meta.lang").alias("lang"), F.get_json_object("h.data", "$.meta.parts[1]").alias("second"))
    out = h.select("path", F.col("error").isNotNull().alias("bad"), "present", "tipus", "titol", "classe", "confianca", F.array_join("keys", ",").alias("keys"))
    return out.join(who, "path", "left").join(to, "path", "left").join(into, "path", "left").join(nested, "path", "left")


Q59 = f"""
WITH {_N}
SELECT path, k % 11 = 1 AS bad, fine AS present, CASE WHEN fine THEN CASE k % 4 WHEN 0 THEN 'transcripcio' WHEN 1 THEN 'cas' WHEN 2 THEN 'oddity' ELSE 'recerca' END END AS tipus,
  CASE WHEN fine AND k % 3 = 0 THEN 'Title ' || (k % 20) END AS titol, CASE WHEN fine AND k % 8 = 0 THEN 'original' END AS classe, CASE WHEN fine AND k % 6 = 0 THEN 'alta' WHEN fine AND k % 6 = 1 THEN 'gran' END AS confianca,
  CASE WHEN fine THEN concat_ws(',', 'tipus', CASE WHEN k % 3 = 0 THEN 'titol' END, CASE WHEN k % 8 = 0 THEN 'classe' END, CASE WHEN k % 6 IN (0, 1) THEN 'confianca' END, 'xrefs', CASE WHEN k % 7 = 0 THEN 'cr_id' END, 'meta') END AS keys,
  CASE WHEN fine THEN 'I' || lpad(CAST(k % 300 AS STRING), 5, '0') || CASE WHEN k % 10 = 0 THEN ',X1' ELSE '' END END AS people,
  CASE WHEN fine THEN CASE WHEN 'n' || (k + 1) < 'n' || (k >> 1) THEN 'n' || (k + 1) || ',n' || (k >> 1) ELSE 'n' || (k >> 1) || ',n' || (k + 1) END WHEN k % 11 = 0 THEN 'Other' END AS links,
  CASE WHEN fine THEN 'n' || (k >> 1) || '#Head ' || (k % 4) END AS embed, CASE WHEN fine THEN 'ca' END AS lang, CASE WHEN fine THEN CAST(k % 3 AS STRING) END AS second FROM p"""


def q60_note_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for notes, each with the number of those that break it: headings, links, embeds, keys, binaries."""
    n = cut(_notes(spark, sf_dir))
    people = spark.range(0, 250).select(F.format_string("I%05d", "id").alias("xref"))
    nothing = n.select("path", F.col("path").alias("name")).where("false")
    found = note_rules.heading_violations(cut(notes.headings(n)), people, (), nothing)
    found = found.unionByName(note_rules.link_violations(notes.wikilinks(n), n)).unionByName(note_rules.embed_violations(notes.section_embeds(n), n))
    found = found.unionByName(quality.forbidden_keys(n.select(F.col("path").alias("id"), "text"), "cr_id").withColumn("rule", F.lit("tracked_key")).select("rule", "id"))
    files = n.select(F.col("path").alias("id"), F.when(F.col("k") % 5 == 0, F.concat(F.lit("x"), "k", F.lit(".JPG"))).otherwise(F.lit("x.md")).alias("name"))
    found = found.unionByName(quality.public_binaries(files, ("jpg",), private=False).withColumn("rule", F.lit("binary")).select("rule", "id"))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


Q60 = f"""
WITH {_N}, t AS (SELECT k, k % 20 AS v FROM p WHERE fine AND k % 3 = 0), e AS (SELECT k, k + 1 AS a, k >> 1 AS b, k % 4 AS s FROM p WHERE fine), x AS (SELECT k FROM p), v(rule, n) AS (
  SELECT 'unreadable', count(*) FROM p WHERE k % 11 = 1 UNION ALL SELECT 'forbidden_key', count(*) FROM p WHERE fine AND k % 7 = 0 UNION ALL SELECT 'kind', count(*) FROM p WHERE fine AND k % 4 = 2
  UNION ALL SELECT 'class', count(*) FROM p WHERE fine AND k % 4 = 0 AND k % 8 <> 0 UNION ALL SELECT 'trust', count(*) FROM p WHERE fine AND k % 6 = 1
  UNION ALL SELECT 'title_missing', count(*) FROM p WHERE fine AND k % 4 = 0 AND k % 3 <> 0 UNION ALL SELECT 'title_repeated', count(*) - count(DISTINCT v) FROM t
  UNION ALL SELECT 'id_form', count(*) FROM p WHERE fine AND k % 10 = 0 UNION ALL SELECT 'id_unknown', count(*) FROM p WHERE fine AND k % 300 >= 250
  UNION ALL SELECT 'link', (SELECT count(*) FROM e WHERE a NOT IN (SELECT k FROM x)) + (SELECT count(*) FROM e WHERE b NOT IN (SELECT k FROM x)) + (SELECT count(*) FROM p WHERE k % 11 = 0)
  UNION ALL SELECT 'embed', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.k = b AND q.fine AND q.k % 5 = s)
  UNION ALL SELECT 'tracked_key', count(*) FROM p WHERE fine AND k % 7 = 0 UNION ALL SELECT 'binary', count(*) FROM p WHERE k % 5 = 0)
SELECT rule, n FROM v WHERE n > 0"""


def q61_note_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of notes: by folder, classes of files, routes cited and broken, claims in tables, the longest folder that exists."""
    n = _notes(spark, sf_dir)
    folders = counters.notes_by_folder(n).select(F.concat(F.lit("folder "), "folder").alias("what"), "n")
    files = n.select("path", F.when(F.col("k") % 4 == 0, F.concat(F.lit("a"), "k", F.lit("_lectura.jpg"))).when(F.col("k") % 4 == 1, F.concat(F.lit("b"), "k", F.lit(".jpg"))).otherwise(F.substring_index("path", "/", -1)).alias("name"))
    classes = counters.file_classes(files).select(F.inline(F.array(*[F.struct(F.lit(x).alias("what"), F.col(x).alias("n")) for x in ("files", "notes", "reading_copies")])))
    lines = n.select("path", F.posexplode(F.split("text", "\n")).alias("idx", "raw"))
    there = spark.range(0, 3).select(F.concat(F.lit("Fonts/a b"), "id", F.lit(".jpg")).alias("name"))
    routes = counters.cited_routes(lines, there, r"Fonts/.*?\.(?:jpg|pdf)").select(F.concat(F.when(F.col("broken"), "broken ").otherwise("cited "), "route").alias("what"), "n")
    claims = quality.table_claims(lines).groupBy("metric", "said").agg(F.count("*").alias("n")).select(F.concat(F.lit("claim "), "metric", F.lit(" "), F.col("said").cast("string")).alias("what"), "n")
    said = n.select(F.concat(F.lit("Fonts/x/y"), F.col("k") % 3, F.lit("/z")).alias("route"))
    best = quality.longest_existing_prefix(said, dimension(spark, [("Fonts",), ("Fonts/x",), ("Fonts/x/y1",)], "folder string")).groupBy("folder").agg(F.count("*").alias("n")).select(F.concat(F.lit("prefix "), "folder").alias("what"), "n")
    return folders.unionByName(classes).unionByName(routes).unionByName(claims).unionByName(best)


Q61 = f"""
WITH {_N}
SELECT 'folder ' || folder AS what, count(*) AS n FROM p WHERE folder <> '00 Old' GROUP BY folder
UNION ALL SELECT 'files', count(*) FROM p WHERE k % 4 <> 0 UNION ALL SELECT 'notes', count(*) FROM p WHERE k % 4 > 1 UNION ALL SELECT 'reading_copies', count(*) FROM p WHERE k % 4 = 0
UNION ALL SELECT CASE WHEN k % 6 < 3 THEN 'cited ' ELSE 'broken ' END || 'Fonts/a b' || (k % 6) || '.jpg', count(*) FROM p WHERE fine GROUP BY k % 6
UNION ALL SELECT 'broken Fonts/c.pdf', count(*) FROM p WHERE fine HAVING count(*) > 0
UNION ALL SELECT 'claim Notes 12' || (k % 10) || '0', count(*) FROM p WHERE fine GROUP BY k % 10
UNION ALL SELECT 'prefix ' || CASE WHEN k % 3 = 1 THEN 'Fonts/x/y1' ELSE 'Fonts/x' END, count(*) FROM p GROUP BY 1"""


def q62_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files as documents; declared and guessed links, what covers a file, discrepancies, what parents' documents add, origins of assets."""
    c = _customers(spark, sf_dir)
    files = c.select(F.concat(F.lit("d"), F.col("n"), F.lit("/f"), "k").alias("path"), F.expr("CASE WHEN k % 9 = 0 THEN '.hidden' WHEN k % 9 = 1 THEN 'x_lectura.jpg' WHEN k % 9 = 2 THEN 'Bateig de la.pdf' ELSE 'Bateig_Joan Ferrándis ' || CAST(k % 4 AS STRING) || '55 amb.pdf' END").alias("name"))
    tokens = notes.document_tokens(files).groupBy(F.array_join("tokens", " ").alias("what")).agg(F.count("*").alias("n"))
    guessed = c.where("k % 2 = 0").select(F.col("k").alias("person"), F.concat(F.lit("f"), F.col("k") % 50).alias("document"))
    declared = c.where("k % 3 = 0").select(F.col("k").alias("person"), F.concat(F.lit("f"), F.col("k") % 50).alias("document"))
    stems = dimension(spark, [("d", f"f{i}") for i in range(4)], "folder string, stem string")
    covered = link.covered_by_stem(guessed.select("document", F.lit("d").alias("folder"), F.concat("document", F.lit(".jpg")).alias("name")).distinct(), stems)
    one = lambda df, name: df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    sides = link.discrepancies(guessed, declared).groupBy("side").agg(F.count("*").alias("n")).select(F.col("side").alias("what"), "n")
    edges = c.where("k > 0").select(F.col("k").alias("child"), F.shiftright("k", 1).alias("parent"))
    more = link.corroboration(edges, declared)
    assets = c.select(F.col("k").alias("asset"), F.concat(F.lit("img"), F.col("k"), F.lit(".jpg")).alias("name"))
    said = c.select(F.col("k").alias("note"), F.concat(F.lit("here is img"), F.col("k") % 10, F.lit(" and img"), F.col("k"), F.lit(".jpg again")).alias("text"))
    return tokens.unionByName(one(link.with_declared(guessed, declared, covered), "links")).unionByName(sides).unionByName(one(more, "parents")).unionByName(one(link.origins(assets, said), "origins"))


Q62 = f"""
WITH {_C}, g AS (SELECT k AS person, 'f' || (k % 50) AS document, k % 50 AS m FROM c WHERE k % 2 = 0), d AS (SELECT k AS person, 'f' || (k % 50) AS document FROM c WHERE k % 3 = 0),
cov AS (SELECT DISTINCT document FROM g WHERE document[1:2] IN ('f0', 'f1', 'f2', 'f3')),
o AS (SELECT DISTINCT k AS asset, k2 AS note FROM (SELECT k % 10 AS k, k AS k2 FROM c UNION ALL SELECT k, k FROM c) WHERE k IN (SELECT k FROM c))
SELECT CASE WHEN k % 4 = 0 THEN 'joan ferrandis' ELSE 'joan ferrandis ' || (k % 4) || '55' END AS what, count(*) AS n FROM c WHERE k % 9 > 2 AND k % 4 > 0 GROUP BY 1
UNION ALL SELECT 'joan ferrandis 055', count(*) FROM c WHERE k % 9 > 2 AND k % 4 = 0
UNION ALL SELECT 'links', count(*) FROM (SELECT person, document FROM d UNION SELECT person, document FROM g WHERE document NOT IN (SELECT document FROM cov))
UNION ALL SELECT 'guessed', count(*) FROM g WHERE person % 3 <> 0 UNION ALL SELECT 'declared', count(*) FROM d WHERE person % 2 <> 0
UNION ALL SELECT 'parents', count(*) FROM (SELECT c.k, d.document FROM c JOIN d ON c.k > 0 AND d.person = c.k >> 1 EXCEPT SELECT person, document FROM d)
UNION ALL SELECT 'origins', count(*) FROM o"""


def q63_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small functions on rows: given names and their variants, words of surnames, marriage years, labels, links, first numbers, slugs, wrapped text, tags."""
    c = _customers(spark, sf_dir)
    a = F.expr("CASE k % 4 WHEN 0 THEN array('joan') WHEN 1 THEN array('maria', 'josep') WHEN 2 THEN array('antoni') ELSE array() END")
    b = F.expr("CASE k % 5 WHEN 0 THEN array('juan') WHEN 1 THEN array('jose') WHEN 2 THEN array('joan') WHEN 3 THEN array('antonio', 'joan') ELSE array('maria', 'josep') END")
    birth, eldest, spouse = F.expr("CASE WHEN k % 3 <> 0 THEN 1700 + k % 50 END"), F.expr("CASE WHEN k % 4 <> 0 THEN 1720 + k % 30 END"), F.expr("CASE WHEN k % 2 = 0 THEN 1705 END")
    long = F.expr("concat('word ', 'w', repeat('x', cast(k % 7 AS int)), ' tail of it')")
    html = F.expr("concat('<p>a &lt; b', cast(k AS string), '</p><b>c</b>')")
    return c.select(
        "k", names.given_match(a, b).alias("given"), F.array_join(F.when(F.size(a) > 0, names.given_variants(F.get(a, F.lit(0)))), ",").alias("variants"), names.first_word(F.expr("concat(' Puig ', k % 3, ' Mas')")).alias("one"), names.second_word(F.expr("CASE WHEN k % 2 = 0 THEN 'Puig' ELSE 'Puig  Mas' END")).alias("two"),
        dates.marriage_year(birth, eldest, spouse).cast("long").alias("marriage"), text.fold_label(F.expr("concat('Àvia Paterna/', k, ':')")).alias("label"), text.slug(F.expr("concat('Ünïcode-', k, '_x')")).alias("slug"),
        text.first_integer(F.expr("concat('about 1.', 200 + k % 9, ' or 7')")).cast("long").alias("number"), F.array_join(text.wrap(long, F.lit(10)), "|").alias("wrapped"), text.strip_tags(html).alias("plain"),
        links.image_url("https://img.example/", F.col("n"), F.col("k") % 120).alias("image"), fiche.kin_role(F.expr("CASE k % 4 WHEN 0 THEN 'Avi Patern:' WHEN 1 THEN 'Pare' WHEN 2 THEN 'Abuelo materno' ELSE 'Other' END")).alias("role"),
        text.strip_accents_exact(F.lit("Àgüeda")).alias("exact"),
    )


Q63 = f"""
WITH {_C}
SELECT k, CASE WHEN k % 4 = 3 THEN 0.0::DOUBLE WHEN k % 4 = 0 THEN CASE k % 5 WHEN 0 THEN 0.8::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
    WHEN k % 4 = 1 THEN CASE k % 5 WHEN 1 THEN 0.5::DOUBLE WHEN 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE CASE WHEN k % 5 = 3 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END END AS given,
  CASE k % 4 WHEN 0 THEN 'joan,juan' WHEN 1 THEN 'maria' WHEN 2 THEN 'antoni,antoni joan,antonio' END AS variants, 'Puig' AS one, CASE WHEN k % 2 = 0 THEN '' ELSE 'Mas' END AS two,
  CASE WHEN k % 4 = 0 THEN CASE WHEN k % 3 <> 0 THEN 1724 + k % 50 ELSE 1727 END ELSE least(CASE WHEN k % 3 <> 0 THEN 1724 + k % 50 WHEN k % 2 = 0 THEN 1727 END, 1719 + k % 30) END AS marriage,
  'avia paterna/' AS label, 'unicode ' || k || ' x' AS slug, 1200 + k % 9 AS number,
  CASE WHEN 6 + k % 7 <= 10 THEN 'word w' || repeat('x', (k % 7)::INT) ELSE 'word|w' || repeat('x', (k % 7)::INT) END || CASE WHEN k % 7 > 4 THEN '|tail of it' ELSE '|tail of it' END AS wrapped,
  'a < b' || k || ' c' AS plain, CASE WHEN k % 120 >= 1 THEN 'https://img.example/' || n || '/' || CASE WHEN k % 120 < 10 THEN '0' ELSE '' END || (k % 120) END AS image,
  CASE k % 4 WHEN 0 THEN 'Avi Patern' WHEN 1 THEN 'Pare' WHEN 2 THEN 'Avi Matern' END AS role, 'Agueda' AS exact FROM c"""


def q64_parish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parishes from a person's places, then the spouses', then the parents', by rules that send early years elsewhere."""
    c = _customers(spark, sf_dir)
    each = c.select(F.col("k").alias("id"), F.explode(F.expr("array(struct(0 AS priority, CASE WHEN k % 3 = 0 THEN 'Àgres' END AS place), struct(1 AS priority, CASE WHEN k % 4 = 0 THEN 'Ibi, Alacant' ELSE 'Nowhere' END AS place), struct(2 AS priority, CASE WHEN k % 5 = 0 THEN 'Alcoi' END AS place))")).alias("x"), (F.lit(1600) + F.col("k") % 100).alias("year")).select("id", "x.*", "year")
    rules = dimension(spark, [(0, "agres", "Agres", 1650, "Bocairent"), (1, "ibi", "Ibi", None, None), (2, "alcoi", "Alcoi", None, None), (3, "alacant", "Alacant", None, None)], "ord int, needle string, parish string, before int, then_parish string")
    return classify.parish_of(each, rules, "Ontinyent")


Q64 = f"""
WITH {_C} SELECT k AS id, CASE WHEN k % 3 = 0 THEN CASE WHEN 1600 + k % 100 < 1650 THEN 'Bocairent' ELSE 'Agres' END WHEN k % 4 = 0 THEN 'Ibi' WHEN k % 5 = 0 THEN 'Alcoi' ELSE 'Ontinyent' END AS parish FROM c"""


def q65_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of people, families and sources in the house style."""
    c = _customers(spark, sf_dir)
    s, none = lambda e: F.expr(e), F.array().cast("array<string>")
    place = F.when(F.col("k") % 3 == 0, F.array(F.lit("2 PLAC Agres"))).otherwise(none)
    person = render.individual(s("concat('I', k)"), s("CASE WHEN k % 7 = 0 THEN ' Anna  Rosa ' ELSE 'Joan' END"), s("CASE WHEN k % 5 <> 0 THEN 'Puig i Mas' END"), s("CASE k % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END"), s("CASE WHEN k % 2 = 0 THEN '1842-03-09' END"), place, s("CASE WHEN k % 4 = 0 THEN 'ANTES 1900' END"), none, s("CASE WHEN k % 2 = 1 THEN concat('F', k) END"), s("array(concat('F', k + 1))"), s("array('S1')"), s("CASE WHEN k % 6 = 0 THEN 'FS1' END"))
    fam = render.family(s("concat('F', k)"), s("concat('I', k)"), F.lit(None).cast("string"), s("array('I1', 'I2')"), s("CASE WHEN k % 2 = 0 THEN '1850' END"), none, none)
    src = render.source(s("concat('S', k)"), F.lit("Title"), s("CASE WHEN k % 2 = 0 THEN 'p. 1' END"), s("concat(repeat('abcdefghi ', 21), 'end')"), F.lit(None).cast("string"))
    return c.select("k", F.array_join(person, "|").alias("person"), F.array_join(fam, "|").alias("family"), F.array_join(src, "|").alias("source"))


Q65 = f"""
WITH {_C}, g AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'Anna Rosa' ELSE 'Joan' END AS g FROM c)
SELECT k, concat_ws('|', '0 @I' || k || '@ INDI', CASE WHEN k % 5 <> 0 THEN '1 NAME ' || g || ' /PUIG I MAS/' ELSE '1 NAME ' || g END, '2 GIVN ' || g, CASE WHEN k % 5 <> 0 THEN '2 SURN PUIG I MAS' END,
    CASE k % 3 WHEN 0 THEN '1 SEX M' WHEN 1 THEN '1 SEX F' END, CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN '1 BIRT' END, CASE WHEN k % 2 = 0 THEN '2 DATE 9 MAR 1842' END, CASE WHEN k % 3 = 0 THEN '2 PLAC Agres' END,
    CASE WHEN k % 4 = 0 THEN '1 DEAT|2 DATE ABT 1900' END, CASE WHEN k % 2 = 1 THEN '1 FAMC @F' || k || '@' END, '1 FAMS @F' || (k + 1) || '@', '1 SOUR @S1@', CASE WHEN k % 6 = 0 THEN '1 _FSFTID FS1' END) AS person,
  concat_ws('|', '0 @F' || k || '@ FAM', '1 HUSB @I' || k || '@', CASE WHEN k % 2 = 0 THEN '1 MARR|2 DATE 1850' END, '1 CHIL @I1@|1 CHIL @I2@') AS family,
  concat_ws('|', '0 @S' || k || '@ SOUR', '1 TITL Title', CASE WHEN k % 2 = 0 THEN '1 PAGE p. 1' END, '1 TEXT ' || rtrim(repeat('abcdefghi ', 20)), '2 CONT abcdefghi end') AS source FROM g"""


def q66_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of parents with their confidence, fields without content left out, and ancestors above them by level."""
    c = _customers(spark, sf_dir)
    fs = lambda x: F.concat(F.lit("P"), x)
    entries = c.where("k % 2 = 1 AND k > 2").select(F.concat(F.lit("I"), "k").alias("target"), fs(F.col("k")).alias("fsftid"))
    edges = c.where("k > 2").select(fs(F.col("k")).alias("child"), F.explode(F.array(F.struct(fs(F.shiftright("k", 1)).alias("parent"), F.lit(0).alias("role")), F.struct(fs(F.shiftright("k", 1) + 1).alias("parent"), F.lit(1).alias("role")))).alias("x")).select("child", "x.*")
    people = c.select(fs(F.col("k")).alias("pid"), F.concat(F.lit("G"), "k").alias("given"), F.lit("").alias("surname"), F.lit("M").alias("sex"), F.expr("CASE WHEN k % 3 = 0 THEN '1700' ELSE '' END").alias("birth_date"), F.lit(None).cast("string").alias("birth_place"), F.lit("").alias("death_date"), F.lit(None).cast("string").alias("death_place"))
    mine = c.where("k % 4 = 0").select(fs(F.col("k")).alias("pid"))
    docs = c.where("k % 11 = 0").select(fs(F.col("k")).alias("pid"), F.lit("doc").alias("document"))
    got = proposals.parent_proposals(entries, people, cut(edges), mine, docs)
    first = F.get("parents", F.lit(0))
    above = proposals.ancestor_levels(entries, cut(edges.select("child", "parent")), 3)
    one = got.withColumn("first", first)
    out = one.select("target", "confidence", "accept", F.array_join(F.transform("parents", lambda x: x["fsftid"]), ",").alias("parents"), proposals.sparse(one, "first").alias("first"))
    levels = above.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", F.size("people").alias("n")))), lambda x: x["n"].cast("string")), ",").alias("above"))
    return out.join(levels, "target", "left")


Q66 = f"""
WITH RECURSIVE {_C}, e AS (SELECT k, k >> 1 AS a, (k >> 1) + 1 AS b FROM c WHERE k > 2), u AS (SELECT k, a AS p FROM e UNION ALL SELECT k, b FROM e),
w(start, p, level) AS (SELECT k, k, 0 FROM c WHERE k % 2 = 1 AND k > 2 UNION SELECT start, u.p, level + 1 FROM w JOIN u ON u.k = w.p WHERE level < 3),
f AS (SELECT start, p, min(level) AS level FROM w GROUP BY 1, 2), v AS (SELECT start, level, count(*) AS n FROM f WHERE level > 1 GROUP BY 1, 2), z AS (SELECT start, string_agg(CAST(n AS STRING), ',' ORDER BY level) AS above FROM v GROUP BY 1),
x AS (SELECT k, a, b, (a % 4 = 0)::INT + (b % 4 = 0)::INT AS own, (a % 11 = 0)::INT + (b % 11 = 0)::INT AS docs, a % 3 = 0 AND b % 3 = 0 AS dated FROM e WHERE k % 2 = 1)
SELECT 'I' || k AS target, CASE WHEN own = 2 OR docs > 0 THEN 'high' WHEN own > 0 THEN 'medium' WHEN dated THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN own = 2 THEN true END AS accept, 'P' || a || ',P' || b AS parents,
  '{{"role":0,"fsftid":"P' || a || '","given":"G' || a || '","sex":"M"' || CASE WHEN a % 3 = 0 THEN ',"birth_date":"1700"' ELSE '' END || CASE WHEN a % 11 = 0 THEN ',"documents":["doc"]' ELSE '' END || ',"own":' || CASE WHEN a % 4 = 0 THEN 'true' ELSE 'false' END || '}}' AS first, above
FROM x LEFT JOIN z ON start = k"""


def q67_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What accepted proposals add: external ids, families with new and known people, child links, children of families that exist."""
    c = _customers(spark, sf_dir)
    people = c.select(F.concat(F.lit("I"), F.format_string("%06d", "k")).alias("xref"), F.expr("CASE WHEN k % 4 = 0 THEN concat('F', k) WHEN k % 4 = 1 THEN '' END").alias("fsftid"), F.expr("CASE WHEN k % 5 = 0 THEN 'F1' END").alias("famc"))
    ids = proposals.external_ids(people, c.select(F.concat(F.lit("I"), F.format_string("%06d", F.col("k") * 2)).alias("target"), F.expr("concat('F', CASE WHEN k % 3 = 0 THEN k * 2 ELSE -1 END)").alias("fsftid")))
    kinds = ids.groupBy("action").agg(F.count("*").alias("n")).select(F.concat(F.lit("id "), "action").alias("what"), F.col("n").cast("string").alias("value"))
    block = "struct('{0}' AS sex, 'G' AS given, 'S' AS surname, '' AS birth_date, '' AS birth_place, '' AS death_date, '' AS death_place, {1} AS fsftid)"
    accepted = c.select(F.col("k").cast("int").alias("ord"), F.concat(F.lit("I"), F.format_string("%06d", "k")).alias("target"), F.expr(f"array({block.format('M', 'concat(CHAR(70), k - k % 4)')}, {block.format('F', 'concat(CHAR(78), k)')})").alias("parents"))
    got = proposals.imports(people, accepted, 1_000_000, 500_000)
    fam = got["families"].select(F.concat(F.lit("family "), "family").alias("what"), F.concat_ws(",", "husband", "wife", F.array_join("children", "+")).alias("value"))
    more = got["people"].groupBy("sex").agg(F.count("*").alias("n"), F.min("xref").alias("a"), F.max("xref").alias("z")).select(F.concat(F.lit("new "), "sex").alias("what"), F.concat_ws(",", F.col("n").cast("string"), "a", "z").alias("value"))
    skipped = got["skipped"].groupBy("why").agg(F.count("*").alias("n")).select(F.concat(F.lit("skipped "), "why").alias("what"), F.col("n").cast("string").alias("value"))
    links_ = got["links"].select(F.concat(F.lit("link "), "target").alias("what"), F.col("raw").alias("value"))
    families = c.select(F.concat(F.lit("F"), "n").alias("xref"), F.array(F.concat(F.lit("I"), "k")).alias("children"))
    kids = proposals.new_children(families, c.select(F.concat(F.lit("F"), F.col("k") % 30).alias("family"), F.concat(F.lit("I"), "k").alias("child"))).groupBy().agg(F.count("*").alias("n")).select(F.lit("children").alias("what"), F.col("n").cast("string").alias("value"))
    return kinds.unionByName(fam).unionByName(more).unionByName(skipped).unionByName(links_).unionByName(kids)


Q67 = f"""
WITH {_C}, i AS (SELECT k, 2 * k AS t, CASE WHEN k % 3 = 0 THEN 'F' || (2 * k) ELSE 'F-1' END AS f FROM c), m AS (SELECT max(k) AS k FROM c),
g AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM c WHERE k % 5 <> 0),
h AS (SELECT *, 'F' || lpad(CAST(499999 + i AS STRING), 6, '0') AS fam, 999999 + row_number() OVER (ORDER BY k) AS new FROM g)
SELECT 'id ' || CASE WHEN t > (SELECT k FROM m) THEN 'no_record' WHEN t % 4 <> 0 THEN 'add' WHEN f = 'F' || t THEN 'same' ELSE 'different' END AS what, CAST(count(*) AS STRING) AS value FROM i GROUP BY 1
UNION ALL SELECT 'family ' || fam, 'I' || lpad(CAST(k - k % 4 AS STRING), 6, '0') || ',I' || new || ',I' || lpad(CAST(k AS STRING), 6, '0') FROM h
UNION ALL SELECT 'new F', count(*) || ',I' || min(new) || ',I' || max(new) FROM h UNION ALL SELECT 'skipped has_parents', CAST(count(*) AS STRING) FROM c WHERE k % 5 = 0
UNION ALL SELECT 'link I' || lpad(CAST(k AS STRING), 6, '0'), '1 FAMC @' || fam || '@' FROM h
UNION ALL SELECT 'children', CAST(count(*) AS STRING) FROM c WHERE k % 30 <> n AND k % 30 IN (SELECT n FROM c)"""


def q68_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards of edits on orders as reviews: values that are no booleans, kinds of review files, rejected targets of two folders, statuses counted, sums."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("target"))
    value = o.select("id", F.expr("CASE s WHEN 'F' THEN 'true' WHEN 'O' THEN 'perhaps' END").alias("accept"))
    bad = edit.not_boolean(value).groupBy().agg(F.count("*").alias("n")).select(F.lit("no boolean").alias("what"), "n")
    kind = dimension(spark, [(quality.review_kind(dimension(spark, [("t", "f")], "target string, fsftid string")),), (quality.review_kind(dimension(spark, [("parents",)], "kind string")),)], "what string").withColumn("n", F.lit(1).cast("long"))
    verdicts = o.select("target", F.col("id").alias("file"), F.when(F.col("s") == "F", False).when(F.col("s") == "O", True).alias("accept"))
    rejected = edit.last_verdicts(verdicts.where("file % 2 = 0"), verdicts.where("file % 2 = 1"), "target", "file").where("accept = false").groupBy().agg(F.count("*").alias("n")).select(F.lit("rejected").alias("what"), "n")
    buckets = counters.bucket_counts(o, "p").select(F.col("p").alias("what"), "n")
    return bad.unionByName(kind).unionByName(rejected).unionByName(buckets)


Q68 = """
SELECT 'no boolean' AS what, count(*) AS n FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'ids', 1 UNION ALL SELECT 'parents', 1
UNION ALL SELECT 'rejected', count(*) FROM (SELECT o_custkey, arg_max(o_orderstatus, (o_orderkey % 2) * 100000000000 + o_orderkey) AS s FROM orders GROUP BY 1) WHERE s = 'F'
UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY 1"""


def q69_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines with the notes that speak of a file, manifests read back, camel-case parameters, numbered open ends by region."""
    c = _customers(spark, sf_dir)
    from ..operators import sinks

    assets = c.select(F.concat(F.lit("img/"), F.format_string("%08d", "k")).alias("path"), F.md5("name").alias("digest"), (F.col("k") * 10).alias("size"))
    said = c.where("k % 3 = 0").select(F.concat(F.lit("img/"), F.format_string("%08d", "k")).alias("asset"), F.explode(F.array(F.lit("b.md"), F.lit("a.md"))).alias("note"))
    lines = cut(sinks.manifest_lines(assets, said))
    back = notes.manifest(lines).groupBy().agg(F.count("*").alias("n"), F.sum("size").alias("value")).select(F.lit("files").alias("what"), F.concat_ws(",", F.col("n").cast("string"), F.col("value").cast("string")).alias("value"))
    remarks = lines.where("startswith(value, '#')").groupBy("value").agg(F.count("*").alias("n")).select(F.col("value").alias("what"), F.col("n").cast("string").alias("value"))
    params = links.camel_params({"birth_place": "x", "given": "", "death_like_date": "1700"}, "q")
    camel = dimension(spark, sorted(params.items()), "what string, value string")
    return back.unionByName(remarks).unionByName(camel)


Q69 = f"""
WITH {_C}
SELECT 'files' AS what, count(*) || ',' || CAST(sum(k * 10)::BIGINT AS STRING) AS value FROM c UNION ALL SELECT '# a.md, b.md', CAST(count(*) AS STRING) FROM c WHERE k % 3 = 0
UNION ALL SELECT 'q.birthPlace', 'x' UNION ALL SELECT 'q.deathLikeDate', '1700'"""

def q71_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five reports on customers, line by line with how often each stands there, by section."""
    c = _customers(spark, sf_dir)
    x = F.concat(F.lit("I"), "k")
    m = c.select(F.expr("CASE k % 3 WHEN 0 THEN 'confident' WHEN 1 THEN 'review' ELSE 'unmatched' END").alias("bucket"), x.alias("left"), F.expr("CASE WHEN k % 2 = 0 THEN '1800' END").alias("left_birth"), F.expr("CASE WHEN k % 6 <> 5 THEN concat('F', k) END").alias("right"), F.lit("1801").alias("right_birth"), (F.col("k") % 9).alias("total"), F.expr("array('name', concat('y', k % 2))").alias("reasons"))
    alone = c.where("k % 4 = 0").select(F.concat(F.lit("F"), "k").alias("right"), F.expr("CASE WHEN k % 8 = 0 THEN 1700 + n END").alias("birth_year"), (F.col("k") % 5).alias("sources"))
    e = c.select(
        x.alias("xref"), F.col("name"), F.expr("CASE k % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'stuck' WHEN 2 THEN 'unknown' ELSE 'unlinked' END").alias("status"), (F.col("k") % 50).alias("score"), F.expr("CASE WHEN k % 3 = 0 THEN '1800' END").alias("birth"), F.expr("CASE WHEN k % 5 = 0 THEN 'Agres' END").alias("town"),
        F.expr("array(named_struct('name', concat('P', k), 'documents', CASE WHEN k % 8 = 0 THEN array('d1') ELSE array() END))").alias("parents"), (F.col("k") % 7).alias("upstream"), F.expr("CASE WHEN k % 2 = 0 THEN 1650 END").alias("oldest"), F.expr("CASE WHEN k % 6 = 0 THEN array('a.pdf') ELSE array() END").alias("documents"), F.expr("CASE WHEN k % 12 = 0 THEN 'here' END").alias("archive"),
        F.expr("CASE n % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'far' END").alias("region"), F.array(F.lit("look")).alias("links"),
    )
    said = settings.provenance(e.withColumn("fresh", F.lit(False)).withColumn("taken", F.lit("2024")), F.col("fresh"), F.col("taken"))
    guides = dimension(spark, [("south", 0, "The south", ["s1"]), ("north", 1, "The north", [])], "region string, ord int, title string, links array<string>")
    gens = c.groupBy((F.col("n") % 4 + 1).alias("gen")).agg(F.count("*").alias("n")).withColumn("of", F.col("gen") * 2)
    counted = reports.counters_report(c.agg(F.count("*").cast("string").alias("value")).select(F.lit(0).alias("ord"), F.lit("people").alias("label"), "value"), gens, gens.select("gen", F.lit(2).alias("delta")), c.groupBy(F.concat(F.lit("d"), F.col("n") % 3).alias("folder")).agg(F.count("*").alias("n")), c.where("k % 40 = 1").select(F.concat(F.lit("r"), "k").alias("route")))
    l = c.select(F.col("k").alias("id"), x.alias("who"), F.lit("bateig").alias("sacrament"), F.expr("CASE WHEN k % 5 <> 0 THEN 1700 + k % 9 END").alias("year"), F.expr("CASE WHEN k % 3 = 0 THEN 'agres' WHEN k % 3 = 1 THEN 'ibi' END").alias("parish"), F.col("n").alias("rank"), F.expr("k % 2 = 0").alias("possible"), F.lit("none").alias("why"))  # noqa: E741
    spans = dimension(spark, [("agres", "bateig", 1, 1700, 1750), ("agres", "bateig", 0, 1600, 1650), ("else", "bateig", 0, 1, 2)], "parish string, sacrament string, ord int, y_from int, y_to int")
    every = [("match", reports.match_report(m, alone)), ("frontier", reports.frontier_report(e, said)), ("worklist", reports.worklist_report(e, guides)), ("counters", counted), ("verification", reports.verification_report(l, spans, "quota 3 of 40"))]
    out = None
    for name, lines in every:
        some = lines.groupBy(F.lit(name).alias("report"), "section", "line").agg(F.count("*").alias("n"))
        out = some if out is None else out.unionByName(some)
    return out


Q71 = f"""
WITH {_C}, m AS (SELECT k, n, 'I' || k AS l, CASE k % 3 WHEN 0 THEN 'confident' WHEN 1 THEN 'review' ELSE 'unmatched' END AS b, CASE WHEN k % 2 = 0 THEN '1800' ELSE '?' END AS lb, CASE WHEN k % 6 <> 5 THEN 'F' || k END AS r, k % 9 AS t FROM c),
e AS (SELECT *, 'I' || k AS x, CASE k % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'stuck' WHEN 2 THEN 'unknown' ELSE 'unlinked' END AS st, k % 50 AS sc, CASE WHEN k % 3 = 0 THEN '1800' END AS bi, CASE WHEN k % 5 = 0 THEN 'Agres' END AS town, CASE n % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'far' END AS rg FROM c),
w AS (SELECT *, CASE rg WHEN 'north' THEN 'The north' WHEN 'south' THEN 'The south' ELSE rg END AS title FROM e WHERE st <> 'ready'),
u(report, section, line) AS (
SELECT 'match', 0, '# Matches of two trees' UNION ALL SELECT 'match', 1, '| ' || b || ' | ' || count(*) || ' |' FROM m GROUP BY b
UNION ALL SELECT 'match', 2, '## Sure (' || count(*) || ')' FROM m WHERE b = 'confident' UNION ALL SELECT 'match', 3, '## To be looked at (' || count(*) || ')' FROM m WHERE b = 'review'
UNION ALL SELECT 'match', CASE b WHEN 'confident' THEN 2 ELSE 3 END, '| ' || concat_ws(' | ', l, lb, coalesce(r, '?'), '1801', t, 'name; y' || (k % 2)) || ' |' FROM m WHERE b <> 'unmatched'
UNION ALL SELECT 'match', 4, '## Only in the first tree (' || count(*) || ')' FROM m WHERE b = 'unmatched' UNION ALL SELECT 'match', 4, '| ' || concat_ws(' | ', l, lb, coalesce(r || ' (' || t || ')', '?')) || ' |' FROM m WHERE b = 'unmatched'
UNION ALL SELECT 'match', 5, '## Only in the second tree (' || count(*) || ')' FROM m WHERE k % 4 = 0 UNION ALL SELECT 'match', 5, '| F' || k || ' | ' || CASE WHEN k % 8 = 0 THEN CAST(1700 + n AS STRING) ELSE '?' END || ' | ' || (k % 5) || ' |' FROM m WHERE k % 4 = 0
UNION ALL SELECT 'frontier', 0, '# Open ends' UNION ALL SELECT 'frontier', 1, 'snapshot of 2024: ' || count(*) FILTER (WHERE st IN ('ready', 'stuck')) || ' of ' || count(*) FROM e
UNION ALL SELECT 'frontier', 1, 'New ancestors above them: ' || coalesce(sum(k % 7), 0)::BIGINT FROM e WHERE st = 'ready' UNION ALL SELECT 'frontier', 2, '## Ready (' || count(*) || ')' FROM e WHERE st = 'ready'
UNION ALL SELECT 'frontier', 2, unnest(list_filter(['### ' || x || ' ' || name || ' ' || sc, '- Birth: ' || coalesce(bi, 'unknown'), '- Parent: P' || k, CASE WHEN k % 8 = 0 THEN '  - Named by our own: d1' END, CASE WHEN k % 7 > 0 THEN '- Above: ' || (k % 7) || CASE WHEN k % 2 = 0 THEN ', back to 1650' ELSE '' END END,
  CASE WHEN k % 6 = 0 THEN '- Document: a.pdf' END, CASE WHEN k % 12 = 0 THEN '- Archive: here' END], lambda y: y IS NOT NULL)) FROM e WHERE st = 'ready'
UNION ALL SELECT 'frontier', s, '## ' || h || ' (' || (SELECT count(*) FROM e WHERE st = z) || ')' FROM (VALUES (3, 'stuck', 'Stuck'), (4, 'unknown', 'Not asked'), (5, 'unlinked', 'Not linked')) v(s, z, h)
UNION ALL SELECT 'frontier', CASE st WHEN 'stuck' THEN 3 WHEN 'unknown' THEN 4 ELSE 5 END, '| ' || concat_ws(' | ', x || ' ' || name, coalesce(bi, '?'), coalesce(town, '?'), CASE WHEN k % 6 = 0 THEN 'a.pdf' ELSE '?' END, CASE WHEN k % 12 = 0 THEN 'here' ELSE '?' END) || ' |' FROM e WHERE st <> 'ready'
UNION ALL SELECT 'worklist', 0, '# Work by archive' UNION ALL SELECT 'worklist', 1, '| ' || title || ' | ' || count(*) || ' |' FROM w GROUP BY title UNION ALL SELECT 'worklist', 2, '## ' || title || ' (' || count(*) || ')' FROM w GROUP BY title
UNION ALL SELECT DISTINCT 'worklist', 2, '- Start: s1' FROM w WHERE rg = 'south'
UNION ALL SELECT 'worklist', 2, unnest(list_filter(['### ' || name || ' ' || x, '- ' || CASE WHEN bi IS NULL AND town IS NULL THEN 'no date and no place' ELSE concat_ws(', ', 'born ' || bi, 'at ' || town) END,
  CASE st WHEN 'stuck' THEN '- parents are not known there either' WHEN 'unknown' THEN '- linked, not asked yet' ELSE '- not found there yet' END, CASE WHEN k % 6 = 0 THEN '- Document: a.pdf' END, '- look'], lambda y: y IS NOT NULL)) FROM w
UNION ALL SELECT 'counters', 0, '# State of the tree' UNION ALL SELECT 'counters', 1, '| people | ' || count(*) || ' |' FROM c UNION ALL SELECT 'counters', 2, '| G' || (n % 4 + 1) || ' | ' || count(*) || ' | ' || (2 * (n % 4 + 1)) || ' |' FROM c GROUP BY n % 4
UNION ALL SELECT DISTINCT 'counters', 3, '- foster: G' || (n % 4 + 1) || ' by 2' FROM c UNION ALL SELECT 'counters', 4, '| d' || (n % 3) || ' | ' || count(*) || ' |' FROM c GROUP BY n % 3 UNION ALL SELECT 'counters', 5, '- broken: r' || k FROM c WHERE k % 40 = 1
UNION ALL SELECT 'verification', 0, unnest(['# Planned lookups', 'quota 3 of 40']) UNION ALL SELECT 'verification', 1, '## Can be asked for (' || count(*) || ')' FROM c WHERE k % 2 = 0 UNION ALL SELECT 'verification', 2, '## Can''t be asked for (' || count(*) || ')' FROM c WHERE k % 2 = 1
UNION ALL SELECT 'verification', CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END, '- I' || k || ': bateig ' || CASE WHEN k % 5 <> 0 THEN CAST(1700 + k % 9 AS STRING) ELSE '?' END || ', ' || CASE k % 3 WHEN 0 THEN 'agres' WHEN 1 THEN 'ibi' ELSE '?' END || CASE WHEN k % 2 = 1 THEN ': none' ELSE '' END FROM c
UNION ALL SELECT 'verification', 3, '| agres | bateig | 1600-1650, 1700-1750 |')
SELECT report, section, line, count(*) AS n FROM u GROUP BY 1, 2, 3"""

QUERIES = {f.__name__: f for f in (q71_reports, q54_fiche, q55_persons, q56_catalogue, q57_candidates, q58_snapshot, q59_headings, q60_note_rules, q61_note_counters, q62_documents, q63_scalars, q64_parish, q65_render, q66_proposals, q67_imports, q68_checks, q69_reports)}
SQL = {"q71_reports": Q71, "q54_fiche": Q54, "q55_persons": Q55, "q56_catalogue": Q56, "q57_candidates": Q57, "q58_snapshot": Q58, "q59_headings": Q59, "q60_note_rules": Q60, "q61_note_counters": Q61, "q62_documents": Q62, "q63_scalars": Q63, "q64_parish": Q64, "q65_render": Q65, "q66_proposals": Q66, "q67_imports": Q67, "q68_checks": Q68, "q69_reports": Q69}
