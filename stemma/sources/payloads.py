"""Saved payloads as DataFrames: pedigree and snapshot JSON, person JSON, catalogue JSON, ancestry responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERSON = "pid string, given string, surname string, sex string, birth_date string, birth_place string, death_date string, death_place string, sosa string"
PEDIGREE = f"root string, calls int, skipped_leaves array<string>, people array<struct<{PERSON.replace(' ', ':').replace(',:', ',')}>>, father_of map<string,string>, mother_of map<string,string>, couples array<array<string>>"
SNAPSHOT = "data string, arrel string, persones map<string,struct<fsftid:string,estat:string,amunt:int,mes_antic:int,pares:array<struct<pid:string,given:string,surname:string,sex:string,birth_date:string,birth_place:string>>>>"
FACT = "struct<type:string,date:struct<formal:string,original:string>,place:struct<original:string,normalized:array<struct<value:string>>>>"
GEDCOMX = f"id string, display struct<name:string,gender:string,birthDate:string,birthPlace:string,deathDate:string,deathPlace:string,ascendancyNumber:string>, names array<struct<nameForms:array<struct<parts:array<struct<type:string,value:string>>>>>>, facts array<{FACT}>"


def pedigree_json(people: DataFrame, edges: DataFrame, couples: DataFrame, calls: DataFrame) -> DataFrame:
    """``root, value``: fetched pedigrees as JSON, one a ``root``; what ``pedigree`` reads.

    ``people (root, ord, pid, given, ...)``, ``edges (root, child, parent, role)``, ``couples (root, a, b)``, ``calls (root,
    calls, skipped_leaves)``. A pedigree is one answer of a fetch, so its people fit into a row.
    """
    names = [x.split()[0] for x in PERSON.split(", ")]
    listed = people.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*names).alias("p")))), lambda x: x["p"]).alias("people"))
    of = lambda role, name: edges.where(F.col("role") == role).groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("child", "parent")))).alias(name))
    pairs = couples.groupBy("root").agg(F.array_sort(F.collect_list(F.array("a", "b"))).alias("couples"))
    every = calls.join(listed, "root", "left").join(of(0, "father_of"), "root", "left").join(of(1, "mother_of"), "root", "left").join(pairs, "root", "left")
    none = lambda c, kind: F.coalesce(c, F.lit(None).cast(kind))
    return every.select("root", F.to_json(F.struct("root", "calls", "skipped_leaves", "people", none("father_of", "map<string,string>").alias("father_of"), none("mother_of", "map<string,string>").alias("mother_of"), "couples")).alias("value"))


def pedigree(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Fetched pedigrees: ``people``, ``edges (child, parent, role)``, ``couples (a, b)``; a file is one, or with ``lines`` each line."""
    raw = spark.read.schema(PEDIGREE).json(path, multiLine=not lines)
    edges = lambda column, role: raw.select(F.explode(column).alias("child", "parent")).withColumn("role", F.lit(role))
    return {
        "people": raw.select(F.posexplode("people").alias("ord", "p")).select("ord", "p.*"),
        "edges": edges("father_of", 0).unionByName(edges("mother_of", 1)),
        "couples": raw.select(F.explode("couples").alias("c")).select(F.get("c", F.lit(0)).alias("a"), F.get("c", F.lit(1)).alias("b")),
    }


def snapshot(texts: DataFrame, column: str = "value") -> DataFrame:
    """``xref, fsftid, status, upstream, oldest, parents`` of whole snapshot files; broken ones give no rows."""
    read = texts.select(F.from_json(column, SNAPSHOT, {"mode": "PERMISSIVE"}).alias("s")).select(F.explode("s.persones").alias("xref", "p"))
    return read.select("xref", F.col("p.fsftid").alias("fsftid"), F.col("p.estat").alias("status"), F.col("p.amunt").alias("upstream"), F.col("p.mes_antic").alias("oldest"), F.col("p.pares").alias("parents"))


def answered(asked: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers that are held already, ``key, body``, and the keys that have to be asked for, each once.

    ``asked (key)``; ``held (key, taken, body)``, of which the last taken counts.
    """
    last = held.groupBy("key").agg(F.max_by("body", "taken").alias("body"))
    keys = asked.select("key").distinct()
    return keys.join(last, "key"), keys.join(last.select("key"), "key", "left_anti")


def _kind(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def persons(raw: DataFrame) -> DataFrame:
    """People from person records: first fact of a type, names from their parts, else split from the display name."""
    fact = lambda name: F.get(F.filter(F.coalesce("facts", F.array().cast(f"array<{FACT}>")), lambda x: _kind(x["type"]) == name), F.lit(0))
    date = lambda f: F.coalesce(F.regexp_replace(f["date"]["formal"], r"^\++", ""), f["date"]["original"])
    place = lambda f: F.coalesce(F.nullif(f["place"]["original"], F.lit("")), F.get(f["place"]["normalized"], F.lit(0))["value"])
    parts = F.flatten(F.flatten(F.transform(F.coalesce("names", F.from_json(F.lit("[]"), "array<struct<nameForms:array<struct<parts:array<struct<type:string,value:string>>>>>>")), lambda n: F.transform(n["nameForms"], lambda f: f["parts"]))))
    part = lambda name: F.get(F.filter(parts, lambda x: (_kind(x["type"]) == name) & (x["value"] != "")), F.lit(0))["value"]
    words = F.filter(F.split(F.trim(F.coalesce("display.name", F.lit(""))), r"\s+"), lambda x: x != "")
    n = F.size(words)
    whole = part("Given").isNotNull() & part("Surname").isNotNull()
    given = F.when(whole, part("Given")).when(n >= 2, F.get(words, F.lit(0))).otherwise(F.coalesce(part("Given"), "display.name", F.lit("")))
    surname = F.when(whole, part("Surname")).when(n >= 3, F.concat_ws(" ", F.slice(words, -2, 2))).when(n == 2, F.get(words, F.lit(1))).otherwise(F.coalesce(part("Surname"), F.lit("")))
    first = lambda pick, a, shown, b: F.coalesce(pick(fact(a)), F.col(f"display.{shown}"), pick(fact(b)))
    return raw.select(
        F.col("id").alias("pid"), given.alias("given"), surname.alias("surname"), F.when(F.col("display.gender") == "Male", "M").when(F.col("display.gender") == "Female", "F").alias("sex"),
        first(date, "Birth", "birthDate", "Christening").alias("birth_date"), first(place, "Birth", "birthPlace", "Christening").alias("birth_place"),
        first(date, "Death", "deathDate", "Burial").alias("death_date"), first(place, "Death", "deathPlace", "Burial").alias("death_place"), F.col("display.ascendancyNumber").alias("sosa"),
    )


def ancestry_edges(people: DataFrame) -> DataFrame:
    """Edges and couples from the numbers of one response: ``n`` to ``2n`` and ``2n + 1``; ``n-S`` is a spouse.

    ``people (call, pid, sosa)``: numbers hold within a call.
    """
    n = people.select("call", "pid", F.regexp_extract("sosa", r"^(\d+)$", 1).try_cast("long").alias("n")).where("n IS NOT NULL")
    up = n.select("call", F.col("pid").alias("child"), F.explode(F.array(F.struct((F.col("n") * 2).alias("n"), F.lit(0).alias("role")), F.struct((F.col("n") * 2 + 1).alias("n"), F.lit(1).alias("role")))).alias("x")).select("call", "child", "x.*")
    return up.join(n.withColumnRenamed("pid", "parent"), ["call", "n"]).select("child", "parent", "role").distinct()


def spouse_pairs(people: DataFrame) -> DataFrame:
    n = people.select("call", F.col("pid").alias("a"), F.col("sosa"))
    s = people.select("call", F.col("pid").alias("b"), F.regexp_extract("sosa", r"^(\d+)-S$", 1).alias("sosa")).where("sosa <> ''")
    return n.join(s, ["call", "sosa"]).select("a", "b").distinct()


NODE = "id string, titol string, descripcio string, udocs boolean, esta_indexat boolean, path array<array<string>>"
BOOK = "_idudocsimple string, id string, titol string, codi string, fons string, grup string, serie string, any_inici string, any_fi string, condicions_acces string, bucket boolean, idamazon string"


def catalogue_nodes(texts: DataFrame, column: str = "value") -> DataFrame:
    """Nodes of tree answers. Children are always asked for; a node's own list of them is not read."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    n = texts.select(F.inline(F.from_json(column, f"array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>")))
    return n.select(empty(F.col("id")).alias("id"), empty(F.col("titol")).alias("title"), F.coalesce("udocs", F.lit(False)).alias("has_documents"), empty(F.col("descripcio")).alias("description"), F.coalesce("path", F.array().cast("array<array<string>>")).alias("path"), F.coalesce("esta_indexat", F.lit(False)).alias("indexed"))


def catalogue_books(texts: DataFrame, column: str = "value") -> DataFrame:
    """Books of fiche answers, with or without the outer object; unreadable years are null."""
    flat = BOOK.replace(" ", ":").replace(",:", ",")
    b = texts.select(F.coalesce(F.from_json(column, f"udoc struct<{flat}>")["udoc"], F.from_json(column, BOOK)).alias("b"))
    empty = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(""))
    return b.select(
        F.coalesce(F.nullif("b._idudocsimple", F.lit("")), "b.id", F.lit("")).alias("id"), empty("titol").alias("title"), empty("codi").alias("code"), empty("fons").alias("fonds"), empty("grup").alias("group"), empty("serie").alias("series"),
        F.trim("b.any_inici").try_cast("int").alias("year_from"), F.trim("b.any_fi").try_cast("int").alias("year_to"), empty("condicions_acces").alias("access"), F.coalesce("b.bucket", F.lit(False)).alias("digitised"), F.coalesce(F.nullif("b.idamazon", F.lit("")), "b._idudocsimple", F.lit("")).alias("scans"),
    )
