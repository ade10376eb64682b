"""Proposals for open ends, and what accepted ones add: parents, ancestors, candidates from records, external ids, families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .classify import confidence
from .edit import upsert
from .graph import levels, reach
from .order import dense

RECORD = "entries array<struct<title:string,id:string,content:struct<gedcomx:struct<persons:array<struct<principal:boolean,display:struct<name:string,birthDate:string,birthPlace:string>>>>>>>"


def parent_proposals(entries: DataFrame, people: DataFrame, edges: DataFrame, mine: DataFrame, documents: DataFrame) -> DataFrame:
    """``target, fsftid, confidence, parents, accept``: one row for each ready entry (``target, fsftid``).

    ``edges (child, parent, role)`` and ``people`` are the fetched tree, ``mine (pid)`` who the user entered,
    ``documents (pid, document)`` what names whom. What the user entered is accepted; else it stays open.
    """
    docs = documents.groupBy("pid").agg(F.array_sort(F.collect_set("document")).alias("documents"))
    up = entries.join(edges.withColumnRenamed("child", "fsftid"), "fsftid").join(people.withColumnRenamed("pid", "parent"), "parent")
    up = up.join(docs.withColumnRenamed("pid", "parent"), "parent", "left").join(mine.select(F.col("pid").alias("parent"), F.lit(True).alias("own")).distinct(), "parent", "left")
    block = F.struct("role", F.col("parent").alias("fsftid"), "given", "surname", "sex", "birth_date", "birth_place", "death_date", "death_place", "documents", F.coalesce("own", F.lit(False)).alias("own"))
    one = up.groupBy("target", "fsftid").agg(F.array_sort(F.collect_list(block)).alias("parents"))
    p = F.col("parents")
    n, own = F.size(p), F.size(F.filter(p, lambda x: x["own"]))
    named = F.aggregate(p, F.lit(0), lambda a, x: a + F.coalesce(F.size(x["documents"]), F.lit(0)))
    dated = F.forall(p, lambda x: F.coalesce(x["birth_date"] != "", F.lit(False)))
    return one.select("target", "fsftid", confidence(n, own, named, dated).alias("confidence"), "parents", F.when((own > 0) & (own == n), True).alias("accept"))


def sparse(rows: DataFrame, column: str = "parents") -> Column:
    """A struct, or a list of them, as JSON without fields that are null, empty text or an empty list."""

    def kept(value: Column, kind: T.StructType) -> Column:
        fields = []
        for f in kind.fields:
            x = value[f.name]
            if isinstance(f.dataType, T.StringType):
                x = F.nullif(x, F.lit(""))
            elif isinstance(f.dataType, T.ArrayType):
                x = F.when(F.size(x) > 0, x)
            fields.append(x.alias(f.name))
        return F.struct(*fields)

    kind = rows.schema[column].dataType
    value = F.transform(column, lambda x: kept(x, kind.elementType)) if isinstance(kind, T.ArrayType) else kept(F.col(column), kind)
    return F.to_json(value, {"ignoreNullFields": "true"})


def ancestor_levels(entries: DataFrame, edges: DataFrame, depth: int, known: DataFrame | None = None) -> DataFrame:
    """``target, level, people``: who stands above the proposed parents (level 1) of each entry, each at the first level, to ``depth``."""
    above = levels(reach(edges, entries.select(F.col("fsftid").alias("person")), depth, known).where("level > 1"))
    return entries.select("target", F.col("fsftid").alias("start")).join(above, "start").select("target", "level", "people")


def branch_imports(start: DataFrame, edges: DataFrame, known: DataFrame, depth: int, first_person: int, first_family: int) -> dict[str, DataFrame]:
    """New people and families of whole branches above accepted people, level by level.

    ``start (pid, xref)`` are people just made, ``edges (child, parent, sex)`` the fetched tree, ``known (pid, xref)``
    who the tree has already: they take their place in a family but nobody walks on from them. Everybody is entered
    once, at the first level; a parent of unknown sex stands as husband. ``depth`` bounds a cyclic tree.
    """
    have = cut(known.select("pid", "xref").unionByName(start.select("pid", "xref")).dropDuplicates(["pid"]))
    level, people, families = start.select("pid"), [], []
    for _ in range(depth):
        up = cut(level.join(edges.withColumnRenamed("child", "pid"), "pid").select("pid", "parent", "sex"))
        if up.isEmpty():
            break
        new = up.select(F.col("parent").alias("pid")).distinct().join(have.select("pid"), "pid", "left_anti")
        new = cut(dense(new, ["pid"], "xref", first_person).withColumn("xref", F.concat(F.lit("I"), F.format_string("%05d", "xref"))))
        first_person += new.count()
        have = cut(have.unionByName(new))
        place = F.when(F.col("sex") == "F", "F").otherwise("M")
        named = up.withColumn("place", place).join(have.select(F.col("pid").alias("parent"), F.col("xref").alias("p")), "parent")
        fam = named.groupBy("pid").agg(F.max(F.when(F.col("place") == "M", F.col("p"))).alias("husband"), F.max(F.when(F.col("place") == "F", F.col("p"))).alias("wife")).join(have.select("pid", F.col("xref").alias("child")), "pid")
        fam = cut(dense(fam, ["child"], "family", first_family).withColumn("family", F.concat(F.lit("F"), F.format_string("%05d", "family"))).select("family", "husband", "wife", "child"))
        first_family += fam.count()
        people.append(new)
        families.append(fam)
        level = new.select("pid")
    empty = start.sparkSession.createDataFrame([], "family string, husband string, wife string, child string")
    return {"people": reduce(DataFrame.unionByName, people, start.select("pid", "xref").where("false")), "families": reduce(DataFrame.unionByName, families, empty)}


def record_candidates(answers: DataFrame, column: str = "value") -> DataFrame:
    """``id, record, name, birth, place, others, url`` of search answers: the principal person, and up to six others named."""
    e = answers.select("id", F.posexplode(F.from_json(column, RECORD)["entries"]).alias("ord", "e")).where("size(e.content.gedcomx.persons) > 0")
    people = F.col("e.content.gedcomx.persons")
    first = F.greatest(F.array_position(F.transform(people, lambda x: F.coalesce(x["principal"], F.lit(False))), True), F.lit(1)).cast("int")
    main = F.element_at(people, first)["display"]
    names = F.transform(people, lambda x, i: F.when(i + 1 != first, F.nullif(x["display"]["name"], F.lit(""))))
    url = F.replace("e.id", F.lit("https://familysearch.org/ark:"), F.lit("https://www.familysearch.org/ark:"))
    return e.select("id", "ord", F.col("e.title").alias("record"), main["name"].alias("name"), main["birthDate"].alias("birth"), main["birthPlace"].alias("place"), F.slice(F.array_compact(names), 1, 6).alias("others"), url.alias("url"))


def external_ids(people: DataFrame, accepted: DataFrame) -> DataFrame:
    """What becomes of each accepted id (``target, fsftid``): ``add``, ``same``, ``different`` or ``no_record``."""
    joined = accepted.join(people.select(F.col("xref").alias("target"), F.col("fsftid").alias("has"), F.lit(True).alias("known")), "target", "left")
    action = F.when(F.col("known").isNull(), "no_record").when(F.coalesce("has", F.lit("")) == "", "add").when(F.col("has") == F.col("fsftid"), "same").otherwise("different")
    return joined.select("target", "fsftid", action.alias("action"))


def imports(people: DataFrame, accepted: DataFrame, first_person: int, first_family: int) -> dict[str, DataFrame]:
    """New families, new people and child links of accepted parent proposals (``ord, target, parents``).

    Children that have parents already, or no record, are left out and named in ``skipped``. A parent whose id
    the tree has is used as it is. The first parent of each sex takes that place; one of unknown sex, or the
    second of a sex, takes the place of a husband unless it is a woman, if that is free.
    """
    child = people.select(F.col("xref").alias("target"), F.col("famc").alias("has"), F.lit(True).alias("known"))
    joined = accepted.join(child, "target", "left")
    skipped = joined.where("known IS NULL OR has IS NOT NULL").select("target", F.when(F.col("known").isNull(), "no_record").otherwise("has_parents").alias("why"))
    fine = joined.where("known AND has IS NULL").select("ord", "target", "parents")
    fam = dense(fine, ["ord", "target"], "family", first_family).withColumn("family", F.concat(F.lit("F"), F.format_string("%05d", "family")))
    blocks = fam.select("ord", "target", "family", F.posexplode("parents").alias("pos", "p")).select("ord", "target", "family", "pos", "p.*")
    blocks = blocks.withColumnRenamed("ord", "o").withColumn("key", F.coalesce(F.nullif("fsftid", F.lit("")), F.concat("target", F.lit("#"), "pos"))).withColumn("ord", F.col("o") * 1000 + F.col("pos"))
    named = upsert(blocks, people.where("fsftid IS NOT NULL").select(F.col("fsftid").alias("key"), "xref"), first_person, "I")
    wife = F.col("sex") == "F"
    places = named.groupBy("ord", "o", "target", "family", "pos", "xref", "sex").count().groupBy("o", "target", "family").agg(
        F.min_by(F.when(~F.coalesce(wife, F.lit(False)), F.col("xref")), F.when(~F.coalesce(wife, F.lit(False)), F.struct((F.col("sex").isNull()).alias("unknown"), "pos"))).alias("husband"),
        F.min_by(F.when(wife, F.col("xref")), F.when(wife, F.col("pos"))).alias("wife"),
    )
    new = named.join(people.select("xref"), "xref", "left_anti")
    first = F.row_number().over(Window.partitionBy("xref").orderBy("ord"))
    return {
        "families": places.select("family", "husband", "wife", F.array("target").alias("children")),
        "people": new.withColumn("nth", first).where("nth = 1").select("xref", "given", "surname", "sex", "birth_date", "birth_place", "death_date", "death_place", "fsftid", "family"),
        "links": fam.select("target", F.concat(F.lit("1 FAMC @"), "family", F.lit("@")).alias("raw")),
        "skipped": skipped,
    }


def new_children(families: DataFrame, accepted: DataFrame) -> DataFrame:
    """Children of accepted proposals (``family, child``) that a family does not have yet, as lines in order. A family may stand in several rows."""
    have = families.select(F.col("xref").alias("family"), F.explode("children").alias("child"))
    fresh = accepted.join(have, ["family", "child"], "left_anti").join(families.select(F.col("xref").alias("family")), "family", "left_semi")
    return fresh.select("family", "child", F.concat(F.lit("1 CHIL @"), "child", F.lit("@")).alias("raw"))
