"""Linking documents to people: fuzzy tokens, declared links, coverage by siblings, discrepancies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio_bound, sequence_ratio
from ..session import cut, importable
from .resolve import copies

#: Fixed value: least similarity of two tokens.
SIMILAR = 0.85


def similar_tokens(left: DataFrame, right: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``l, r``: pairs of distinct tokens (three letters and more) whose ratio reaches ``least``.

    A ratio this high needs many pairs of letters in common: the blocks that match hold at least
    ``least / 2`` of all letters, and there is one block more at most than letters that don't match. So a token of
    ``n`` pairs shares at least ``need`` of them, and one of its ``n - need + 1`` rarest. Tokens meet through those
    (repeats of a pair numbered), so common pairs join little; the length bound cuts further, and only then are
    tokens compared.
    """
    importable(left.sparkSession)
    size, i = F.length("token"), F.col("i")
    either = left.select("token").unionByName(right.select("token")).where(F.length("token") > 2).distinct()
    pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.substring(F.col("token"), k, F.lit(2)))
    each = either.select("token", size.alias("n"), F.posexplode(pairs).alias("i", "g"))
    each = each.select("token", "n", "g", F.row_number().over(Window.partitionBy("token", "g").orderBy(i)).alias("turn"))
    often = each.groupBy("g", "turn").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("token").orderBy("often", "g", "turn"))
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * (2 * (1.5 * least - 1) / (2 - least)) - 1 - 1e-9))
    kept = cut(each.join(often, ["g", "turn"]).withColumn("rank", rank).where(F.col("rank") <= F.col("n") - need).select("token", "g", "turn"))
    a = kept.join(left.select("token").distinct(), "token", "left_semi").select(F.col("token").alias("l"), "g", "turn")
    b = kept.join(right.select("token").distinct(), "token", "left_semi").select(F.col("token").alias("r"), "g", "turn")
    met = a.join(b, ["g", "turn"]).where(ratio_bound(F.col("l"), F.col("r")) >= least).select("l", "r").distinct()
    return met.where((F.col("l") == F.col("r")) | (sequence_ratio(F.col("l"), F.col("r")) >= least))


def fuzzy(people: DataFrame, documents: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``person, document``: every token (longer than two letters) of the person has a similar one in the document."""
    p = people.select("person", F.explode(F.array_distinct(F.filter("tokens", lambda x: F.length(x) > 2))).alias("token"))
    d = documents.select("document", F.explode(F.array_distinct("tokens")).alias("token"))
    near = similar_tokens(p, d, least)
    need = p.groupBy("person").agg(F.count("*").alias("need"))
    hit = p.join(near, p.token == near.l).select("person", "l", "r").join(d.withColumnRenamed("token", "r"), "r").groupBy("person", "document").agg(F.countDistinct("l").alias("got"))
    return hit.join(need, "person").where("got = need").select("person", "document")


def fuzzy_classes(people: DataFrame, documents: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``what, person, document, first_person, first_document``: the links of ``fuzzy`` by classes of the same tokens, so repeated names do not multiply.

    A row ``pair`` links the first person of a class with the first document of one; every other member is a row
    ``person`` or ``document`` beside the first of its class, and has the links of that one. Expanded they are all links.
    """
    told = F.array_sort(F.array_distinct(F.filter("tokens", lambda x: F.length(x) > 2))).alias("tokens")
    (p, p_copies), (d, d_copies) = (copies(rows.select(F.col(name).alias("id"), told), ["tokens"]) for rows, name in ((people, "person"), (documents, "document")))
    links = fuzzy(p.withColumnRenamed("id", "person"), d.withColumnRenamed("id", "document"), least)
    none = {x: F.lit(None).cast(rows.schema["id"].dataType) for x, rows in (("person", p), ("document", d))}
    out = links.select(F.lit("pair").alias("what"), "person", "document", none["person"].alias("first_person"), none["document"].alias("first_document"))
    out = out.unionByName(p_copies.select(F.lit("person").alias("what"), F.col("id").alias("person"), none["document"].alias("document"), F.col("first").alias("first_person"), none["document"].alias("first_document")))
    return out.unionByName(d_copies.select(F.lit("document").alias("what"), none["person"].alias("person"), F.col("id").alias("document"), none["person"].alias("first_person"), F.col("first").alias("first_document")))



def with_declared(guessed: DataFrame, declared: DataFrame, covered: DataFrame) -> DataFrame:
    """Declared links, and guesses whose document no declaration covers."""
    fine = guessed.join(covered.select("document").distinct(), "document", "left_anti").select("person", "document")
    return declared.select("person", "document").unionByName(fine).distinct()


def covered_by_stem(files: DataFrame, notes: DataFrame) -> DataFrame:
    """``document``: files whose name begins with the stem of a note in the same folder."""
    return files.join(notes.select(F.col("folder"), "stem"), "folder").where(F.startswith("name", "stem")).select("document").distinct()


def discrepancies(guessed: DataFrame, declared: DataFrame) -> DataFrame:
    """Links on one side only, and on which."""
    g, d = guessed.select("person", "document", F.lit(True).alias("g")), declared.select("person", "document", F.lit(True).alias("d"))
    both = g.join(d, ["person", "document"], "full_outer")
    return both.where("g IS NULL OR d IS NULL").select("person", "document", F.when(F.col("g").isNull(), "declared").otherwise("guessed").alias("side"))


def corroboration(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Documents of a person's parents that are not the person's own."""
    up = edges.select(F.col("child").alias("person"), "parent").join(links.select(F.col("person").alias("parent"), "document"), "parent").select("person", "document").distinct()
    return up.join(links, ["person", "document"], "left_anti")


def origins(assets: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes whose text names an asset or its stem: names found in texts meet names of files, so no text meets every file."""
    said = notes.select("note", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_\-.]+)"), 1))).alias("word"))
    names = assets.select("asset", F.explode(F.array_distinct(F.array("name", F.regexp_replace("name", r"\.[^.]*$", "")))).alias("word"))
    return names.join(said, "word").select("asset", "note").distinct()
