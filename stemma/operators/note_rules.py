"""Rules for the headings of notes, their images, links and section embeds, and names beside ids in prose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, ratio_bound, sequence_ratio
from ..session import importable
from . import quality

#: The vocabulary of headings.
KINDS = ("transcripcio", "cas", "recerca", "informe", "familia", "persona")
CLASSES = ("original", "index", "consulta", "memoria", "narrativa")
TRUST = ("alta", "mitjana", "baixa")
FORBIDDEN = "cr_id"


def heading_violations(found: DataFrame, people: DataFrame, archives: tuple[str, ...], files: DataFrame) -> DataFrame:
    """``rule, id`` (the note's path) of headings (``notes.headings``), against ``people (xref)`` and ``files (path, name)``."""
    h = found.withColumn("id", F.col("path"))
    ok = h.where("error IS NULL AND present")
    transcript = ok.where("tipus = 'transcripcio'")
    ids = ok.select("id", F.explode("xrefs").alias("value"))
    images = ok.select("id", F.explode("imatges").alias("image"))
    name = F.substring_index("image", "/", -1)
    exist = files.select(F.col("path").alias("image")).distinct()
    value = lambda df, c: df.select("id", F.col(c).alias("value"))
    rules = [
        ("unreadable", h.where("error IS NOT NULL").select("id")),
        ("forbidden_key", ok.where(F.array_contains("keys", FORBIDDEN)).select("id")),
        ("kind", ok.where(~F.coalesce(F.col("tipus").isin(*KINDS), F.lit(False))).select("id")),
        ("class", transcript.where(~F.coalesce(F.col("classe").isin(*CLASSES), F.lit(False))).select("id")),
        ("trust", quality.outside(value(ok, "confianca"), TRUST).select("id")),
        ("title_missing", quality.required(value(transcript, "titol"))),
        ("title_repeated", quality.repeated(ok.select("id", F.nullif("titol", F.lit("")).alias("key")))),
        ("id_form", quality.malformed(ids, r"^@I\d{5}@$")),
        ("id_unknown", quality.missing(ids.where(F.col("value").rlike(r"^@I\d{5}@$")).select("id", F.trim(F.replace("value", F.lit("@"))).alias("key")), people.select(F.col("xref").alias("key"))).select("id")),
        ("image_missing", images.join(exist, "image", "left_anti").select("id")),
        ("image_ambiguous", images.join(exist, "image", "left_semi").select("id", name.alias("name")).join(files.groupBy("name").count().where("count > 1"), "name").select("id")),
        ("captions", ok.where("size(descripcio_imatges) > 0 AND size(descripcio_imatges) <> coalesce(size(imatges), 0)").select("id")),
    ]
    if archives:
        rules.append(("archive", quality.outside(value(ok, "arxiu"), archives).select("id")))
    return quality.violations(rules)


def link_violations(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links (``path, target``) that resolve to no note, or to several, by the name of the file."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    targets = found.select(stem.alias("key"))
    return quality.violations([("link", quality.not_unique(links.select(F.col("path").alias("id"), F.substring_index("target", "/", -1).alias("key")), targets))])


def embed_violations(embeds: DataFrame, found: DataFrame) -> DataFrame:
    """Section embeds (``path, target, section``) whose note has no such heading."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    heads = found.select(stem.alias("target"), F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^#+\s+(.*?)\s*$"), 1)).alias("section")).distinct()
    return quality.violations([("embed", embeds.join(heads, ["target", "section"], "left_anti").select(F.col("path").alias("id")))])


#: An id with a name behind it, and words behind an id that are no part of a name.
BESIDE = r"(?U)@(I\d{5})@\s*[*_`]{0,2}((?:[A-ZÀ-Ú][\wÀ-ɏ'’]*(?:\s+(?:i|de|del|la)\s+)?[ ]?){1,4})"
NO_NAMES = ("sosa", "els", "que", "amb", "del", "les", "una", "seu", "seua")


def names_beside_ids(texts: DataFrame, people: DataFrame, least: float = 0.85) -> DataFrame:
    """``path, line, xref, name, rule``: ids with a name behind them that nobody has (``unknown_id``), or that somebody else has (``other_person``).

    ``texts (path, text)``; ``people (xref, tokens)`` has the folded words of each person's name. A name of two words
    and more (of three letters and more) fits if one of its words is similar to one of the person's; one word alone
    may be what others call a person, and is not judged. Only distinct pairs of words are compared.
    """
    importable(texts.sparkSession)
    lines = texts.select("path", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    both = F.arrays_zip(F.regexp_extract_all("raw", F.lit(BESIDE), 1).alias("xref"), F.regexp_extract_all("raw", F.lit(BESIDE), 2).alias("name"))
    said = lines.select("path", (F.col("at") + 1).alias("line"), F.posexplode(both).alias("nth", "z")).select("path", "line", "nth", "z.xref", F.trim("z.name").alias("name"))
    said = said.join(people.select("xref", F.col("tokens").alias("own")), "xref", "left")
    unknown = said.where("own IS NULL").select("path", "line", "xref", "name", F.lit("unknown_id").alias("rule"))
    words = F.filter(F.split(fold(F.col("name")), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*NO_NAMES))
    judged = said.where("own IS NOT NULL").withColumn("words", words).where(F.size("words") > 1)
    met = judged.select("path", "line", "nth", "xref", "name", F.explode("words").alias("w"), "own").select("path", "line", "nth", "xref", "name", "w", F.explode_outer("own").alias("t"))
    distinct = met.where("t IS NOT NULL").select("w", "t").distinct()
    near = distinct.where((F.col("w") == F.col("t")) | ((ratio_bound(F.col("w"), F.col("t")) >= least) & (sequence_ratio(F.col("w"), F.col("t")) >= least))).withColumn("near", F.lit(True))
    fits = met.join(near, ["w", "t"], "left").groupBy("path", "line", "nth", "xref", "name").agg(F.coalesce(F.bool_or("near"), F.lit(False)).alias("fits"))
    return unknown.unionByName(fits.where("NOT fits").select("path", "line", "xref", "name", F.lit("other_person").alias("rule")))
