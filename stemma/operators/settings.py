"""Settings of a project as values and short tables; which line file counts; who made what."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Misconfigured
from ..functions.places import norm_component
from ..session import dimension


def setting(config: dict, *keys: str, default: object = None) -> object:
    """A nested value; nothing and an empty text count as unset."""
    node: object = config
    for key in keys:
        if not isinstance(node, dict) or key not in node:
            return default
        node = node[key]
    return default if node is None or node == "" else node


@dataclass(frozen=True)
class Scalars:
    """Settings that are single values, with their defaults; ``None`` is unset."""

    export: str | None
    floor: str | None
    counting_root: str | None
    default_parish: str
    marriage_age: int
    archives: dict[str, str]


def scalars(config: dict) -> Scalars:
    """The single values of a configuration. Texts that are empty count as unset."""
    text = lambda *keys: None if (v := setting(config, *keys)) is None else str(v)
    age = setting(config, "apv", "edat_de_casar", default=24)
    if not str(age).strip().isdigit():
        raise Misconfigured(f"the age of marriage is no number: {age}")
    archives = setting(config, "frontmatter", "arxius", default={}) or {}
    return Scalars(text("exportacio_familysearch"), text("apv", "terra_documentada"), text("estat", "arrel"), text("apv", "parroquia_per_defecte") or "", int(age), {str(k): str(v) for k, v in archives.items()})


def root_id(config: dict) -> str:
    """Who fetches begin with; a project has to say so."""
    found = setting(config, "familysearch", "arrel")
    if found is None:
        raise Misconfigured("familysearch: arrel is not set")
    return str(found)


def is_backup(name: str) -> bool:
    """Whether a file name ends in a time, as dated copies do."""
    return re.fullmatch(r".*_\d{8}-\d{6}", name.rsplit(".", 1)[0]) is not None


def tree_file(names: list[str], configured: str | None = None, example: str | None = None) -> str:
    """The line file that counts: the configured one, else the only one that is no dated copy, else the example; never a guess between two."""
    if configured:
        if configured not in names:
            raise Misconfigured(f"{configured} is not there")
        return configured
    found = sorted(n for n in names if n.endswith(".ged") and not is_backup(n) and n != example)
    if len(found) == 1:
        return found[0]
    if not found and example in names:
        return example
    raise Misconfigured("no line file" if not found else f"more than one line file: {', '.join(found)}")


def agent(component: str, project: str | None = None, contact: str | None = None, default: str = "genealogy", purpose: str = "personal research") -> str:
    """How requests name themselves, with a way to be reached if one is set."""
    who = f"; {contact}" if contact else ""
    return f"{project or default}-{component}/0.1 ({purpose}{who})"


def towns(spark: SparkSession, config: dict) -> DataFrame:
    """``region, ord, needle``: towns of the regions in their order, normalised as places are, with exonyms."""
    rows = [(region, town) for region, listed in (setting(config, "regions", default={}) or {}).items() for town in listed]
    made = dimension(spark, [(r, i, t) for i, (r, t) in enumerate(rows)], "region string, ord int, town string")
    return made.select("region", "ord", norm_component(F.col("town")).alias("needle"))


def guides(spark: SparkSession, config: dict) -> DataFrame:
    """``region, score, note, links``: guides with their defaults, and a row for places of no region."""
    given = setting(config, "guides", default={}) or {}
    rows = [(k, float(v.get("score") or 0), v.get("note") or "", sorted((v.get("links") or {}).items())) for k, v in ({"unknown": {}} | given).items()]
    return dimension(spark, rows, "region string, score double, note string, links array<struct<name:string,url:string>>")


def fallbacks(spark: SparkSession, config: dict) -> DataFrame:
    """``region, ord, needle``: needles in lower case, in their order."""
    rows = [(region, i, needle.lower()) for i, (needle, region) in enumerate((setting(config, "fallbacks", default={}) or {}).items())]
    return dimension(spark, rows, "region string, ord int, needle string")


def edited_by(contributors: Column, me: str) -> Column:
    """Whether a map of contributors has this one."""
    return F.coalesce(F.map_contains_key(contributors, F.lit(me)), F.lit(False))


def provenance(entries: DataFrame, fresh: Column, taken: Column) -> DataFrame:
    """``line``: where what a report says about parents comes from: asked now, a snapshot with how many it covers, or nothing."""
    counted = entries.agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("ready", "stuck")).alias("known"), F.max(fresh).alias("fresh"), F.max(taken).alias("taken"))
    return counted.select(
        F.when(F.col("fresh"), F.concat(F.lit("asked now: "), F.col("known").cast("string"), F.lit(" of "), F.col("n").cast("string")))
        .when(F.col("taken").isNotNull(), F.concat(F.lit("snapshot of "), "taken", F.lit(": "), F.col("known").cast("string"), F.lit(" of "), F.col("n").cast("string")))
        .otherwise("never asked")
        .alias("line")
    )


def surnames(people: DataFrame) -> DataFrame:
    """``person, kin``: the set of normalised surnames of each person's parents; ``people (person, surname_norm)`` has a row for each parent."""
    return people.groupBy("person").agg(F.array_sort(F.collect_set(F.nullif("surname_norm", F.lit("")))).alias("kin"))


def source_label(n: Column, file: Column) -> Column:
    """What a report calls its source: a file and how many people it has."""
    return F.concat(file, F.lit(" ("), n.cast("string"), F.when(n == 1, " person)").otherwise(" people)"))


def snapshot_person(snapshot: DataFrame) -> DataFrame:
    """People that a snapshot names as parents, with the columns of a person; what it does not know is null."""
    p = snapshot.select("xref", F.explode("parents").alias("p"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    return p.select(F.col("xref").alias("child"), F.col("p.pid").alias("pid"), F.col("p.given").alias("given"), F.col("p.surname").alias("surname"), F.col("p.sex").alias("sex"), F.col("p.birth_date").alias("birth_date"), F.col("p.birth_place").alias("birth_place"), none("death_date"), none("death_place"))


def rebuilt(preamble: str, header: str, chunks: list[str], note: list[str] | None = None) -> str:
    """A review file from its parts: preamble, remarks, header and the entries as they were written."""
    remarks = "\n".join(f"# {x}".rstrip() for x in note or [])
    return "\n".join(x for x in (preamble.rstrip("\n"), remarks, header.strip("\n"), *(c.strip("\n") for c in chunks)) if x) + "\n"


def chunk_verdict(chunk: str) -> bool | None:
    """What the text of one entry says about ``accept``; nothing if it does not say."""
    found = re.search(r"(?m)^\s*(?:-\s+)?accept:\s*(true|false)\s*(?:#.*)?$", chunk)
    return None if found is None else found[1] == "true"
