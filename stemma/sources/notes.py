"""Notes, documents, assets, manifests and review files as DataFrames."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slug
from ..session import importable
from . import linefiles

#: Words of file names that are no part of a person's name.
BOILERPLATE = (
    "llistat|llistats|genealogia|genealogies|bateig|baptisme|matrimoni|casament|defuncio|obit|certificat|registre|partida|expedient|amb|arbol|genealogico|apellido|els|les|de|del|la|el|o"
)
IMAGES = ("jpg", "jpeg", "png", "pdf", "tif", "tiff")


def notes(spark: SparkSession, root: str, found: DataFrame | None = None) -> DataFrame:
    """``path, text`` of all Markdown notes, settings folders left out; ``found`` is what ``files`` gives, where it is there already."""
    found = files(spark, root) if found is None else found
    return linefiles.contents(found.where(F.endswith("name", F.lit(".md"))), root).select("path", F.col("content").cast("string").alias("text"))


def _yaml(block: str) -> tuple[str | None, str | None]:
    """A heading block as JSON, or what is wrong with it: keys, nested by indentation, lists, quoted or plain scalars."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in block.split("\n") if x.strip() and not x.lstrip().startswith("#")]

    pair_of = re.compile(r"^([^\s:][^:]*):(?:\s+(.*))?$")

    def value(at: int, text: str, indent: int) -> tuple[object, int]:
        """What stands behind a key or dash at line ``at - 1``: on its line, or deeper below."""
        if text:
            if text.startswith("[") and text.endswith("]"):
                return [_scalar(x) for x in text[1:-1].split(",") if x.strip()], at
            return _scalar(text), at
        # A list may stand as deep as its key.
        if at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and re.match(r"-(\s|$)", lines[at][1])):
            return inner(at, lines[at][0])
        return [], at

    def inner(at: int, indent: int) -> tuple[object, int]:
        listed = bool(re.match(r"-(\s|$)", lines[at][1]))
        out: list | dict = [] if listed else {}
        while at < len(lines) and lines[at][0] == indent:
            text = lines[at][1]
            if bool(re.match(r"-(\s|$)", text)) != listed:
                break
            if listed:
                rest = text[1:].strip()
                if pair_of.match(rest) and rest[0] not in "\"'[":
                    # A map in a list: it begins on the dash's line.
                    deeper = indent + len(text) - len(rest)
                    lines[at] = (deeper, rest)
                    item, at = inner(at, deeper)
                else:
                    item, at = value(at + 1, rest, indent)
                out.append(item)
                continue
            pair = pair_of.match(text)
            if not pair:
                raise ValueError(text)
            out[pair[1].strip()], at = value(at + 1, (pair[2] or "").strip(), indent)
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError(lines[at][1])
        return out, at

    if not lines:
        return "{}", None
    try:
        out, at = inner(0, lines[0][0])
        if at < len(lines) or not isinstance(out, dict):
            raise ValueError(lines[min(at, len(lines) - 1)][1])
    except ValueError as e:
        return None, f"unreadable line: {str(e)[:60]}"
    return json.dumps(out, ensure_ascii=False), None


def review_rows(text: str) -> list[dict]:
    """The entries of a review file as dictionaries with a verdict ``accept`` of true, false or nothing; refuses other values."""
    out = []
    for entry in review_entries(text)[1]:
        data, error = _yaml("entry:\n" + entry)
        if error:
            raise ValueError(error)
        row = json.loads(data)["entry"][0]
        if row.get("accept") == []:
            row["accept"] = None
        if row.setdefault("accept", None) not in (True, False, None):
            raise ValueError(f"accept must be true, false or empty: {row['accept']}")
        out.append(row)
    return out


def reviews(texts: DataFrame) -> DataFrame:
    """``path, ord, entry, accept, data, error`` of the entries of review files (``path, text``), each file by itself.

    ``entry`` is the text as it stands, with the remarks above it, ``data`` the same as JSON. A file with an entry that
    can't be read, or whose verdict is neither true, false nor empty, has one row with the error.
    """
    importable(texts.sparkSession)

    def read(frames):
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    entries, data = review_entries(text or "")[1], review_rows(text or "")
                    rows += [(path, i, e, d["accept"], json.dumps(d, ensure_ascii=False), None) for i, (e, d) in enumerate(zip(entries, data, strict=True))]
                except ValueError as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "ord", "entry", "accept", "data", "error"]).astype(object).where(lambda f: f.notna(), None)

    return texts.select("path", "text").mapInPandas(read, "path string, ord long, entry string, accept boolean, data string, error string")


def split_without_loss(texts: DataFrame) -> DataFrame:
    """``path, entries, same``: whether a review file's header and entries, put together again, are the file."""
    importable(texts.sparkSession)

    def join(frames):
        for frame in frames:
            parts = [review_entries(t or "") for t in frame["text"]]
            back = ["\n".join([head, *entries] if head or not entries else entries) for head, entries in parts]
            yield pd.DataFrame({"path": frame["path"], "entries": [len(e) for _, e in parts], "same": [b == (t or "") or "\n".join([h, *e]) == (t or "") for b, t, (h, e) in zip(back, frame["text"], parts, strict=True)]})

    return texts.select("path", "text").mapInPandas(join, "path string, entries long, same boolean")


def _scalar(text: str) -> object:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    return None if text in ("null", "~", "") else text


@F.pandas_udf(T.StructType([T.StructField("data", T.StringType()), T.StructField("error", T.StringType())]))
def heading(text: pd.Series) -> pd.DataFrame:
    """The heading block of a note as JSON; null without one, an error if it is unclosed or unreadable."""
    rows = []
    for t in text:
        if t is None or not t.startswith("---\n"):
            rows.append((None, None))
            continue
        end = t.find("\n---", 3)
        rows.append((None, "unclosed") if end < 0 else _yaml(t[4 : end + 1]))
    return pd.DataFrame(rows, columns=["data", "error"])


def headings(found: DataFrame) -> DataFrame:
    """``path, error, keys`` and the known fields of each note's heading."""
    importable(found.sparkSession)
    read = found.select("path", heading("text").alias("h")).select("path", "h.*")
    one = lambda k: F.get_json_object("data", f"$.{k}").alias(k)
    many = lambda k: F.from_json(F.get_json_object("data", f"$.{k}"), "array<string>").alias(k)
    return read.select("path", "error", F.col("data").isNotNull().alias("present"), F.json_object_keys("data").alias("keys"), *map(one, ("tipus", "titol", "arxiu", "classe", "confianca")), *map(many, ("xrefs", "imatges", "descripcio_imatges", "casos", "fonts", "persones")))


def files(spark: SparkSession, root: str) -> DataFrame:
    """``path, name, size`` of all files; contents are not read."""
    return linefiles.listed(spark, root).select("path", F.substring_index("path", "/", -1).alias("name"), "size")


def document_tokens(found: DataFrame) -> DataFrame:
    """``document, tokens`` of files that are documents, by the words of their names; nameless ones are dropped."""
    keep = found.where(~F.startswith("name", F.lit(".")) & ~F.endswith("name", F.lit("_lectura.jpg")) & (F.col("name") != "MANIFEST.sha256"))
    stem = F.replace(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))
    plain = F.regexp_replace(stem, rf"(?iU)\b(?:{BOILERPLATE})\b", " ")
    tokens = F.filter(F.split(slug(plain), " "), lambda t: F.length(t) > 2)
    return keep.select(F.col("path").alias("document"), tokens.alias("tokens")).where(F.size("tokens") > 0)


def assets(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGES, found: DataFrame | None = None) -> DataFrame:
    """``path, digest, size`` of files with an allowed extension; ``found`` is what ``files`` gives, where it is there already."""
    found = files(spark, root) if found is None else found
    kept = found.where(F.lower(F.substring_index("path", ".", -1)).isin(*extensions))
    return linefiles.contents(kept, root).select("path", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("size"))


def manifest(lines: DataFrame) -> DataFrame:
    """``digest, size, path`` from manifest lines; blank lines and remarks are left out."""
    three = F.split(F.trim("value"), r"\s+", 3)
    return lines.where("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(F.get(three, F.lit(0)).alias("digest"), F.get(three, F.lit(1)).try_cast("long").alias("size"), F.get(three, F.lit(2)).alias("path"))


def declared(found: DataFrame) -> DataFrame:
    """``person, document`` from the ``xrefs`` of headings."""
    return found.select(F.col("path").alias("document"), F.explode("xrefs").alias("x")).select(F.trim(F.replace("x", F.lit("@"))).alias("person"), "document")


def wikilinks(found: DataFrame) -> DataFrame:
    """``path, target``: links of notes, without labels and sections."""
    return found.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"), 1)).alias("target"))


def section_embeds(found: DataFrame) -> DataFrame:
    pattern = F.lit(r"!\[\[([^\]#|]+)#([^\]|]+)\]\]")
    both = F.arrays_zip(F.regexp_extract_all("text", pattern, 1).alias("target"), F.regexp_extract_all("text", pattern, 2).alias("section"))
    return found.select("path", F.inline(both))


def review_entries(text: str) -> tuple[str, list[str]]:
    """A review file's header and the text of each entry, nothing lost.

    A run of remarks and blank lines above an entry belongs to it. Above the first entry only its own rule
    (a remark of dashes) does; the rest is the header.
    """
    lines = text.split("\n")
    remark = re.compile(r"^\s*(#.*)?$")
    starts = [i for i, line in enumerate(lines) if re.match(r"^-\s", line)]
    if not starts:
        return text, []
    tops = []
    for k, start in enumerate(starts):
        top = start
        if k:
            while top - 1 > starts[k - 1] and remark.match(lines[top - 1]):
                top -= 1
        else:
            above = start
            while above and not lines[above - 1].strip():
                above -= 1
            while above and re.match(r"^#\s*-{2,}", lines[above - 1]):
                above -= 1
                top = above
        tops.append(top)
    ends = [*tops[1:], len(lines)]
    return "\n".join(lines[: tops[0]]), ["\n".join(lines[a:b]) for a, b in zip(tops, ends, strict=True)]
