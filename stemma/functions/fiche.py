"""Field extraction from saved index pages: inline and bold pairs, rows and cells, kinship, results, quota lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold_label, unescape, unescape_all

#: The order and the stems of kinship rows.
KIN_ORDER = ("Interessat/da", "Cònjuge", "Pare", "Mare", "Avi Patern", "Àvia paterna", "Avi Matern", "Àvia Materna")
KIN_STEMS = {
    "interessat": "Interessat/da", "interesado": "Interessat/da", "conjuge": "Cònjuge", "conyuge": "Cònjuge", "avi patern": "Avi Patern", "abuelo paterno": "Avi Patern",
    "avia paterna": "Àvia paterna", "abuela paterna": "Àvia paterna", "avi matern": "Avi Matern", "abuelo materno": "Avi Matern", "avia materna": "Àvia Materna",
    "abuela materna": "Àvia Materna", "pare": "Pare", "padre": "Pare", "mare": "Mare", "madre": "Mare",
}


def clean(c: Column) -> Column:
    """A fragment without tags, entities decoded, blanks single."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", "\n")), r"[ \t\xa0]+", " "), F.lit(" \n\t\r"))


def pairs(pages: DataFrame, labels: DataFrame, id_column: str = "id", html: str = "html", rows: DataFrame | None = None) -> DataFrame:
    """``id, key, value``: first value of each known field, from small/bold pairs, bold labels, then table cells.

    ``labels (label, key)`` has folded labels, few enough to be sent to every task. A row all of whose cells are labels
    is a header, not pairs. ``rows`` is what ``table_rows`` gives, where it is there already. Only named fields move.
    """
    p = pages.select(F.col(id_column).alias("id"), F.col(html).alias("html"))
    inline, bold = r"(?is)<small[^>]*>(.*?)</small>\s*(?:<br\s*/?>)?\s*<b[^>]*>(.*?)</b>", r"(?is)<b[^>]*>([^<]{2,40}?):?\s*</b>\s*([^<]*)"
    both = []
    for rank, pattern in enumerate((inline, bold)):
        z = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), 1).alias("label"), F.regexp_extract_all("html", F.lit(pattern), 2).alias("value"))
        found = p.select("id", F.lit(rank).alias("rank"), F.posexplode(z).alias("pos", "z")).select("id", "rank", "pos", clean(F.col("z.label")).alias("label"), clean(F.col("z.value")).alias("value"))
        both.append(found.select("id", "rank", "pos", fold_label(F.col("label")).alias("folded"), "value"))
    r = (table_rows(p) if rows is None else rows).crossJoin(F.broadcast(labels.agg(F.collect_set("label").alias("known"))))
    r = r.where("size(cells) > 1").withColumn("each", F.transform("cells", lambda c: F.struct(c.alias("cell"), fold_label(c).alias("folded"))))
    header = (F.size(F.filter("cells", lambda c: c != "")) >= 3) & F.forall("each", lambda x: (x["cell"] == "") | F.array_contains("known", x["folded"]))
    plain = r.where(~header & kin_role(F.get("cells", F.lit(0))).isNull())
    at = F.sequence(F.lit(0), F.greatest(F.size("each") - 2, F.lit(0)), F.lit(2))
    two = F.transform(at, lambda i: F.struct((F.col("row") * 1000 + i).alias("pos"), F.get("each", i)["folded"].alias("folded"), F.get("cells", i + 1).alias("value")))
    both.append(plain.select("id", F.lit(2).alias("rank"), F.inline(two)))
    every = both[0].unionByName(both[1]).unionByName(both[2]).where("value NOT IN ('', '...')")
    named = every.join(F.broadcast(labels.select(F.col("label").alias("folded"), "key")), "folded")
    return named.groupBy("id", "key").agg(F.min_by("value", F.struct("rank", "pos")).alias("value"))


#: The order of the reference row of older pages.
LEGACY = ("sacrament", "identificador", "book", "folio", "entry", "sex")


def legacy(pages: DataFrame, known: DataFrame, id_column: str = "id", html: str = "html") -> DataFrame:
    """``id, key, value``: the reference row of older saved pages, which stands right behind a row of its labels.

    Only for pages without an ``identificador`` among ``known (id, key, value)``, and for keys that those lack.
    """
    header = r"(?is)Sagrament.*?Identificador.*?Llibre.*?Foli.*?Apunt.*?Sexe(.*)$"
    p = pages.select(F.col(id_column).alias("id"), F.regexp_extract(html, header, 1).alias("after")).where("after <> ''")
    p = p.join(known.where("key = 'identificador'").select("id"), "id", "left_anti")
    c = cells(p.select("id", F.regexp_extract("after", r"(?is)(<tr[^>]*>.*?</tr>)", 1).alias("html")))
    named = c.where((F.col("col") < len(LEGACY)) & (F.col("cell") != "")).select("id", F.element_at(F.array(*map(F.lit, LEGACY)), F.col("col") + 1).alias("key"), F.col("cell").alias("value"))
    return named.join(known.select("id", "key"), ["id", "key"], "left_anti").select("id", "key", "value")


def table_rows(pages: DataFrame, id_column: str = "id", html: str = "html") -> DataFrame:
    """``id, row, cells`` of all table rows that have cells: a row of a table stays one, so its cells are seen together without moving."""
    rows = pages.select(F.col(id_column).alias("id"), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row", "r"))
    raw = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda c: F.regexp_replace(c, r"<[^>]+>", "\n"))
    plain = rows.select("id", "row", unescape_all(raw).alias("cells")).where("size(cells) > 0")
    return plain.select("id", "row", F.transform("cells", lambda c: F.trim(F.regexp_replace(c, r"[ \t\xa0]+", " "), F.lit(" \n\t\r"))).alias("cells"))


def cells(p: DataFrame) -> DataFrame:
    """``id, row, col, cell`` of all table rows."""
    return table_rows(p).select("id", "row", F.posexplode("cells").alias("col", "cell"))


def kin_role(label: Column) -> Column:
    """The role whose longest stem the folded label begins with, which is computed once: a lambda over an array of one."""

    def of(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for stem in sorted(KIN_STEMS, key=len):
            out = F.when(F.startswith(t, F.lit(stem)), F.lit(KIN_STEMS[stem])).otherwise(out)
        return out

    return F.element_at(F.transform(F.array(fold_label(label)), of), 1)


def kin(pages: DataFrame, id_column: str = "id", html: str = "html", rows: DataFrame | None = None) -> DataFrame:
    """``id, role, given, surname1, surname2, birthplace`` in the fixed order of roles; ``rows`` as for ``pairs``."""
    c = (table_rows(pages, id_column, html) if rows is None else rows).where("size(cells) > 1")
    at = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    r = c.select("id", "row", kin_role(F.get("cells", F.lit(0))).alias("role"), at(1).alias("given"), at(2).alias("surname1"), at(3).alias("surname2"), at(4).alias("birthplace"))
    return r.where("role IS NOT NULL").withColumn("ord", F.array_position(F.array(*map(F.lit, KIN_ORDER)), F.col("role")))


def results(pages: DataFrame, id_column: str = "id", html: str = "html", rows: DataFrame | None = None) -> DataFrame:
    """``id, row, book, from, to, folio, registro`` of hit lists; ``rows`` as for ``pairs``."""
    c = (table_rows(pages, id_column, html) if rows is None else rows).where("size(cells) > 1")
    joined = c.select("id", "row", F.array_join("cells", " ").alias("text"))
    ref = r"(?i)\b([A-Z]{1,3}-?\d{0,3})\s*\((\d{4})[_\-](\d{4})\)\s*(?:Folio|Foli)\s*(\d+\w?)"
    part = lambda k, name: F.regexp_extract("text", ref, k).alias(name)
    return joined.where(F.col("text").rlike(ref)).select("id", "row", part(1, "book"), part(2, "from"), part(3, "to"), part(4, "folio"), F.regexp_extract("text", r"(?i)Registro\s*num\.?\s*(\d+)", 1).alias("registro"))


def quota(page: Column) -> Column:
    """``used`` and ``limit`` as the archive writes them, null where it does not."""
    t = F.regexp_replace(page, r"<[^>]+>", " ")
    used = F.regexp_extract(t, r"(?is)ya\s+has?\s+realizado\s+(\d+)", 1).try_cast("int")
    most = F.regexp_extract(t, r"(?is)m[áa]ximo\s+de\s+(\d+)", 1).try_cast("int")
    return F.struct(used.alias("used"), most.alias("limit"))


def references(c: Column) -> Column:
    """Image references in a text, distinct and sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(ark:/\d+/[\w\-:]+|DGS\s*\d+)"), 1)))
