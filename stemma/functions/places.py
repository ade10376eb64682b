"""Place strings: components from specific to broad, exonyms, matching and layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, fold

#: Foreign or older spellings and the form that is used.
EXONYMS = {
    "fontanares": "fontanars dels alforins", "fontanars": "fontanars dels alforins", "fontanares de los alforines": "fontanars dels alforins",
    "onteniente": "ontinyent", "mogente": "moixent", "fuente la higuera": "la font de la figuera", "la fuente de la higuera": "la font de la figuera",
    "bocairente": "bocairent", "agres": "agres", "baneres": "banyeres de mariola", "baneras": "banyeres de mariola", "banyeres": "banyeres de mariola",
    "banyeres de mariola": "banyeres de mariola", "valencia": "provincia de valencia", "provincia de valencia": "provincia de valencia",
    "alicante": "alacant", "alacant": "alacant", "comunidad valenciana": "comunitat valenciana", "comunitat valenciana": "comunitat valenciana",
    "catalonia": "catalunya", "cataluna": "catalunya", "catalunya": "catalunya", "spain": "espanya", "espana": "espanya", "espanya": "espanya",
    "france": "franca", "francia": "franca", "castilla la mancha": "castella la manxa", "castilla-la mancha": "castella la manxa", "gerona": "girona",
    "la bisbal de ampurdan": "la bisbal d emporda", "la bisbal demporda": "la bisbal d emporda", "la bisbal d emporda": "la bisbal d emporda",
    "sant julia de ramis": "sant julia de ramis", "san julian de ramis": "sant julia de ramis", "vilasacra": "vila sacra", "vila-sacra": "vila sacra",
    "vila sacra": "vila sacra", "san miquel de campmajor": "sant miquel de campmajor", "sant miquel de campmajor": "sant miquel de campmajor",
    "draguinhan": "draguignan", "ile de porquerolles": "porquerolles", "porquerolles": "porquerolles",
}
#: Components too broad to tell two places apart.
BROAD = ("espanya", "franca", "catalunya", "comunitat valenciana", "castella la manxa", "provincia de valencia", "girona", "alacant", "provence alpes cote dazur", "var", "albacete", "barcelona", "")


def norm_component(c: Column, exonyms: dict[str, str] | None = None) -> Column:
    p = collapse(F.translate(fold(c), "'-", "  "))
    table = EXONYMS if exonyms is None else exonyms
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), p), p)


def place_components(c: Column, exonyms: dict[str, str] | None = None) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: norm_component(x, exonyms)), lambda x: x != "")


def place_key(c: Column, exonyms: dict[str, str] | None = None) -> Column:
    return F.coalesce(F.try_element_at(place_components(c, exonyms), F.lit(1)), F.lit(""))


def place_match(a: Column, b: Column, broad: tuple[str, ...] = BROAD) -> Column:
    """From two component arrays: 1 same first, 0.5 shared among the first two, else 0; broad ones are no evidence."""
    head = lambda x: F.filter(F.slice(x, 1, 2), lambda p: ~p.isin(*broad))
    return (
        F.when((F.size(head(a)) == 0) | (F.size(head(b)) == 0), 0.0)
        .when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), 1.0)
        .when(F.arrays_overlap(head(a), head(b)), 0.5)
        .otherwise(0.0)
    )


def parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def six_levels(c: Column) -> Column:
    """Hamlet, town, postal code (empty), province, region, country: wide levels from the end, specific ones from the start."""
    p = parts(c)
    n = F.size(p)
    at = lambda i: F.coalesce(F.try_element_at(p, i), F.lit(""))
    country = F.when(n >= 2, at(F.lit(-1))).otherwise("")
    region = F.when(n >= 3, at(F.lit(-2))).otherwise("")
    province = F.when(n >= 4, at(F.lit(-3))).otherwise("")
    head = F.greatest(n - 3, F.lit(1))
    hamlet = F.when(head >= 2, at(F.lit(1))).otherwise("")
    town = F.when(head >= 2, at(F.lit(2))).otherwise(at(F.lit(1)))
    return F.when(n == 0, F.lit("")).otherwise(F.concat(hamlet, F.lit(", "), town, F.lit(", , "), province, F.lit(", "), region, F.lit(", "), country))


def flattened(c: Column) -> Column:
    """A six-level place without its postal slot and empty levels."""
    levels = F.transform(F.split(c, ","), lambda x: F.trim(x))
    kept = F.filter(levels, lambda x, i: (x != "") & ~((i == 2) & (F.size(levels) == 6)))
    return F.array_join(kept, ", ")
