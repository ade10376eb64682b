"""Personal names: surname parts, given-name tokens, bilingual variants and their scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, split_words

#: Bilingual pairs of given names. A name may stand in several groups.
NAME_GROUPS = (
    ("agusti", "agustin", "agustino"), ("andreu", "andres"), ("anna", "ana"), ("antoni", "antonio", "antoni joan"), ("antonia",),
    ("bartomeu", "bartolome"), ("bernat", "bernardo"), ("carme", "carmen"), ("caterina", "catalina"), ("consol", "consuelo"),
    ("dolors", "dolores"), ("elena", "helena"), ("esteve", "esteban", "estevan"), ("felip", "felipe"), ("ferran", "fernando"),
    ("francesc", "francisco"), ("francesca", "francisca"), ("gaieta", "cayetano"), ("guillem", "guillermo"), ("jaume", "jaime"),
    ("joan", "juan"), ("joaquim", "joaquin"), ("joaquima", "joaquina"), ("jordi", "jorge"), ("josep", "jose"), ("josepa", "josefa"),
    ("llorenc", "lorenzo"), ("lluis", "luis"), ("lluisa", "luisa"), ("magdalena",), ("manuela",), ("margarida", "margarita"),
    ("maria",), ("marti", "martin"), ("miquel", "miguel"), ("montserrat", "montserrada"), ("narcis", "narciso"), ("neus", "nieves"),
    ("pasqual", "pascual"), ("pasquala", "pascuala"), ("pere", "pedro"), ("purificacio", "purificacion"), ("ramon", "raimundo"),
    ("roser", "rosario"), ("salvador",), ("teresa", "theresa"), ("tomas",), ("vicent", "vicente"), ("victoria", "victoriano"), ("victorina",),
)


def variants_of(groups=NAME_GROUPS) -> dict[str, list[str]]:
    out: dict[str, set[str]] = {}
    for group in groups:
        for name in group:
            out.setdefault(name, set()).update(group)
    return {k: sorted(v) for k, v in sorted(out.items())}


def _map(entries: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def norm_surname(c: Column) -> Column:
    s = F.replace(fold(c), F.lit("'"), F.lit(" "))
    s = F.regexp_replace(s, r"(?U)\b(i|y)\b", " ")
    s = F.regexp_replace(s, r"(?U)\b(de|del|de la|de las|de los|dels|d|la|las|los|el)\b", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def surname_parts(c: Column) -> Column:
    return split_words(norm_surname(c))


def given_tokens(c: Column) -> Column:
    g = F.replace(fold(c), F.lit(","), F.lit(" "))
    g = F.regexp_replace(g, r"(?U)\bmaria del?\b", "maria")
    return F.filter(F.split(g, " "), lambda t: (t != "") & ~t.isin("de", "del", "la"))


def given_variants(token: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(variants_of()), token), F.array(token))


def given_match(a: Column, b: Column) -> Column:
    """1 for equal lists, 1 or 0.8 if the first names are variants, 0.5 if any are, else 0."""
    first_a, first_b = F.try_element_at(a, F.lit(1)), F.try_element_at(b, F.lit(1))
    every = lambda x: F.flatten(F.transform(x, given_variants))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .when(a == b, 1.0)
        .when(F.arrays_overlap(given_variants(first_a), given_variants(first_b)), F.when(first_a == first_b, 1.0).otherwise(0.8))
        .when(F.arrays_overlap(every(a), every(b)), 0.5)
        .otherwise(0.0)
    )


def surname_score(a: Column, b: Column) -> Column:
    """3 for equal parts; 2.25 for the same first part, but 1.2 if later parts differ; 1.2 for any shared part."""
    same_first = F.try_element_at(a, F.lit(1)) == F.try_element_at(b, F.lit(1))
    later_a, later_b = F.slice(a, 2, 100), F.slice(b, 2, 100)
    clash = (F.size(later_a) > 0) & (F.size(later_b) > 0) & ~F.arrays_overlap(later_a, later_b)
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .when(a == b, 3.0)
        .when(~F.arrays_overlap(a, b), 0.0)
        .when(same_first & clash, 1.2)
        .when(same_first, 2.25)
        .otherwise(1.2)
    )


def first_word(c: Column) -> Column:
    return F.coalesce(F.try_element_at(split_words(F.coalesce(c, F.lit(""))), F.lit(1)), F.lit(""))


def second_word(c: Column) -> Column:
    return F.coalesce(F.try_element_at(split_words(F.coalesce(c, F.lit(""))), F.lit(2)), F.lit(""))
