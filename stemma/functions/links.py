"""Search links, page numbers and page lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import percent_encode_plus, search_term

#: The fields of the search form in the order in which it posts them.
FIELDS = (
    "pagina", "nom", "a1", "a2", "nompa", "nomma", "a2p", "a2m", "a2op", "a2om", "nomcon", "cognomcj", "cognomq", "llocnaix", "lins", "llocevento",
    "llocpare", "llocmare", "lloctots", "labuopat", "labuapat", "labuomat", "labuamat", "lconyuge", "sexo", "principio", "final", "causa_muerte",
    "principio_evento", "final_evento", "direccion", "profeq", "observa", "tipus", "filtre", "orden",
)
#: Other names of fields.
ALIAS = {
    "given": "nom", "surname": "a1", "surname2": "a2", "father_given": "nompa", "mother_given": "nomma", "father_surname2": "a2p", "mother_surname2": "a2m",
    "gf_paternal_surname2": "a2op", "gf_maternal_surname2": "a2om", "spouse_given": "nomcon", "spouse_surname": "cognomcj", "any_surname": "cognomq",
    "birth_place": "llocnaix", "registered_place": "lins", "event_place": "llocevento", "any_place": "lloctots", "sex": "sexo", "birth_from": "principio",
    "birth_to": "final", "event_from": "principio_evento", "event_to": "final_evento", "profession": "profeq", "sacrament": "tipus", "match": "filtre",
    "order": "orden", "page": "pagina",
}
#: Fields that carry codes and years, never encoded.
LITERAL = ("pagina", "tipus", "filtre", "orden", "sexo", "principio", "final", "principio_evento", "final_evento")
DEFAULTS = {"pagina": "1", "filtre": "P", "orden": "evento"}


def search_url(base: str, terms: dict[str, Column], accents: bool = False) -> Column:
    """The search link with all fields in order. Unknown names are an error."""
    unknown = sorted(set(terms) - set(FIELDS) - set(ALIAS))
    if unknown:
        raise ValueError(f"fields that the form does not have: {', '.join(unknown)}")
    given = {ALIAS.get(k, k): v for k, v in terms.items()}

    def value(field: str) -> Column:
        raw = F.coalesce(given[field].cast("string"), F.lit("")) if field in given else F.lit(DEFAULTS.get(field, ""))
        return raw if field in LITERAL else search_term(raw, accents)

    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *[F.concat(F.lit(f"{f}="), value(f)) for f in FIELDS]))


def camel_params(terms: dict[str, str | None], prefix: str) -> dict[str, str]:
    """``birth_place`` with prefix ``q`` becomes ``q.birthPlace``; empty values are dropped."""
    out = {}
    for key, value in terms.items():
        if value not in (None, ""):
            head, *rest = key.split("_")
            out[f"{prefix}.{head}{''.join(x.capitalize() for x in rest)}"] = str(value)
    return out


def record_link(base: str, surname: Column, given: Column, place: Column, year: Column, span: int = 3) -> Column:
    """A record-search link: surname, first given name before a comma, place, and a span of years if one is known."""
    fields = [
        F.concat(F.lit("q.surname="), percent_encode_plus(F.coalesce(surname, F.lit("")))),
        F.concat(F.lit("q.givenName="), percent_encode_plus(F.trim(F.substring_index(F.coalesce(given, F.lit("")), ",", 1)))),
        F.concat(F.lit("q.birthLikePlace="), percent_encode_plus(F.coalesce(place, F.lit("")))),
        F.when(year.isNotNull(), F.concat(F.lit("q.birthLikeDate.from="), (year - span).cast("string"))),
        F.when(year.isNotNull(), F.concat(F.lit("q.birthLikeDate.to="), (year + span).cast("string"))),
    ]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *fields))


def page_segment(n: Column) -> Column:
    """Two digits at least; null below one."""
    return F.when(n >= 1, F.format_string("%02d", n.cast("int")))


def page_list(spec: Column) -> Column:
    """``3,9,11-13`` as sorted distinct numbers; null if a range runs backwards or an item is no number."""
    items = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")
    low = lambda x: F.trim(F.get(F.split(x, "-"), F.lit(0))).try_cast("int")
    high = lambda x: F.trim(F.element_at(F.split(x, "-"), -1)).try_cast("int")
    fine = F.forall(items, lambda x: low(x).isNotNull() & high(x).isNotNull() & (low(x) <= high(x)) & (F.size(F.split(x, "-")) <= 2))
    return F.when(fine, F.sort_array(F.array_distinct(F.flatten(F.transform(items, lambda x: F.sequence(low(x), F.greatest(low(x), high(x))))))))


def image_url(base: str, book: Column, page: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), book.cast("string"), F.lit("/"), page_segment(page))
