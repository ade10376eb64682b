"""Scalar cases of the text, name, place, date and link functions."""

import pytest
from pyspark.sql import functions as F

from stemma.functions import dates, links, names, places, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "year"),
    [("16 NOV 1992", 1992), ("1842", 1842), ("MAR 1845", 1845), ("1992-11-16", 1992), ("ANTES 23 APR 1775", 1775), ("APROXIMADAMENTE 1800", 1800), ("ABT. 1700", 1700), ("sense data", None), ("", None), (None, None), ("912", None)],
)
def test_year(spark, raw, year):
    assert value(spark, dates.parse_year(F.lit(raw).cast("string"))) == year


@pytest.mark.parametrize(
    ("raw", "shown"),
    [("1859-10-17", "17 OCT 1859"), ("1859-10", "OCT 1859"), ("1859", "1859"), ("26 DEC 1803", "26 DEC 1803"), ("APROXIMADAMENTE 1800", "ABT 1800"), ("about 1859-10-07", "ABT 7 OCT 1859"), ("qui sap", "qui sap"), (None, None)],
)
def test_rendered_date(spark, raw, shown):
    assert value(spark, dates.render_date(F.lit(raw).cast("string"))) == shown


def test_year_scores_and_marriage(spark):
    score = lambda a, b: value(spark, dates.year_match(F.lit(a).cast("int"), F.lit(b).cast("int")))
    assert score(1800, 1800) == 1 and score(1800, 1803) == 0 and score(None, 1800) == 0
    assert abs(score(1800, 1801) - 2 / 3) < 1e-12
    wed = lambda *x: value(spark, dates.marriage_year(*[F.lit(v).cast("int") for v in x]))
    assert wed(1747, None, None) == 1771 and wed(1600, 1620, None) == 1619 and wed(None, None, 1700) == 1722 and wed(None, 1650, None) == 1649 and wed(None, None, None) is None


def test_fold_and_words(spark):
    assert value(spark, text.fold(F.lit("  ÀLÇAR\t ñandú  "))) == "alcar nandu"
    assert value(spark, text.fold(F.lit(None).cast("string"))) == ""
    assert value(spark, text.slug(F.lit("Acta d'Òbit_1871 (còpia)"))) == "acta d obit 1871 copia"
    assert value(spark, text.words(F.lit("---\na: b\n---\nEl gos\n| taula |\nÉs meu"))) == ["el", "gos", "és", "meu"]
    assert value(spark, text.shingles(F.split(F.lit("a b c d"), " "), 3)) == ["a b c", "b c d"]
    assert value(spark, text.percent_encode(F.lit("a b/ç~*"))) == "a%20b/%C3%A7~%2A"
    assert value(spark, text.strip_tags(F.lit("<b>Font</b>&amp;<i>Pou</i>"))) == "Font & Pou"
    assert value(spark, text.wrap(F.lit("aa bb cc ddddd"), F.lit(5))) == ["aa bb", "cc", "ddddd"]
    assert value(spark, text.first_integer(F.lit("hi ha 1.234 fitxers"))) == 1234
    assert [round(value(spark, text.sequence_ratio(F.lit(a), F.lit(b))), 3) for a, b in (("ferrandis", "ferrandiz"), ("vicent", "vicente"), ("josefa", "josep"))] == [0.889, 0.923, 0.727]


def test_names(spark):
    parts = lambda s: value(spark, names.surname_parts(F.lit(s)))
    assert parts("PONT I PAGÉS") == ["pont", "pages"] and parts("de la Font y Ferrer") == ["font", "ferrer"]
    given = lambda s: names.given_tokens(F.lit(s))
    assert value(spark, given("Anna, Maria del Carme")) == ["anna", "maria", "carme"]
    score = lambda a, b: value(spark, names.given_match(given(a), given(b)))
    assert score("Josep", "Josep") == 1 and score("Josep", "José") == 0.8 and score("Maria Josepa", "Josefa") == 0.5 and score("", "Pere") == 0 and score("Pere", "Jaume") == 0
    surname = lambda a, b: value(spark, names.surname_score(names.surname_parts(F.lit(a)), names.surname_parts(F.lit(b))))
    assert surname("Pont Pages", "Pont i Pagés") == 3 and surname("Pont Pages", "Pont Vila") == 1.2 and surname("Pont Pages", "Pont") == 2.25 and surname("Pont Pages", "Pages") == 1.2 and surname("Pont", "Vila") == 0


def test_places(spark):
    parts = lambda s: places.place_components(F.lit(s))
    assert value(spark, parts("Onteniente, Valencia, España")) == ["ontinyent", "provincia de valencia", "espanya"]
    assert value(spark, places.place_key(F.lit(", Agres, , Alicante"))) == "agres"
    match = lambda a, b: value(spark, places.place_match(parts(a), parts(b)))
    assert match("Agres, Spain", "Agres") == 1 and match("El Poblet, Agres", "Agres, Spain") == 0.5 and match("Spain", "Spain") == 0 and match("", "Agres") == 0
    assert value(spark, places.six_levels(F.lit("Sant Vicenç, Cabanes, Girona, Catalonia, Spain"))) == "Sant Vicenç, Cabanes, , Girona, Catalonia, Spain"
    assert value(spark, places.flattened(F.lit(", Agres, 03837, Alacant, , Espanya"))) == "Agres, Alacant, Espanya"


def test_links(spark):
    got = value(spark, links.search_url("u", {"surname": F.lit("Pagès"), "event_from": F.lit(1800)}))
    assert got.startswith("u?pagina=1&nom=&a1=pages&") and "principio_evento=1800" in got and got.endswith("filtre=P&orden=evento")
    with pytest.raises(ValueError):
        links.search_url("u", {"nope": F.lit(1)})
    assert value(spark, links.page_list(F.lit("3, 9,11-13,9"))) == [3, 9, 11, 12, 13] and value(spark, links.page_list(F.lit("5-3"))) is None
    assert [value(spark, links.page_segment(F.lit(n))) for n in (7, 123, 0)] == ["07", "123", None]
    assert links.camel_params({"birth_place": "x", "sex": "", "given_name": None}, "q") == {"q.birthPlace": "x"}
