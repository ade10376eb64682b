"""Payloads, notes, fiches, the place dictionary, record rendering and sinks."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stemma.functions import fiche
from stemma.operators import edit, places, render, sinks
from stemma.sources import gedcom, notes, payloads

FILE = str(Path(__file__).parent / "fixtures" / "small.ged")


def test_pedigree(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"root": "A", "calls": 1, "people": [{"pid": "A"}, {"pid": "B"}, {"pid": "C"}], "father_of": {"A": "B"}, "mother_of": {"A": "C"}, "couples": [["B", "C"]]}))
    got = payloads.pedigree(spark, str(tmp_path / "p.json"))
    assert [r.pid for r in got["people"].orderBy("ord").collect()] == ["A", "B", "C"]
    assert {tuple(r) for r in got["edges"].collect()} == {("A", "B", 0), ("A", "C", 1)} and [tuple(r) for r in got["couples"].collect()] == [("B", "C")]


def test_snapshot(spark):
    good = json.dumps({"data": "d", "persones": {"I1": {"fsftid": "X", "estat": "ready", "amunt": 2, "pares": [{"pid": "Y"}]}}})
    got = payloads.snapshot(spark.createDataFrame([(good,), ("{broken",)], "value string")).collect()
    assert [(r.xref, r.status, r.upstream, r.parents[0].pid) for r in got] == [("I1", "ready", 2, "Y")]


def test_persons(spark):
    rows = [
        {"id": "A", "display": {"name": "Josep Ferrer Blanch", "gender": "Male", "birthDate": "1859"}, "facts": [{"type": "http://x/Christening", "date": {"formal": "+1859-10"}, "place": {"normalized": [{"value": "Agres"}]}}]},
        {"id": "B", "display": {"name": "x", "gender": "Female"}, "names": [{"nameForms": [{"parts": [{"type": "http://x/Given", "value": "Anna"}, {"type": "http://x/Surname", "value": "Pou"}]}]}], "facts": [{"type": "http://x/Birth", "date": {"original": "about 1900"}, "place": {"original": "Onteniente"}}]},
    ]
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows], "v string").select(F.from_json("v", payloads.GEDCOMX).alias("p")).select("p.*")
    got = {r.pid: r for r in payloads.persons(raw).collect()}
    assert (got["A"].given, got["A"].surname, got["A"].sex, got["A"].birth_date, got["A"].birth_place) == ("Josep", "Ferrer Blanch", "M", "1859", "Agres")
    assert (got["B"].given, got["B"].surname, got["B"].birth_date, got["B"].birth_place) == ("Anna", "Pou", "about 1900", "Onteniente")


def test_ancestry_numbers(spark):
    p = spark.createDataFrame([(1, "A", "1"), (1, "B", "2"), (1, "C", "3"), (1, "S", "1-S"), (2, "B", "1"), (2, "D", "2")], "call int, pid string, sosa string")
    assert {tuple(r) for r in payloads.ancestry_edges(p).collect()} == {("A", "B", 0), ("A", "C", 1), ("B", "D", 0)}
    assert [tuple(r) for r in payloads.spouse_pairs(p).collect()] == [("A", "S")]


def test_catalogue(spark):
    t = spark.createDataFrame([(json.dumps({"udoc": {"_idudocsimple": "7", "titol": "Baptismes", "any_inici": " 1600 ", "any_fi": "?", "bucket": True}}),), (json.dumps({"id": "8"}),)], "value string")
    got = {r.id: (r.title, r.year_from, r.year_to, r.digitised, r.scans) for r in payloads.catalogue_books(t).collect()}
    assert got == {"7": ("Baptismes", 1600, None, True, "7"), "8": ("", None, None, False, "")}
    n = spark.createDataFrame([(json.dumps([{"id": "1", "titol": "Arxiu", "udocs": True, "fills": [2, 3]}]),)], "value string")
    assert [(r.id, r.title, r.has_documents, r.path) for r in payloads.catalogue_nodes(n).collect()] == [("1", "Arxiu", True, [])]


def test_notes(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntipus: cas\ntitol: \"El cas: u\"\nxrefs:\n  - \"@I00001@\"\n  - '@I00002@'\nimatges: []\n---\ncos [[Altra|nom]] ![[Nota#Part]]\n")
    (tmp_path / "b.md").write_text("sense\n")
    (tmp_path / "c.md").write_text("---\ntipus: cas\n")
    (tmp_path / "d.md").write_text("---\n---\n")
    found = notes.notes(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in notes.headings(found).collect()}
    assert (got["a.md"].tipus, got["a.md"].titol, got["a.md"].xrefs, got["a.md"].error) == ("cas", "El cas: u", ["@I00001@", "@I00002@"], None)
    assert not got["b.md"].present and got["b.md"].error is None and got["c.md"].error == "unclosed" and got["d.md"].present
    assert {r.person for r in notes.declared(notes.headings(found)).collect()} == {"I00001", "I00002"}
    assert {r.target for r in notes.wikilinks(found).collect()} == {"Altra", "Nota"}
    assert [(r.target, r.section) for r in notes.section_embeds(found).collect()] == [("Nota", "Part")]


def test_documents_and_manifest(spark, tmp_path):
    for name in ("Bateig_de_Josep_Ferrer.jpg", "Bateig_lectura.jpg", ".amagat", "MANIFEST.sha256", "de.pdf"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.document.rsplit("/", 1)[1]: r.tokens for r in notes.document_tokens(notes.files(spark, str(tmp_path))).collect()}
    assert got == {"Bateig_de_Josep_Ferrer.jpg": ["josep", "ferrer"]}
    lines = sinks.manifest_lines(notes.assets(spark, str(tmp_path)))
    back = notes.manifest(lines.unionByName(spark.createDataFrame([("# remark",), ("",)], "value string")))
    assert back.exceptAll(notes.assets(spark, str(tmp_path)).select("digest", "size", "path")).count() == 0 and back.count() == 3


def test_review_split():
    text = "# header\n\n# --- part one\n- a: 1\n  accept: true\n\n# why b\n- b: 2\n- c: 3\n"
    head, entries = notes.review_entries(text)
    assert head == "# header\n" and entries == ["# --- part one\n- a: 1\n  accept: true", "\n# why b\n- b: 2", "- c: 3\n"]
    assert "\n".join([head, *entries]) == text


def test_fiche(spark):
    page = """<table><tr><td><small>Llibre</small><br><b>B-01</b></td><td><small>Foli</small><b>12v</b></td></tr>
    <tr><th>Llibre</th><th>Foli</th><th>Apunt</th></tr><tr><td>Pare</td><td>Josep</td><td>Ferrer</td><td>Blanch</td><td>Agres</td></tr>
    <tr><td>Apunt</td><td>3</td></tr><tr><td>Interesado/a</td><td>Anna</td></tr></table><div><b>Professi&oacute;:</b> pag&egrave;s</div>"""
    df = spark.createDataFrame([(1, page)], "id int, html string")
    labels = spark.createDataFrame([("llibre", "book"), ("foli", "folio"), ("apunt", "entry"), ("professio", "profession")], "label string, key string")
    assert {r.key: r.value for r in fiche.pairs(df, labels).collect()} == {"book": "B-01", "folio": "12v", "entry": "3", "profession": "pagès"}
    assert [(r.role, r.given, r.surname1, r.birthplace) for r in fiche.kin(df).orderBy("ord").collect()] == [("Interessat/da", "Anna", "", ""), ("Pare", "Josep", "Ferrer", "Agres")]
    hits = spark.createDataFrame([(1, "<tr><td>B-2 (1600_1650) Folio 12v</td><td>Registro num. 7</td></tr><tr><td>x</td><td>y</td></tr>")], "id int, html string")
    assert [(r.book, r["from"], r.to, r.folio, r.registro) for r in fiche.results(hits).collect()] == [("B-2", "1600", "1650", "12v", "7")]
    said = spark.createDataFrame([("<p>El m&aacute;ximo: máximo de 15, ya has realizado 4</p>",), ("res",)], "p string").select(fiche.quota(F.col("p")).alias("q")).collect()
    assert [(r.q.used, r.q.limit) for r in said] == [(4, 15), (None, None)]


def test_place_book(spark):
    raw = ["0 @I1@ INDI", "1 BIRT", "2 PLAC , Agres, , Alacant, , Espanya", "1 DEAT", "2 PLAC Agres", "3 MAP", "4 LATI N38", "4 LONG W0", "2 DATE 1900", "1 BURI", "2 PLAC Girona"]
    lines = gedcom.nested(gedcom.tokenise(spark.createDataFrame([("f", i, r) for i, r in enumerate(raw)], "path string, idx int, raw string")))
    book = places.place_book(lines).cache()
    assert {r.key: (r.plac, [(m.depth, m.rest) for m in r.map_lines]) for r in book.collect()} == {"agres": ("Agres", [(1, "MAP"), (2, "LATI N38"), (2, "LONG W0")]), "girona": ("Girona", [])}
    asked = spark.createDataFrame([("El Poblet, Agres, Spain",), ("Terrades, Girona, Catalonia, Spain",), ("Girona",), (None,)], "place string")
    got = {r.place: (r.place_lines, r.known) for r in places.lookup(asked, book).collect()}
    assert got["El Poblet, Agres, Spain"] == (["2 PLAC Agres", "3 MAP", "4 LATI N38", "4 LONG W0"], True)
    assert got["Terrades, Girona, Catalonia, Spain"] == (["2 PLAC , Terrades, , Girona, Catalonia, Spain"], False)
    assert got["Girona"] == (["2 PLAC Girona"], True) and got[None] == ([], False)


def test_render(spark):
    e = F.array().cast("array<string>")
    null = F.lit(None).cast("string")
    got = spark.range(1).select(
        render.individual(F.lit("I1"), F.lit("Josep "), F.lit("Ferrer  Blanch"), F.lit("M"), F.lit("1859-10-17"), F.array(F.lit("2 PLAC Agres")), null, e, F.lit("F1"), F.array(F.lit("F2")), e, F.lit("X-1")).alias("i"),
        render.family(F.lit("F1"), F.lit("I1"), null, F.array(F.lit("I2")), F.lit("1880"), e, e).alias("f"),
        render.source(F.lit("S1"), F.lit("Llibre"), F.lit("12"), F.lit("aa bb cc"), null, 5).alias("s"),
    ).first()
    assert got.i == ["0 @I1@ INDI", "1 NAME Josep /FERRER BLANCH/", "2 GIVN Josep", "2 SURN FERRER BLANCH", "1 SEX M", "1 BIRT", "2 DATE 17 OCT 1859", "2 PLAC Agres", "1 FAMC @F1@", "1 FAMS @F2@", "1 _FSFTID X-1"]
    assert got.f == ["0 @F1@ FAM", "1 HUSB @I1@", "1 MARR", "2 DATE 1880", "1 CHIL @I2@"]
    assert got.s == ["0 @S1@ SOUR", "1 TITL Llibre", "1 PAGE 12", "1 TEXT aa bb", "2 CONT cc"]


def test_sinks(spark, tmp_path):
    with pytest.raises(edit.Refused):
        sinks.write_report("no title", tmp_path / "r.md")
    (tmp_path / "r.md").write_text("mine")
    with pytest.raises(edit.Refused):
        sinks.write_report("# ok\n", tmp_path / "r.md")
    sinks.write_report("# ok\n", tmp_path / "r.md", force=True)
    assert sinks.markdown_table(spark.createDataFrame([(1, "a|b")], "n int, t string"), "T").splitlines()[-1] == "| 1 | a\\|b |"
    lines = gedcom.load(spark, FILE)
    sinks.write_lines(lines, gedcom.file_meta(spark, FILE), str(tmp_path / "out"))
    assert (tmp_path / "out" / "small.ged").read_bytes() == Path(FILE).read_bytes()
    assert sinks.dated_copy(tmp_path / "out" / "small.ged").read_bytes() == Path(FILE).read_bytes()
    flat = sinks.flattened_places(lines).where("tag = 'PLAC'").first().raw
    assert flat == "2 PLAC Agres, Alacant, Espanya"
    assert "accept: null" in sinks.proposals_yaml(spark.createDataFrame([("parents", "I1")], "kind string, target string"))
    got = json.loads(sinks.snapshot_json(spark.createDataFrame([("I1", "X", "ready"), ("I2", None, "ready"), ("I3", "Y", "unknown")], "xref string, fsftid string, status string"), "d", "r"))
    assert list(got["persones"]) == ["I1"]


def test_prefixes_claims_and_kinds(spark):
    from stemma.operators import quality

    routes = spark.createDataFrame([("a/b/c.jpg",), ("x/y",)], "route string")
    got = {r.route: r.folder for r in quality.longest_existing_prefix(routes, spark.createDataFrame([("a",), ("a/b",)], "folder string")).collect()}
    assert got == {"a/b/c.jpg": "a/b", "x/y": None}
    lines = spark.createDataFrame([("| Persones | 1.018 |",), ("| a | b | c |",), ("text 7",), ("| --- | --- |",)], "raw string")
    assert [tuple(r) for r in quality.table_claims(lines).collect()] == [("Persones", 1018)]
    assert quality.review_kind(spark.createDataFrame([("I1", "X")], "target string, fsftid string")) == "ids"
    assert quality.review_kind(spark.createDataFrame([("parents", "I1")], "kind string, target string")) == "parents"
    with pytest.raises(ValueError):
        quality.review_kind(spark.createDataFrame([(1,)], "x int"))
    texts = spark.createDataFrame([(1, "---\ncr_id: 3\n---\n"), (2, "---\na: b\n---\ncr_id: 3")], "id int, text string")
    assert [r.id for r in quality.forbidden_keys(texts, "cr_id").collect()] == [1]
    files = spark.createDataFrame([(1, "a.JPG"), (2, "a.md")], "id int, name string")
    assert [quality.public_binaries(files, ("jpg",), p).count() for p in (False, True)] == [1, 0]
    assert sinks.fiche_markdown("T", {"book": "B"}, [("Llibre", "book"), ("Foli", "folio")], [("Pare", "Josep", "Agres"), ("Mare", "", "")]).splitlines()[4] == "| Llibre | B |"
