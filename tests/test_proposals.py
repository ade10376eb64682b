"""Proposals, imports and the rules for notes."""

import json

from stemma.operators import note_rules, proposals
from stemma.sources import notes

PEOPLE = "pid string, given string, surname string, sex string, birth_date string, birth_place string, death_date string, death_place string"


def tree(spark):
    row = lambda p, sex, born: (p, f"N{p}", "Cognom", sex, born, None, None, None)
    people = spark.createDataFrame([row("P", "M", "1800"), row("Q", "F", "1805"), row("R", "M", None)], PEOPLE)
    edges = spark.createDataFrame([("A", "P", 0), ("A", "Q", 1), ("B", "R", 0)], "child string, parent string, role int")
    return people, edges


def test_parent_proposals(spark):
    people, edges = tree(spark)
    entries = spark.createDataFrame([("I1", "A"), ("I2", "B")], "target string, fsftid string")
    none = spark.createDataFrame([], "pid string, document string")
    got = {r.target: (r.confidence, [p.fsftid for p in r.parents], r.accept) for r in proposals.parent_proposals(entries, people, edges, none.select("pid"), none).collect()}
    assert got == {"I1": ("medium", ["P", "Q"], None), "I2": ("low", ["R"], None)}
    own = spark.createDataFrame([("R",)], "pid string")
    named = spark.createDataFrame([("P", "acta.pdf")], "pid string, document string")
    got = {r.target: (r.confidence, r.accept) for r in proposals.parent_proposals(entries, people, edges, own, named).collect()}
    assert got == {"I1": ("high", None), "I2": ("high", True)}


def test_imports(spark):
    people, edges = tree(spark)
    entries = spark.createDataFrame([("I00001", "A"), ("I00002", "B"), ("I00009", "A")], "target string, fsftid string")
    none = spark.createDataFrame([], "pid string, document string")
    found = proposals.parent_proposals(entries, people, edges, none.select("pid"), none).selectExpr("cast(right(target, 1) AS int) AS ord", "target", "parents")
    mine = spark.createDataFrame([("I00001", None, "A"), ("I00002", "F00001", "B"), ("I00003", None, "P")], "xref string, famc string, fsftid string")
    out = proposals.imports(mine, found, 4, 2)
    assert [tuple(r) for r in out["families"].collect()] == [("F00002", "I00003", "I00004", ["I00001"])]
    assert [(r.xref, r.fsftid, r.family) for r in out["people"].collect()] == [("I00004", "Q", "F00002")]
    assert [tuple(r) for r in out["links"].collect()] == [("I00001", "1 FAMC @F00002@")]
    assert {tuple(r) for r in out["skipped"].collect()} == {("I00002", "has_parents"), ("I00009", "no_record")}


def test_external_ids_and_children(spark):
    people = spark.createDataFrame([("I1", None), ("I2", "X"), ("I3", "Y")], "xref string, fsftid string")
    want = spark.createDataFrame([("I1", "W"), ("I2", "X"), ("I3", "Z"), ("I4", "V")], "target string, fsftid string")
    assert {r.target: r.action for r in proposals.external_ids(people, want).collect()} == {"I1": "add", "I2": "same", "I3": "different", "I4": "no_record"}
    families = spark.createDataFrame([("F1", ["I1"])], "xref string, children array<string>")
    got = proposals.new_children(families, spark.createDataFrame([("F1", "I1"), ("F1", "I2"), ("F9", "I3")], "family string, child string"))
    assert [r.raw for r in got.collect()] == ["1 CHIL @I2@"]


def test_record_candidates(spark):
    persons = [{"display": {"name": "Pare"}}, {"principal": True, "display": {"name": "Fill", "birthDate": "1800"}}, {"display": {"name": ""}}, {"display": {"name": "Mare"}}]
    answer = json.dumps({"entries": [{"title": "Acta", "id": "https://familysearch.org/ark:/1", "content": {"gedcomx": {"persons": persons}}}, {"title": "buida", "content": {"gedcomx": {"persons": []}}}]})
    got = proposals.record_candidates(spark.createDataFrame([(1, answer)], "id int, value string")).collect()
    assert [(r.record, r.name, r.birth, r.others, r.url) for r in got] == [("Acta", "Fill", "1800", ["Pare", "Mare"], "https://www.familysearch.org/ark:/1")]


def test_note_rules(spark, tmp_path):
    def note(name, heading, body=""):
        (tmp_path / name).write_text(f"---\n{heading}\n---\n{body}")

    note("good.md", "tipus: transcripcio\ntitol: Una\nclasse: original\nxrefs:\n  - \"@I00001@\"", "# Part\n[[kind]] ![[good#Part]]")
    note("kind.md", "tipus: rara\ntitol: Una")
    note("id.md", "tipus: cas\nconfianca: molta\nxrefs:\n  - I1\n  - \"@I00009@\"", "[[enlloc]] ![[good#Res]]")
    note("bare.md", "tipus: transcripcio\nclasse: x\ncr_id: 7\nimatges:\n  - no.jpg\ndescripcio_imatges:\n  - a\n  - b")
    (tmp_path / "bad.md").write_text("---\ntipus: cas\n")
    found = notes.notes(spark, str(tmp_path)).cache()
    people = spark.createDataFrame([("I00001", ["serra", "aina"])], "xref string, tokens array<string>")
    files = spark.createDataFrame([], "path string, name string")
    got = {(r.rule, r.id.rsplit("/", 1)[1]) for r in note_rules.heading_violations(notes.headings(found), people, (), files).collect()}
    assert got == {("kind", "kind.md"), ("title_repeated", "kind.md"), ("trust", "id.md"), ("id_form", "id.md"), ("id_unknown", "id.md"), ("class", "bare.md"), ("title_missing", "bare.md"), ("forbidden_key", "bare.md"), ("image_missing", "bare.md"), ("captions", "bare.md"), ("unreadable", "bad.md")}
    assert {r.id.rsplit("/", 1)[1] for r in note_rules.link_violations(notes.wikilinks(found), found).collect()} == {"id.md"}
    assert {r.id.rsplit("/", 1)[1] for r in note_rules.embed_violations(notes.section_embeds(found), found).collect()} == {"id.md"}
    text = "Segons @I00001@ Aina Serra\nla @I00001@ **Pere Pou** i @I00001@ Bernat; @I00001@ Àina Sera de Dalt.\n@I00007@ Qui Sap, @I00001@ no, @I00001@\nPere Pou"
    said = spark.createDataFrame([("a", text), ("b", None)], "path string, text string")
    assert sorted(tuple(r) for r in note_rules.names_beside_ids(said, people).collect()) == [("a", 2, "I00001", "Pere Pou", "other_person"), ("a", 3, "I00007", "Qui Sap", "unknown_id")]
