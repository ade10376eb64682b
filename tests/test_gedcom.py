"""The GEDCOM source on a small tree with the awkward cases: doubled label, foster link, dangling wife, bad line."""

from pathlib import Path

import pytest

from stemma.operators import graph, sinks
from stemma.sources import gedcom

FILE = str(Path(__file__).parent / "fixtures" / "small.ged")


@pytest.fixture(scope="module")
def lines(spark):
    return gedcom.load(spark, FILE).cache()


def test_round_trip(spark, lines, tmp_path):
    meta = gedcom.file_meta(spark, FILE).first()
    assert meta.has_bom and meta.trailing_newline and meta.newline == "\n"
    sinks.write_lines(lines, gedcom.file_meta(spark, FILE), str(tmp_path))
    assert (tmp_path / "small.ged").read_bytes() == Path(FILE).read_bytes()


def test_lines(lines):
    by = {r.idx: r for r in lines.collect()}
    bad = next(r for r in by.values() if r.raw.startswith("text"))
    assert (bad.level, bad.tag, bad.value) == (-1, "", bad.raw)
    famc = next(r for r in by.values() if r.raw == "1 FAMC @F00001@")
    assert famc.pointer == "F00001"
    date = next(r for r in by.values() if r.raw == "2 DATE 3 MAY 1990")
    assert by[date.parent_idx].tag == "BIRT"
    assert [r.tag for r in gedcom.records(lines).orderBy("start").collect()] == ["HEAD", "INDI", "INDI", "INDI", "INDI", "FAM", "FAM", "SOUR", "TRLR"]


def test_people(lines):
    people = {r.xref: r for r in gedcom.people(lines).collect()}
    aina, pere, rosa = people["I00001"], people["I00002"], people["I00003"]
    assert (aina.given, aina.surname, aina.birth_year, aina.birth_town, aina.generation, aina.is_direct) == ("Aina", "Serra Pou", 1990, "agres", 1, True)
    assert (pere.given, pere.birth_date, pere.birth_year, pere.approximate, pere.famc_is_birth, pere.fsftid, pere.source_count, pere.sosa) == ("Pere", "ABT 1960", 1960, True, False, "AAAA-001", 1, "2 G2")
    assert pere.fams == ["F00001"] and rosa.death_year == 2019 and rosa.famc is None


def test_edges_and_walks(lines):
    people, families = gedcom.people(lines), gedcom.families(lines)
    edges = gedcom.parent_edges(people, families).cache()
    assert sorted((r.child, r.parent, r.role, r.is_birth) for r in edges.collect()) == [("I00001", "I00002", 0, True), ("I00001", "I00003", 1, True), ("I00002", "I00004", 0, False)]
    assert sorted(tuple(r) for r in gedcom.spouses(people, families).collect()) == [("I00002", "I00003"), ("I00003", "I00002"), ("I00004", "I09999")]
    roots = people.where("xref = 'I00001'").selectExpr("xref AS person")
    count = lambda birth: {r.gen: r.n for r in graph.generation_counts(graph.ancestor_slots(edges, roots, 6, birth)).collect()}
    assert count(True) == {1: 1, 2: 2} and count(False) == {1: 1, 2: 2, 3: 1}
    assert [tuple(r) for r in graph.foster_delta(edges, roots, 6).collect()] == [(3, 1)]
    assert {(r.person, r.level) for r in graph.reach(edges, roots, 9).collect()} == {("I00002", 1), ("I00003", 1), ("I00004", 2)}


def test_labels_and_ids(lines):
    kept, gone = gedcom.without_repeated_tag(lines)
    assert [r.raw for r in gone.collect()] == ["1 _SOSADABOVILLE 2 G2"]
    assert kept.count() == lines.count() - 1
    assert {r.prefix: r.next for r in gedcom.next_ids(lines).collect()} == {"I": "I00005", "F": "F00003", "S": "S00002"}
