"""Review files, pedigree files, labels and refusals by kind."""

import pytest
from pyspark.sql import functions as F

from stemma import errors
from stemma.functions import labels
from stemma.operators import counters, edit, settings
from stemma.sources import gedcom, notes, payloads
from stemma.streaming import rate

REVIEW = """# Review
# of proposals

# ----
- target: "I1"
  accept: true

# doubtful
# indeed
- target: I2
  accept:
  parents:
    - given: Joan
      documents: [a.pdf, b.pdf]
- target: I3
"""


def test_review_files_are_split_in_tasks(spark):
    texts = spark.createDataFrame([("a", REVIEW), ("b", REVIEW.replace("accept: true", "accept: sure")), ("c", ""), ("d", None), ("e", "# only remarks\n"), ("f", "\n- x: 1\n")], "path string, text string").repartition(3)
    got = {}
    for r in notes.reviews(texts).collect():
        got.setdefault(r.path, []).append((r.ord, r.accept, r.data, r.error))
    a = sorted(got["a"])
    assert [x[:2] for x in a] == [(0, True), (1, None), (2, None)] and '"documents": ["a.pdf", "b.pdf"]' in a[1][2] and a[0][3] is None
    assert [x[:3] for x in got["b"]] == [(None, None, None)] and "sure" in got["b"][0][3] and set(got) == {"a", "b", "f"}
    entries = {r.ord: r.entry for r in notes.reviews(texts.where("path = 'a'")).collect()}
    assert entries[1].startswith("\n# doubtful\n# indeed\n- target: I2") and entries[0].startswith("# ----\n- target")
    assert {r.path: (r.entries, r.same) for r in notes.split_without_loss(texts).collect()} == {"a": (3, True), "b": (3, True), "c": (0, True), "d": (0, True), "e": (0, True), "f": (1, True)}


def test_pedigrees_come_back(spark, tmp_path):
    people = spark.createDataFrame([("R", 1, "B", "Anna", "Mas", None, "1800", None, "", None, "2"), ("R", 0, "A", 'Joan "X"', "Puig", "M", None, None, None, None, "1")], "root string, ord int, pid string, given string, surname string, sex string, birth_date string, birth_place string, death_date string, death_place string, sosa string")
    edges = spark.createDataFrame([("R", "A", "B", 1)], "root string, child string, parent string, role int")
    calls = spark.createDataFrame([("R", 2, ["Z"]), ("S", 1, [])], "root string, calls int, skipped_leaves array<string>")
    pairs = spark.createDataFrame([("R", "C", "B")], "root string, a string, b string")
    payloads.pedigree_json(people, edges, pairs, calls).select("value").write.text(str(tmp_path / "p"))
    got = payloads.pedigree(spark, str(tmp_path / "p"), lines=True)
    assert [(r.ord, r.pid, r.given, r.birth_date, r.death_date) for r in got["people"].orderBy("ord").collect()] == [(0, "A", 'Joan "X"', None, None), (1, "B", "Anna", "1800", "")]
    assert [tuple(r) for r in got["edges"].collect()] == [("A", "B", 1)] and [tuple(r) for r in got["couples"].collect()] == [("C", "B")]


def test_labels(spark):
    one = spark.range(1).select(
        labels.person(F.lit("Anna"), F.lit("Mas"), F.lit(None).cast("int"), F.lit("4 G3"), F.lit("I1")).alias("a"), labels.person(F.lit(None).cast("string"), F.lit("Mas"), F.lit(1800), F.lit(""), F.lit("I2")).alias("b"),
        labels.lookup(F.lit("X"), F.lit("bateig"), F.lit(None).cast("int"), F.lit("Agres"), F.lit(False), F.lit("why"), F.lit("u")).alias("c"), labels.account(F.lit(3), F.lit(2), F.lit(1.25), F.lit(0)).alias("d"), labels.quota(F.lit(3), F.lit(40), F.lit("d"), F.lit(None).cast("int"), F.lit(False)).alias("e"),
    ).first()
    assert tuple(one) == ("Anna Mas (?, Sosa 4) @I1@", " Mas (1800) @I2@", "~~**X**: bateig ?, Agres~~\n    why\n    <u>", one.d, "3/40 lookups (d), our own pace") and one.d.startswith("3 requests, 2 held already, 1.")


def test_spans_and_trailers(spark):
    raw = ["0 HEAD", "0 @I1@ INDI", "1 SEX M", "0 @I2@ INDI", "0 @I2@ INDI", "0 TRLR"]
    lines = gedcom.nested(gedcom.tokenise(spark.createDataFrame([("f", i, r) for i, r in enumerate(raw)] + [("g", 0, "0 HEAD")], "path string, idx int, raw string"))).cache()
    want = lambda *x: spark.createDataFrame([("f", i) for i in x], "path string, xref string")
    assert [tuple(r) for r in edit.record_spans(lines, want("I1", "I1")).collect()] == [("f", "I1", 1, 3)]
    for bad in ("I2", "I9"):
        with pytest.raises(errors.Refused):
            edit.record_spans(lines, want("I1", bad))
    assert [tuple(r) for r in edit.trailers(lines.where("path = 'f'")).collect()] == [("f", 5)]
    with pytest.raises(errors.Refused):
        edit.trailers(lines)


def test_single_settings():
    assert settings.scalars({}) == settings.Scalars(None, None, None, "", 24, {})
    got = settings.scalars({"apv": {"edat_de_casar": "21", "terra_documentada": "I7", "parroquia_per_defecte": ""}, "frontmatter": {"arxius": {"a": 1}}, "estat": {"arrel": "I1"}})
    assert (got.marriage_age, got.floor, got.default_parish, got.archives, got.counting_root) == (21, "I7", "", {"a": "1"}, "I1")
    assert settings.root_id({"familysearch": {"arrel": "X"}}) == "X"
    for bad in (lambda: settings.root_id({}), lambda: settings.scalars({"apv": {"edat_de_casar": "old"}})):
        with pytest.raises(errors.Misconfigured):
            bad()


def test_held_answers_and_exit_codes(spark):
    asked = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    held, open_ = payloads.answered(asked, spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("z", 1, "")], "key string, taken int, body string"))
    assert [tuple(r) for r in held.collect()] == [("a", "new")] and [tuple(r) for r in open_.collect()] == [("b",)]
    routes = spark.createDataFrame([("x", False), ("y", True)], "route string, broken boolean")
    assert (counters.exit_code(routes), counters.exit_code(routes.where("NOT broken"))) == (1, 0)


def test_refusals_by_kind(spark):
    assert all(issubclass(x, errors.Refused) for x in (errors.Misconfigured, errors.Damaged, errors.Spent)) and edit.Refused is errors.Refused
    with pytest.raises(errors.Misconfigured):
        settings.tree_file(["a.ged", "b.ged"])
    counts = spark.createDataFrame([("2024-05-01", 40, 0), ("2024-05-02", 3, 37)], "day string, used long, remaining long")
    assert rate.refuse_when_spent(counts, "2024-05-02") == 37 and rate.refuse_when_spent(counts, "2024-05-03") == -1
    with pytest.raises(errors.Spent):
        rate.refuse_when_spent(counts, "2024-05-01")
