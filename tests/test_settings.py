"""Settings, line files that count, review rows, branch imports, walks, older pages, bounded reports."""

import pytest
from pyspark.sql import functions as F

from stemma.functions import fiche
from stemma.operators import edit, graph, proposals, reports, settings, sinks
from stemma.sources import notes


def test_setting_and_tree_file():
    config = {"familysearch": {"root": "P1", "empty": ""}, "list": []}
    assert settings.setting(config, "familysearch", "root") == "P1"
    assert settings.setting(config, "familysearch", "empty", default=3) == 3 and settings.setting(config, "no", "way") is None
    names = ["Tree.ged", "Tree_20260730-101500.ged", "example.ged", "notes.md"]
    assert settings.tree_file(names, example="example.ged") == "Tree.ged"
    assert settings.tree_file(["example.ged"], example="example.ged") == "example.ged"
    assert settings.tree_file(names, "example.ged") == "example.ged"
    for args in ((["a.ged", "b.ged"],), ([],), (names, "other.ged")):
        with pytest.raises(edit.Refused):
            settings.tree_file(*args)
    assert settings.agent("index", "mine", "a@b.example") == "mine-index/0.1 (personal research; a@b.example)"
    assert settings.agent("index") == "genealogy-index/0.1 (personal research)"


def test_dimensions(spark):
    config = {"regions": {"north": ["Onteniente", "Agres"], "south": ["Ibi"]}, "guides": {"north": {"score": 3, "links": {"b": "u2", "a": "u1"}}}, "fallbacks": {"Alacant": "south"}}
    assert [tuple(r) for r in settings.towns(spark, config).orderBy("ord").collect()] == [("north", 0, "ontinyent"), ("north", 1, "agres"), ("south", 2, "ibi")]
    guides = {r.region: r for r in settings.guides(spark, config).collect()}
    assert guides["unknown"].score == 0 and [x.name for x in guides["north"].links] == ["a", "b"]
    assert [tuple(r) for r in settings.fallbacks(spark, config).collect()] == [("south", 0, "alacant")]
    assert settings.towns(spark, {}).count() == 0


def test_small_labels(spark):
    e = spark.createDataFrame([("ready", False, "2024"), ("unknown", False, None), ("stuck", False, None)], "status string, fresh boolean, taken string")
    line = lambda df, taken="taken": settings.provenance(df, F.col("fresh"), F.col(taken)).first().line
    assert line(e) == "snapshot of 2024: 2 of 3"
    assert line(e.withColumn("fresh", F.lit(True))) == "asked now: 2 of 3"
    assert line(e.withColumn("taken", F.lit(None).cast("string"))) == "never asked"
    p = spark.createDataFrame([(1, "puig"), (1, ""), (1, "mas"), (1, "puig"), (2, "")], "person int, surname_norm string")
    assert {r.person: r.kin for r in settings.surnames(p).collect()} == {1: ["mas", "puig"], 2: []}
    one = spark.range(1, 3).select(settings.source_label(F.col("id"), F.lit("t.ged")).alias("x"), settings.edited_by(F.create_map(F.lit("me"), F.lit("Me")), "me").alias("mine"), settings.edited_by(F.lit(None).cast("map<string,string>"), "me").alias("not_mine"))
    assert [tuple(r) for r in one.orderBy("x").collect()] == [("t.ged (1 person)", True, False), ("t.ged (2 people)", True, False)]


def test_review_files():
    text = "# head\n\n# ---\n- target: I1\n  accept: true\n  parents:\n    - given: Joan\n      documents: [a, b]\n    - given: ''\n# why\n- target: I2\n"
    rows = notes.review_rows(text)
    assert [r["accept"] for r in rows] == [True, None] and rows[0]["parents"][0] == {"given": "Joan", "documents": ["a", "b"]}
    with pytest.raises(ValueError):
        notes.review_rows("- target: I1\n  accept: perhaps\n")
    header, entries = notes.review_entries(text)
    assert [settings.chunk_verdict(e) for e in entries] == [True, None]
    assert settings.rebuilt("# p\n", "## h", ["- a: 1\n", "- b: 2"], ["said", ""]) == "# p\n# said\n#\n## h\n- a: 1\n- b: 2\n"


def test_nested_headings():
    read = notes._yaml("a:\n  b: x\n  c:\n  - 1\n  - d: 2\ne: [p, 'q']\n# remark\nf:\n")
    assert read == ('{"a": {"b": "x", "c": ["1", {"d": "2"}]}, "e": ["p", "q"], "f": []}', None)
    assert notes._yaml("a: 1\n  b: 2")[0] is None and notes._yaml("just words")[0] is None and notes._yaml("")[0] == "{}"


def test_branch_imports(spark):
    start = spark.createDataFrame([("A", "I00010")], "pid string, xref string")
    edges = spark.createDataFrame([("A", "B", "M"), ("A", "C", "F"), ("B", "D", None), ("C", "E", "F"), ("C", "K", "M"), ("K", "Z", "M"), ("D", "A", "M")], "child string, parent string, sex string")
    known = spark.createDataFrame([("K", "I00003")], "pid string, xref string")
    got = proposals.branch_imports(start, edges, known, 9, 11, 5)
    people = {r.pid: r.xref for r in got["people"].collect()}
    assert people == {"B": "I00011", "C": "I00012", "D": "I00013", "E": "I00014"}
    families = {r.child: (r.husband, r.wife) for r in got["families"].collect()}
    # K is known, so nobody walks on from there; D's father is A, who stands already.
    assert families == {"I00010": ("I00011", "I00012"), "I00011": ("I00013", None), "I00012": ("I00003", "I00014"), "I00013": ("I00010", None)}
    assert sorted(r.family for r in got["families"].collect()) == ["F00005", "F00006", "F00007", "F00008"]


def test_walks(spark):
    nodes = spark.createDataFrame([("a", "r"), ("b", "a"), ("c", "b"), ("r", "c")], "id string, parent string")
    assert {(r.id, r.level) for r in graph.catalogue_walk(nodes, "r", 2).collect()} == {("a", 1), ("b", 2)}
    people = spark.createDataFrame([(f"P{n}", n) for n in (1, 127, 128, 130, 255, 256)], "pid string, n long")
    assert {r.pid: r.followed for r in graph.roots_to_chain(people, 2).collect()} == {"P128": True, "P130": True, "P255": False}
    assert {r.book: r["last"] for r in graph.last_page(spark.createDataFrame([("x", 1), ("x", 9), ("y", 2)], "book string, page int")).collect()} == {"x": 9, "y": 2}
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "child int, parent int")
    assert {tuple(r) for r in graph.distances(edges, spark.createDataFrame([(1,)], "person int"), 5).collect()} == {(1, 1), (2, 2), (3, 2)}


def test_older_pages(spark):
    html = "<table><tr><td>Sagrament</td><td>Identificador</td><td>Llibre</td><td>Foli</td><td>Apunt</td><td>Sexe</td></tr><tr><td>Bateig</td><td>77</td><td>B-2</td><td></td><td>4</td><td>M</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, html), (3, "<p>none</p>")], "id int, html string")
    known = spark.createDataFrame([(2, "identificador", "5"), (1, "book", "B-9")], "id int, key string, value string")
    assert {tuple(r) for r in fiche.legacy(pages, known).collect()} == {(1, "sacrament", "Bateig"), (1, "identificador", "77"), (1, "entry", "4"), (1, "sex", "M")}


def test_reports_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(sinks, "MOST", 3)
    assert sinks.markdown_table(spark.range(3).orderBy("id"), "T").endswith("| 0 |\n| 1 |\n| 2 |\n")
    with pytest.raises(edit.Refused):
        sinks.markdown_table(spark.range(4), "T")


def test_edits_before_exact_lines(spark):
    lines = spark.createDataFrame([("f", 0, 1, 0, "INDI", "0 @I1@ INDI"), ("f", 1, 1, 1, "SEX", "1 SEX M"), ("f", 2, 1, 1, "CHAN", "1 CHAN")], "path string, idx int, rec_id int, level int, tag string, raw string")
    block = spark.createDataFrame([("f", 1, "1 SEX M", 0, "1 NOTE a"), ("f", 1, "1 SEX M", 1, "2 CONT b")], "path string, rec_id int, find string, seq int, raw string")
    assert [r.raw for r in edit.splice(lines, edit.exact_inserts(lines, block)).orderBy("idx").collect()][1:3] == ["1 NOTE a", "2 CONT b"]
    with pytest.raises(edit.Refused):
        edit.exact_inserts(lines, block.withColumn("find", F.lit("1 SEX F")))
    again = edit.reread(lines, lines.where("idx < 2")).first()
    assert (again.lines, again.read_again, again.same) == (3, 2, False)


def test_reports_stand_in_order(spark):
    e = spark.createDataFrame([("n", "I2", "B", "stuck", 5.0), ("n", "I1", "A", "unknown", 9.0), ("s", "I3", "C", "stuck", 1.0), ("x", "I4", "D", "unlinked", 2.0), ("n", "I5", "E", "ready", 99.0)], "region string, xref string, name string, status string, score double")
    e = e.withColumns({"birth": F.lit(None).cast("string"), "town": F.lit("T"), "documents": F.array(F.lit("d")), "links": F.array().cast("array<string>")})
    guides = spark.createDataFrame([("s", 0, "South", ["go"]), ("n", 1, "North", [])], "region string, ord int, title string, links array<string>")
    lines = [x for x in reports.text_of(reports.worklist_report(e, guides)).split("\n") if x.startswith(("#", "- Start"))]
    assert lines == ["# Work by archive", "## South (1)", "- Start: go", "### C I3", "## North (2)", "### A I1", "### B I2", "## x (1)", "### D I4"]


def test_scans_are_spread(spark, data):
    from stemma.session import spread, table

    one = table(spark, data, "documents")
    assert one.rdd.getNumPartitions() == 1 and spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(one.repartition(3)).rdd.getNumPartitions() == 3


@pytest.mark.parametrize("least", [0.85, 0.7])
def test_similar_tokens_lose_no_pair(spark, least):
    import random
    from difflib import SequenceMatcher

    from stemma.operators import link

    rng = random.Random(5)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 12))) for _ in range(60)]
    changed = []
    for w in base:
        w = list(w)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice("abcd")
        changed.append("".join(w))
    tokens = sorted({w for w in base + changed if len(w) > 2})
    left, right = tokens[::2] + tokens[:10], tokens[1::2] + tokens[:20]
    want = {(x, y) for x in left for y in right if SequenceMatcher(None, x, y).ratio() >= least}
    got = {(r.l, r.r) for r in link.similar_tokens(spark.createDataFrame([(x,) for x in left], "token string"), spark.createDataFrame([(x,) for x in right], "token string"), least).collect()}
    assert got == want and len(want) > 30
