"""Faults found at sizes and keys that the driver's small tables do not have."""

from pyspark.sql import functions as F

from stemma.operators import graph
from stemma.plans import catalog


def customers(spark, folder, keys, **columns):
    """A folder whose customers have these keys."""
    rows = [(k, f"Customer#{k}", k % 25, 1.0 * k, ("BUILDING", "MACHINERY", "FURNITURE")[k % 3]) for k in keys]
    spark.createDataFrame(rows, "c_custkey int, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_spouses_without_a_record_come_last_whatever_the_key(spark, tmp_path):
    # Family 13785 names a husband without a record; as text I0X comes before I27571, but behind I01571.
    folder = customers(spark, tmp_path, [27570, 27571, 55140, 55141])
    got = {r.xref: r.spouses for r in catalog.queries()["q43_relations"](spark, folder).collect()}
    assert got["I27570"] == "I27571,I0X" and got["I27571"] == "I0X"


def test_slots_are_counted_a_row_a_person_and_generation(spark):
    # Two parents each, who are the same two people: slots double, rows do not.
    edges = spark.createDataFrame([(c, p, c != 3) for c in range(4) for p in (0, 1)], "child long, parent long, is_birth boolean")
    roots = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 3)], "person long")
    for birth in (True, False):
        counted, listed = graph.slot_counts(edges, roots, 9, birth), graph.ancestor_slots(edges, roots, 9, birth)
        assert {(r.person, r.gen): r.n for r in counted.collect()} == {(r.person, r.gen): r.n for r in listed.groupBy("person", "gen").agg(F.count("*").alias("n")).collect()}
        assert counted.count() == counted.select("person", "gen").distinct().count()
        for of in (graph.implex, graph.generation_counts):
            assert sorted(map(tuple, of(counted).collect())) == sorted(map(tuple, of(listed).collect()))
    # A list of the slots of twenty generations has 2^20 rows.
    assert graph.implex(graph.slot_counts(edges, roots.where("person = 0"), 20)).first().slots == 2**20 - 1
    assert graph.foster_delta(edges, roots, 10).agg(F.max("delta")).first()[0] == 2**10
    assert tuple(graph.implex(graph.slot_counts(edges, roots.where("person > 9"), 4)).first()) == (0, 0, 0)


def test_lists_hold_all_names_of_a_nation(spark, tmp_path):
    folder = customers(spark, tmp_path, range(0, 5000, 25))
    spark.createDataFrame([(k, k) for k in range(9)], "o_orderkey int, o_custkey int").write.parquet(f"{folder}/orders.parquet")
    got = {r.key: r.n for r in catalog.queries()["q53_upsert"](spark, folder).where("key LIKE 'list %'").collect()}
    assert got == {"list 0": 200}


def test_imports_name_every_link_and_all_children_of_a_nation(spark, tmp_path):
    got = {r.what: r.value for r in catalog.queries()["q67_imports"](spark, customers(spark, tmp_path, range(60))).collect()}
    assert sum(w.startswith("link ") for w in got) == 48 and got["link I000001"] == "1 FAMC @F500000@"
    assert got["children"] == str(sum(k % 30 != k % 25 and k % 30 < 25 for k in range(60)))


def test_shared_prose_of_two_later_documents_is_a_pair(spark, tmp_path):
    passage = [f"w{i}" for i in range(20)]
    texts = [(k, " ".join([*passage, f"own{k}", *(f"x{i}" for i in range(14))][: 35 if k else 20]), None) for k in range(3)] + [(3, " ".join(passage), None)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): (r.longest, r.shared) for r in catalog.queries()["q16_shingle_pairs"](spark, str(tmp_path)).collect()}
    # Documents 1 and 2 share the passage and a tail; document 3 is a copy of 0.
    assert got == {(0, 1): (20, 9), (0, 2): (20, 9), (1, 2): (20, 12), (0, 3): (20, 9)}


def test_the_near_copy_stage_takes_fingerprints_and_similarity(spark):
    import random

    import corpus_pipeline
    from stemma.llm import near_copies, op04_simhash

    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    docs = [(0, " ".join(base)), (1, " ".join([*base[:100], "x", *base[101:]]))]
    found = None
    for k in range(400):
        words = [rng.choice("abcdefgh") for _ in range(60)]
        other = words[:]
        other[rng.randrange(60)] = "z"
        a, b = " ".join(words), " ".join(other)
        near = (op04_simhash.fingerprint(a.encode()) ^ op04_simhash.fingerprint(b.encode())).bit_count() <= 3
        if near and not near_copies.alike(near_copies.shingles(a.encode()), near_copies.shingles(b.encode()), 0.9):
            found = (a, b)
            break
    assert found, "no such pair in 400"
    docs += [(2, found[0]), (3, found[1])]
    df = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars int")
    rows = df.select(F.struct("doc_id").alias("row"), F.col("text").alias("t"))
    strict = {r.doc_id.doc_id: r.component_id.doc_id for r in near_copies.near_groups(rows, least=0.99).collect()}
    both = {r.doc_id.doc_id: r.component_id.doc_id for r in near_copies.joined_groups(rows, least=0.99).collect()}
    assert strict == {0: 0, 1: 1, 2: 2, 3: 3} and both[3] == 2 and both[0] == 0
    assert 3 not in {r.doc_id for r in near_copies.one_of_each(df, least=0.99).collect()}
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()} <= {0, 1, 2}


def test_pairs_of_classes_expand_to_all_pairs(spark, tmp_path):
    names = ("red ring", "red bolt", "hot gear", "ring red")
    parts = [(k, names[(k >> 1) % 4], f"Brand#{k % 3 and 1}", "LARGE", 1 + (k >> 3) % 2) for k in range(64)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    for name, brand in (("q34_pair_score_words", False), ("q04_pair_score", True)):
        rows = catalog.queries()[name](spark, str(tmp_path)).collect()
        first = {r.r_id: r.l_id for r in rows if r.what == "copy"}
        pairs = {(r.l_id, r.r_id) for r in rows if r.what == "pair"}
        assert len(rows) == len(first) + len(pairs) and not set(first) & {x for p in pairs for x in p}
        share = lambda a, b: set(a[1].split()) & set(b[1].split()) and (not brand or a[2:4] == b[2:4])
        assert {(a[0], b[0]) for a in parts for b in parts if (first.get(a[0], a[0]), first.get(b[0], b[0])) in pairs} == {(a[0], b[0]) for a in parts for b in parts if a[0] % 2 == 0 and b[0] % 2 == 1 and share(a, b)}
        # Two sides of at most eight classes, or of sixteen with brands: pairs do not grow with copies.
        assert len(pairs) <= (256 if brand else 64)


def test_people_that_no_score_tells_apart_are_paired_once(spark, tmp_path):
    # All attributes repeat after 159,600 keys, so these are 120 people and 120 copies.
    keys = [k + 159600 * n for k in range(120) for n in range(2)]
    rows = catalog.queries()["q49_person_score"](spark, customers(spark, tmp_path, keys)).collect()
    assert {(r.l_id, r.r_id) for r in rows if r.what == "copy"} == {(k, k + 159600) for k in range(120)}
    pairs = [(r.l_id, r.r_id) for r in rows if r.what == "pair"]
    assert len(set(pairs)) == len(pairs) > 0 and all(a < 120 and b < 120 for a, b in pairs)


def test_fuzzy_links_do_not_grow_with_copies(spark, tmp_path):
    from stemma.operators import link

    names = ["small ring", "red bolt", "ring small", "of"]
    people = spark.createDataFrame([(k, names[k % 4].split()) for k in range(80)], "person int, tokens array<string>")
    docs = spark.createDataFrame([(f"d{k:02}", [w + "s" * (k % 2) for w in names[k % 4].split()] + ["1840"]) for k in range(40)], "document string, tokens array<string>")
    rows = link.fuzzy_classes(people, docs).collect()
    person, document = ({r[kind]: r[f"first_{kind}"] for r in rows if r.what == kind} for kind in ("person", "document"))
    pairs = [(r.person, r.document) for r in rows if r.what == "pair"]
    ids = [f"d{k:02}" for k in range(40)]
    got = {(p, q) for p in range(80) for q in ids if (person.get(p, p), document.get(q, q)) in pairs}
    assert got == {tuple(r) for r in link.fuzzy(people, docs).collect()} and len(got) == 1000
    # Two names in either order are one class: two classes of people with as many of documents.
    assert len(set(pairs)) == len(pairs) == 2


def test_lines_of_a_small_table_are_made_by_all_cores(spark, tmp_path):
    from stemma.plans import trees

    lines = trees._lines(spark, customers(spark, tmp_path, range(400)))
    # People and families; a scan of one file and a small shuffle were two tasks.
    assert lines.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert lines.select("path", "idx").distinct().count() == lines.count() > 4000


def test_links_of_both_kinds_are_joined_by_one_walk(spark, monkeypatch):
    import random

    from stemma.llm import near_copies, op04_simhash

    rng = random.Random(5)
    x, y = ([rng.choice("abcdefghij") for _ in range(9)] for _ in range(2))
    # One set of shingles, several times over: the words' counts and with them the fingerprints differ.
    texts = [" ".join(x * m + y * n) for m, n in ((20, 3), (3, 20), (10, 10), (4, 4))] + [" ".join(rng.choice("klmnopq") for _ in range(30)) for _ in range(4)]
    texts += [texts[-1], texts[0] + " z", "", " "]
    sets, prints = [near_copies.shingles(t.encode()) for t in texts], [op04_simhash.fingerprint(t.encode()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 or near_copies.alike(sets[i], sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert len({tuple(s) for s in sets[:4]}) == 1 < len(set(prints[:4]))
    calls, walk = [], near_copies.components
    for module in (near_copies, op04_simhash):
        monkeypatch.setattr(module, "components", lambda edges: calls.append(1) or walk(edges))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, t string").select("row", F.col("t"))
    got = {r.doc_id: r.component_id for r in near_copies.joined_groups(rows).collect()}
    assert [got[i] for i in range(len(texts))] == root
    # Candidates and groups; there were four walks, each with files for every partition and round.
    assert len(calls) == 2


def test_folders_of_many_files_are_listed_and_read_by_tasks(spark, tmp_path):
    from stemma.operators import sinks
    from stemma.sources import linefiles, notes

    said = {f"{k >> 4}/n {k}%.md": ["a", "", f"b{k}"][k % 3 :] for k in range(60)}
    lines = spark.createDataFrame([(p, i, raw) for p, text in said.items() for i, raw in enumerate(text)] + [("9/long.pdf", i, "x" * 999) for i in range(2000)], "path string, idx long, raw string")
    meta = spark.createDataFrame([(p, k % 2 == 0, ("\n", "\r\n")[k % 3 > 0], k % 5 > 0 or said[p][-1:] == [""]) for k, p in enumerate(said)], "path string, has_bom boolean, newline string, trailing_newline boolean")
    root, read = sinks.staged_lines(lines, meta, str(tmp_path))
    assert sinks.checked(lines, meta, root).where("same").count() == 61
    # Spark's reader keeps each file that it lists in the driver: only large ones may be among them.
    assert len([f for f in read.inputFiles() if "/files/" in f]) == 1 == len(linefiles.large(spark, root))
    # The driver is told of a list a task, not of each file.
    assert len(list((tmp_path / root / "list").iterdir())) < 30
    out = str(tmp_path / "out")
    assert sinks.write_lines(lines, meta, out, parts=2).count() == 61
    (tmp_path / "out" / "0" / ".hidden.md").write_text("")
    (tmp_path / "out" / "_no").mkdir()
    (tmp_path / "out" / "_no" / "x.md").write_text("")
    (tmp_path / "out" / "0" / "empty.md").write_text("")
    found = notes.files(spark, out)
    assert {r.path.removeprefix(out + "/") for r in found.collect()} == {*said, "9/long.pdf", "0/empty.md"}
    got = notes.notes(spark, out, found)
    ends = {r.path: (("﻿" if r.has_bom else ""), r.newline, r.trailing_newline) for r in meta.collect()}
    assert {r.path.removeprefix(out + "/"): r.text for r in got.collect()} == {"0/empty.md": ""} | {p: ends[p][0] + ends[p][1].join(t) + ends[p][1] * ends[p][2] for p, t in said.items()}
    assert [(r.size, len(r.digest)) for r in notes.assets(spark, out).collect()] == [(2_000_000, 64)]


def test_cells_of_a_page_are_seen_together_without_moving(spark):
    from stemma.functions import fiche

    html = "<tr><th>Nom</th><th>Lloc</th><th>&nbsp;</th><th>Nom</th></tr><tr><td>Nom</td><td>Anna &amp; <i>Rosa</td><td>Lloc</td></tr><tr><td>Àvia paterna</td><td>Nom</td><td>x</td></tr><tr></tr><tr><td>lloc:</td><td>...</td><td>Lloc</td><td>Ibi&lt;</td></tr>"
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id int, html string")
    labels = spark.createDataFrame([("nom", "name"), ("lloc", "place")], "label string, key string")
    assert [tuple(r) for r in fiche.kin(pages).collect()] == [(1, 2, "Àvia paterna", "Nom", "x", "", "", 6)]
    assert {r.key: r.value for r in fiche.pairs(pages, labels).collect()} == {"name": "Anna & \nRosa", "place": "Ibi<"}
    # Each cell was a row, and all of them moved four times; now only what has been named moves.
    plan = fiche.pairs(pages, labels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in fiche.results(pages)._jdf.queryExecution().executedPlan().toString()


def test_texts_of_said_are_made_behind_the_joins(spark, data):
    import re

    found = catalog.queries()["q84_said"](spark, data)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Rows that moved and were sorted held five texts each, and one task of a small file made all of them.
    assert "Exchange" in plan and "lookup" not in "".join(plan.splitlines()[i] for i, line in enumerate(plan.splitlines()) if "Exchange" in line or "Sort" in line)
    wide = [line for line in plan.splitlines() if re.search(r"AS lookup#", line)]
    assert len(wide) == 1 and plan.index("AS lookup#") < plan.index("Exchange")
    assert "REPARTITION_BY_NUM" in plan
