"""Operators 11 to 13 against brute force: awkward rows, ties, empty tables, clashing names, long texts, wide numbers."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import op11_benchmark, op12_audit, op13_centroids
from tests.llm.test_ops import SCHEMA, keyed, passage, rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


ITEMS = [
    ("b", passage(1, 30)), ("a", passage(1, 30).upper() + " tail of another"), ("10", "Only, three: Words"), ("9", "words"), ("9", passage(7, 25)), ("e", ""), ("n", None), ("p", " .,;\n"),
    (None, passage(8, 14)), ("z", "a b a b a b a b a b a b a b"), ("y", "x x x"), ("w", "Über naïve 日本 c d e f g h i j k l m"), ("exact", "c d e f g h i j k l"),
]


def leaky() -> list[tuple]:
    rng = random.Random(5)
    texts = [t for _, t, *_ in rows()]
    texts += [passage(50, 20) + " " + passage(1, 30) + " " + passage(51, 20), passage(1, 30)[5:200].replace(" ", ",\n"), "x " * 5000, "a b " * 9, "b a b a b a b a b a", "only three words", "Only-three-words words", "über naïve 日本 c d e f g h i j"]
    texts += [" ".join(rng.choice("abcdefghijklmx") for _ in range(400)) for _ in range(6)]
    texts += [" ".join(passage(1, 30).split()[:9]), " ".join(passage(1, 30).split()[3:13]), (passage(60, 30000) + " " + " ".join(passage(8, 14).split()[1:12]) + " ") * 2]
    return [(i if i != 3 else None, t) for i, t in enumerate(texts)]


def hits(text, items=ITEMS, window=10):
    w, mark, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        if not v:
            continue
        k = min(window, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                mark |= set(range(i, i + k))
                found |= {name} - {None}
    return len(w), mark, found


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_contamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op11_benchmark, "BLOCK", block)
    monkeypatch.setattr(op11_benchmark, "PIECE", 7 if block == 400 else 4096)
    docs = spark.createDataFrame([(*r, 1, "t") for r in leaky()], "doc_id long, text string, n_words int, k1 string").repartition(3)
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id string, text string, words int")
    got = {}
    for r in op11_benchmark.contamination(docs, items).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, {x for s in r.spans for x in range(s.a, s.b)}, set(r["items"])))
        assert all(p.b < q.a for p, q in zip(r.spans, r.spans[1:], strict=False)) and r["items"] == sorted(r["items"])
    assert got == {i: [hits(t)] for i, t in leaky()}
    assert sum(bool(h[0][1]) for h in got.values()) > 12


def test_decontamination_query_digests(spark, tmp_path):
    spark.createDataFrame(leaky(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op11_benchmark.op11_benchmark_decontamination(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = [(i, n, len(mark), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(mark)) for i, (n, mark, found) in ((i, hits(t)) for i, t in leaky())]
    assert keyed(got) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_cleaned_texts_lose_spans_or_all(spark):
    docs = spark.createDataFrame([(1, f"Before it, {passage(1, 30)}; and after."), (2, passage(1, 30)), (3, None), (3, "Nothing here"), (3, "Nothing here"), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:2], "item_id string, text string")
    assert keyed(op11_benchmark.cleaned(docs, items, coverage=0.95)) == [(1, "Before it, ; and after.", len(words(passage(1, 30)))), (2, "", len(words(passage(1, 30)))), (3, "Nothing here", 0), (3, "Nothing here", 0), (3, None, 0), (4, "", 0)]
    # A text that is hit in more than four words of five goes; spans shorter than the limit stay.
    assert {r.text for r in op11_benchmark.cleaned(docs, items).where("doc_id < 3").collect()} == {""}
    assert {r.n_removed for r in op11_benchmark.cleaned(docs, items, longest=99, coverage=1.0).collect()} == {0}


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert keyed(op11_benchmark.contamination(docs, items.where("false"))) == [(1, 2, [], [], 0), (None, 0, [], [], 0)]
    assert op11_benchmark.contamination(docs.where("false"), items).count() == 0


def audit_by_hand(docs, labels):
    said = {}
    for i, quality, toxic in labels:
        q, t = said.get(i, (False, False))
        said[i] = (q or quality == 1, t or toxic == 1)
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = {}
    for i, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and first[text] < i]
        parts.setdefault(source or "", []).append(({x for x, f in zip("ABCDE", fails, strict=True) if f}, *(said.get(i, (False, False)) if i is not None else (False, False))))
    out, removed = [], {}
    for part, found in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                gone = [bool(f & set(order[:k])) for f, *_ in found]
                here = [x in f and not g for (f, *_), g in zip(found, gone, strict=True)]
                row = [sum(not g and x not in f for (f, *_), g in zip(found, gone, strict=True)), sum(here), sum(x in f and g for (f, *_), g in zip(found, gone, strict=True)), sum(f == {x} for f, *_ in found), sum(h and q for h, (_, q, _) in zip(here, found, strict=True)), sum(h and t for h, (_, _, t) in zip(here, found, strict=True))]
                removed[part, x] = removed.get((part, x), 0) + sum(here)
                out.append((part, order, k + 1, *row, x))
    return [(*r[:-1], removed[r[0], r[-1]]) for r in out]


def audited() -> tuple[list, list]:
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " ", long, long, long + " #", long.upper(), "a b " * 150, ("a b " * 150).upper() + "$", long + " x", *[rng.choice([long, long + "|", "A", "a " * 300]) for _ in range(20)], " ".join(f"é{i}" for i in range(9000))]
    docs = [(i if i != 9 else None, t, rng.choice(["s", "t", None, ""])) for i, t in enumerate(texts)] + [(3, long, "s"), (None, long, None), (-5, "", "ü")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 28)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_audit_equals_brute_force(spark):
    docs, labels = audited()
    d = spark.createDataFrame([(*r, 1, "x", 0, 1) for r in docs], "doc_id long, text string, source string, mask int, part string, w int, first int").repartition(3)
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = op12_audit.audit(op12_audit.labelled_cells(op12_audit.failures(d), label))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = audit_by_hand(docs, labels)
    assert keyed(got) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert op12_audit.audit(op12_audit.labelled_cells(op12_audit.failures(d.where("false")), label)).count() == 0


def test_audit_takes_other_filters_and_refuses_too_many(spark):
    cells = spark.createDataFrame([("p", 3, 5, 2, 1), ("p", 1, 1, 0, 0), ("p", 1, 1, 1, 0), ("p", 0, 7, 7, 7)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in op12_audit.audit(cells, "XY").collect()}
    assert got == {("XY", 1): (7, 7, 0, 2, 3, 1, 9), ("XY", 2): (7, 0, 5, 0, 0, 0, 5), ("YX", 1): (9, 5, 0, 0, 2, 1, 5), ("YX", 2): (7, 2, 5, 2, 1, 0, 9)}
    for bad in ("ABCDEFGH", "AA"):
        with pytest.raises(ValueError):
            op12_audit.orders(spark, bad)


def cluster_by_hand(vectors, dimensions, n, rounds):
    kept = [(i, [math.floor(x * 64) if abs(x) < 1e300 else int(x) * 64 for x in v]) for i, v in vectors if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(q) for _, q in order[:n]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda q: min((far(q, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[1], []).append(q)
        for k, g in groups.items():
            centroids[k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    found = [(i, nearest(q)[1], d if (d := nearest(q)[0]) < 2**63 else None) for i, q in kept]
    return found, centroids, [sum(nearest(q)[0] for _, q in kept if nearest(q)[1] == k) for k in range(len(centroids))]


def vectors_of(seed, many, dimensions=4):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(rng.choice([-2, 0, 3]), 0.7) for _ in range(dimensions)]) for i in range(many)]
    z = [0.0] * (dimensions - 1)
    return out + [(many, None), (many + 1, [1.0]), (many + 2, [None, *z]), (many + 3, [math.nan, *z]), (many + 4, [math.inf, *z]), (None, [0.5, *z]), (7, [0.5, *z]), (7, [0.5, *z]), (7, [-0.001, *z]), (many + 5, [])]


@pytest.mark.parametrize("more", [[], [(5000, [3e6, 1.0, 2.0, -7e5])], [(5000, [1e15, 1.0, 2.0, -3.7e14]), (5001, [1.1e15, -0.3, 2.0, 0.0])], [(5000, [1.5e307, 0.3, -0.3, 2.0]), (5001, [1e18, 1.0, 2.0, 3.0])]])
def test_clusters_equal_brute_force(spark, monkeypatch, more):
    monkeypatch.setattr(op13_centroids, "BLOCK", 37)
    made = vectors_of(1, 300) + more
    df = spark.createDataFrame([(*r, 1, "c") for r in made], "vec_id long, embedding array<double>, label int, cluster string").repartition(3)
    found, told = op13_centroids.clusters(df, 6, 3, dimensions=4)
    want, centroids, inertia = cluster_by_hand(made, 4, 6, 3)
    assert keyed(found) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert [c["centroid"] for c in told] == centroids and [c["inertia"] for c in told] == inertia and sum(c["size"] for c in told) == len(want)


def test_clusters_of_ties_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], schema)
    found, told = op13_centroids.clusters(same, 3, 3, dimensions=2)
    assert {(r.cluster, r.distance) for r in found.collect()} == {(0, 0)} and [c["size"] for c in told] == [20, 0, 0]
    few, told = op13_centroids.clusters(same.limit(2), 16, 3, dimensions=2)
    assert few.count() == 2 and len(told) == 2
    none, told = op13_centroids.clusters(same.where("false"), 16, 3, dimensions=2)
    assert none.count() == 0 and told == []


def test_centroid_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_centroids.op13_centroid_clustering(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_products_are_exact_up_to_the_bound():
    rng = np.random.default_rng(2)
    for most in (1 << 10, op13_centroids.PLAIN, 1 << 27, 1 << 29):
        x, c = rng.integers(-most, most + 1, (50, 64)).astype(np.float64), rng.integers(-most, most + 1, (5, 64)).astype(object)
        best, far = op13_centroids.nearest(x, c)
        true = [[sum((int(a) - int(b)) ** 2 for a, b in zip(row, one, strict=True)) for one in c] for row in x]
        assert best.tolist() == [min(range(5), key=r.__getitem__) for r in true] and far.tolist() == [min(r) for r in true]


def test_schema_names_are_those_of_documents(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert op12_audit.failures(docs).columns == ["doc_id", "part", "mask"]
    assert op11_benchmark.contamination(docs, spark.createDataFrame(ITEMS, "item_id string, text string")).where(F.col("n_words") < 0).count() == 0
