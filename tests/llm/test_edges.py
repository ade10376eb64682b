"""Hot groups, very long texts, empty tables and clashing names, against brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stemma.llm import near_copies, op01_suffix, op03_bpe, op04_simhash, op06_substrings, op07_tokens, op08_embeddings, op09_language, op10_lm, repeats
from tests.llm.test_ops import SCHEMA, covered, keyed, passage, rows


def contexts() -> list[tuple[int, str]]:
    """One passage in many contexts, a part of them equal, some with a second passage right behind."""
    rng = random.Random(9)
    hot, other = passage(21, 70), passage(22, 50)
    out = []
    for i in range(700):
        before = " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 6))) + " " + passage(1000 + i, rng.randint(0, 50))
        out.append((i, before + " " + rng.choice(["x ", "y ", ""]) + hot + " " + (other if i % 3 == 0 else passage(5000 + i, 20))))
    return out


@pytest.mark.parametrize("many", [2048, 30])
def test_one_passage_in_many_contexts(spark, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    made = contexts()
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    key = docs.select("doc_id", *op01_suffix.content_key(F.col("text")))
    texts = [t.encode() for _, t in made]
    want = [(i, int(mark.sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~mark])).hexdigest()) for (i, _), t, mark in zip(made, texts, covered(texts, 400), strict=True)]
    got = key.join(op01_suffix.without_repeats(docs), ["k1", "k2"]).select("doc_id", "n_removed", "kept_sha256")
    assert keyed(got) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    seqs = [tuple(t.split()) for t in texts]
    want = [(i, int(mark.sum()), hashlib.sha256(b" ".join(w for w, m in zip(s, mark, strict=True) if not m)).hexdigest()) for (i, _), s, mark in zip(made, seqs, covered(seqs, 35), strict=True)]
    got = key.join(op06_substrings.without_repeats(docs), ["k1", "k2"]).select("doc_id", "n_removed", "kept_sha256")
    assert keyed(got) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_passages_on_both_sides_of_400_bytes(spark):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts, want = [], []
    for size in (398, 399, 400, 401):
        shared = "<" + letters(size - 2) + ">"
        for _ in range(2):
            texts.append(letters(60) + "|" + shared + "|" + letters(60))
            # The bars beside the passage are shared too.
            want.append(size + 2 if size + 2 >= 400 else 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = docs.select("doc_id", *op01_suffix.content_key(F.col("text")))
    got = {r.doc_id: r.n_removed for r in key.join(op01_suffix.without_repeats(docs), ["k1", "k2"]).collect()}
    assert [got[i] for i in range(8)] == [int(m.sum()) for m in covered([t.encode() for t in texts], 400)]
    assert all(got[i] >= w for i, w in enumerate(want))


def test_pipeline_takes_passages_of_over_50_words(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    shared = " ".join(word() for _ in range(52))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(80)) + " " + (shared if i < 4 else word()) + " " + " ".join(word() for _ in range(80)), "en", "a", 0) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert len(got) == 9
    for r in docs.collect():
        left = got[r.doc_id]
        assert left.n_chars == len(left.text)
        assert (left.text == r.text) == (r.doc_id >= 4) and (r.doc_id >= 4 or len(left.text) <= len(r.text) - len(shared))


def components_of(n: int, linked) -> list[int]:
    least = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(a):
                if least[a] != least[b] and linked(a, b):
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return least


@pytest.mark.parametrize("many", [2, 40])
def test_simhash_deals_large_groups_anew(spark, monkeypatch, many):
    monkeypatch.setattr(op04_simhash, "MANY", many)
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, 160)]
    for _ in range(5):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, 160).astype(np.uint64))
    codes = np.unique(codes)
    found = op04_simhash.links(spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")).collect()
    at = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    pairs = {(at[r.u], at[r.v]) for r in found} | {(at[r.v], at[r.u]) for r in found}
    assert all(bin(int(codes[a]) ^ int(codes[b])).count("1") <= 3 for a, b in pairs)
    assert components_of(len(codes), lambda a, b: (a, b) in pairs) == components_of(len(codes), lambda a, b: bin(int(codes[a]) ^ int(codes[b])).count("1") <= 3)


@pytest.mark.parametrize("block", [300, 2_000_000])
def test_near_copies_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(12)
    texts = []
    for _ in range(3):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
        for _ in range(14):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy[: rng.choice([150, 150, 140, 120, 100])]))
    sets = [near_copies.shingles(t.encode()) for t in texts]
    shared = [{tuple(x) for x in enumerate(near_copies.bands(s).tolist())} for s in sets]
    want = components_of(len(texts), lambda a, b: near_copies.alike(sets[a], sets[b]) and bool(shared[a] & shared[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, t string")
    got = {r.doc_id: r.component_id for r in near_copies.near_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want and 3 <= len(set(want)) < len(texts)


def test_very_long_texts(spark):
    """Beyond the pieces of eight megabytes and the stride of 2**19 windows."""
    rng = random.Random(1)
    some = [passage(i, 400) for i in range(40)]
    long = " ".join(rng.choice(some) + f" q{i}" for i in range(3600))
    texts = [long, "short one", passage(7, 60) + " " + long[5000:5600], ""]
    assert len(long) > 8 << 20 and len(long.split()) > 1 << 19
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seqs = [tuple(t.split()) for t in texts]
    want = {i: (len(s), int(mark.sum())) for i, (s, mark) in enumerate(zip(seqs, covered(seqs, 35), strict=True))}
    key = docs.select("doc_id", *op01_suffix.content_key(F.col("text")))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in key.join(op06_substrings.without_repeats(docs), ["k1", "k2"]).collect()} == want
    raw = [t.encode() for t in texts]
    # Where 400 bytes are copied elsewhere: a set of hashes of all strings is enough to count.
    seen: dict[int, int] = {}
    for t in raw:
        for i in range(len(t) - 399):
            h = hash(t[i : i + 400])
            seen[h] = seen.get(h, 0) + 1
    sizes = {}
    for i, t in enumerate(raw):
        end = total = 0
        for at in range(len(t) - 399):
            if seen[hash(t[at : at + 400])] > 1:
                total += at + 400 - max(end, at)
                end = at + 400
        sizes[i] = (len(t), total)
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in key.join(op01_suffix.without_repeats(docs), ["k1", "k2"]).collect()} == sizes
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counted = {r.doc_id: r.n_tokens for r in op07_tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert counted == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp % 2**64 for r in op04_simhash.fingerprints(docs).collect()} == {i: op04_simhash.fingerprint(t) for i, t in enumerate(raw)}


def test_empty_tables_of_maps(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert op03_bpe.encode(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert op03_bpe.digest(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert op07_tokens.count_tokens(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert op10_lm.lm_scores(empty, public_tokenizers.path(op10_lm.VOCABULARY)).count() == 0


def test_vectors_beside_columns_of_the_same_names(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    made = [(i, (base[i % 40] + 0.02 * rng.normal(size=16)).tolist(), 1.0, 2, 3, "x") for i in range(400)]
    plain = op08_embeddings.near_vectors(spark.createDataFrame([r[:2] for r in made], "vec_id long, embedding array<double>"))
    clashing = op08_embeddings.near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>, e double, c int, cell int, component_id string"))
    assert keyed(clashing) == keyed(plain)
    assert {r.component_id for r in plain.collect()} == set(range(40)) and {r.n_links for r in plain.collect()} == {9}


def test_unequal_bytes_of_equal_hash_are_told_apart():
    data = np.frombuffer(b"abcabdab", np.uint8)
    at, size = np.array([0, 3, 6]), np.array([3, 3, 2])
    assert op07_tokens.same_bytes(data, at, size, np.array([0, 3, 6]), size)
    assert not op07_tokens.same_bytes(data, at, size, np.array([0, 0, 6]), size)
    assert not op07_tokens.same_bytes(data, at, size, at, np.array([3, 2, 2]))


def test_draw_of_each_language(spark):
    made = [(i, f"text number {i} of this kind", "en" if i % 50 else "fr") for i in range(2000)]
    got = op09_language.identify(spark.createDataFrame(made, "doc_id long, text string, lang string"), sample=40)
    assert got.count() == 2000 and {r.lang_pred for r in got.collect()} <= {"en", "fr"}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_awkward_rows(spark, stage):
    """Null, empty and repeated rows, null ids and sources, other columns with the names that operators use."""
    name, run = stage
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    out = run(spark, docs, "")
    ids = [r.doc_id for r in out.collect()]
    if name == "bpe_encode":
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in rows())
    else:
        assert out.columns == docs.columns
        assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None and name in ("suffix_dedup", "mix_sources"))
        assert {(r.k1, r.t, r.fp) for r in out.collect()} <= {(1, "x", "y")}
    if name == "quality_rules":
        assert not {0, 1, 2, 3} & set(ids)
    if name == "simhash_dedup":
        # One of the wordless, one of the repeated rows, one of the two equal passages.
        assert ids.count(3) == 1 and len({0, 1, 2} & set(ids)) == 1 and len({6, 7} & set(ids)) == 1
    if name == "suffix_dedup":
        assert not {0, 1, 2, 6, 7} & set(ids) and ids.count(3) == 2
    assert run(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
