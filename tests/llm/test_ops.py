"""Every corpus operator on a small table of awkward rows, against brute force."""

import hashlib
import random
import unicodedata
from collections import Counter, defaultdict
from math import log

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stemma.llm import op01_suffix, op02_mix, op03_bpe, op04_simhash, op05_quality, op06_substrings, op07_tokens, op08_embeddings, op09_language, op10_lm, repeats
from stemma.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 long, t string, fp string, `__source` string"
WORDS = ["the", "of", "and", "to", "in", "casa", "über", "naïve", "l'eau", "x1", "ñu", "日本", "don't", "WE'LL", "a", "Z9"]


def passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def rows() -> list[tuple]:
    shared = passage(1, 120)
    texts = [
        (0, None, "en", "b"), (1, "", "en", "b"), (2, " \t\n", None, None), (3, "one two", "en", "a"), (3, "one two", "en", "a"),
        (4, passage(2, 90) + " " + shared + " " + passage(3, 70), "en", "a"), (5, passage(4, 50) + "\n" + shared + " " + passage(5, 40), "de", "b"),
        (6, shared, "de", None), (7, shared, "fr", "é"), (8, shared[:-9] + " tail é", "fr", "z"), (None, passage(6, 150), "fr", "a"), (9, "ab" * 600, None, "a"),
        (10, "x " * 700, "es", "b"), (11, "Straße Ärger über Öl und Maß der die das und ist nicht " * 5, "de", "c"), (12, "12 34 !! ??", "es", "c"),
        (13, passage(7, 4000), "en", "b"), (14, "it's we're I'll '' 'x <|endoftext|>   tab\there\r\n İstanbul ΣΑΣ", "en", "c"), (2**40, passage(8, 60), "es", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 1, "x", "y", "z") for i, t, lang, s in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def keyed(found) -> list[tuple]:
    return sorted((tuple(r) for r in found.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def raw() -> list[tuple]:
    return [(r[0], (r[1] or "").encode()) for r in rows()]


def covered(seqs: list, w: int) -> list[np.ndarray]:
    seen = Counter(s[i : i + w] for s in seqs for i in range(len(s) - w + 1))
    out = []
    for s in seqs:
        mark = np.zeros(len(s), bool)
        for i in range(len(s) - w + 1):
            if seen[s[i : i + w]] > 1:
                mark[i : i + w] = True
        out.append(mark)
    return out


@pytest.mark.parametrize("many", [2048, 1])
def test_suffix_dedup(docs, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    want = []
    for (i, t), mark in zip(raw(), covered([t for _, t in raw()], 400), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~mark]) if t else b""
        spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        want.append((i, len(t), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = docs.select("doc_id", *op01_suffix.content_key(F.col("text"))).join(op01_suffix.without_repeats(docs), ["k1", "k2"]).drop("k1", "k2")
    assert keyed(got) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_stripped_texts_stay_valid(docs):
    out = op01_suffix.stripped(docs, length=40)
    assert out.columns == docs.columns and out.count() == len(rows())
    assert {r.doc_id for r in out.where("text IS NULL").collect()} == {0}
    assert out.where("doc_id = 6").first().text == ""


def test_substring_dedup(docs):
    seqs = [tuple(t.split()) for _, t in raw()]
    want = []
    for (i, _), s, mark in zip(raw(), seqs, covered(seqs, 35), strict=True):
        kept = b" ".join(w for w, m in zip(s, mark, strict=True) if not m)
        want.append((i, len(s), int(mark.sum()), hashlib.sha256(kept).hexdigest()))
    got = docs.select("doc_id", *op01_suffix.content_key(F.col("text"))).join(op06_substrings.without_repeats(docs), ["k1", "k2"]).drop("k1", "k2")
    assert keyed(got) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_engines_agree_with_counting():
    rng = np.random.default_rng(0)
    for window, engine, kind in ((16, op01_suffix.engine, np.uint8), (5, op01_suffix.engine, np.uint8), (80, op01_suffix.engine, np.uint8), (7, op06_substrings.engine, np.uint64), (3, op06_substrings.engine, np.uint64)):
        for _ in range(15):
            pool = [rng.integers(0, rng.integers(2, 30), rng.integers(1, 90)).astype(kind) for _ in range(6)]
            some = [np.concatenate([pool[k] for k in rng.integers(0, 6, rng.integers(1, 5))]) for _ in range(rng.integers(1, 12))]
            seen = Counter(r[i : i + window].tobytes() for r in some for i in range(len(r) - window + 1))
            for r, flags in zip(some, engine(some, window), strict=True):
                assert [seen[r[i : i + window].tobytes()] > 1 for i in range(len(r) - window + 1)] == flags.tolist()


def test_mix(docs, empty):
    mix = op02_mix.Mix(docs, block=16, shard_slots=8)
    got = mix.taken().collect()
    sizes = [len(t.split()) for _, t in raw()]
    assert sorted(r["size"] for r in got) == sorted(sizes) and len(got) == len(sizes)
    by = defaultdict(lambda: [0, 0, 0.0])
    source = {r[0]: r[3] for r in rows()}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        x = by[source[r.doc_id]]
        x[0], x[1], x[2] = x[0] + r.taken, r.source_size, r.target
    assert all(abs(taken - target) <= 1 for taken, _, target in by.values())
    assert abs(sum(x[2] for x in by.values()) - sum(sizes)) < 1e-6
    assert keyed(op02_mix.Mix(docs.repartition(5), block=16, shard_slots=8).taken()) == keyed(mix.taken())
    texts = op02_mix.mixed_texts(docs, block=16, shard_slots=8)
    assert texts.columns == docs.columns
    words = Counter()
    for r in texts.collect():
        words[r.doc_id] += len(r.text.encode().split())
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in words.items() if v}
    assert op02_mix.Mix(empty).taken().count() == 0


def test_targets_and_permutation():
    assert op02_mix.targets([("a", 10), ("b", 10), (None, 10)]) == [5.0, 10.0, 15.0]
    out = op02_mix.targets([("a", 100), ("b", 1), ("c", 1)])
    assert out[1:] == [3.0, 3.0] and out[0] == 96.0
    for n in (1, 2, 3, 17, 1000):
        assert sorted(op02_mix.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    every = list(op02_mix.draw([5, 0, 170], 4, 1))
    assert [x for x, _, _ in every] == list(range(44)) and sum(n for _, _, n in every).tolist() == [5, 0, 170]
    assert {int(n.sum()) for _, _, n in every[:-1]} == {4}
    assert all((every[i + 1][1] == every[i][1] + every[i][2]).all() for i in range(43))
    for low, high in ((0, 1), (7, 20), (43, 44), (40, 99)):
        assert [(x, b.tolist(), n.tolist()) for x, b, n in op02_mix.draw([5, 0, 170], 4, 1, low, high)] == [(x, b.tolist(), n.tolist()) for x, b, n in every[low:high]]
    assert list(op02_mix.draw([0, 0], 4, 1)) == [] == list(op02_mix.draw([], 4, 1))


def test_bpe(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in raw():
        ids = library.encode(t.decode(), add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    path = public_tokenizers.path("word_bpe_49k.json")
    assert keyed(op03_bpe.digest(docs, path)) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    whole = op03_bpe.encode(docs, path).select("doc_id", F.size("token_ids").cast("long"), F.sha2(F.array_join(F.transform("token_ids", lambda x: x.cast("string")), " "), 256), F.sha2("decoded", 256))
    assert keyed(whole) == keyed(op03_bpe.digest(docs, path))


def test_token_counts(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(i, len(t), n, n > 512) for i, t in raw() for n in [len(library.encode(t.decode(), add_special_tokens=False).ids)]]
    assert keyed(op07_tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_tokenizers_on_junk():
    rng = random.Random(3)
    bits = ["a", "b", "s", "'", "'s", "'re", "'l", " ", "  ", "\n", " ", "1", "!", "é", "é", "Σ", "İ", "\U0001f600", "<|endoftext|>", "<|end", "\x1c", "\x85", "\x00", "Ⅷ"]
    junk = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    word, byte = (Tokenizer.from_file(public_tokenizers.path(x)) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    encoder = op03_bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"), cache=50)
    assert [encoder.encode(t) for t in junk if unicodedata.normalize("NFC", t).strip()] == [word.encode(t, add_special_tokens=False).ids for t in junk if unicodedata.normalize("NFC", t).strip()]
    counter = op07_tokens.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
    counter.counter.most = 100  # tables are dropped and built again
    assert [n for at in range(0, len(junk), 100) for n in counter.counts([t.encode() for t in junk[at : at + 100]])] == [len(byte.encode(t, add_special_tokens=False).ids) for t in junk]


def naive_fingerprint(t: bytes) -> int:
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in t).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def test_simhash(docs):
    prints = [(i, naive_fingerprint(t)) for i, t in raw()]
    least = list(range(len(prints)))
    for _ in prints:
        least = [min(least[b] for b in range(len(prints)) if bin(prints[a][1] ^ prints[b][1]).count("1") <= 3) for a in range(len(prints))]
    group = defaultdict(list)
    for (i, _), g in zip(prints, least, strict=True):
        group[g].append(i)
    want = [(i, p, min((x for x in group[g] if x is not None), default=None)) for (i, p), g in zip(prints, least, strict=True)]
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in op04_simhash.near_groups(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = op04_simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(group)


def test_gray_index_finds_all_components():
    rng = np.random.default_rng(1)
    for spread, centres in ((2, 3), (6, 20), (3, 1)):
        codes = rng.integers(0, 2**63, centres, dtype=np.uint64)[rng.integers(0, centres, 800)]
        for _ in range(spread):
            codes = codes ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64))
        codes = np.unique(codes)
        near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3

        def classes(pairs, n=len(codes)):
            root = list(range(n))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in pairs:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            return [find(x) for x in range(n)]

        at = {int(c): i for i, c in enumerate(codes)}
        found = op04_simhash.GrayIndex(np.zeros(len(codes), np.int64), codes).links(3)
        assert classes([(at[int(a)], at[int(b)]) for a, b in found]) == classes(zip(*np.nonzero(near), strict=True))


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_quality(docs, spark):
    import duckdb

    table = docs.select("doc_id", "text", "lang").toPandas()
    c = duckdb.connect()
    c.register("documents", table)
    want = c.sql(op05_quality.ORACLE_SQL).fetchall()
    got = op05_quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    tidy = lambda rows_: sorted((tuple(None if x != x else x for x in r) for r in rows_), key=str)
    assert tidy((r[0] if r[0] is None else int(r[0]), *r[1:]) if r[0] == r[0] else (None, *r[1:]) for r in want) == tidy(map(tuple, got))
    passed = op05_quality.passing(docs)
    assert passed.columns == docs.columns
    assert passed.count() == sum(r.kept for r in got)


def test_repeated_words_by_hand(spark):
    line = "a b c d e f g h i"
    df = spark.createDataFrame([(1, f"{line} {line}", "en"), (2, line, "en"), (3, "w " * 20, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.n_repeat_words for r in op05_quality.features(df).collect()}
    assert got == {1: 18, 2: 0, 3: 20}


def vectors() -> list[tuple]:
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    out = [(i, (base[i % 30] + 0.15 * rng.normal(size=8)).tolist()) for i in range(150)]
    return [*out, (150, out[3][1]), (150, out[3][1]), (151, None), (152, [0.0] * 8), (153, [1.0, None, *[0.0] * 6]), (154, [float("nan")] * 8), (155, [float("inf"), *[0.0] * 7]), (156, []), (157, [1.0, 2.0]), (158, [2.0, 4.0]), (159, [1e300, 2e300]), (160, (10 * np.array(out[4][1])).tolist())]


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(op08_embeddings, "BLOCK", 16)
    rows_ = vectors()
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows_]
    unit = [np.array(v) / max(map(abs, v)) if ok else None for (_, v), ok in zip(rows_, fine, strict=True)]

    def linked(a, b):
        if not (fine[a] and fine[b]) or a == b or len(unit[a]) != len(unit[b]):
            return False
        return unit[a] @ unit[b] / np.sqrt((unit[a] @ unit[a]) * (unit[b] @ unit[b])) >= 0.95

    n = len(rows_)
    near = [[b for b in range(n) if linked(a, b)] for a in range(n)]
    least = [r[0] for r in rows_]
    for _ in range(n):
        new = [min([least[a], *(least[b] for b in near[a])]) for a in range(n)]
        if new == least:
            break
        least = new
    want = sorted((rows_[a][0], len(near[a]), least[a], rows_[a][0] == least[a]) for a in range(n))
    got = op08_embeddings.near_vectors(spark.createDataFrame(rows_, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == want
    assert op08_embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language(spark, docs, empty):
    import zlib

    got = op09_language.identify(docs).collect()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {0, 1, 2, 12}
    assert {r.lang_pred for r in op09_language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert op09_language.identify(empty).count() == 0


def test_language_held_out_accuracy(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    got = op09_language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.95


def test_lm(docs, monkeypatch, empty):
    monkeypatch.setattr(op10_lm, "BLOCK", 300)
    path = public_tokenizers.path(op10_lm.VOCABULARY)
    encode = op10_lm.tokenizer(path).encode_ordinary
    texts = [(i, encode(t.decode())) for i, t in raw()]
    c = Counter(tuple(x[i : i + n]) for _, x in texts for n in (1, 2, 3) for i in range(len(x) - n + 1))
    total = sum(len(x) for _, x in texts)
    f = lambda g: c[g] if len(g) == 1 or c[g] >= 2 else 0
    want = []
    for i, x in texts:
        s = 0.0
        for k in range(len(x)):
            most = min(k, 2)
            for n in range(most + 1, 0, -1):
                g = tuple(x[k - n + 1 : k + 1])
                if n == 1:
                    s += log(c[g] / total * 0.4**most)
                elif f(g) and f(g[:-1]):
                    s += log(f(g) / f(g[:-1]) * 0.4 ** (most - n + 1))
                    break
        want.append((i, len(x), round(s, 6), round(s / len(x), 6) if x else None))
    got = [(r.doc_id, r.n_tokens, round(r.log_score, 6), None if r.mean_log_score is None else round(r.mean_log_score, 6)) for r in op10_lm.lm_scores(docs, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert op10_lm.lm_scores(empty, path).count() == 0


@pytest.mark.parametrize("run", [op04_simhash.near_groups, op04_simhash.one_of_each, op05_quality.quality, op05_quality.passing, op01_suffix.stripped, op01_suffix.without_repeats, op06_substrings.without_repeats, op02_mix.mixed_texts])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


@pytest.mark.parametrize("stride", [1 << 19, 37])
def test_segments_hold_each_window_once(monkeypatch, stride):
    monkeypatch.setattr(repeats, "STRIDE", stride)
    powers, units = repeats.Powers(), repeats.hash_words()
    text = (passage(11, 300) + " " + passage(12, 80) + " " + passage(11, 300)).encode()
    u = units(text)
    assert len(u) == len(text.split()) and units(b"") .tolist() == [] and len(set(units(b"a b a \x00").tolist())) == 3
    with np.errstate(over="ignore"):
        a, s, lo, n, p = repeats.segments(u, 35, 11, powers)
        assert repeats.segments(u[:34], 35, 11, powers) is None
    starts = [x for low, count in zip(lo.tolist(), n.tolist(), strict=True) for x in range(low, low + count)]
    assert starts == list(range(len(u) - 34))
    anchors = {}
    for h, low, count, place in zip(a.tolist(), lo.tolist(), n.tolist(), p.tolist(), strict=True):
        assert anchors.setdefault(h, u[low + place : low + place + 11].tobytes()) == u[low + place : low + place + 11].tobytes()
        assert 0 <= place - count + 1 and place + 11 <= count + 34
    # Equal windows have equal anchors at equal places.
    where = {x: (h, low + place - x) for h, low, count, place in zip(a.tolist(), lo.tolist(), n.tolist(), p.tolist(), strict=True) for x in range(low, low + count)}
    seen = {}
    for x in starts:
        assert seen.setdefault(u[x : x + 35].tobytes(), where[x]) == where[x]
    assert len(seen) < len(starts)
