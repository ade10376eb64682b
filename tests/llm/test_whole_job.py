"""The corpus operators do the whole job: rows on which a narrowed method gives other results."""

import random
from collections import Counter
from math import log

import public_tokenizers

import corpus_pipeline
from stemma.llm import near_copies, op04_simhash, op10_lm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)


def test_long_text_without_function_words_is_rejected(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeionrstl") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    prose = [" ".join(rng.choice(("the", "of", "and", "to", "in")) if rng.random() < 0.25 else rng.choice(words) for _ in range(120)) for _ in range(30)]
    docs = table_of(spark, [*prose, " ".join(rng.choice(words) for _ in range(120))])
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()} == set(range(30))


def test_single_trigrams_count(spark, tmp_path):
    texts = ["the cat sat on the mat", "the cat sat on the rug", "a heron waits by the river", ""]
    table_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    encode = op10_lm.tokenizer(public_tokenizers.path(op10_lm.VOCABULARY)).encode_ordinary
    tokens = [encode(t) for t in texts]
    c = Counter(tuple(x[i : i + n]) for x in tokens for n in (1, 2, 3) for i in range(len(x) - n + 1))
    total = sum(map(len, tokens))
    # A model of its own texts knows every n-gram, so nothing ever backs off.
    want = {i: sum(log(c[tuple(x[max(0, k - 2) : k + 1])] / (c[tuple(x[max(0, k - 2) : k])] if k else total)) for k in range(len(x))) for i, x in enumerate(tokens)}
    got = {r.doc_id: r.log_score for r in op10_lm.op10_lm_scores(spark, str(tmp_path)).collect()}
    assert {i: round(v, 6) for i, v in got.items()} == {i: round(v, 6) for i, v in want.items()}


def test_near_copies_of_similarity_08_go(spark):
    rng = random.Random(2)
    texts, drop = [], set()
    for _ in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        # Words far apart changed: each takes five shingles of 196. Four leave 176 of 216 (0.81), six 166 of 226 (0.73).
        for changed in (0, 4, 6):
            copy = list(words)
            for k in range(changed):
                copy[15 + 30 * k] = f"x{rng.randint(0, 10**6)}"
            drop |= {len(texts)} if changed == 4 else set()
            texts.append(" ".join(copy))
    texts += ["", " ", "one two", "One  two", "three"]
    drop |= {37, 39}
    docs = table_of(spark, texts)
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()} == set(range(len(texts))) - drop
    assert not drop - {37, 39} <= {i for i in range(36)} - {r.doc_id for r in op04_simhash.one_of_each(docs).collect()}
    sets = [near_copies.shingles(t.encode()) for t in texts[:36]]
    assert all(near_copies.alike(sets[i], sets[i + 1]) and not near_copies.alike(sets[i], sets[i + 2]) for i in range(0, 36, 3))
