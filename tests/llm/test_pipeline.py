"""The pipeline's stages on the smallest driver tables, each against what it must keep."""

import corpus_pipeline
from stemma.llm import near_copies, op01_suffix, op03_bpe, op05_quality
from stemma.llm.common import table, written


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, data))
        kept.append(docs.count())
        if name != "bpe_encode":
            assert docs.columns == columns
            assert docs.where("text IS NULL OR n_chars <> length(text)").count() == 0
        if name == "quality_rules":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in op05_quality.quality(before).where("kept").collect()}
        if name == "simhash_dedup":
            # Brute force over all pairs: five words, Jaccard similarity of 0.8; the smallest id of each component stays.
            ids, texts = zip(*sorted((r.doc_id, r.text) for r in before.collect()), strict=True)
            sets = [near_copies.shingles(t.encode()) for t in texts]
            least = list(range(len(ids)))
            pairs = [(a, b) for a in range(len(ids)) for b in range(a) if near_copies.alike(sets[a], sets[b])]
            while any(least[a] != least[b] for a, b in pairs):
                for a, b in pairs:
                    least[a] = least[b] = min(least[a], least[b])
            assert {r.doc_id for r in docs.collect()} == {ids[k] for k in least}
        if name == "suffix_dedup":
            seen, again = set(), set()
            for r in before.collect():
                t = r.text.encode()
                for i in range(len(t) - 249):
                    (again if t[i : i + 250] in seen else seen).add(t[i : i + 250])
            for r in docs.collect():
                t = r.text.encode()
                assert sum(t[i : i + 250] in again for i in range(len(t) - 249)) <= 12, "only where a character was kept whole, or two kept stretches meet"
        if name == "mix_sources":
            size = {r.doc_id: len(r.text.encode().split()) for r in before.collect()}
            words: dict[int, int] = {}
            for r in docs.collect():
                words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
            assert all(n <= 3 * size[i] for i, n in words.items())
        if name == "bpe_encode":
            encoder = op03_bpe.Encoder(op03_bpe.public_tokenizers.path(op03_bpe.VOCABULARY))
            texts: dict[int, list] = {}
            for r in before.collect():
                texts.setdefault(r.doc_id, []).append(encoder.encode(r.text))
            for r in docs.collect():
                assert list(r.token_ids) in texts[r.doc_id] and len(r.token_ids) == r.n_tokens
    assert kept[0] >= kept[1] >= kept[2] > 0
    assert op01_suffix.LENGTH == 400 and op01_suffix.STAGE_LENGTH == 250
