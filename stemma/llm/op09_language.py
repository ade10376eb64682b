"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (a blended spectrum: all lengths from 1 to 5)
that both contain, over the geometric mean of what each contains. N-grams are presence bits in a hashed
space. Nyström: a sample of training texts serves as landmarks, and kernel ridge regression, one class
against the rest, is solved in the space they span. Scoring is ``K(x, landmarks) @ B``; as the kernel is a
product of presence vectors, ``landmarks @ B`` is folded once into a weight matrix, and batches of texts are
scored by matrix products.

Fitting uses a bounded sample of labelled rows (``SAMPLE``); scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, importable, pieces, spread, table, tidy

SPECTRUM = 5
BITS = 15
SAMPLE, LANDMARKS, RIDGE = 3000, 400, 1e-3
HELD_OUT = 5
BATCH = 128


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return out


def presence(text: str, is_letter: np.ndarray, out: np.ndarray) -> bool:
    """Mark the n-grams of a text in ``out`` (zeros); false if it has no letter.

    Letters are lowered; every run of other characters counts as one blank.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter[codes]
    if not letter.any():
        return False
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character behind a run of letters stays, as a blank
    codes = np.concatenate([[0], np.where(letter, codes, 0)[keep], [0]]).astype(np.uint64)
    shift, mult = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        key = codes + np.uint64(1)
        for n in range(1, SPECTRUM + 1):
            if n > 1:
                if len(key) < 2:
                    break
                key = key[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
            out[((key + np.uint64(n)) * mult) >> shift] = 1
    return True


def fit(packed: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Classes and weights by presence bit. ``packed``: the bits of a training text in each row, in the sample's order."""
    classes = sorted(set(langs))
    def unit(rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(rows, axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    # Landmarks take turns among the classes, so that rare ones have theirs.
    turn = sorted(range(len(langs)), key=lambda i, seen={}: (seen.__setitem__(langs[i], seen.get(langs[i], -1) + 1) or seen[langs[i]], i))
    mark = unit(packed[turn[:landmarks]])
    k_mm = (mark @ mark.T).astype(np.float64)
    k_nm = np.concatenate([unit(packed[at : at + 256]) @ mark.T for at in range(0, len(packed), 256)]).astype(np.float64)
    value, vector = np.linalg.eigh(k_mm)
    fine = value > 1e-6 * value.max()
    root = vector[:, fine] / np.sqrt(value[fine])
    z = k_nm @ root
    y = np.array([[1.0 if lang == c else 0.0 for c in classes] for lang in langs])
    # Every class weighs the same in sum.
    w = (1 / y.sum(0))[y.argmax(1)][:, None]
    w *= len(langs) / w.sum()
    alpha = np.linalg.solve(z.T @ (w * z) + ridge * len(langs) * np.eye(z.shape[1]), z.T @ (w * y))
    return classes, (mark.T @ (root @ alpha).astype(np.float32)).astype(np.float32)


def held_out(id_column: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    ``und`` with score 0 where a text is null or has no letter, and everywhere if no row is labelled. A null
    id is never held out nor learned from. Repeated rows are scored each, and each may be drawn to learn from. Of
    languages with equal scores the first in code-point order is taken. An empty table gives an empty result;
    other columns are not looked at.
    """
    importable(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    labelled = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("t"), F.col(lang_column).alias("lang"), held_out(id_column).alias("out")).where("lang IS NOT NULL AND NOT out AND doc_id IS NOT NULL AND t IS NOT NULL")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(1, sample // max(1, len(counts)))
    # A draw by hash of the id, at each language's rate, and of that the first of each language: the documented bound.
    h = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    rate = F.lit(None)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1 << 30, int((1 << 30) * each / n) + 1))).otherwise(rate)
    chosen = labelled.where(h < rate).select("t", "lang", h.alias("h")) if counts else None

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = letters()
        for batch in batches:
            rows = []
            for t, lang, order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mark = np.zeros(1 << BITS, np.uint8)
                if presence(t, known, mark):
                    rows.append((np.packbits(mark).tobytes(), lang, order))
            if rows:
                b, g, o = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.binary()), pa.array(g, pa.string()), pa.array(o, pa.int64())], names=["b", "lang", "h"])

    # At most `sample` rows of four kilobytes (one a language, if there are more languages than that).
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "b"))
    rows = chosen.mapInArrow(tidy(bits), "b binary, lang string, h long").withColumn("nth", nth).where(F.col("nth") <= each).collect() if counts else []
    rows.sort(key=lambda r: (r.h, bytes(r.b), r.lang))
    classes, weights = (["und"], np.zeros((1 << BITS, 1), np.float32)) if not rows else fit(np.array([np.frombuffer(r.b, np.uint8) for r in rows]), [r.lang for r in rows])

    def make():
        known = letters()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, texts in pieces(batch.column(2)):
                best, score = [], []
                for at in range(0, len(texts), BATCH):
                    some = texts[at : at + BATCH]
                    x = np.zeros((len(some), 1 << BITS), np.float32)
                    has = np.array([presence(t.decode(), known, row) for t, row in zip(some, x, strict=True)])
                    found = (x @ weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
                    top = found.argmax(1)
                    best += [classes[i] if ok else "und" for i, ok in zip(top.tolist(), has.tolist(), strict=True)]
                    score += np.where(has, np.clip(found.max(1), 0, 1), 0).astype(np.float64).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

        return step

    return arrow_map(docs.select(F.col(id_column), held_out(id_column).alias("out"), text_column), make, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return identify(spread(table(spark, sf_dir, "documents")))
