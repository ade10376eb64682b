"""Substring dedup: relative Lempel-Ziv parsing against indexed reference blocks.

A block's reference is its segments, as sequences of word symbols, with an index over all their suffixes
(prefix-doubling ranks, which also give common prefixes). Each segment is parsed greedily: at a place, the
longest match that starts anywhere else in the reference becomes a factor, and parsing goes on behind it.
Factors of at least a window's length are duplicate spans. A window that begins inside a factor may end
beyond its boundary and still match another part of the reference, so the places before each boundary are
looked up too. How segments of all documents meet the blocks that can match them is described in ``repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content_key, cut, spread, table, tidy
from .repeats import hash_words, merge, repeated, unpacked

WINDOW = 35
ANCHOR = 11


class Reference:
    """Suffix index of a block; ``longest[i]`` is the length of the longest match of place ``i`` with any other place."""

    def __init__(self, rows: list[np.ndarray]):
        size = np.array([len(r) for r in rows], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size + 1)])  # a separator of its own closes each row
        n = int(self.start[-1])
        symbols = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[self.start[1:] - 1] = False
        symbols[inner] = np.unique(np.concatenate(rows), return_inverse=True)[1] + len(rows)
        symbols[~inner] = np.arange(len(rows))
        ranks, reach = [symbols], 1
        most = int(size.max()) + 1
        while reach < most:
            r = ranks[-1]
            key = r * (n + len(rows) + 1)
            key[: n - reach] += r[reach:] + 1
            ranks.append(np.unique(key, return_inverse=True)[1])
            reach *= 2
        order = np.argsort(ranks[-1], kind="stable")
        a, b = order[:-1], order[1:]
        common = np.zeros(n - 1, np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            x, y = a + common, b + common
            ok = (x < n) & (y < n)
            ok[ok] = ranks[level][x[ok]] == ranks[level][y[ok]]
            common[ok] += 1 << level
        self.longest = np.zeros(n, np.int64)
        self.longest[b] = common
        self.longest[a] = np.maximum(self.longest[a], common)


def engine(rows: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each row of symbols, whether the window at each start also starts elsewhere, from a greedy parse."""
    reference = Reference(rows)
    longest, flags = reference.longest, []
    for r, row in enumerate(rows):
        n = len(row)
        match = longest[reference.start[r] : reference.start[r] + n]
        out = np.zeros(max(0, n - window + 1), bool)
        at = 0
        while at < len(out):
            factor = int(match[at])
            if factor >= window:
                out[at : at + factor - window + 1] = True
            stop = at + max(factor, 1)
            # Windows that begin in this factor and cross its boundary.
            edge = max(at + 1, stop - window + 1)
            out[edge:stop] = match[edge : min(stop, len(out))] >= window
            at = stop
        flags.append(out)
    return flags


def without_repeats(docs: DataFrame, window: int = WINDOW, text_column: str = "text", with_text: bool = False) -> DataFrame:
    """One row a distinct text: ``k1, k2, n_words, n_removed, kept_sha256`` and, if asked for, ``kept`` (kept words joined by one space)."""
    texts, found = repeated(docs, text_column, window, min(ANCHOR, window), hash_words, engine)
    joined = texts.join(found.hint("shuffle_hash"), ["k1", "k2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                words = unpacked(text.as_py()).split()
                edges = [0, *merge(spans.as_py() or []).ravel().tolist(), len(words)]
                kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                joined_words = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), sha256(joined_words).hexdigest(), joined_words.decode() if with_text else None))
            n, removed, sha, shown = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(shown, pa.string())], names=["k1", "k2", "n_words", "n_removed", "kept_sha256", "kept"])

    out = joined.select("k1", "k2", "t", "spans").mapInArrow(tidy(run), "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, kept string")
    # Copies of a text from several partitions give equal rows.
    return (out if with_text else out.drop("kept")).dropDuplicates(["k1", "k2"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``. Null and empty texts: no words and the hash of nothing; repeated rows each give a row."""
    docs = spread(table(spark, sf_dir, "documents"))
    # Cut, so that a partition with very many copies of one text can be split.
    return docs.select("doc_id", *content_key(F.col("text"))).join(cut(without_repeats(docs)), ["k1", "k2"]).drop("k1", "k2")
