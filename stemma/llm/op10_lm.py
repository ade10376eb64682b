"""Language-model scores: stupid backoff over token n-grams, computed by joining count tables.

``S(c | a b)`` is ``f(abc) / f(ab)`` if the trigram occurs in the corpus, else ``0.4 f(bc) / f(b)`` if the
bigram does, else ``0.16 f(c) / N``. Counts below a cutoff may be taken as none; the query takes all as they are. Tokens come from a public byte-level
vocabulary; a text's first token is scored by its unigram, its second by its bigram, with no discount for
the context that is not there.

1. Documents are read in *blocks* of consecutive documents. A block's n-grams of all orders are exploded and
   combined, and dealt by hash into the parts of the count table.
2. A part adds up the counts of all blocks and joins them to the n-grams that each block asked for, which
   answers the block with their totals.
3. A block's documents are joined to its answers, by block; log scores are summed for each document.

These are the relations (n-gram, count) and (document, n-gram) and their join by hash partition. Rows are packed
by block and part, sorted by n-gram, so a join merges sorted runs inside a task, instead of one row of Spark's
for each n-gram. What moves grows with the distinct n-grams of a block, not with its tokens, and no n-gram is hot:
a block sends each of its n-grams once. The number of parts follows the number of tokens, and parts and blocks
are dealt to tasks by number, so the largest task does not grow with the corpus. Nothing is collected or broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, importable, mix64, pieces, spread, table, tidy, width

VOCABULARY = "byte_bpe_50k.tiktoken"
ORDER, CUTOFF, DISCOUNT = 3, 2, 0.4
#: Tokens of a block; a longer text makes a block of its own.
BLOCK = 2_000_000
#: Tokens of the corpus for each part of the count table, at most: what a part holds and answers is bounded by it.
PART = 3_000_000
BITS = 20  # of a token id in an n-gram's key
TOKEN = "<u4"  # as which tokens are packed

SCHEMA = "block long, part int, ids array<long>, sizes array<int>, data binary"


def tokenizer(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def grams(tokens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Keys of the n-grams of each order, ending at each token; -1 where a text has not so many tokens yet."""
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(tokens)) - np.repeat(start, sizes)
    out = [tokens]
    for order in range(2, ORDER + 1):
        longer = np.full(len(tokens), -1, np.int64)
        longer[1:] = (out[-1][:-1] << BITS) | tokens[1:]
        longer[place < order - 1] = -1
        out.append(longer)
    return out


def tagged(keys: np.ndarray, order: int) -> np.ndarray:
    """Keys of different orders told apart: no id is as long as its room, so the top bits are free."""
    return keys | (np.int64(order) << np.int64(61))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def shrink(values: np.ndarray, kind: str) -> bytes:
    """Numbers as compressed byte planes."""
    raw = values.astype(kind)
    return zstandard.ZstdCompressor(level=3).compress(raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes())


def grow(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)


def by_part(items: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the items in which those of a part stand together, and the parts' edges in it."""
    part = part_of(items, parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _row(block: int, part: int, ids: list | None, sizes: list, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "part": pa.array([part], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int32())), "data": pa.array([data], pa.binary())})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def lm_scores(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", cutoff: int = CUTOFF) -> DataFrame:
    """``doc_id, n_tokens, log_score, mean_log_score`` of every row (natural logs).

    Null and empty texts: no tokens, a sum of 0 and a null mean. Repeated rows are counted and scored each.
    Ids must be whole numbers or null. Bigrams and trigrams that occur less than ``cutoff`` times count for nothing.
    """
    spark = importable(docs.sparkSession)

    def read_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        block = TaskContext.get().partitionId() << 24
        ids: list = []
        held: list[np.ndarray] = []
        total = 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, texts in pieces(batch.column(1)):
                for i, text in enumerate(texts, first):
                    held.append(np.array(encode(text.decode()), np.uint32))
                    ids.append(names[i])
                    total += len(held[-1])
                    if total >= BLOCK:
                        yield _row(block, -1, ids, list(map(len, held)), shrink(np.concatenate(held), TOKEN))
                        block, total = block + 1, 0
                        held.clear()
                        ids.clear()
        if held:
            yield _row(block, -1, ids, list(map(len, held)), shrink(np.concatenate(held), TOKEN))

    blocks = cut(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(text_column, F.lit("")).cast("binary").alias("t")).mapInArrow(tidy(read_in), SCHEMA))

    count = blocks.select(F.count("*"), F.count_distinct(F.shiftright("block", 24)), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n = count[2] or 1
    parts = max(width(spark), -(-n // PART))
    # Blocks have numbers within their task's: about as many in each, so these are nearly numbers without gaps.
    run_of = max(1, -(-count[0] // max(1, count[1])))
    tasks = max(1, min(run_of * count[1], 4 * parts))
    home = F.pmod(F.shiftright("block", 24) * run_of + F.col("block").bitwiseAND(F.lit((1 << 24) - 1)), F.lit(tasks)).cast("int")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, sizes, data in _rows(batches):
            each = [np.unique(k[k >= 0], return_counts=True) for k in grams(grow(data, TOKEN), np.array(sizes, np.int64))]
            items, counts = np.concatenate([tagged(k, n) for n, (k, _) in enumerate(each, 1)]), np.concatenate([c for _, c in each])
            order, edge = by_part(items, parts)
            for p in range(parts):
                at = order[edge[p] : edge[p + 1]]
                if len(at):
                    keys = shrink(np.diff(items[at], prepend=0), "<i8")
                    yield _row(block, p, None, [len(keys)], keys + shrink(counts[at], "<u4"))

    def keys_of(data: bytes, size: int) -> np.ndarray:
        return np.cumsum(grow(data[:size], "<i8"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in groupby(_rows(batches), key=lambda r: r[1]):
            asked = [(block, sizes[0], data) for block, _, _, sizes, data in group]
            keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
            # Blocks are merged a few at a time, so that repeats are combined as they come.
            for at in range(0, len(asked), 16):
                some = asked[at : at + 16]
                every = np.concatenate([keys, *(keys_of(data, size) for _, size, data in some)])
                times = np.concatenate([counts, *(grow(data[size:], "<u4") for _, size, data in some)])
                keys, where = np.unique(every, return_inverse=True)
                counts = np.zeros(len(keys), np.int64)
                np.add.at(counts, where, times)
            total = np.where(((keys >> 61) > 1) & (counts < cutoff), 0, counts)
            for block, size, data in asked:
                yield _row(block, part, None, [0], shrink(total[np.searchsorted(keys, keys_of(data, size))], "<u8"))

    asked = blocks.mapInArrow(tidy(explode), SCHEMA).repartitionById(parts, "part").sortWithinPartitions("part", "block")
    answers = asked.mapInArrow(tidy(add_up), SCHEMA)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_rows(batches), key=lambda r: r[0]):
            # The block's documents come first (part -1), then the answers by part.
            _, _, ids, sizes, data = next(group)
            size, tokens = np.array(sizes, np.int64), grow(data, TOKEN)
            found = grams(tokens, size)
            items, places = [], []
            for order, k in enumerate(found, 1):
                distinct, where = np.unique(k[k >= 0], return_inverse=True)
                items.append(tagged(distinct, order))
                places.append(where)
            edges = np.cumsum([0, *map(len, items)])
            order, _ = by_part(np.concatenate(items), parts)
            answered = [grow(row[4], "<u8") for row in group]
            totals = np.zeros(edges[-1])
            totals[order] = np.concatenate(answered) if answered else 0
            del items, answered, order
            f = []
            for i, k in enumerate(found):
                here = np.zeros(len(tokens))
                here[k >= 0] = totals[edges[i] : edges[i + 1]][places[i]]
                f.append(here)
            del found, places, totals
            one, two, three = f
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
            steps = np.minimum(place, 2)
            before, pair_before = np.concatenate([[0.0], one[:-1]]), np.concatenate([[0.0], two[:-1]])
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where((three > 0) & (pair_before > 0), three / pair_before, np.where(two > 0, two / before * DISCOUNT ** np.maximum(steps - 1, 0), one / n * DISCOUNT**steps))
            logs = np.concatenate([[0.0], np.log(s)])
            stop = np.cumsum(size)
            # Sums over stretches that may be empty: an added zero closes the last one.
            total = np.where(size > 0, np.add.reduceat(np.append(logs[1:], 0.0), np.minimum(stop - size, len(tokens))), 0.0) if len(size) else np.empty(0)
            mean = [t / k if k else None for t, k in zip(total.tolist(), sizes, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(size), "log_score": pa.array(total), "mean_log_score": pa.array(mean, pa.float64())})

    both = answers.unionByName(blocks)
    return both.repartitionById(tasks, home).sortWithinPartitions("block", "part").mapInArrow(tidy(score), "doc_id long, n_tokens long, log_score double, mean_log_score double")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` under the trigram model of all of ``documents``."""
    return lm_scores(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(VOCABULARY), cutoff=1)
