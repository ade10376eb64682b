"""Mixing sources to target weights.

1. *Targets*: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the total size; no
   source gets more than three times what it has, the excess going to the others by weight.
2. *Packing*: each source's documents, in a pseudorandom order, form one stream of words cut into blocks of
   fixed length. Stream positions come from two levels of sums, so a hot source is spread over many tasks.
3. *Drawing*: output shards have a fixed number of slots. The number of slots that each source fills in a
   shard is a multinomial draw weighted by what each source has to give, so totals meet targets. Draws form a
   tree over the shards, so tasks make them, each those of its own shards.
4. *Mapping*: a source's slots are numbered through all shards; slot ``j`` of pass ``e`` takes block
   ``P(j)``, a keyed permutation of the source's block numbers (a Feistel network with cycle walking). A
   short last block comes last in a pass, and a source's last slot is cut at the target.
5. *Joining*: slots and pieces of documents meet by source and block number.

Everything depends only on the rows and the seed, so reruns agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, importable, mix64, table, tidy, width

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
BLOCK, SHARD_SLOTS, SEED = 1024, 4096, 20
#: Parts of a source's stream; positions are summed within and over parts.
PARTS = 4096


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: float = MOST_PASSES) -> list[float]:
    """Target of each source, given in order with its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    total = float(sum(n for _, n in sizes))
    cap = [most * n for _, n in sizes]
    out = [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    left = total
    while open_:
        share = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if share * weight[i] > cap[i]]
        if not full:
            for i in open_:
                out[i] = share * weight[i]
            break
        for i in full:
            out[i] = float(cap[i])
            left -= cap[i]
            open_.discard(i)
        left = max(left, 0.0)
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of ``range(n)``, applied to each index."""
    if n < 2:
        return index.copy()
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    open_ = np.ones(len(index), bool)
    with np.errstate(over="ignore"):
        while open_.any():
            left, right = out[open_] >> np.uint64(half), out[open_] & mask
            for r in range(4):
                salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & ((1 << 64) - 1))
                left, right = right, left ^ (mix64(right + salt) & mask)
            out[open_] = (left << np.uint64(half)) | right
            open_ = out >= np.uint64(n)
    return out.astype(np.int64)


def slots_of(size: int, target: float, block: int) -> tuple[int, int]:
    """Slots that a source of ``size`` words fills to give ``target`` words, and the words of its last slot."""
    words = min(round(target), MOST_PASSES * size)
    if not size or not words:
        return 0, 0
    full, tail = divmod(size, block)
    blocks = full + (tail > 0)
    passes, rest = divmod(words, size)
    if not rest:
        return passes * blocks, tail or block
    if rest <= full * block:
        n = -(-rest // block)
        return passes * blocks + n, rest - (n - 1) * block
    return passes * blocks + full + 1, rest - full * block


def _multinomial(rng: np.random.Generator, n: int, left: np.ndarray) -> np.ndarray:
    """``n`` draws weighted by what each source has left, none above that; excess is drawn anew."""
    got = np.zeros_like(left)
    while missing := n - int(got.sum()):
        open_ = left - got
        got += np.minimum(rng.multinomial(missing, open_ / open_.sum()), open_)
    return got


def draw(slots: list[int], per_shard: int, seed: int, low: int = 0, high: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shards ``low .. high - 1``: number, each source's slots in earlier shards, and its slots in this one.

    A tree of draws: the shards of a node are halved, and a multinomial draw gives each source's slots in the left
    half. A node's generator is known by its bounds, so any task finds its own shards from the root, in as many
    draws as the tree is deep, and all tasks agree.
    """
    left = np.array(slots, np.int64)
    shards = -(-int(left.sum()) // per_shard)
    high = shards if high is None else min(high, shards)
    todo = [(0, shards, np.zeros_like(left), left)] if low < high else []
    while todo:
        a, b, before, has = todo.pop()
        if b - a == 1:
            yield a, before, has
            continue
        middle = (a + b) // 2
        first = _multinomial(np.random.default_rng([seed, a, b]), (middle - a) * per_shard, has)
        if high > middle:
            todo.append((middle, b, before + first, has - first))
        if low < middle:
            todo.append((a, middle, before, first))


class Mix:
    """The plan of a mixture: ``placed`` has each row's stream position, ``pieces`` what each slot takes of each row."""

    def __init__(self, docs: DataFrame, source_column: str = "source", text_column: str = "text", id_column: str = "doc_id", block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        spark = importable(docs.sparkSession)
        self.block = block
        marked = docs.select(F.col(id_column).alias("__id"), F.col(source_column).alias("__source"), F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("long").alias("__size"), F.xxhash64(F.lit(seed), id_column, text_column).alias("__h"))
        slim = cut(marked.withColumn("__part", F.pmod(F.shiftrightunsigned("__h", 40), F.lit(PARTS)).cast("int")))
        # One row a source: sources are names in a catalogue, not data.
        found = slim.groupBy("__source").agg(F.sum("__size").alias("n")).collect()
        rows = sorted(((r["__source"], r["n"]) for r in found), key=lambda r: (r[0] is None, (r[0] or "").encode()))
        self.targets = targets(rows)
        plan = [(name, i, n, t, *slots_of(n, t, block)) for i, ((name, n), t) in enumerate(zip(rows, self.targets, strict=True))]
        self.plan = spark.createDataFrame(plan, "__source string, s int, source_size long, target double, slots long, last long")
        by_part = slim.groupBy("__source", "__part").agg(F.sum("__size").alias("n"))
        before = by_part.select("__source", "__part", (F.sum("n").over(Window.partitionBy("__source").orderBy("__part")) - F.col("n")).alias("before"))
        inside = Window.partitionBy("__source", "__part").orderBy("__h", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)
        placed = slim.withColumn("within", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
        before = before.withColumnsRenamed({"__source": "b_source", "__part": "b_part"})
        placed = placed.join(before, F.col("__source").eqNullSafe(F.col("b_source")) & (F.col("__part") == F.col("b_part"))).withColumn("start", F.col("before") + F.col("within"))
        named = self.plan.select(F.col("__source").alias("p_source"), "s", "source_size", "target")
        placed = placed.join(named, F.col("__source").eqNullSafe(F.col("p_source")))
        self.placed = cut(placed.select("__id", "__h", "__size", "s", "start", "source_size", "target"))
        shards = -(-sum(p[4] for p in plan) // shard_slots)

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                # Numbers of a range come in order.
                numbers = batch.column(0).to_numpy()
                for shard, before, counts in draw([p[4] for p in plan], shard_slots, seed, int(numbers[0]), int(numbers[-1]) + 1):
                    for s in np.flatnonzero(counts).tolist():
                        _, _, size, _, slots, last = plan[s]
                        n = int(counts[s])
                        full, tail = divmod(size, block)
                        blocks = full + (tail > 0)
                        k = np.arange(int(before[s]), int(before[s]) + n)
                        turn, j = k // blocks, k % blocks
                        take = np.where(j < full, block, tail)
                        take[k == slots - 1] = last
                        to = j.copy()
                        for e in np.unique(turn).tolist():
                            here = (turn == e) & (j < full)
                            to[here] = permuted(j[here], full, (seed * 1009 + s) * 8 + e)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.full(n, s, np.int32)), pa.array(k), pa.array(turn.astype(np.int32)), pa.array(to), pa.array(take.astype(np.int32))], names=["shard", "s", "slot", "turn", "b", "take"])

        drawn = spark.range(0, shards, 1, max(1, min(shards, width(spark))))
        self.slots = drawn.mapInArrow(tidy(fill), "shard long, s int, slot long, turn int, b long, take int")
        spans = self.placed.where("__size > 0").select("s", "start", "__size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("__size") - 1) / block))).alias("b"))
        low, high = F.greatest(F.col("start"), F.col("b") * block), F.least(F.col("start") + F.col("__size"), (F.col("b") + 1) * block)
        spans = spans.select("s", "start", "b", (low - F.col("start")).alias("from_word"), (high - F.col("start")).alias("to_word"), (low - F.col("b") * block).alias("at"))
        # What a map makes of a short table can be long, which the planner does not know: no broadcast.
        joined = spans.join(self.slots.hint("merge"), ["s", "b"]).where("at < take")
        #: Row (s, start), words from_word .. to_word - 1, and the slot that takes them.
        self.pieces = joined.select("s", "start", "from_word", F.least(F.col("to_word"), F.col("from_word") + F.col("take") - F.col("at")).alias("to_word"), "shard", "slot", "turn")

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` of every row."""
        sums = self.pieces.groupBy("s", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
        out = self.placed.join(sums.withColumn("some", F.lit(True)), ["s", "start"], "left")
        taken = F.when(F.col("__size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0))
        return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, source_column: str = "source", text_column: str = "text", id_column: str = "doc_id", **settings) -> DataFrame:
    """The mixture as rows like ``docs``: one for each row and pass that is taken, its text cut to the words taken.

    A row's words taken in one pass stay in order, with their original white space; stretches that are not
    neighbours are joined by a line end. Rows of which nothing is taken (and rows without words) give none.
    """
    mix = Mix(docs, source_column, text_column, id_column, **settings)
    spans = mix.pieces.groupBy("s", "start", "turn").agg(F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("__spans"))
    # Rows of one id and text are interchangeable: they are told apart by their turn among themselves.
    alike = Window.partitionBy("__id", "__h").orderBy("s", "start")
    keyed = mix.placed.where("__size > 0").withColumn("__nth", F.row_number().over(alike)).join(spans, ["s", "start"]).select(F.col("__id").alias("__m_id"), F.col("__h").alias("__m_h"), F.col("__nth").alias("__m_nth"), "__spans")
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    # Other columns travel in a struct, so no name can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_column).alias("id"), F.xxhash64(F.lit(settings.get("seed", SEED)), id_column, text_column).alias("h"), F.xxhash64(*plain).alias("all"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", "h").orderBy("all")))
    joined = rows.join(keyed, F.col("id").eqNullSafe(F.col("__m_id")) & (F.col("h") == F.col("__m_h")) & (F.col("nth") == F.col("__m_nth")))

    @F.pandas_udf("string")
    def cut_text(texts, spans):
        word = re.compile(rb"[^\x20\x09-\x0D]+")
        out = []
        for text, pairs in zip(texts, spans, strict=True):
            raw = (text or "").encode()
            edges = [m.span() for m in word.finditer(raw)]
            runs: list[list[int]] = []
            for p in pairs:
                a, b = p["from_word"], p["to_word"]
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            out.append(b"\n".join(raw[edges[a][0] : edges[b - 1][1]] for a, b in runs).decode())
        return pd.Series(out, dtype=object)

    cut_ = joined.select("row", cut_text(F.col(f"row.`{text_column}`"), F.col("__spans")).alias("text"))
    return cut_.select(*[F.col("text").alias(c) if c == text_column else F.col(f"row.`{c}`") for c in docs.columns])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all of ``documents``. Null texts have size 0; repeated rows each count; an empty table gives an empty result."""
    return Mix(table(spark, sf_dir, "documents")).taken()
