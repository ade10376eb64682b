"""Near copies by similarity: sets of word shingles whose Jaccard similarity reaches a limit.

1. A map gives each text a hash of its set of shingles and ``BANDS`` hashes of ``ROWS`` least values each. Equal
   sets become one row. Sets of similarity 0.8 share no band in one case of 16,000.
2. Sets that share a band are linked to the least of them; components of these links are the candidates.
3. A task gets whole components of candidates with their texts, compares sets that share a band exactly, and
   emits links. Connected components of those are the groups. A component of more than ``BLOCK`` shingles is cut
   into blocks by set size, similar sets being in the same or the next class of sizes, and each pair of blocks
   that can hold links is compared by itself, so no task holds more than two blocks.

64 bits of a SimHash cannot do this alone: at similarity 0.8 about ten of them differ. Where groups are taken for
the pipeline (``one_of_each``), links of SimHash fingerprints within three bits, from operator 4's index, count too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import op04_simhash
from .common import arrow_map, cut, mix64, pieces, tidy, width
from .components import components
from .op04_simhash import SEED, first_of_groups

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 32, 6
#: Shingles that a task holds at once, unless one text has more.
BLOCK = 2_000_000
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles in order; a shorter text is one shingle, no word gives none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(size) - 1
    begin, end = (stop - size + 1)[:n].tolist(), stop[min(shingle, len(words)) - 1 :].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)], np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 512):
            least = np.minimum(least, (_FACTORS[:, None] * found[None, at : at + 512]).min(1))
        out = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two ordered sets have that Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def links(sets: list[np.ndarray], least: float = LEAST, side: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of places, enough to connect all similar sets that share a band; with ``side``, all those of different sides."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    buckets: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(sets):
        for b in bands(s).tolist():
            buckets[b].append(i)
    out, tried = [], set()
    for bucket in buckets.values():
        known: dict[int, list[int]] = {}
        for i in bucket:
            mine = find(i)
            for r in [r for r in known if find(r) != mine]:
                for j in known[r]:
                    if (j, i) not in tried and (side is None or side[i] != side[j]):
                        tried.add((j, i))
                        if alike(sets[j], sets[i], least):
                            out.append((j, i))
                            root[max(find(j), mine)] = min(find(j), mine)
                            mine = find(i)
                            break
            merged: dict[int, list[int]] = {}
            for r, members in known.items():
                merged.setdefault(find(r), []).extend(members)
            merged.setdefault(mine, []).append(i)
            known = merged
    return out


def _tiles(members: DataFrame, least: float) -> DataFrame:
    """``least, fp, tile, side``: each candidate set once for each comparison it takes part in (``side`` 2: with all of its tile).

    ``members`` has ``least, fp, m`` (its number of shingles) and ``component``.
    """
    total = cut(members.groupBy("component").agg(F.sum("m").alias("total")).select("component", (F.col("total") > BLOCK).alias("large")))
    told = members.join(total, "component")
    calm = told.where("NOT large").select("least", "fp", F.col("component").alias("tile"), F.lit(2).alias("side"))
    # Similar sets differ in size by a factor of at most 1 / least: their classes are the same or neighbours.
    large = told.where("large").withColumn("k", F.floor(F.log(F.greatest("m", F.lit(1))) / float(np.log(1 / least) + 1e-9)).cast("int"))
    count = cut(large.groupBy("component", "k").agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("blocks")))
    near = count.select("component", (F.col("k") - 1).alias("k"), F.col("blocks").alias("up"))
    below = count.select("component", (F.col("k") + 1).alias("k"), F.col("blocks").alias("down"))
    count = cut(count.join(near, ["component", "k"], "left").join(below, ["component", "k"], "left"))
    large = large.join(count, ["component", "k"]).withColumn("j", F.pmod(F.hash("fp"), "blocks"))

    def to(k1, j1, k2, j2, side):
        return F.struct(k1.alias("k1"), j1.alias("j1"), k2.alias("k2"), j2.alias("j2"), side.cast("int").alias("side"))

    def numbers(n):
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    k, j = F.col("k"), F.col("j")
    same = F.transform(numbers(F.col("blocks")), lambda x: to(k, F.least(x, j), k, F.greatest(x, j), F.when(x == j, 2).when(j < x, 0).otherwise(1)))
    over = F.transform(numbers(F.col("up")), lambda x: to(k, j, k + 1, x, F.lit(0)))
    under = F.transform(numbers(F.col("down")), lambda x: to(k - 1, x, k, j, F.lit(1)))
    dealt = large.select("least", "fp", "component", F.explode(F.concat(same, over, under)).alias("x"))
    return calm.unionByName(dealt.select("least", "fp", F.xxhash64("component", "x.k1", "x.j1", "x.k2", "x.j2").alias("tile"), F.col("x.side").alias("side")))


def _marked(rows: DataFrame, shingle: int, prints: bool = False) -> DataFrame:
    """``doc_id, fp, m, bands`` of rows ``row, t``: a hash of the set of shingles, its size and bands; with ``prints`` also ``print``, operator 4's fingerprint."""
    kind = rows.schema["row"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, texts in pieces(batch.column(1)):
                sets = [shingles(t, shingle) for t in texts]
                fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                out = {"doc_id": batch.column(0).slice(first, len(texts)), "fp": pa.array(fp), "m": pa.array(list(map(len, sets)), pa.int32()), "bands": pa.array([bands(s).view(np.int64) for s in sets], pa.list_(pa.int64()))}
                if prints:
                    out["print"] = pa.array(np.array([op04_simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        return step

    return cut(arrow_map(rows.select("row", "t"), make, f"doc_id {kind}, fp long, m int, bands array<long>" + ", print long" * prints))


def _set_links(rows: DataFrame, distinct: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links ``u, v`` between similar sets that share a band, enough to connect them; ``distinct`` has ``fp, least, m, bands``."""
    each = distinct.select("fp", F.explode("bands").alias("b"))
    # Both sides of this join are plain rows of a shuffle, so a band that very many sets share can be split.
    shared = cut(each.groupBy("b").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").select("b", "u"))
    candidates = components(each.join(shared, "b").where("u <> fp").select("u", F.col("fp").alias("v")).distinct())
    # A component's smallest node has no row of its own.
    candidates = candidates.unionByName(candidates.select(F.col("component").alias("node"), "component").distinct())
    members = cut(candidates.join(distinct, candidates.node == distinct.fp).select("least", "fp", "m", "component"))
    texts = rows.join(_tiles(members, least), F.col("row") == F.col("least")).select("tile", "side", "fp", F.coalesce("t", F.lit("")).cast("binary").alias("t"))
    texts = texts.repartition(width(rows.sparkSession), "tile").sortWithinPartitions("tile", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows))
        for _, group in groupby(each, key=lambda r: r[0]):
            known = {fp: (side, shingles(t, shingle)) for _, side, fp, t in group}
            names, side = list(known), [x for x, _ in known.values()]
            found = links([x for _, x in known.values()], least, None if 2 in side else side)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in found], pa.int64()), pa.array([names[j] for _, j in found], pa.int64())], names=["u", "v"])

    return texts.mapInArrow(tidy(compare), "u long, v long")


def _told(marked: DataFrame, nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``doc_id, component_id`` of marked rows, whose ``node`` is one of ``nodes`` (with ``least``, its smallest row) and linked by ``edges (u, v)``."""
    named = nodes.select(node, "least").join(components(edges).withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", node).join(named.select(node, "component").join(first, "component").select(node, "component_id"), node).select("doc_id", "component_id")


def near_groups(rows: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``doc_id, component_id`` of rows ``row, t``: the smallest row of all that links reach."""
    marked = _marked(rows, shingle)
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("m").alias("m"), F.first("bands").alias("bands")))
    return _told(marked, distinct, _set_links(rows, distinct, shingle, least), "fp")


def joined_groups(rows: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``doc_id, component_id`` of rows ``row, t``: the smallest row reachable through links of SimHash fingerprints and of similar sets together.

    Fingerprints are the nodes. Texts of one set are linked by the least of their fingerprints, which stands for the
    set in its links, so links of both kinds give components at once.
    """
    marked = _marked(rows, shingle, prints=True)
    ends = [F.min("print").alias("print"), F.max("print").alias("last")]
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("m").alias("m"), F.first("bands").alias("bands"), *ends))
    prints = cut(marked.groupBy("print").agg(F.min("doc_id").alias("least")))
    at = lambda end: distinct.select(F.col("fp").alias(end), F.col("print").alias(f"{end}_print"))
    similar = _set_links(rows, distinct, shingle, least).join(at("u"), "u").join(at("v"), "v").select(F.col("u_print").alias("u"), F.col("v_print").alias("v"))
    # Texts of one set that have several fingerprints: their words stand in another order.
    mixed = distinct.where("print <> last").select("fp", F.col("print").alias("u"))
    same = marked.select("fp", F.col("print").alias("v")).join(mixed, "fp").where("u <> v").select("u", "v").distinct()
    close = op04_simhash.links(prints.select(F.col("print").alias("fp")))
    return _told(marked, prints, close.unionByName(similar).unionByName(same), "print")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near copies, by fingerprints and by similarity, chosen as in ``op04_simhash.one_of_each``."""
    return first_of_groups(docs, lambda rows: joined_groups(rows, shingle, least), id_column, text_column)
