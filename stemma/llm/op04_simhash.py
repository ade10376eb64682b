"""SimHash near-dedup through a Gray-order hierarchical index.

1. A map gives each text its 64-bit fingerprint. Equal fingerprints become one row before anything moves.
2. Two fingerprints within three bits agree in one of four 16-bit parts. Each distinct fingerprint goes to
   its four (part, value) groups; a task indexes all groups it was dealt. A group of too many codes is dealt
   anew by four parts of its other 48 bits, and so on.
3. The index sorts a group by Gray rank, so that neighbours differ in few bits, and factors the bits that a
   run of neighbours shares (mask and pattern) into upper nodes, level by level. A search walks pairs of
   nodes and drops a pair as soon as the differences of the shared bits exceed the radius, or when both
   sides already belong to one component. Radii grow from 1 to 3, so dense groups are joined by their
   cheapest links first.
4. A task emits a spanning forest of the links it found; connected components finish the work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, content_key, cut, pieces, spread, table, tidy, width
from .components import components

RADIUS = 3
FAN = 8
SEED = 42
#: Node pairs that a task holds at once.
FRONTIER = 1 << 17
#: Codes of a group above which it is dealt anew by a second part.
MANY = 200_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits; a bit is set if more than half of the shingles' hashes have it. No word: zero."""
    words = text.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(size) - 1
    begin = (stop - size + 1)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin, stop[shingle - 1 :].tolist(), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        votes += np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp long`` (the 64 bits as a signed value) of every row; null text counts as empty."""
    kind = docs.schema[id_column].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, texts in pieces(batch.column(1)):
                fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(fp)], names=["doc_id", "fp"])

        return step

    return arrow_map(docs.select(id_column, text_column), make, f"doc_id {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the binary reflected Gray sequence."""
    out = codes.copy()
    for by in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(by)
    return out


class GrayIndex:
    """Index of several groups of distinct codes; ``links`` finds a spanning forest of the pairs within a radius, group by group."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), group))
        self.codes = codes[order]
        _, first, size = np.unique(group[order], return_index=True, return_counts=True)
        self.label = np.arange(len(codes), dtype=np.int64)
        every = np.arange(len(codes), dtype=np.int64)
        # By level: AND and OR of each node's codes, its first item, its first child and number of children.
        self.low, self.high, self.first, self.child, self.fan = [self.codes], [self.codes], [every], [every], [np.ones_like(every)]
        first, size = first.astype(np.int64), size.astype(np.int64)
        while True:
            nodes = -(-size // FAN)
            start = np.cumsum(nodes) - nodes
            where = np.repeat(np.arange(len(size)), nodes)
            local = np.arange(int(nodes.sum())) - start[where]
            child = first[where] + local * FAN
            self.low.append(np.bitwise_and.reduceat(self.low[-1], child))
            self.high.append(np.bitwise_or.reduceat(self.high[-1], child))
            self.first.append(self.first[-1][child])
            self.child.append(child)
            self.fan.append(np.minimum(FAN, size[where] - local * FAN))
            if (nodes <= 1).all():
                break
            first, size = start, nodes
        self.forest: list[tuple[int, int]] = []

    def _uniform(self) -> None:
        """The component of each node whose items all share one, else -1."""
        self.one = [self.label]
        for child in self.child[1:]:
            low, high = np.minimum.reduceat(self.one[-1], child), np.maximum.reduceat(self.one[-1], child)
            self.one.append(np.where(low == high, low, -1))

    def _join(self, a: np.ndarray, b: np.ndarray) -> bool:
        la, lb = self.label[a], self.label[b]
        new = la != lb
        if not new.any():
            return False
        a, b, la, lb = a[new], b[new], la[new], lb[new]
        pair, at = np.unique(np.minimum(la, lb) * len(self.codes) + np.maximum(la, lb), return_index=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for x, y, i in zip((pair // len(self.codes)).tolist(), (pair % len(self.codes)).tolist(), at.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                self.forest.append((int(a[i]), int(b[i])))
        to = np.arange(len(self.codes))
        touched = list(root)
        to[touched] = [find(x) for x in touched]
        self.label = to[self.label]
        return True

    def links(self, radius: int) -> np.ndarray:
        """Pairs of codes, enough to connect all that pairs within ``radius`` connect."""
        top = len(self.low) - 1
        for r in range(1, radius + 1):
            self._uniform()
            roots = np.arange(len(self.low[top]))
            stack, seen, changed = [(top, roots, roots)], 0, False
            while stack:
                level, a, b = stack.pop()
                if len(a) > FRONTIER:
                    stack += [(level, a[FRONTIER:], b[FRONTIER:])]
                    a, b = a[:FRONTIER], b[:FRONTIER]
                seen += len(a)
                one = self.one[level]
                mixed = (one[a] != one[b]) | (one[a] < 0)
                # Bits that all items of a node share: the AND equals the OR there.
                shared = ~(self.low[level][a] ^ self.high[level][a]) & ~(self.low[level][b] ^ self.high[level][b])
                near = np.bitwise_count((self.low[level][a] ^ self.low[level][b]) & shared) <= r
                keep = mixed & near if level else near & (a != b)
                a, b = a[keep], b[keep]
                if not len(a):
                    continue
                if level == 0:
                    changed |= self._join(a, b)
                    if changed and seen > 4 * len(self.codes):
                        self._uniform()
                        seen, changed = 0, False
                    continue
                fan = self.fan[level]
                count = fan[a] * fan[b]
                which = np.repeat(np.arange(len(a)), count)
                k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                x, y = self.child[level][a][which] + k // fan[b][which], self.child[level][b][which] + k % fan[b][which]
                ok = x <= y
                stack.append((level - 1, x[ok], y[ok]))
        if not self.forest:
            return np.empty((0, 2), np.uint64)
        return self.codes[np.array(self.forest)]


def dealt(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, g``: every fingerprint once for each group in which it is compared.

    Codes within the radius agree in one of ``radius + 1`` parts of their bits, so each code goes to as many groups,
    by part and value. Within a group of more than ``MANY`` codes the same holds for the bits that are left: such a
    group is dealt anew by parts of those, and again, as long as there are bits to tell parts by.
    """
    parts = radius + 1
    rows, bits, out = distinct.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("g")), 64, None
    while True:
        size = bits // parts
        last = bits - size * (parts - 1)
        shift = lambda by: F.shiftrightunsigned("rest", by) if by < 64 else F.lit(0).cast("long")
        low = lambda x, n: x.bitwiseAND(F.lit((1 << n) - 1)) if n else F.lit(0).cast("long")
        ways = [
            F.struct(F.lit(i).alias("i"), low(shift(size * i), last if i == parts - 1 else size).alias("value"), F.shiftleft(shift(size * i + (last if i == parts - 1 else size)), size * i).bitwiseOR(low(F.col("rest"), size * i)).alias("rest"))
            for i in range(parts)
        ]
        spread = rows.select("fp", "g", F.explode(F.array(*ways)).alias("x")).select("fp", F.col("x.rest").alias("rest"), F.xxhash64("g", "x.i", "x.value").alias("g"))
        # Codes of one part leave as many bits as the least that another leaves.
        bits -= size
        if bits < 2 * parts:
            return spread.select("fp", "g") if out is None else out.unionByName(spread.select("fp", "g"))
        large = cut(spread.groupBy("g").count().where(F.col("count") > MANY).select("g"))
        if large.isEmpty():
            return spread.select("fp", "g") if out is None else out.unionByName(spread.select("fp", "g"))
        calm = spread.join(large, "g", "left_anti").select("fp", "g")
        out = calm if out is None else out.unionByName(calm)
        rows = cut(spread.join(large, "g", "left_semi").select("fp", "rest", "g"))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``u, v`` between different fingerprints (column ``fp``, distinct): a spanning forest of each group of ``dealt``."""
    groups = dealt(distinct, radius).repartition(width(distinct.sparkSession), "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        fp, g = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        _, inverse, size = np.unique(g, return_inverse=True, return_counts=True)
        several = size[inverse] > 1
        if several.any():
            found = GrayIndex(g[several], fp[several].view(np.uint64)).links(radius).view(np.int64)
            for at in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + (1 << 16), 0]), pa.array(found[at : at + (1 << 16), 1])], names=["u", "v"])

    return groups.select("fp", "g").mapInArrow(tidy(run), "u long, v long")


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id among all rows reachable through links.

    Repeated rows each give a row. Rows without an id take part in links; a component of such rows alone has a null id.
    """
    marked = cut(fingerprints(docs, shingle, id_column, text_column))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = components(links(distinct, radius))
    named = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest id (null last), then of the smallest content key.

    Of repeated rows one stays.
    """
    return first_of_groups(docs, lambda rows: near_groups(rows, shingle, radius, "row", "t"), id_column, text_column)


def first_of_groups(docs: DataFrame, groups: Callable[[DataFrame], DataFrame], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As ``one_of_each``; ``groups`` gives ``doc_id, component_id`` for rows ``row, t``, the row being its own id."""
    keys = content_key(F.col(text_column))
    rows = docs.select(F.struct(F.col(id_column).isNull().alias("no"), F.col(id_column).alias("id"), *keys).alias("row"), F.col(text_column).alias("t"))
    found = groups(rows)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id.*").distinct()
    stay = stay.select(F.col("id").alias("s_id"), F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    # Other columns travel in a struct, so no name can clash.
    mine = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_column).alias("id"), *keys).join(stay, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")) & F.col("id").eqNullSafe(F.col("s_id")))
    nth = F.row_number().over(Window.partitionBy("k1", "k2", "id").orderBy("k1"))
    return mine.withColumn("nth", nth).where("nth = 1").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: 3-word shingles, three bits. Empty and null texts share fingerprint zero."""
    found = near_groups(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
