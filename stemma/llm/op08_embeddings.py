"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Equal vectors become one class first. Classes are dealt to cells around pivot rows (a bounded sample, which
decides only where a class is kept, never what is found). Neighbouring cells make up *squares' sides* of about
equal numbers, a large cell several of them; a task compares two sides, so a vector moves once for each side
that its own can link with, and the number of sides follows the number of tasks as long as two sides fit into one.
Two sides need no comparison if the angles between the pivots of their cells exceed both radii and the
threshold's angle; inside a task the same holds for blocks, by their own centres and radii. That is the triangle
inequality, so no link is lost. A tile product multiplies int8 codes of two blocks; the length of each vector's
quantisation error bounds the error of each product, and every pair that could reach the threshold is computed
again from the full vectors in double precision. A task returns link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, importable, table, tidy, width
from .components import components

THRESHOLD = 0.95
BLOCK = 2048
#: Most pivots: they and their pairs are held by the driver.
PIVOTS = 512
#: Most vectors of a side; a task holds two.
SIDE = 1 << 16


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales, and the lengths of the coded vectors and of their errors (rounded up)."""
    scale = np.abs(rows).max(1) / 127
    codes = np.rint(rows / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    up = 1 + 1e-9
    return codes, scale, np.sqrt((back * back).sum(1)) * up, np.sqrt(((rows - back) ** 2).sum(1)) * up + 1e-12


class Block:
    """Vectors with their codes, error bounds, centre and radius."""

    def __init__(self, c: np.ndarray, m: np.ndarray, rows: np.ndarray):
        self.c, self.m, self.rows = c, m, rows
        u = unit(rows)
        self.codes, self.scale, self.length, self.error = quantise(u)
        # Whole numbers up to 127 * 127 * dimension: exact in single precision below 2**24, else in double.
        self.kind = np.float32 if rows.shape[1] * 127 * 127 < 1 << 24 else np.float64
        middle = u.sum(0)
        size = float(np.sqrt(middle @ middle))
        self.centre = middle / size if size > 0 else u[0]
        self.radius = float(np.arccos(np.clip(u @ self.centre, -1, 1)).max())

    def far(self, other: Block, reach: float) -> bool:
        return float(np.arccos(np.clip(self.centre @ other.centre, -1, 1))) > self.radius + other.radius + reach


def near_pairs(x: Block, y: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold, by strips; for one block with itself only those above the diagonal."""
    right = np.ascontiguousarray(y.codes.T.astype(x.kind))
    for at in range(0, len(x.rows), 512):
        rows = slice(at, at + 512)
        product = x.codes[rows].astype(x.kind) @ right
        # |x.y - x^.y^| <= |x^||ey| + |ex||y^| + |ex||ey|; single precision steps get a margin of 1e-5.
        product *= x.scale[rows].astype(x.kind)[:, None]
        product *= y.scale.astype(x.kind)
        slack = float((x.length[rows].max() * y.error.max()) + x.error[rows].max() * y.length.max() + x.error[rows].max() * y.error.max()) + 1e-5
        i, j = np.nonzero(product >= threshold - slack)
        i += at
        if x is y:
            i, j = i[i < j], j[i < j]
        own = x.length[i] * y.error[j] + x.error[i] * y.length[j] + x.error[i] * y.error[j] + 1e-5
        close = product[i - at, j] + own >= threshold
        i, j = i[close], j[close]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            exact = np.einsum("ij,ij->i", x.rows[a], y.rows[b]) / np.sqrt(np.einsum("ij,ij->i", x.rows[a], x.rows[a]) * np.einsum("ij,ij->i", y.rows[b], y.rows[b]))
            hit = exact >= threshold
            yield a[hit], b[hit]


def _chain(cells: list[int], pivots: np.ndarray, offset: int) -> list[int]:
    """Cells in an order in which neighbours are near: each time the nearest that is left."""
    out, left = cells[:1], cells[1:]
    while left:
        at = int((pivots[[k - offset for k in left]] @ pivots[out[-1] - offset]).argmax())
        out.append(left.pop(at))
    return out


class Forest:
    """Union-find over the places of a tile; keeps the pairs that joined something."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            high, at = np.unique(high, return_index=True)  # one new parent for each root
            self.root[high] = low[at]
            self.edges += zip(a[at].tolist(), b[at].tolist(), strict=True)
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Null and zero vectors, and vectors with null or non-finite components, link with nothing, and are
    components of their own. Vectors of different lengths never link. Repeated rows link with each other;
    of rows that share the smallest id, all are kept. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    importable(spark)
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("e"))
    fine = F.coalesce(F.forall("e", lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False))) & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine)
    # Large components are brought to the range in which squares can be summed; cosine does not change.
    most = F.array_max(F.transform("e", lambda x: F.abs(x)))
    rows = rows.withColumn("e", F.when(F.col("fine") & ((most > 1e100) | (most < 1e-100)), F.transform("e", lambda x: x / most)).otherwise(F.col("e")))
    classes = cut(rows.where("fine").groupBy("e").agg(F.count("*").alias("m"), F.min("vec_id").alias("least")).withColumn("c", F.monotonically_increasing_id()))
    n = classes.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    some = [r.e for r in classes.orderBy(F.xxhash64("e"), "c").limit(min(PIVOTS, -(-n // BLOCK))).collect()]
    by_size: dict[int, np.ndarray] = {}
    for e in some:
        by_size.setdefault(len(e), []).append(e)
    pivots = {d: unit(np.array(x, np.float64)) for d, x in by_size.items()}
    offset, at = {}, 0
    for d, x in pivots.items():
        offset[d], at = at, at + len(x)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column(1).to_pylist()
            cell, angle = np.full(len(e), -1, np.int32), np.zeros(len(e))
            size = np.fromiter(map(len, e), np.int64, len(e))
            for d in np.unique(size).tolist():
                i = np.flatnonzero(size == d)
                if d in pivots:
                    near = unit(np.array([e[k] for k in i], np.float64)) @ pivots[d].T
                    cell[i] = near.argmax(1) + offset[d]
                    angle[i] = np.arccos(np.clip(near.max(1), -1, 1))
                else:
                    cell[i] = -d  # lengths that no pivot has: a cell for each
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(angle)], names=["c", "cell", "angle"])

    placed = cut(classes.select("c", "e").mapInArrow(tidy(place), "c long, cell int, angle double").groupBy("c").agg(F.min("cell").alias("cell"), F.max("angle").alias("angle")))
    cells = {r.cell: (r.n, r.angle) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}
    reach = float(np.arccos(threshold)) + 1e-6
    # As many sides as give each task a few squares; more only where two sides would be too much for a task.
    most = max(BLOCK, min(SIDE, -(-n // math.ceil(math.sqrt(4 * width(spark))))))
    near: dict[int, np.ndarray] = {}  # by dimension: which cells, in order, can link
    order: dict[int, list[int]] = {}
    for d, x in pivots.items():
        order[d] = mine = _chain([k for k in cells if offset[d] <= k < offset[d] + len(x)], x, offset[d])
        at = [k - offset[d] for k in mine]
        angle = np.array([cells[k][1] for k in mine])
        near[d] = np.arccos(np.clip(x[at] @ x[at].T, -1, 1)) <= angle[:, None] + angle[None, :] + reach
    for k in cells:
        if k < 0:
            order[-k], near[-k] = [k], np.ones((1, 1), bool)
    # Sides: a large cell has several, small neighbours share one. At most PIVOTS cells are known here, and n / BLOCK sides.
    sides: list[tuple[int, list[int]]] = []  # dimension, and places of its cells in their order
    home: dict[int, tuple[int, int]] = {}  # of a cell: its first side, and how many it has
    for d, mine in order.items():
        room = 0
        for place_, k in enumerate(mine):
            count = cells[k][0]
            if count <= room:
                sides[-1][1].append(place_)
                home[k], room = (len(sides) - 1, 1), room - count
            else:
                many = -(-count // most)
                home[k], room = (len(sides), many), most - count if many == 1 else 0
                sides += [(d, [place_]) for _ in range(many)]
    plan = spark.createDataFrame([(k, *home[k]) for k in cells], "cell int, first int, many int")
    # At most PIVOTS rows, and one for each vector length that no pivot has.
    homed = classes.join(placed, "c").join(F.broadcast(plan), "cell").select("c", "e", "m", (F.col("first") + F.pmod(F.hash("c"), "many")).alias("side"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by side; each run of BLOCK becomes one row for each square that its side is in."""
        now, held, turn = None, [], 0
        of_cell: dict[int, list[int]] = {}  # sides by dimension, for the squares

        def squares(side: int) -> Iterator[tuple[int, int]]:
            d, mine = sides[side]
            if d not in of_cell:
                of_cell[d] = [i for i, (dim, _) in enumerate(sides) if dim == d]
            can = near[d][mine].any(0)
            for other in of_cell[d]:
                if can[sides[other][1]].any():
                    yield min(side, other), max(side, other)

        def row() -> Iterator[pa.RecordBatch]:
            c, m, e = (list(x) for x in zip(*held, strict=True))
            flat = np.array(e, np.float64)
            single = flat.astype(np.float32)
            flat = single if (single == flat).all() else flat
            payload = [pa.array([now], pa.int32()), pa.array([turn], pa.int32()), pa.array([flat.shape[1]], pa.int32()), pa.array([np.array(c, np.int64).tobytes()]), pa.array([np.array(m, np.int64).tobytes()]), pa.array([flat.tobytes()])]
            for a, b in squares(now):
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), *payload], names=["a", "b", "side", "turn", "d", "cs", "ms", "es"])

        for batch in batches:
            for c, e, m, side in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and (side != now or len(held) == BLOCK):
                    yield from row()
                    held, turn = [], turn + 1
                now = side
                held.append((c, m, e))
        if held:
            yield from row()

    packed = homed.repartitionById(max(1, min(len(sides), width(spark))), "side").sortWithinPartitions("side", "c").mapInArrow(tidy(pack), "a int, b int, side int, turn int, d int, cs binary, ms binary, es binary")
    # Squares are numbered row by row of a triangle, so they are dealt evenly.
    tasks = max(1, min(len(sides) * (len(sides) + 1) // 2, 4 * width(spark)))
    number = F.pmod(F.shiftright(F.col("b").cast("long") * (F.col("b") + 1), 1) + F.col("a"), F.lit(tasks)).cast("int")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (tuple(x[k].as_py() for x in batch.columns) for batch in batches for k in range(batch.num_rows))
        for (a, b), group in groupby(each, key=lambda r: r[:2]):
            blocks: dict[int, list[Block]] = {a: [], b: []}
            for _, _, side, _, d, cs, ms, es in group:
                c = np.frombuffer(cs, np.int64)
                rows_ = np.frombuffer(es, np.float32 if len(es) == 4 * len(c) * d else np.float64).astype(np.float64).reshape(len(c), d)
                blocks[side].append(Block(c, np.frombuffer(ms, np.int64), rows_))
            every = blocks[a] if a == b else blocks[a] + blocks[b]
            start = np.cumsum([0, *(len(x.c) for x in every)])
            count, forest = np.zeros(int(start[-1]), np.int64), Forest(int(start[-1]))
            split = 0 if a == b else len(blocks[a])
            for i in range(len(every) if a == b else split):
                for j in range(i if a == b else split, len(every)):
                    x, y = every[i], every[j]
                    if x.far(y, reach):
                        continue
                    for p, q in near_pairs(x, y, threshold):
                        np.add.at(count, p + start[i], y.m[q])
                        np.add.at(count, q + start[j], x.m[p])
                        forest.add(p + start[i], q + start[j])
            some = np.flatnonzero(count)
            if len(some):
                name = np.concatenate([x.c for x in every])
                u, v = (np.array(z, np.int64) for z in zip(*forest.edges, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([name[some], name[u]])), pa.array(np.concatenate([count[some], np.full(len(u), -1)])), pa.array(np.concatenate([np.zeros(len(some), np.int64), name[v]]))], names=["c", "n", "other"])

    # A packed row is about BLOCK vectors: a few to a batch.
    found = cut(packed.repartitionById(tasks, number).sortWithinPartitions("b", "a", "side", "turn").mapInArrow(tidy(tiles), "c long, n long, other long"))
    counts = found.where("n >= 0").groupBy("c").agg(F.sum("n").alias("n"))
    stars = components(found.where("n < 0").select(F.col("c").alias("u"), F.col("other").alias("v")))
    named = classes.select("c", "e", "m", "least").join(counts, "c", "left").join(stars.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = named.join(least, "component").select("e", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    fine_rows = rows.where("fine").join(answer, "e").select("vec_id", "n_links", "component_id")
    rest = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fine_rows.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``, whatever their labels, at cosine 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
