"""Centroid clustering of integer vectors, exact, with the distances of a block as one matrix product.

Vectors are quantised to integers and held in blocks of rows. ``|x|^2 - 2 x.c + |c|^2`` is computed in
float64 with BLAS wherever the largest magnitudes prove that every term and sum stays below 2^53, and is then
exact; otherwise in 64-bit integers where those suffice, and in Python's integers beyond. Sums of a round are
combined by ``treeAggregate`` over the blocks: a row a centroid and component, whatever the size of the table.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, spread, table

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors in one block.
BLOCK = 4096
#: Rows with a component beyond this are kept apart, so that one of them does not send a whole block to the integers.
PLAIN = 1 << 22
EXACT = 1 << 53
LONG = (1 << 63) - 1


def quantised(x: float, scale: int = SCALE) -> int:
    """``floor(scale * x)`` without rounding; ``scale`` is a power of two."""
    return math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale


def packed(rows: np.ndarray, wide: list[list[int]]) -> Iterator[tuple[str, bytes]]:
    """Payloads of a block: a matrix of small integers as float64, or lists of Python integers."""
    if len(rows):
        yield "plain", np.ascontiguousarray(rows, np.float64).tobytes()
    if wide:
        yield "wide", pickle.dumps(wide)


def unpacked(kind: str, data: bytes, dimensions: int) -> np.ndarray:
    if kind == "plain":
        return np.frombuffer(data, np.float64).reshape(-1, dimensions)
    found = np.empty((len(rows := pickle.loads(data)), dimensions), object)
    found[:] = rows
    return found


def blocks(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``ids, kind, data``: the kept vectors, quantised, in blocks. Others (null, of another length, with a null or non-finite component) are left out."""
    kind = vectors.schema[id_column].dataType.simpleString()
    fine = F.col("v").isNotNull() & (F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).where(fine)

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                with np.errstate(over="ignore"):
                    small = np.floor(values * scale)
                plain = np.abs(small).max(axis=1, initial=0) <= PLAIN
                wide = [[quantised(x, scale) for x in row] for row in values[~plain].tolist()]
                for name, data in packed(small[plain], wide):
                    ids = part.column(0).filter(pa.array(plain if name == "plain" else ~plain))
                    offsets = pa.array([0, len(ids)], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, ids), pa.array([name]), pa.array([data], pa.binary())], names=["ids", "kind", "data"])

        return step

    return arrow_map(kept, make, f"ids array<{kind}>, kind string, data binary")


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid (the smaller number of equal ones), exact.

    ``rows`` are float64 integers or Python integers, ``centroids`` Python integers. Distances are int64 where
    those hold them, else Python integers.
    """
    most = max((abs(int(x)) for x in (rows.max(initial=0), rows.min(initial=0), *centroids.ravel())), default=0)
    bound = rows.shape[1] * (2 * most) ** 2
    if bound < EXACT:
        x, c = rows.astype(np.float64, copy=False), centroids.astype(np.float64)
        far = np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]
        best = far.argmin(axis=1)
        return best, far[np.arange(len(x)), best].astype(np.int64)
    # Floats beyond 2^53 are whole numbers, so the way over Python's integers is exact for them as well.
    kind = np.int64 if bound <= LONG else object
    x, c = (np.array([[int(v) for v in row] for row in part.tolist()], kind).reshape(part.shape) for part in (rows, centroids))
    far = np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best]


def added(total: tuple, rows: np.ndarray, centroids: np.ndarray) -> tuple:
    """Sums of components, counts and summed distances of each centroid, with a block's rows added; Python integers throughout."""
    sums, counts, spread_ = total
    best, far = nearest(rows, centroids)
    for k in np.unique(best).tolist():
        mine = rows[best == k]
        # A block's sum of small integers stays exact in float64: 4,096 rows of 2^22.
        sums[k] = [a + int(b) for a, b in zip(sums[k], mine.sum(axis=0).tolist(), strict=True)]
        counts[k] += len(mine)
        spread_[k] += sum(far[best == k].tolist())
    return sums, counts, spread_


def united(a: tuple, b: tuple) -> tuple:
    """Two totals as one."""
    return [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(a[0], b[0], strict=True)], [x + y for x, y in zip(a[1], b[1], strict=True)], [x + y for x, y in zip(a[2], b[2], strict=True)]


def totals(held: DataFrame, centroids: np.ndarray) -> tuple:
    """Sums, counts and distances of every centroid over all blocks, combined in a tree."""
    n, dimensions = centroids.shape
    zero = ([[0] * dimensions for _ in range(n)], [0] * n, [0] * n)
    return held.select("kind", "data").rdd.treeAggregate(zero, lambda t, r: added(t, unpacked(r.kind, bytes(r.data), dimensions), centroids), united)


def first_centroids(vectors: DataFrame, n: int = CENTROIDS, id_column: str = "vec_id", vector_column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> np.ndarray:
    """The kept vectors of the ``n`` smallest hashes of their ids; rows without an id come last, equal ids by their components."""
    fine = F.col("v").isNotNull() & (F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.sha2(F.concat(F.lit("1:"), F.col(id_column).cast("string")), 256).alias("h"), F.col(vector_column).cast("array<double>").alias("v")).where(fine)
    found = kept.orderBy(F.asc_nulls_last("h"), "v").limit(n).collect()
    out = np.empty((len(found), dimensions), object)
    for i, row in enumerate(found):
        out[i, :] = [quantised(x, scale) for x in row.v]
    return out


def clusters(vectors: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS, id_column: str = "vec_id", vector_column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, list[dict]]:
    """``vec_id, cluster, distance`` of every kept vector, and a record a centroid: ``cluster, size, inertia, centroid``.

    Null vectors, those of another length and those with null or non-finite components are left out. Fewer
    vectors than ``n`` give as many centroids; none give no rows. Repeated rows each give a row and count each;
    a null id is kept. Of equal distances the smaller number wins, and equal centroids keep their own numbers.
    Distances that a long can't hold are null, the assignment is exact all the same. Other columns are not read.
    """
    centroids = first_centroids(vectors, n, id_column, vector_column, dimensions, scale)
    held = cut(blocks(vectors, id_column, vector_column, dimensions, scale))
    kind = vectors.schema[id_column].dataType.simpleString()
    if not len(centroids):
        return held.select(F.explode("ids").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        sums, counts, _ = totals(held, centroids)
        for k, count in enumerate(counts):
            if count:
                centroids[k, :] = [s // count for s in sums[k]]
    _, counts, inertia = totals(held, centroids)

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i in range(batch.num_rows):
                best, far = nearest(unpacked(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), dimensions), centroids)
                distance = pa.array([x if x <= LONG else None for x in far.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), pa.array(best, pa.int32()), distance], names=["vec_id", "cluster", "distance"])

        return step

    found = arrow_map(held, make, f"vec_id {kind}, cluster int, distance long")
    return found, [{"cluster": k, "size": counts[k], "inertia": inertia[k], "centroid": [int(x) for x in centroids[k]]} for k in range(len(centroids))]


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``, sixteen centroids, three rounds; awkward rows as in ``clusters``. A row a centroid is broadcast."""
    found, told = clusters(spread(table(spark, sf_dir, "embeddings")))
    long = lambda x: x if x <= LONG else None
    each = spark.createDataFrame([(c["cluster"], long(c["inertia"]), ",".join(map(str, c["centroid"]))) for c in told], "cluster int, cluster_inertia long, named string")
    whole = F.lit(long(sum(c["inertia"] for c in told))).cast("long")
    return found.join(F.broadcast(each), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", whole.alias("inertia"), F.sha2("named", 256).alias("centroid_sha256"))


def _oracle() -> str:
    def assign(k: int) -> str:
        # The nearest centroid of every vector: the least pair of distance and number.
        return f"""a{k} AS MATERIALIZED (
  SELECT rid, arg_min(c, [d, c]) AS c, min(d) AS d FROM (
    SELECT rid, c, list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (q[i] - m[i]) * (q[i] - m[i])))::BIGINT AS d FROM v, c{k}
  ) GROUP BY rid
)"""

    def update(k: int) -> str:
        return f"""c{k + 1} AS MATERIALIZED (
  SELECT c{k}.c, coalesce(u.m, c{k}.m) AS m FROM c{k} LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS m FROM (
      SELECT c, i, sum(q[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, q, unnest(range(1, {DIMENSIONS + 1})) AS i FROM a{k} JOIN v USING (rid)) GROUP BY c, i
    ) GROUP BY c
  ) u ON u.c = c{k}.c
)"""

    rounds = ",\n".join(f"{assign(k)},\n{update(k)}" for k in range(ROUNDS))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, q) - 1)::INTEGER AS c, q AS m FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v ORDER BY h, q LIMIT {CENTROIDS})
),
{rounds},
{assign(ROUNDS)}
SELECT vec_id, a{ROUNDS}.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{ROUNDS}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (rid) JOIN c{ROUNDS} ON c{ROUNDS}.c = a{ROUNDS}.c"""


ORACLE_SQL = _oracle()
