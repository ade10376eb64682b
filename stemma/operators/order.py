"""Order over a whole table without a task that holds it: sorted ranges, and totals of ranges carried on to the next.

A table is dealt into ranges of its order and written once, so that all readers see the same ranges. What a row
takes from all earlier rows is what its range gives, started from the totals of the ranges before; those are a
row a partition, and the driver adds them up.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, importable

_AT, _PART, _BEFORE, _FIRST, _NTH = "__order_at", "__order_part", "__order_before", "__order_first", "__order_nth"
_INSIDE = (1 << 33) - 1  # low bits of Spark's row ids: the place in the partition


def ranged(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows in ranges of ``by``, sorted inside each; nulls first. Rows of one key stay together, so ``by`` should tell rows apart."""
    return cut(rows.repartitionByRange(*by).sortWithinPartitions(*by))


def dense(rows: DataFrame, by: list[str], name: str, first: int = 1) -> DataFrame:
    """Adds ``name``: numbers without gaps from ``first`` in the order of ``by``. Equal keys are numbered one after another in no set order."""
    held = ranged(rows, by).withColumn(_AT, F.monotonically_increasing_id())
    part = F.shiftrightunsigned(_AT, 33)
    counts = held.groupBy(part.alias(_PART)).agg(F.count("*").alias("n")).orderBy(_PART).collect()
    starts, total = [], first
    for row in counts:
        starts.append((row[_PART], total))
        total += row.n
    begin = rows.sparkSession.createDataFrame(starts, f"{_PART} long, {_BEFORE} long")
    # A row for each partition.
    found = held.withColumn(_PART, part).join(F.broadcast(begin), _PART)
    return found.withColumn(name, F.col(_BEFORE) + F.col(_AT).bitwiseAND(F.lit(_INSIDE))).drop(_AT, _PART, _BEFORE)


def numbered(rows: DataFrame, within: list[str], by: list[str], name: str, first: int = 1) -> DataFrame:
    """Adds ``name``: numbers from ``first`` in each group ``within``, in the order of ``by``, however large a group is. Null is a group."""
    every = dense(rows, [*within, *by], _NTH, first)
    keys = [F.col(c).alias(f"__order_key{i}") for i, c in enumerate(within)]
    least = every.groupBy(*keys).agg(F.min(_NTH).alias(_FIRST))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__order_key{i}")) for i, c in enumerate(within)])
    return every.join(least, same).withColumn(name, F.col(_NTH) - F.col(_FIRST) + F.lit(first)).select(*[F.col(f"`{c}`") for c in rows.columns if c != name], name)


def scan(rows: DataFrame, by: list[str], start: Any, step: Callable[[Any, pa.RecordBatch, bool], tuple[Any, list[pa.Array]]], join: Callable[[Any, Any], Any], added: str, needs: list[str] | None = None) -> DataFrame:
    """Adds the columns ``added`` that ``step`` makes of each row and all rows before it in the order of ``by``.

    ``step(state, batch, wanted)`` gives the state after a batch and, where ``wanted``, the new columns; ``join``
    puts two states together as if their rows had been read one after the other, so that ``join(start, x)`` is
    ``x``. Each range is read twice: for its state, for which ``step`` gets the columns it ``needs`` (all, if
    none are named), and from the state that the ranges before lead to. States must stay small: the driver holds one
    a partition.
    """
    importable(rows.sparkSession)
    # The range is a column: a task's own number is another one where plans are united or partitions put together.
    held = ranged(rows, by).withColumn(_PART, F.spark_partition_id())

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = start, None
        for batch in batches:
            if batch.num_rows:
                part = batch.column(batch.num_columns - 1)[0].as_py()
                state, _ = step(state, batch, False)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["part", "state"])

    read = sorted(held.select(*(needs or rows.columns), _PART).mapInArrow(states, "part long, state binary").collect())
    before, now = {}, start
    for row in read:
        before[row.part] = now
        now = join(now, pickle.loads(row.state))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = start, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column(batch.num_columns - 1)[0].as_py()
                state = before[part]
            state, columns = step(state, batch, True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    names = [*rows.columns, *(x.split()[0] for x in added.split(", "))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return held.mapInArrow(run, f"{schema}, {added}")
