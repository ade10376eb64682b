"""Rate accounting: a rolling budget and a daily quota, in batch and as streams.

The streams are ours: where data is at rest the batch form is exact; the streams give the same rows once their
watermark has passed, late ones included as long as they are not behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import Spent

#: Fixed value: least nap, in seconds.
LEAST_NAP = 0.5


def rolling(samples: DataFrame, budget: float, window: int) -> DataFrame:
    """Adds ``spent, n, allowed, nap`` to ``samples (key, ts, seconds)``: the sum of the last ``window`` seconds, both ends included."""
    order = Window.partitionBy("key").orderBy(F.unix_micros("ts")).rangeBetween(-window * 1_000_000, 0)
    out = samples.withColumns({"spent": F.sum("seconds").over(order), "n": F.count("*").over(order), "oldest": F.min("ts").over(order)})
    age = (F.unix_micros("ts") - F.unix_micros("oldest")) / 1e6
    return out.withColumn("allowed", F.col("spent") < budget).withColumn("nap", F.when(F.col("allowed"), 0.0).otherwise(F.greatest(F.lit(LEAST_NAP), window - age))).drop("oldest")


class Governor(StatefulProcessor):
    """The rolling budget of one key as state: samples not told yet, and those of the window before the last one told.

    A timer waits for the watermark to pass the earliest sample not told, since before that an earlier one may still
    come. Then all samples behind the watermark are told in order of time, with what they may spend or how long
    to nap. State holds the samples of one window and of the watermark's delay.
    """

    def __init__(self, budget: float, window: int):
        self.budget, self.window = budget, window * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seconds double, id long")
        self.told = handle.getListState("told", "at long, seconds double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [row for part in rows for row in zip(part["at"].tolist(), part["seconds"].astype(float).tolist(), part["id"].tolist(), strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(_passed(min(at for at, _, _ in new)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(x for x in held if _passed(x[0]) <= passed)
        if not due:
            return
        rest = [x for x in held if _passed(x[0]) > passed]
        past = sorted(tuple(x) for x in self.told.get()) if self.told.exists() else []
        line = [*past, *((at, seconds) for at, seconds, _ in due)]
        out, low, high = [], 0, len(past)
        for at, seconds, identity in due:
            while high < len(line) and line[high][0] <= at:
                high += 1
            while line[low][0] < at - self.window:
                low += 1
            spent = fsum(x for _, x in line[low:high])
            allowed = spent < self.budget
            nap = 0.0 if allowed else max(LEAST_NAP, (self.window - (at - line[low][0])) / 1e6)
            out.append((key[0], identity, at, seconds, spent, high - low, allowed, nap))
        # Only the window before the last one told can matter to later samples.
        kept = [x for x in line if x[0] >= due[-1][0] - self.window]
        self.told.put(kept)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(_passed(min(at for at, _, _ in rest)))
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["key", "id", "at", "seconds", "spent", "n", "allowed", "nap"])

    def close(self) -> None:
        pass


def _passed(micros: int) -> int:
    """The first millisecond at which a watermark leaves a time behind."""
    return -(-micros // 1000)


def stateful(spark: SparkSession) -> SparkSession:
    """State with timers needs the store that keeps it on disk; only where the session has Spark's default."""
    key, default = "spark.sql.streaming.stateStore.providerClass", "HDFSBackedStateStoreProvider"
    if spark.conf.get(key, default).endswith(default):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def rolling_stream(samples: DataFrame, budget: float, window: int, delay: str = "1 minute") -> DataFrame:
    """The rows of ``rolling`` from a stream of ``key, id, ts, seconds``, each when the watermark has passed it.

    Samples later than ``delay`` are behind the watermark and dropped, as by all of Spark's aggregates.
    """
    stateful(samples.sparkSession)
    kind = samples.schema["key"].dataType.simpleString()
    timed = samples.withWatermark("ts", delay).select("key", F.col("id").cast("long").alias("id"), "ts", F.unix_micros("ts").alias("at"), F.col("seconds").cast("double").alias("seconds"))
    found = timed.groupBy("key").transformWithStateInPandas(Governor(budget, window), f"key {kind}, id long, at long, seconds double, spent double, n long, allowed boolean, nap double", "Append", "EventTime")
    return found.select("key", "id", F.timestamp_micros("at").alias("ts"), "seconds", "spent", "n", "allowed", "nap")


def daily(requests: DataFrame, limit: int, server: DataFrame | None = None) -> DataFrame:
    """``day, used, remaining``; the server's count is taken where it is larger."""
    ours = requests.groupBy("day").agg(F.count("*").alias("used"))
    if server is not None:
        ours = ours.join(server, "day", "left").select("day", F.greatest("used", F.coalesce("server_used", F.lit(0))).alias("used"))
    return ours.withColumn("remaining", F.greatest(F.lit(0).cast("long"), limit - F.col("used")))


def refuse_when_spent(counts: DataFrame, day: str) -> int:
    """What is left of a day (``daily``), or a refusal if nothing is; a day without requests has not begun to be spent."""
    row = counts.where(F.col("day").cast("string") == day).first()
    if row is not None and row.remaining <= 0:
        raise Spent(f"{day}: all {row.used} requests are used")
    return -1 if row is None else row.remaining


def daily_stream(events: DataFrame, limit: int, delay: str = "1 day", server: DataFrame | None = None) -> DataFrame:
    """The same counts from a stream of ``ts``: tumbling days, closed when the watermark passes them.

    ``server`` is a stream of ``ts, server_used``; its largest count of a day with requests of ours is taken where it is larger.
    """
    said = events.select("ts", F.lit(1).alias("ours"), F.lit(None).cast("long").alias("server_used"))
    if server is not None:
        said = said.unionByName(server.select("ts", F.lit(0).alias("ours"), F.col("server_used").cast("long").alias("server_used")))
    w = said.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum("ours").alias("ours"), F.max("server_used").alias("server_used"))
    used = F.greatest("ours", F.coalesce("server_used", F.lit(0).cast("long")))
    return w.where("ours > 0").select(F.to_date("w.start").alias("day"), used.alias("used"), F.greatest(F.lit(0).cast("long"), limit - used).alias("remaining"))


def spent_stream(events: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Seconds spent by key in sliding windows of a stream of ``key, ts, seconds``."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", window, slide).alias("w"), "key").agg(F.sum("seconds").alias("spent"), F.count("*").alias("n"))
    return w.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "spent", "n")
