"""Streams give the rows of the batch forms, late ones included."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stemma.streaming import rate

START = datetime(2024, 5, 1, 12)


def samples(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(240):
        ts = START + timedelta(seconds=rng.randint(0, 900), microseconds=rng.choice([0, 0, 500, 1000, 999_999]))
        out.append((rng.choice(["a", "a", "b", "c"]), i, ts, rng.choice([0.5, 1.0, 2.0, 6.25])))
    return out + [("a", 1000 + k, out[0][2], 1.0) for k in range(3)]


def files_of(spark, rows, schema, folder, order, pieces):
    """Rows as files in the order in which a stream reads them, one a batch."""
    rows = sorted(rows, key=order)
    size = -(-len(rows) // pieces)
    for k in range(pieces):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def run(spark, stream, name, folder):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(folder)).start()
    query.awaitTermination()
    return spark.table(name)


def test_rolling_stream_equals_batch_with_late_rows(spark, tmp_path):
    schema = "key string, id long, ts timestamp, seconds double"
    rng = random.Random(8)
    # Up to forty seconds late, within the watermark's minute; a row far ahead lets the watermark pass all others.
    rows = samples(1)
    late = {r: r[2] + timedelta(seconds=rng.randint(0, 40)) for r in rows}
    end = ("z", 9999, START + timedelta(days=1), 1.0)
    files = files_of(spark, rows, schema, tmp_path / "in", late.__getitem__, 6)
    spark.createDataFrame([end], schema).coalesce(1).write.mode("append").parquet(files)
    spark.createDataFrame([("z", 9998, START + timedelta(days=1), 1.0)], schema).coalesce(1).write.mode("append").parquet(files)
    want = {(r.key, r.id): (r.ts, round(r.spent, 6), r.n, r.allowed, round(r.nap, 6)) for r in rate.rolling(spark.createDataFrame(rows, schema), 10.0, 60).collect()}
    stream = rate.rolling_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files), 10.0, 60)
    got = {(r.key, r.id): (r.ts, round(r.spent, 6), r.n, r.allowed, round(r.nap, 6)) for r in run(spark, stream, "rolled", tmp_path / "c").where("key <> 'z'").collect()}
    assert got == want and len({a for *_, a, _ in want.values()}) == 2


def test_daily_stream_merges_the_server(spark, tmp_path):
    rng = random.Random(2)
    ours = [(START + timedelta(hours=rng.randint(0, 24 * 9)),) for _ in range(300)]
    server = [(START + timedelta(days=d, hours=rng.randint(0, 8)), rng.choice([5, 90])) for d in range(12) for _ in range(2)]
    days = spark.createDataFrame(ours, "ts timestamp").select(F.to_date("ts").alias("day"))
    told = spark.createDataFrame(server, "ts timestamp, server_used long").groupBy(F.to_date("ts").alias("day")).agg(F.max("server_used").alias("server_used"))
    want = {(r.day, r.used, r.remaining) for r in rate.daily(days, 40, told).collect()}
    order = lambda r: r[0] + timedelta(hours=(r[0].hour * 7) % 20)
    a = files_of(spark, [*ours, (START + timedelta(days=30),)], "ts timestamp", tmp_path / "a", order, 4)
    b = files_of(spark, [*server, (START + timedelta(days=30), 0)], "ts timestamp, server_used long", tmp_path / "b", order, 4)
    stream = rate.daily_stream(spark.readStream.schema("ts timestamp").parquet(a), 40, server=spark.readStream.schema("ts timestamp, server_used long").parquet(b))
    got = {(r.day, r.used, r.remaining) for r in run(spark, stream, "merged", tmp_path / "c").collect()}
    assert got == want and any(used == 90 for _, used, _ in want) and any(used not in (5, 90) for _, used, _ in want)
