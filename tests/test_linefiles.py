"""Line files at scale: scans in blocks, parents at any depth, checked writes, numbers without a single task."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stemma.operators import edit, order, sinks
from stemma.sources import gedcom, linefiles

FILES = {
    "plain.ged": b"0 HEAD\n1 CHAR UTF-8\n",
    "bom.ged": "﻿0 HEAD\r\n1 NAME Núria\r\n\r\n2 X".encode(),
    "open.ged": b"0 HEAD",
    "blank.ged": b"\n\n",
    "tail.ged": b"a\n\n",
    "long.ged": ("﻿" + "".join(f"{i % 4} TAG línia {i} {'x' * (i % 50)}\n" for i in range(3000))).encode(),
    "with space+%.ged": "0 é\n".encode(),
    "empty.ged": b"",
    "mark.ged": "﻿".encode(),
}


def lines_of(data: bytes) -> list[str]:
    text = data.decode().removeprefix("﻿")
    return [x.removesuffix("\r") for x in text.split("\n")][: -1 if text.endswith("\n") else None] if text else []


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in FILES.items():
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path


@pytest.fixture(params=["134217728", "700"])
def blocks(spark, request):
    """Spark's own size of a block, and one that cuts the long file into many."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield int(request.param)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_numbered_over_blocks(spark, folder, blocks):
    got = {}
    read = gedcom.raw_lines(spark, str(folder / "in"))
    for r in read.collect():
        got.setdefault(r.path, {})[r.idx] = r.raw
    named = {linefiles.unquoted(p): [v[i] for i in range(len(v))] for p, v in got.items()}
    assert named == {n: lines_of(d) for n, d in FILES.items() if lines_of(d)}
    if blocks == 700:
        assert read.rdd.getNumPartitions() > 20
    meta = {linefiles.unquoted(r.path): (r.has_bom, r.newline, r.trailing_newline) for r in gedcom.file_meta(spark, str(folder / "in")).collect()}
    assert meta == {n: (d.startswith(b"\xef\xbb\xbf"), "\r\n" if b"\r" in d else "\n", d.endswith(b"\n")) for n, d in FILES.items() if d}


def test_rewrite_is_byte_identical_and_keeps_what_it_replaces(spark, folder, blocks):
    source = str(folder / "in")
    lines, meta = gedcom.raw_lines(spark, source), gedcom.file_meta(spark, source)
    out = folder / "out"
    sinks.write_lines(lines, meta, str(out))
    written = {n for n, d in FILES.items() if lines_of(d)}
    assert {f.name for f in out.iterdir() if f.is_file()} == {n.replace("%", "%25").replace(" ", "%20") for n in written}
    for n in written:
        assert (out / n.replace("%", "%25").replace(" ", "%20")).read_bytes() == FILES[n]
    changed = lines.where("path LIKE '%plain.ged'").withColumn("raw", F.concat("raw", F.lit("!")))
    done = sinks.write_lines(changed, meta, str(out), keep=".before")
    assert [tuple(r) for r in done.collect()] == [("plain.ged", True)]
    assert (out / "plain.ged").read_bytes() == b"0 HEAD!\n1 CHAR UTF-8!\n" and (out / "plain.ged.before").read_bytes() == FILES["plain.ged"]
    assert not [f for f in out.iterdir() if f.is_dir()]


@pytest.mark.parametrize("damage", [lambda b: b[:-7], lambda b: b.replace(b"12", b"13", 1), lambda b: b.removeprefix(b"\xef\xbb\xbf"), lambda b: b.replace(b"\n", b"\r\n")])
def test_damaged_write_is_refused_and_removed(spark, folder, damage):
    source = str(folder / "in" / "long.ged")
    lines, meta = gedcom.raw_lines(spark, source), gedcom.file_meta(spark, source)
    root, _ = sinks.staged_lines(lines, meta, str(folder / "stage"))
    assert sinks.checked(lines, meta, root).first().same
    file = next(Path(linefiles.staged_files(root)).iterdir())
    file.write_bytes(damage(file.read_bytes()))
    with pytest.raises(edit.Refused):
        sinks.checked(lines, meta, root)
    assert not Path(root).exists()


def test_two_paths_of_one_name_are_refused(spark, tmp_path):
    lines = spark.createDataFrame([("a/x", 0, "1"), ("b/x", 0, "2")], "path string, idx long, raw string")
    meta = spark.createDataFrame([], "path string, has_bom boolean, newline string, trailing_newline boolean")
    root, read = sinks.staged_lines(lines, meta, str(tmp_path))
    assert sorted(tuple(r) for r in read.collect()) == [("a/x", 0, "1"), ("b/x", 0, "2")]
    with pytest.raises(ValueError):
        linefiles.publish(spark, root, str(tmp_path / "out"))


def parents_of(lines):
    """Records and nearest smaller levels by a stack, file by file."""
    out, state = {}, {}
    for path, idx, level in sorted(lines, key=lambda x: (x[0], x[1])):
        nth, stack = state.get(path, (0, []))
        parent = None
        if level is not None and level >= 0:
            stack = [x for x in stack if x[0] < level]
            nth, parent = nth + (level == 0), stack[-1][1] if stack and level else None
            stack = [*stack, (level, idx)]
        state[path] = (nth, stack)
        out[path, idx] = (nth, parent)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_parents_at_any_depth(spark, seed):
    rng = random.Random(seed)
    lines = [("deep", i, min(i, 60) if i < 200 else rng.randint(0, 60)) for i in range(900)]
    lines += [(f"f{i % 7}", i * 3, rng.choice([None, -1, 0, 1, 2, 5, 40, 99])) for i in range(600)]
    lines += [("late", i, 40 - i) for i in range(30)]
    df = spark.createDataFrame(lines, "path string, idx long, level int").repartition(6)
    got = {(r.path, r.idx): (r.rec_id, r.parent_idx) for r in gedcom.nested(df).collect()}
    assert got == parents_of(lines) and got["deep", 40] == (1, 39)
    before = {}
    want = set()
    for path, idx, level in sorted(lines, key=lambda x: (x[0], x[1])):
        if path in before and level is not None and before[path] is not None and level > before[path] + 1:
            want.add((path, idx))
        before[path] = level
    assert {(r.path, r.idx) for r in gedcom.level_jumps(df).collect()} == want
    assert gedcom.nested(df.where("false")).count() == 0
    # Ranges keep their states where plans are united and partitions put together.
    twice = gedcom.nested(df.where("path = 'late'")).unionByName(gedcom.nested(df.where("path = 'deep'"))).coalesce(1)
    assert {(r.path, r.idx): (r.rec_id, r.parent_idx) for r in twice.collect()} == {k: v for k, v in parents_of(lines).items() if k[0] in ("deep", "late")}
    numbers = order.dense(df, ["path", "idx"], "n").unionByName(order.dense(df, ["path", "idx"], "n")).coalesce(2).groupBy("path", "idx").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    assert numbers.where("a <> b").isEmpty() and numbers.agg(F.countDistinct("a")).first()[0] == len(lines)


def test_numbers_without_gaps(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, x double").repartition(5)
    got = order.dense(df, ["x", "i"], "n", 7)
    assert got.columns == ["g", "i", "x", "n"]
    assert [r.i for r in sorted(got.collect(), key=lambda r: r.n)] == [i for _, i, _ in sorted(rows, key=lambda r: r[2])]
    assert sorted(r.n for r in got.collect()) == list(range(7, 507))
    inner = order.numbered(df, ["g"], ["x", "i"], "n")
    for g in ("hot", "a", None):
        assert [(r.i, r.n) for r in sorted((r for r in inner.collect() if r.g == g), key=lambda r: r.n)] == [(i, k) for k, (_, i, _) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[2]), 1)]
    assert order.dense(df.where("false"), ["x"], "n").count() == 0
    # No window without a partition, and no task that takes all rows.
    assert "Window" not in got._jdf.queryExecution().toString()
