"""Guarded edits of line files: splits, splices, replacements, deletions, and the checks that refuse them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused
from .order import dense, numbered


def three_way(rows: DataFrame, column: str = "accept") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted (true), rejected (false), pending (null)."""
    c = F.col(column)
    return rows.where(c.eqNullSafe(F.lit(True))), rows.where(c.eqNullSafe(F.lit(False))), rows.where(c.isNull())


def lost(rows: DataFrame, *parts: DataFrame) -> DataFrame:
    """Rows that are in one of the whole and its parts more often than in the other."""
    every = reduce(DataFrame.unionByName, parts)
    return rows.exceptAll(every).unionByName(every.exceptAll(rows))


def not_boolean(rows: DataFrame, column: str = "accept") -> DataFrame:
    """Rows with a value other than true, false and nothing."""
    return rows.where(F.col(column).isNotNull() & F.col(column).cast("string").try_cast("boolean").isNull())


def last_verdicts(first: DataFrame, second: DataFrame, key: str, order: str, column: str = "accept") -> DataFrame:
    """Verdicts of two folders, one a key: that of the last file of the second folder, else of the first."""
    both = first.withColumn("folder", F.lit(0)).unionByName(second.withColumn("folder", F.lit(1)))
    # A struct keeps a verdict that is nothing.
    return both.groupBy(key).agg(F.max_by(F.struct(column), F.struct("folder", order)).alias("v")).select(key, F.col(f"v.{column}").alias(column))


def check_booleans(rows: DataFrame, column: str = "accept") -> None:
    """Refuse values other than true, false and nothing."""
    if not not_boolean(rows, column).isEmpty():
        raise Refused(f"{column} must be true, false or empty")


def record_spans(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``path, xref, start, end`` of the records ``wanted (path, xref)``, half-open; one that is not there exactly once is refused."""
    found = wanted.select("path", "xref").distinct().join(lines.where("level = 0 AND xref IS NOT NULL").select("path", "xref", "rec_id"), ["path", "xref"], "left")
    bad = found.groupBy("path", "xref").agg(F.count("rec_id").alias("n")).where("n <> 1").orderBy("path", "xref").first()
    if bad is not None:
        raise Refused(f"{bad.path} has {bad.n} records @{bad.xref}@")
    spans = lines.join(found, ["path", "rec_id"], "left_semi").groupBy("path", "rec_id").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"))
    return found.join(spans, ["path", "rec_id"]).select("path", "xref", "start", "end")


def trailers(lines: DataFrame) -> DataFrame:
    """``path, at``: the line before which new records go, the first ``0 TRLR``; a file without one is refused."""
    at = lines.groupBy("path").agg(F.min(F.when((F.col("level") == 0) & (F.col("tag") == "TRLR"), F.col("idx"))).alias("at"))
    bad = at.where("at IS NULL").orderBy("path").first()
    if bad is not None:
        raise Refused(f"{bad.path} has no line 0 TRLR")
    return at


def splice(lines: DataFrame, inserts: DataFrame) -> DataFrame:
    """Lines with inserts (``path, at, seq, raw``) before line ``at``, in order of ``seq``; all numbered anew."""
    old = lines.select("path", F.col("idx").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("seq"), "raw")
    new = inserts.select("path", "at", F.lit(0).alias("kind"), "seq", "raw")
    return numbered(old.unionByName(new), ["path"], ["at", "kind", "seq"], "idx", 0).select("path", "idx", "raw")


def patch(lines: DataFrame, replace: DataFrame, insert: DataFrame, delete: DataFrame) -> DataFrame:
    """Replacements (``path, idx, raw``), inserts and deletions (``path, idx``) at once.

    One line may be replaced once, and not both replaced or used as a place of insertion and deleted,
    whatever the order in which the edits were written.
    """
    twice = replace.groupBy("path", "idx").count().where("count > 1")
    gone = replace.select("path", "idx").unionByName(insert.select("path", F.col("at").alias("idx"))).join(delete, ["path", "idx"], "left_semi")
    if not twice.isEmpty() or not gone.isEmpty():
        raise Refused("two edits touch one line")
    left = lines.join(delete, ["path", "idx"], "left_anti").join(replace.select("path", "idx", F.col("raw").alias("new")), ["path", "idx"], "left").select("path", "idx", F.coalesce("new", "raw").alias("raw"))
    return splice(left, insert)


def exact_lines(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (``path, rec_id, find, raw``) as replacements: the found line must be the only such line of its record."""
    hit = edits.join(lines.select("path", "rec_id", "idx", F.col("raw").alias("find")), ["path", "rec_id", "find"], "left")
    if not hit.groupBy("path", "rec_id", "find", "raw").agg(F.count("idx").alias("n")).where("n <> 1").isEmpty():
        raise Refused("a line to be replaced is not there exactly once")
    return hit.select("path", "idx", "raw")


def exact_inserts(lines: DataFrame, inserts: DataFrame) -> DataFrame:
    """Blocks (``path, rec_id, find, seq, raw``) as inserts before the line found, which must be the only such line of its record."""
    hit = inserts.join(lines.select("path", "rec_id", F.col("idx").alias("at"), F.col("raw").alias("find")), ["path", "rec_id", "find"], "left")
    if not hit.groupBy("path", "rec_id", "find", "seq", "raw").agg(F.count("at").alias("n")).where("n <> 1").isEmpty():
        raise Refused("a line to insert before is not there exactly once")
    return hit.select("path", "at", "seq", "raw")


def before_stamp(lines: DataFrame, additions: DataFrame) -> DataFrame:
    """Additions (``path, rec_id, seq, raw``) as inserts before their record's change stamp, else behind its last line."""
    stamp_ = F.min(F.when((F.col("level") == 1) & (F.col("tag") == "CHAN"), F.col("idx")))
    where = lines.join(additions.select("path", "rec_id").distinct(), ["path", "rec_id"], "left_semi").groupBy("path", "rec_id").agg(F.coalesce(stamp_, F.max("idx") + 1).alias("at"))
    return additions.join(where, ["path", "rec_id"]).select("path", "at", "seq", "raw")


def reread(written: DataFrame, read: DataFrame) -> DataFrame:
    """``path, lines, read_again, same``: what was written beside what is read again."""
    count = lambda df, name: df.groupBy("path").agg(F.count("*").alias(name), F.sum(F.xxhash64(F.col("idx").cast("long"), "raw").cast("decimal(20,0)")).alias(f"{name}_sum"))
    both = count(written, "lines").join(count(read, "read_again"), "path", "full_outer")
    same = (F.col("lines") == F.col("read_again")) & (F.col("lines_sum") == F.col("read_again_sum"))
    return both.select("path", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("read_again", F.lit(0)).alias("read_again"), F.coalesce(same, F.lit(False)).alias("same"))


def deletable(lines: DataFrame, block: DataFrame) -> DataFrame:
    """A block (``path, idx``), one a file, that may be deleted: no record line, no change stamp, and no deeper line left behind."""
    order = Window.partitionBy("path", "rec_id").orderBy("idx")
    stamped = F.max(F.when(F.col("level") == 1, F.struct("idx", "tag"))).over(order)["tag"]
    seen = lines.withColumn("next_level", F.lead("level").over(order)).withColumn("stamped", stamped == "CHAN")
    mine = seen.join(block, ["path", "idx"], "left_semi")
    last = mine.groupBy("path").agg(F.max_by(F.struct("level", "next_level"), "idx").alias("l"), F.min("level").alias("top"), F.min_by("level", "idx").alias("first"), F.count("*").alias("n"), (F.max("idx") - F.min("idx") + 1).alias("span"))
    orphan = last.where((F.col("l.next_level") > F.col("top")) | (F.col("first") > F.col("top")) | (F.col("n") != F.col("span")))
    if not mine.where("level = 0 OR stamped").isEmpty() or not orphan.isEmpty():
        raise Refused("the block is not a whole branch that may go")
    return block


def only_adds(before: DataFrame, after: DataFrame) -> None:
    """Refuse a result that lacks a line of the original."""
    if not before.select("path", "raw").exceptAll(after.select("path", "raw")).isEmpty():
        raise Refused("the result lacks lines of the original")


def stamp(lines: DataFrame, touched: DataFrame, date: str, time: str) -> DataFrame:
    """Date and time of the change stamps of touched records (``path, rec_id``)."""
    under = lines.where("tag = 'CHAN'").select("path", "rec_id", F.col("idx").alias("c")).join(touched, ["path", "rec_id"], "left_semi")
    value = F.when(F.col("tag") == "DATE", F.lit(f"2 DATE {date}")).when(F.col("tag") == "TIME", F.lit(f"3 TIME {time}"))
    hit = F.col("c").isNotNull() & (F.col("idx") > F.col("c")) & F.col("tag").isin("DATE", "TIME")
    return lines.join(under, ["path", "rec_id"], "left").withColumn("raw", F.when(hit, value).otherwise(F.col("raw"))).drop("c")


def upsert(wanted: DataFrame, existing: DataFrame, first: int, prefix: str) -> DataFrame:
    """Adds ``xref`` to ``wanted (key, ord)``: that of the existing row with the key, else new ids in order from ``first``."""
    joined = wanted.join(existing.select("key", F.col("xref").alias("old")), "key", "left")
    new = joined.where("old IS NULL").groupBy("key").agg(F.min("ord").alias("ord"))
    ids = dense(new, ["ord", "key"], "made", first).withColumn("made", F.concat(F.lit(prefix), F.format_string("%05d", "made")))
    return joined.join(ids.select("key", "made"), "key", "left").withColumn("xref", F.coalesce("old", "made")).drop("old", "made")
