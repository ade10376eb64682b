"""Walks over parent edges ``(child, parent, ...)``: slots by generation, closures, levels, spines, Sosa numbers.

Walks with a visited set are loops of joins with a reliable checkpoint each level; the frontier is a table,
never a list in the driver. Walks that keep duplicates are bounded by their depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, importable
from .order import dense

#: Edges that every task may hold (8 bytes each, and as much again in the driver while they are sent).
FEW = 4_000_000
#: Bytes of text in an Arrow batch.
BATCH = 4 << 20


def ancestor_slots(edges: DataFrame, roots: DataFrame, depth: int, birth_only: bool = True) -> DataFrame:
    """``person, gen`` of every ancestor slot, the root at generation 1; a person reached twice has two slots.

    Stops at ``depth``, so a cyclic file ends too. Each generation is written once and read by the next.
    """
    usable = edges.where("is_birth") if birth_only and "is_birth" in edges.columns else edges
    step = usable.select("child", "parent")
    level = roots.select("person", F.lit(1).alias("gen"))
    out = level
    for g in range(2, depth + 1):
        level = cut(level.join(step, level.person == step.child).select(F.col("parent").alias("person"), F.lit(g).alias("gen")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def slot_counts(edges: DataFrame, roots: DataFrame, depth: int, birth_only: bool = True) -> DataFrame:
    """``person, gen, n``: the slots of ``ancestor_slots`` counted, so a generation has at most a row for each person."""
    usable = edges.where("is_birth") if birth_only and "is_birth" in edges.columns else edges
    step = cut(usable.select("child", "parent"))
    level = cut(roots.groupBy("person").agg(F.count("*").alias("n")).select("person", F.lit(1).alias("gen"), "n"))
    out = level
    for g in range(2, depth + 1):
        level = cut(level.join(step, level.person == step.child).groupBy(F.col("parent").alias("person")).agg(F.sum("n").alias("n")).select("person", F.lit(g).alias("gen"), "n"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def _slots(slots: DataFrame) -> Column:
    """Number of slots of ``ancestor_slots`` or ``slot_counts``."""
    return F.coalesce(F.sum("n"), F.lit(0)) if "n" in slots.columns else F.count("*")


def generation_counts(slots: DataFrame) -> DataFrame:
    """Slots of each generation beside the number that a full pedigree has."""
    return slots.groupBy("gen").agg(_slots(slots).alias("n")).withColumn("of", F.pow(F.lit(2.0), F.col("gen") - 1).cast("long"))


def implex(slots: DataFrame) -> DataFrame:
    """Slots, distinct ancestors, and their difference."""
    return slots.agg(_slots(slots).alias("slots"), F.countDistinct("person").alias("people")).withColumn("implex", F.col("slots") - F.col("people"))


def foster_delta(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Generations in which walking through foster families adds slots, and how many."""
    count = lambda birth, name: slot_counts(edges, roots, depth, birth).groupBy("gen").agg(F.sum("n").alias(name))
    both = count(False, "every").join(count(True, "birth"), "gen", "full_outer").na.fill(0)
    return both.select("gen", (F.col("every") - F.col("birth")).alias("delta")).where("delta <> 0")


def reach(edges: DataFrame, starts: DataFrame, depth: int, known: DataFrame | None = None) -> DataFrame:
    """``start, person, level`` of everybody above each start, each once at its first level; ``known`` people are not entered."""
    step = edges.select("child", "parent").distinct()
    if known is not None:
        step = step.join(known.select(F.col("person").alias("parent")).distinct(), "parent", "left_anti").select("child", "parent")
    level = starts.select(F.col("person").alias("start"), "person").distinct()
    seen = level.withColumn("level", F.lit(0))
    for k in range(1, depth + 1):
        found = level.join(step, level.person == step.child).select("start", F.col("parent").alias("person")).distinct()
        level = cut(found.join(seen, ["start", "person"], "left_anti"))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level.withColumn("level", F.lit(k))))
    return seen.where("level > 0")


def upstream(reached: DataFrame, years: DataFrame) -> DataFrame:
    """Number of people above each start and the earliest known year among them, from the pairs of ``reach``."""
    return reached.join(years, "person", "left").groupBy("start").agg(F.countDistinct("person").alias("upstream"), F.min("year").alias("oldest"))


def strong_components(edges: DataFrame) -> DataFrame:
    """``person, circle`` of everybody who is above themselves: people of one circle are above each other; it is named by the least.

    Ends of lines fall away first. Then everybody takes the least name that they reach, and who is reached back
    by that one within the same name belongs to its circle; the rest goes on. Only names move along edges, never sets.
    """
    left = cut(edges.select("child", "parent").where("child <> parent").distinct())
    found = left.select(F.col("child").alias("person"), F.col("child").alias("circle")).where("false")
    while True:
        size = left.count()
        while size:
            left = cut(left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent"))
            before, size = size, left.count()
            if size == before:
                break
        if not size:
            return found
        names = cut(left.select(F.col("child").alias("person"), F.col("child").alias("name")).distinct())
        while True:
            seen = left.join(names.toDF("parent", "theirs"), "parent").groupBy(F.col("child").alias("person")).agg(F.min("theirs").alias("theirs"))
            moved = cut(names.join(seen, "person", "left").select("person", F.least("name", F.coalesce("theirs", "name")).alias("name"), F.coalesce(F.col("theirs") < F.col("name"), F.lit(False)).alias("moved")))
            names = moved.drop("moved")
            if moved.where("moved").isEmpty():
                break
        inner = cut(left.join(names.toDF("child", "name"), "child").join(names.toDF("parent", "other"), "parent").where("name = other").select("child", "parent", "name"))
        circle = front = cut(names.where("person = name").select("person", F.col("name").alias("circle")))
        while not front.isEmpty():
            up = inner.join(front.select(F.col("person").alias("child")), "child").select(F.col("parent").alias("person"), F.col("name").alias("circle")).distinct()
            front = cut(up.join(circle, "person", "left_anti"))
            circle = cut(circle.unionByName(front))
        found = cut(found.unionByName(circle))
        left = cut(left.join(circle.select(F.col("person").alias("child")), "child", "left_anti").join(circle.select(F.col("person").alias("parent")), "parent", "left_anti").select("child", "parent"))


def upstream_counts(edges: DataFrame, starts: DataFrame, years: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``start, upstream, oldest``: what ``upstream`` of ``reach`` to the end gives, without a row for each pair.

    Circles are contracted first; what is above a circle is then gathered once, from the top down, as bitmaps of
    people's numbers (a row for 32,768 neighbours in number, united in the aggregate), and years as minima. Starts
    with nobody above them give no row. People of one circle, and circles, have neighbouring numbers. A bitmap
    takes 4 KB however few people it names, so where closures are small and scattered ``reach`` is the smaller one.
    """
    step = edges.select("child", "parent").distinct()
    if known is not None:
        step = step.join(known.select(F.col("person").alias("parent")).distinct(), "parent", "left_anti").select("child", "parent")
    step = cut(step)
    people = step.select(F.col("child").alias("person")).unionByName(step.select(F.col("parent").alias("person"))).unionByName(starts.select("person")).distinct()
    people = people.join(strong_components(step), "person", "left").select("person", F.coalesce("circle", "person").alias("circle"))
    people = dense(people, ["circle", "person"], "n").join(years.select("person", "year"), "person", "left")
    people = cut(people)
    name = lambda column: people.select(F.col("person").alias(column), F.col("circle").alias(f"{column}_circle"))
    up = cut(step.join(name("child"), "child").join(name("parent"), "parent").select(F.col("child_circle").alias("circle"), F.col("parent_circle").alias("above")).where("circle <> above").distinct())
    mine = cut(people.groupBy("circle", F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits")))
    least = cut(people.groupBy("circle").agg(F.min("year").alias("year")))
    # Everything at and above a circle; ``above`` is the year without its own people.
    ready = cut(least.select("circle").join(up.select("circle").distinct(), "circle", "left_anti"))
    sets = cut(mine.join(ready, "circle", "left_semi"))
    oldest = cut(least.join(ready, "circle", "left_semi").select("circle", F.lit(None).cast(least.schema["year"].dataType).alias("above"), "year"))
    waiting = up
    while True:
        waiting = cut(waiting.join(ready.select(F.col("circle").alias("above"), F.lit(True).alias("done")), "above", "left").select("circle", "above", F.coalesce("done", F.lit(False)).alias("done")).where("NOT done").drop("done"))
        next_ = cut(up.select("circle").distinct().join(waiting.select("circle").distinct(), "circle", "left_anti").join(oldest, "circle", "left_anti"))
        if next_.isEmpty():
            break
        ready = next_
        now = up.join(ready, "circle", "left_semi")
        gathered = now.join(sets.withColumnRenamed("circle", "above"), "above").select("circle", "bucket", "bits").unionByName(mine.join(ready, "circle", "left_semi"))
        sets = cut(sets.unionByName(gathered.groupBy("circle", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))))
        years_ = now.join(oldest.select(F.col("circle").alias("above"), F.col("year").alias("theirs")), "above").groupBy("circle").agg(F.min("theirs").alias("above"))
        oldest = cut(oldest.unionByName(years_.join(least, "circle").select("circle", "above", F.least("above", "year").alias("year"))))
    count = sets.groupBy("circle").agg((F.sum(F.bitmap_count("bits")) - 1).alias("upstream"))
    # The least year among the others of a circle: its least, or for that person the least of the rest.
    eldest = people.where("year IS NOT NULL").groupBy("circle").agg(F.min(F.struct("year", "person")).alias("e"))
    rest = people.join(eldest, "circle").where("person <> e.person").groupBy("circle").agg(F.min("year").alias("rest"))
    beside = people.join(eldest, "circle", "left").join(rest, "circle", "left").select("person", "circle", F.when(F.col("person") == F.col("e.person"), F.col("rest")).otherwise(F.col("e.year")).alias("beside"))
    out = starts.select("person").distinct().join(beside, "person").join(count, "circle").join(oldest.select("circle", "above"), "circle")
    return out.where("upstream > 0").select(F.col("person").alias("start"), "upstream", F.least("above", "beside").alias("oldest"))


def levels(reached: DataFrame) -> DataFrame:
    """People of each level above each start. Lists stay within one person's level."""
    return reached.groupBy("start", "level").agg(F.array_sort(F.collect_list("person")).alias("people"))


def joined_levels(edges: DataFrame, starts: DataFrame, depth: int, separator: str = ",") -> DataFrame:
    """``start, level, people``: ``levels`` of ``reach`` with people as text, without a row for each pair on the way.

    Starts are dealt to all cores, and each is walked by itself over the edges, which every task holds as arrays; so
    nothing but the result grows with pairs, and that goes out start by start. More edges than ``FEW`` are joined.
    """
    spark = importable(edges.sparkSession).sparkContext
    step = cut(edges.select(F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent")).distinct())
    if step.count() > FEW:
        return levels(reach(step, starts, depth)).select("start", "level", F.array_join(F.transform("people", lambda x: x.cast("string")), separator).alias("people"))
    rows = step.toArrow()
    child, parent = (rows.column(i).to_numpy() for i in (0, 1))
    ids = np.unique(np.concatenate([child, parent]))
    child, parent = np.searchsorted(ids, child), np.searchsorted(ids, parent)
    begin = np.concatenate([[0], np.cumsum(np.bincount(child, minlength=len(ids)))]).astype(np.int64)
    sent = spark.broadcast((ids, begin, parent[np.argsort(child, kind="stable")].astype(np.int32)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, begin, above = sent.value
        names, fresh = pa.array(ids).cast(pa.string()), np.zeros(len(ids), bool)
        held: list[tuple[pa.Array, ...]] = []
        size = 0
        for batch in batches:
            for start in batch.column(0).to_pylist():
                at = int(np.searchsorted(ids, start))
                if at == len(ids) or ids[at] != start:
                    continue
                seen = np.zeros(len(ids), bool)
                seen[at] = True
                level, found = np.array([at]), []
                while len(found) < depth:
                    first, n = begin[level], begin[level + 1] - begin[level]
                    up = above[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    up = up[~seen[up]]
                    if not len(up):
                        break
                    seen[up] = fresh[up] = True
                    level = np.flatnonzero(fresh) if 16 * len(up) > len(ids) else np.unique(up)
                    fresh[level] = False
                    found.append(level)
                if found:
                    cuts = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    people = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), names.take(pa.array(np.concatenate(found)))), separator)
                    held.append((pa.array([start] * len(found), pa.int64()), pa.array(range(1, len(found) + 1), pa.int32()), people))
                    size += people.nbytes
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*held)], names=["start", "level", "people"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*held)], names=["start", "level", "people"])

    dealt = starts.select(F.col("person").cast("long").alias("person")).where("person IS NOT NULL").distinct().repartition(4 * spark.defaultParallelism)
    return dealt.mapInArrow(walk, "start long, level int, people string")


def spine(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """``root, person, step`` along first parents of sex M (unknown counts as M): edges need ``role`` and ``sex``."""
    pick = cut(edges.where("sex IS NULL OR sex = 'M'").groupBy("child").agg(F.min_by("parent", "role").alias("parent")))
    level = roots.select(F.col("person").alias("root"), "person", F.lit(0).alias("step"), F.array("person").alias("path"))
    out = level
    for k in range(1, depth + 1):
        level = cut(level.join(pick, level.person == pick.child).where(~F.expr("array_contains(path, parent)")).select("root", F.col("parent").alias("person"), F.lit(k).alias("step"), F.concat("path", F.array("parent")).alias("path")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("path")


def sosa_edges(people: DataFrame) -> DataFrame:
    """Edges from Sosa numbers: the father of ``n`` is ``2n``, the mother ``2n + 1``; ``people (person, n)``."""
    up = people.select("person", F.explode(F.array(F.struct((F.col("n") * 2).alias("n"), F.lit(0).alias("role")), F.struct((F.col("n") * 2 + 1).alias("n"), F.lit(1).alias("role")))).alias("x")).select(F.col("person").alias("child"), "x.*")
    return up.join(people.select(F.col("person").alias("parent"), "n"), "n").select("child", "parent", "role")


def sosa_generation(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) + 1e-9).cast("int") + 1


def roots_to_chain(people: DataFrame, most: int = 40, generation: int = 8) -> DataFrame:
    """``pid, followed``: people of an answer's last generation, in order of their numbers; the first ``most`` are asked about next.

    ``people (pid, n)`` have Sosa numbers of one answer. The cap is the request budget, not a property of the data.
    """
    last = people.where(sosa_generation(F.col("n")) == generation).select("pid", "n").orderBy("n").limit(most).select("pid", F.lit(True).alias("f"))
    return people.where(sosa_generation(F.col("n")) == generation).select("pid").join(last, "pid", "left").select("pid", F.coalesce("f", F.lit(False)).alias("followed"))


def chained(answers: DataFrame, root: str, rounds: int = 2, most: int | None = 40, generation: int = 8) -> dict[str, DataFrame]:
    """What asking for a root, then for the people where its answer ends, and so on, gives from answers at rest.

    ``answers (root, pid, sosa, birth_date, ...)``: one ancestry answer a root, whose numbers hold within it and end
    with ``generation``. Each round asks for all people of the last generation of the round before that were not
    asked for yet, in the order of calls and numbers; ``most`` is the budget of calls after the first (None: no
    bound). Result: ``people``, one row a pid, as ``merge_people`` of the calls in their order; ``edges (child, parent,
    role)``, of which a later call's stand; ``couples``; ``calls (call, root)``; ``skipped (pid)``, who was not asked
    for because the budget was spent. A root without an answer is a call all the same.
    """
    spark = answers.sparkSession
    calls = cut(spark.createDataFrame([(1, root)], "call long, root string"))
    made, asked, taken, skipped = 1, calls, [], []
    for turn in range(rounds):
        got = cut(answers.join(calls, "root"))
        taken.append(got)
        n = F.regexp_extract("sosa", r"^(\d+)$", 1).try_cast("long")
        last = got.select("pid", "call", n.alias("n")).where((F.col("n") >= 1 << (generation - 1)) & (F.col("n") < 1 << generation))
        # Each once, at its first place.
        last = last.groupBy("pid").agg(F.min(F.struct("call", "n")).alias("first")).join(asked.select(F.col("root").alias("pid")), "pid", "left_anti")
        last = dense(last.select("pid", "first.call", "first.n"), ["call", "n", "pid"], "nth", made + 1).select(F.col("nth").alias("call"), F.col("pid").alias("root"))
        if turn + 1 == rounds:
            break
        fits = F.lit(True) if most is None else F.col("call") <= most + 1
        skipped.append(last.where(~fits).select(F.col("root").alias("pid")))
        calls = cut(last.where(fits))
        new = calls.count()
        if not new:
            break
        made, asked = made + new, cut(asked.unionByName(calls))
    every = reduce(DataFrame.unionByName, taken)
    nth = F.row_number().over(Window.partitionBy("pid").orderBy(F.coalesce(F.col("birth_date"), F.lit("")) == "", "call", F.regexp_extract("sosa", r"^(\d+)", 1).try_cast("long"), "sosa"))
    people = every.withColumn("nth", nth).where("nth = 1").drop("nth", "root", "call", "sosa")
    numbers = every.select("call", "pid", F.regexp_extract("sosa", r"^(\d+)$", 1).try_cast("long").alias("n")).where("n IS NOT NULL")
    up = numbers.select("call", F.col("pid").alias("child"), F.col("n").alias("of"), F.explode(F.array(F.struct((F.col("n") * 2).alias("n"), F.lit(0).alias("role")), F.struct((F.col("n") * 2 + 1).alias("n"), F.lit(1).alias("role")))).alias("x")).select("call", "child", "of", "x.*")
    named = up.join(numbers.withColumnRenamed("pid", "parent"), ["call", "n"])
    edges = named.groupBy("child", "role").agg(F.max_by("parent", F.struct("call", "of")).alias("parent")).select("child", "parent", "role")
    both = named.groupBy("call", "child", "of").agg(F.max(F.when(F.col("role") == 0, F.col("parent"))).alias("a"), F.max(F.when(F.col("role") == 1, F.col("parent"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    beside = every.select("call", F.col("pid").alias("b"), F.regexp_extract("sosa", r"^(\d+)-S$", 1).try_cast("long").alias("n")).where("n IS NOT NULL").join(numbers.withColumnRenamed("pid", "a"), ["call", "n"]).select("a", "b")
    nobody = spark.createDataFrame([], "pid string")
    return {"people": people, "edges": edges, "couples": both.unionByName(beside).distinct(), "calls": asked, "skipped": reduce(DataFrame.unionByName, skipped, nobody)}


def catalogue_walk(nodes: DataFrame, root: str, depth: int) -> DataFrame:
    """``id, level`` of all nodes below ``root`` (``nodes: id, parent``), each once at its first level."""
    start = nodes.sparkSession.createDataFrame([(root,)], "person string")
    return reach(nodes.select(F.col("parent").alias("child"), F.col("id").alias("parent")), start, depth).select(F.col("person").alias("id"), "level")


def last_page(pages: DataFrame) -> DataFrame:
    """``book, last``: the end of each book, from pages at rest."""
    return pages.groupBy("book").agg(F.max("page").alias("last"))


def distances(edges: DataFrame, root: DataFrame, depth: int) -> DataFrame:
    """``person, generation``: generations between a person and the root, the root being 1."""
    found = reach(edges, root, depth)
    return found.groupBy("person").agg((F.min("level") + 1).alias("generation")).unionByName(root.select("person", F.lit(1).alias("generation")))


def merge_people(*parts: DataFrame) -> DataFrame:
    """One row a ``pid`` from several fetches in order: the first, unless it lacks a birth date and a later one has it."""
    every = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("part", F.lit(i)))
    nth = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("birth_date").isNull(), "part"))
    return every.withColumn("nth", nth).where("nth = 1").drop("nth", "part")


def live_relations(edges: DataFrame, couples: DataFrame) -> DataFrame:
    """Spouses from couples both ways and from common children, each pair once."""
    a, b = edges.select("child", F.col("parent").alias("pid")), edges.select("child", F.col("parent").alias("other"))
    co = a.join(b, "child").where("pid <> other").select("pid", "other")
    return couples.select(F.col("a").alias("pid"), F.col("b").alias("other")).unionByName(couples.select(F.col("b").alias("pid"), F.col("a").alias("other"))).unionByName(co).distinct()
