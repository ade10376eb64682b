"""GEDCOM files as DataFrames: numbered lines, records, people, families and parent edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import is_approximate, parse_year
from ..functions.names import given_tokens, norm_surname, surname_parts
from ..functions.places import place_key
from ..functions.text import non_empty
from ..operators.order import scan
from ..session import cut, written


#: Most blocks of files whose offsets are sent to every task; a block is as large as a task's share of a file.
MOST_BLOCKS = 200_000


def _read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file, the block of it that a task reads, and Spark's row id, which counts on inside a block."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def _blocks(read: DataFrame) -> DataFrame:
    """``path, block, before, least, n`` and counts of each block of each file; ``before`` are the lines of the file's earlier blocks."""
    each = read.groupBy("path", "block").agg(
        F.max("size").alias("size"), F.count("*").alias("n"), F.min("row").alias("least"), F.sum(F.octet_length("value").cast("long") + 1).alias("bytes"),
        F.count_if(F.endswith("value", F.lit("\r"))).alias("returns"), F.min_by(F.startswith("value", F.lit("\ufeff")), "row").alias("marked"),
    )
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, idx, raw`` of every line, in the order of its file from 0. Large files are read in blocks, by many tasks.

    Lines end in a newline, or a carriage return and a newline; a byte-order mark is no part of the first. Numbers
    follow from the lines counted in each block, a row a block; lines themselves are not shuffled. An empty file has
    no lines. A block that is dealt otherwise in the second reading than in the first is an error, not a lost line.
    """
    read = _read(spark, path)
    blocks = cut(_blocks(read).select(F.col("path").alias("b_path"), F.col("block").alias("b_block"), "before", "least", "n"))
    known = F.broadcast(blocks) if blocks.count() <= MOST_BLOCKS else blocks
    at = F.col("row") - F.col("least")
    fine = at.between(F.lit(0), F.col("n") - 1)
    idx = F.when(fine, F.col("before") + at).otherwise(F.raise_error(F.lit("a file was read in other blocks than it was counted in")))
    joined = read.join(known, (F.col("path") == F.col("b_path")) & (F.col("block") == F.col("b_block")), "left").select("path", idx.cast("long").alias("idx"), F.regexp_replace("value", r"\r\z", "").alias("raw"))
    return joined.withColumn("raw", F.when(F.col("idx") == 0, F.regexp_replace("raw", "^\ufeff", "")).otherwise(F.col("raw")))


def file_meta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, has_bom, newline, trailing_newline`` of every file: what a byte-exact rewrite needs besides the lines.

    The reader drops a mark at the beginning of a file and a newline at its end; the size of the file tells whether
    they were there. For files that are not compressed; Spark does not list files of no bytes. A file with carriage returns is taken to have them throughout.
    """
    each = _blocks(_read(spark, path)).groupBy("path").agg(F.max("size").alias("size"), F.sum("bytes").alias("bytes"), F.sum("returns").alias("returns"), F.min_by("marked", "block").alias("marked"))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("length"))
    # Bytes beyond lines and newlines: a mark not seen in the first line is three more, a last newline that is not there one less.
    over = F.col("size") - F.col("bytes")
    mark = F.when(F.col("bytes").isNull(), F.col("length") >= 3).otherwise(F.coalesce("marked", F.lit(False)) | (over >= 2))
    last = F.when(F.col("bytes").isNull(), False).otherwise(over.isin(0, 3))
    return files.join(each, "path", "left").select("path", mark.alias("has_bom"), F.when(F.col("returns") > 0, F.lit("\r\n")).otherwise(F.lit("\n")).alias("newline"), last.alias("trailing_newline"))


def tokenise(lines: DataFrame) -> DataFrame:
    """Adds ``level, xref, tag, value, pointer``. A line that does not begin with a number keeps its text as value at level -1."""
    blank = F.trim("raw") == ""
    head = F.regexp_extract("raw", r"^(\S*)(?: |$)", 1)
    level = head.try_cast("int")
    rest = F.when(F.contains("raw", F.lit(" ")), F.regexp_extract("raw", r"^\S* (.*)$", 1)).otherwise("")
    has_xref = rest.rlike(r"^@[^ ]*@ ?")
    xref = F.when(has_xref, F.regexp_extract(rest, r"^@([^ @]*)@", 1))
    after = F.when(has_xref, F.regexp_replace(rest, r"^@[^ ]*@ ?", "")).otherwise(rest)
    tag, value = F.substring_index(after, " ", 1), F.when(F.contains(after, F.lit(" ")), F.regexp_extract(after, r"^\S* (.*)$", 1)).otherwise("")
    good = level.isNotNull() & ~blank
    out = lines.select(
        "*",
        F.when(good, level).when(~blank, F.lit(-1)).alias("level"),
        F.when(good, xref).alias("xref"),
        F.when(good, tag).when(~blank, F.lit("")).alias("tag"),
        F.when(good, value).when(~blank, F.col("raw")).otherwise(F.lit("")).alias("value"),
    )
    return out.withColumn("pointer", F.nullif(F.regexp_extract(F.trim("value"), r"^@([^@]+)@$", 1), F.lit("")))


#: What a stretch of lines leaves behind: the first path, the last one, records of it so far, its least level, and its open lines as (level, idx).
_NOTHING = (None, None, 0, None, ())


def _open_after(earlier: tuple, later: tuple) -> tuple:
    """What two stretches leave behind, read one after the other: lines stay open that the later one has no line at or above."""
    if later[0] is None or earlier[0] is None:
        return earlier if later[0] is None else later
    if earlier[1] != later[0] or later[0] != later[1]:
        return (earlier[0], *later[1:])
    least = min((x for x in (earlier[3], later[3]) if x is not None), default=None)
    still = tuple(x for x in earlier[4] if later[3] is None or x[0] < later[3])
    return earlier[0], later[1], earlier[2] + later[2], least, still + later[4]


def _nest(state: tuple, batch: pa.RecordBatch, wanted: bool) -> tuple[tuple, list[pa.Array]]:
    """Records and parents of the lines of a batch, and what it leaves behind."""
    first, now, records, least, open_ = state
    open_ = list(open_)
    nth, parents = [], []
    for path, idx, level in zip(*(batch.column(c).to_pylist() for c in ("path", "idx", "level")), strict=True):
        if path != now:
            first, now, records, least, open_ = path if first is None else first, path, 0, None, []
        parent = None
        if level is not None and level >= 0:
            while open_ and open_[-1][0] >= level:
                open_.pop()
            if level == 0:
                records += 1
            elif open_:
                parent = open_[-1][1]
            open_.append((level, idx))
            least = level if least is None else min(least, level)
        nth.append(records)
        parents.append(parent)
    columns = [pa.array(nth, pa.int64()), pa.array(parents, pa.int64())] if wanted else []
    return (first, now, records, least, tuple(open_)), columns


def nested(lines: DataFrame) -> DataFrame:
    """Adds ``rec_id`` and ``parent_idx``, at any depth.

    ``rec_id`` is a running count of level-0 lines of the file, 0 before the first. The parent is the nearest earlier
    line of the record with a smaller level; blank lines and lines without a level neither have nor are one. Files
    are scanned in ranges of lines, so a long file is no single task; what passes between ranges is a row each.
    Lines are written first: to deal them into ranges they are read twice, and taking them apart costs far more.
    """
    return scan(written(lines), ["path", "idx"], _NOTHING, _nest, _open_after, "rec_id long, parent_idx long", ["path", "idx", "level"])


def load(spark: SparkSession, path: str) -> DataFrame:
    return nested(tokenise(raw_lines(spark, path)))


def records(lines: DataFrame) -> DataFrame:
    """``path, rec_id, xref, tag, start, end`` with half-open spans."""
    return lines.where("rec_id > 0").groupBy("path", "rec_id").agg(F.min_by("xref", "idx").alias("xref"), F.min_by("tag", "idx").alias("tag"), F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"))


def of_type(lines: DataFrame, tag: str) -> DataFrame:
    """Lines of all records of a kind."""
    kinds = records(lines).where(F.col("tag") == tag).select("path", "rec_id")
    return lines.join(kinds, ["path", "rec_id"], "left_semi")


def sub(lines: DataFrame, tag: str, level: int = 1) -> DataFrame:
    """Lines of a tag at a level."""
    return lines.where((F.col("level") == level) & (F.col("tag") == tag))


def record_counts(lines: DataFrame) -> DataFrame:
    """``tag, n``: records of each kind."""
    return lines.where("level = 0").groupBy("tag").agg(F.count("*").alias("n"))


def _levels_before(state: tuple, batch: pa.RecordBatch, wanted: bool) -> tuple[tuple, list[pa.Array]]:
    now, level = state
    out = []
    for path, mine in zip(batch.column("path").to_pylist(), batch.column("level").to_pylist(), strict=True):
        out.append(level if path == now else None)
        now, level = path, mine
    return (now, level), [pa.array(out, pa.int32())] if wanted else []


def level_jumps(lines: DataFrame) -> DataFrame:
    """Lines that are deeper than the line before by more than one level."""
    seen = scan(lines, ["path", "idx"], (None, None), _levels_before, lambda a, b: a if b[0] is None else b, "before int", ["path", "level"])
    return seen.where("level > before + 1").drop("before")


def _first(tag: str, column: str = "value", level: int = 1) -> Column:
    here = (F.col("level") == level) & (F.col("tag") == tag)
    return F.min_by(F.when(here, F.trim(column)), F.when(here, F.col("idx")))


def events(lines: DataFrame) -> DataFrame:
    """First event of each tag of each record with its first date and place; blanks are null."""
    top = lines.where("level = 1").select("path", "rec_id", "idx", "tag")
    child = lines.where("level = 2 AND tag IN ('DATE', 'PLAC')").select("path", F.col("parent_idx").alias("p"), F.col("tag").alias("t"), F.col("idx").alias("i"), F.col("value").alias("v"))
    got = top.join(child.withColumnRenamed("path", "c_path"), (F.col("path") == F.col("c_path")) & (F.col("idx") == F.col("p")), "left")
    each = got.groupBy("path", "rec_id", "tag", "idx").agg(*[F.min_by(F.when(F.col("t") == k, non_empty(F.col("v"))), F.when(F.col("t") == k, F.col("i"))).alias(n) for k, n in (("DATE", "date"), ("PLAC", "place"))])
    return each.groupBy("path", "rec_id", "tag").agg(F.min_by(F.struct("date", "place"), "idx").alias("e"))


def people(lines: DataFrame) -> DataFrame:
    """One row a person, in file order by ``ord``: names, events with their fallbacks, families, label, sources and derived columns."""
    who = lines.where("rec_id > 0").groupBy("path", "rec_id").agg(
        F.min_by("xref", "idx").alias("xref"), F.min_by("tag", "idx").alias("kind"), F.min("idx").alias("ord"), _first("NAME").alias("name"),
        F.min_by(F.when((F.col("level") == 2) & (F.col("tag") == "GIVN"), F.trim("value")), F.when((F.col("level") == 2) & (F.col("tag") == "GIVN"), F.col("idx"))).alias("givn"),
        F.min_by(F.when((F.col("level") == 2) & (F.col("tag") == "SURN"), F.trim("value")), F.when((F.col("level") == 2) & (F.col("tag") == "SURN"), F.col("idx"))).alias("surn"),
        _first("SEX").alias("sex"), _first("_FSFTID").alias("fsftid"), _first("FAMC", "pointer").alias("famc"),
        F.min_by(F.when((F.col("level") == 2) & (F.col("tag") == "PEDI"), F.trim("value")), F.when((F.col("level") == 2) & (F.col("tag") == "PEDI"), F.col("idx"))).alias("pedigree"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("level") == 1) & (F.col("tag") == "FAMS") & F.col("pointer").isNotNull(), F.struct("idx", "pointer")))), lambda x: x["pointer"]).alias("fams"),
        _first("_SOSADABOVILLE").alias("sosa"), F.count_if(F.col("tag") == "SOUR").alias("source_count"),
    )
    tags = (("BIRT", "b"), ("CHR", "c"), ("DEAT", "d"), ("BURI", "u"))
    e = events(lines.where(F.col("tag").isin("DATE", "PLAC", *[t for t, _ in tags]))).groupBy("path", "rec_id").agg(*[F.max(F.when(F.col("tag") == t, F.col("e"))).alias(n) for t, n in tags])
    out = who.where("kind = 'INDI'").join(e, ["path", "rec_id"], "left")
    known = lambda x: F.col(f"{x}.date").isNotNull() | F.col(f"{x}.place").isNotNull()
    birth, death = F.when(known("b"), F.col("b")).otherwise(F.col("c")), F.when(known("d"), F.col("d")).otherwise(F.col("u"))
    slash = lambda i: F.trim(F.regexp_extract("name", r"^([^/]*)(?:/([^/]*)/?)?", i))
    out = out.withColumns({"birth": birth, "death": death, "given": F.coalesce(non_empty(F.col("givn")), slash(1)), "surname": F.coalesce(non_empty(F.col("surn")), slash(2))})
    out = out.select(
        "path", "xref", "ord", "name", "given", "surname", "sex", F.col("birth.date").alias("birth_date"), F.col("birth.place").alias("birth_place"),
        F.col("death.date").alias("death_date"), F.col("death.place").alias("death_place"), "fsftid", "famc", "fams", "pedigree", "sosa", "source_count",
    )
    return derived(out)


def derived(p: DataFrame) -> DataFrame:
    """Columns that follow from a person's own: years, normalised names, town, generation and direct line."""
    return p.withColumns(
        {
            "birth_year": parse_year(F.col("birth_date")), "death_year": parse_year(F.col("death_date")), "surname_norm": norm_surname(F.col("surname")),
            "surname_parts": surname_parts(F.col("surname")), "given_tokens": given_tokens(F.col("given")), "birth_town": place_key(F.col("birth_place")),
            "approximate": is_approximate(F.col("birth_date")), "famc_is_birth": F.coalesce(F.lower("pedigree") == "birth", F.lit(True)),
            "generation": F.regexp_extract(F.coalesce("sosa", F.lit("")), r"(?:^|\s)G(\d+)(?:\s|$)", 1).try_cast("int"),
            "is_direct": F.coalesce((F.col("sosa") != "") & ~F.substring_index("sosa", " ", 1).rlike("[-.]"), F.lit(False)),
        }
    )


def label(p: DataFrame) -> Column:
    years = F.concat(F.lit("("), F.coalesce(F.col("birth_year").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("death_year").cast("string"), F.lit("")), F.lit(")"))
    return F.concat_ws(" ", F.nullif("given", F.lit("")), F.nullif("surname", F.lit("")), F.when(F.col("birth_year").isNotNull() | F.col("death_year").isNotNull(), years), F.when(F.col("birth_town") != "", F.col("birth_town")))


def families(lines: DataFrame) -> DataFrame:
    at = lambda tag: (F.col("level") == 1) & (F.col("tag") == tag)
    fam = lines.where("rec_id > 0").groupBy("path", "rec_id").agg(
        F.min_by("xref", "idx").alias("xref"), F.min_by("tag", "idx").alias("kind"), F.min("idx").alias("ord"), _first("HUSB", "pointer").alias("husband"), _first("WIFE", "pointer").alias("wife"),
        F.transform(F.array_sort(F.collect_list(F.when(at("CHIL") & F.col("pointer").isNotNull(), F.struct("idx", "pointer")))), lambda x: x["pointer"]).alias("children"),
    ).where("kind = 'FAM'")
    marriage = events(lines).where("tag = 'MARR'").select("path", "rec_id", F.col("e.date").alias("marriage_date"), F.col("e.place").alias("marriage_place"))
    return fam.join(marriage, ["path", "rec_id"], "left").drop("rec_id", "kind")


def parent_edges(p: DataFrame, f: DataFrame) -> DataFrame:
    """``child, parent, role, is_birth``: at most two rows a child, husband first; parents that do not exist are dropped."""
    roles = F.explode(F.array(F.struct(F.col("husband").alias("parent"), F.lit(0).alias("role")), F.struct(F.col("wife").alias("parent"), F.lit(1).alias("role")))).alias("r")
    pairs = p.select(F.col("xref").alias("child"), "famc", F.col("famc_is_birth").alias("is_birth")).join(f.select(F.col("xref").alias("famc"), "husband", "wife"), "famc").select("child", "is_birth", roles)
    return pairs.select("child", F.col("r.parent").alias("parent"), F.col("r.role").alias("role"), "is_birth").join(p.select(F.col("xref").alias("parent")), "parent", "left_semi")


def spouses(p: DataFrame, f: DataFrame) -> DataFrame:
    return spouses_in_order(p, f).drop("nth")


def spouses_in_order(p: DataFrame, f: DataFrame) -> DataFrame:
    """``xref, spouse, nth``: each spouse once, numbered by the family that names it first."""
    both = f.select(F.col("xref").alias("fam"), F.explode(F.array_compact(F.array("husband", "wife"))).alias("spouse"))
    each = p.select("xref", F.posexplode("fams").alias("at", "fam")).join(both, "fam").where("xref <> spouse")
    return each.groupBy("xref", "spouse").agg(F.min("at").alias("nth"))


def children(p: DataFrame, f: DataFrame) -> DataFrame:
    return p.select("xref", F.explode("fams").alias("fam")).join(f.select(F.col("xref").alias("fam"), F.posexplode("children").alias("ord", "child")), "fam").select("xref", "child", "ord").distinct()


def leaves(p: DataFrame) -> DataFrame:
    """People without a family of their parents."""
    return p.where("famc IS NULL")


def root_person(p: DataFrame) -> DataFrame:
    """The first person whose label begins with number 1; else the first of the file."""
    one = F.coalesce(F.substring_index("sosa", " ", 1) == "1", F.lit(False))
    return p.groupBy().agg(F.min_by("xref", F.struct((~one).alias("other"), "path", "ord")).alias("xref")).where("xref IS NOT NULL")


def eldest_child(down: DataFrame, p: DataFrame) -> DataFrame:
    """``xref, eldest``: the earliest birth year among a person's children."""
    return down.join(p.select(F.col("xref").alias("child"), "birth_year"), "child").groupBy("xref").agg(F.min("birth_year").alias("eldest"))


def without_repeated_tag(lines: DataFrame, tag: str = "_SOSADABOVILLE") -> tuple[DataFrame, DataFrame]:
    """Lines with only the last ``tag`` of each record, and the lines dropped."""
    nth = F.row_number().over(Window.partitionBy("path", "rec_id", "tag").orderBy(F.desc("idx")))
    marked = lines.withColumn("nth", nth)
    extra = (F.col("tag") == tag) & (F.col("nth") > 1)
    return marked.where(~extra | F.col("tag").isNull()).drop("nth"), marked.where(extra).drop("nth")


def next_ids(lines: DataFrame) -> DataFrame:
    """``prefix, next``: the largest numeric suffix of each kind of id plus one, padded to five digits."""
    ids = lines.where("level = 0 AND xref IS NOT NULL").select(F.regexp_extract("xref", r"^([A-Za-z]+)", 1).alias("prefix"), F.regexp_extract("xref", r"(\d+)$", 1).try_cast("long").alias("n"))
    top = ids.groupBy("prefix").agg(F.max("n").alias("n"))
    return top.select("prefix", F.concat("prefix", F.format_string("%05d", F.coalesce("n", F.lit(0)) + 1)).alias("next"))
