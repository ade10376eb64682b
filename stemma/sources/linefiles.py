"""Line files written in ordered parts, put together, read again and compared before they take the place of others.

Spark tasks write the parts, each a stretch of one file, and lists of them; the commit of the write takes the lists
that count, so what a failed or doubled task left behind is no part of any file. Files are put together from their
parts and moved in tasks as well: neither the driver nor one row ever holds a file. Folders of many files are listed
and read by tasks too, since Spark's reader keeps every file of a folder in the driver. Folders are URIs that all
machines share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..errors import Refused
from ..session import cut, importable

CHUNK = 8 << 20
#: Files of up to so many bytes are read whole by tasks that know their names; larger ones are few, and Spark's reader cuts them into blocks.
WHOLE = 1 << 20
#: Rows of a listing, and bytes of contents, that a task gives at once.
ENTRIES, BYTES = 10_000, 4 << 20


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder: a URI, or a plain path of this machine."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def file_name(path: str) -> str:
    """The name of a staged file for any path: without separators, and none that Spark takes to be hidden."""
    return "f" + quote(path, safe="")


@dataclass
class Part(WriterCommitMessage):
    """Where one task lists the stretches that it wrote; nothing if there are none."""

    told: str | None


class LineWriter(DataSourceArrowWriter):
    """Writes rows ``path, idx, data``, sorted in each task by path and place, as one part for each stretch of a file."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, root = place(self.folder)
        done: list[list] = []
        out = None
        for batch in iterator:
            paths, at = batch.column("path").to_pylist(), batch.column("idx").to_pylist()
            data = batch.column("data").cast(pa.binary()).to_pylist()
            i = 0
            while i < len(paths):
                j = i
                while j < len(paths) and paths[j] == paths[i]:
                    j += 1
                if out is None or done[-1][0] != paths[i]:
                    if out is not None:
                        out.close()
                    name = f"{root}/parts/{uuid.uuid4().hex}"
                    fs.create_dir(f"{root}/parts", recursive=True)
                    out = fs.open_output_stream(name)
                    done.append([paths[i], name, at[i], at[i], 0, 0])
                piece = b"".join(data[i:j])
                out.write(piece)
                done[-1][3:] = [at[j - 1], done[-1][4] + j - i, done[-1][5] + len(piece)]
                i = j
        if out is not None:
            out.close()
        if not done:
            return Part(None)
        told, keys = f"{uuid.uuid4().hex}.json", ("path", "part", "first", "last", "lines", "bytes")
        fs.create_dir(f"{root}/told", recursive=True)
        with fs.open_output_stream(f"{root}/told/{told}") as out:
            for part in done:
                out.write((json.dumps(dict(zip(keys, part, strict=True))) + "\n").encode())
        return Part(told)

    def commit(self, messages: list[Part | None]) -> None:
        """The tasks' lists of parts, a line each, in one folder: the driver moves a file a task and reads none."""
        fs, root = place(self.folder)
        fs.create_dir(f"{root}/list", recursive=True)
        for message in messages:
            if message and message.told:
                fs.move(f"{root}/told/{message.told}", f"{root}/list/{message.told}")

    def abort(self, messages: list[Part | None]) -> None:
        fs, root = place(self.folder)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)


class LineFiles(DataSource):
    """The format ``stemma_lines``: write only; line files are read by ``gedcom.raw_lines``."""

    @classmethod
    def name(cls) -> str:
        return "stemma_lines"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        del schema, overwrite
        return LineWriter(self.options["path"])


def stage(lines: DataFrame, meta: DataFrame, folder: str) -> str:
    """Write ``lines (path, idx, raw)`` as files in a new folder below ``folder``, and return that; each file as ``meta`` says.

    ``meta (path, has_bom, newline, trailing_newline)`` is that of ``gedcom.file_meta``; a path that it lacks gets
    plain newlines, the last one too. A path without lines gives no file.
    """
    spark = importable(lines.sparkSession)
    spark.dataSource.register(LineFiles)
    root = f"{folder.rstrip('/')}/staged-{uuid.uuid4().hex}"
    ends = lines.groupBy("path").agg(F.min("idx").alias("__first"), F.max("idx").alias("__last")).join(meta.select("path", "has_bom", "newline", "trailing_newline"), "path", "left")
    full = lines.select("path", F.col("idx").cast("long").alias("idx"), "raw").join(ends, "path")
    bom = F.when((F.col("idx") == F.col("__first")) & F.coalesce("has_bom", F.lit(False)), F.lit("﻿")).otherwise("")
    end = F.when((F.col("idx") < F.col("__last")) | F.coalesce("trailing_newline", F.lit(True)), F.coalesce("newline", F.lit("\n"))).otherwise("")
    ready = full.select("path", "idx", F.concat(bom, "raw", end).alias("data")).repartitionByRange("path", "idx").sortWithinPartitions("path", "idx")
    ready.write.format("stemma_lines").mode("append").option("path", root).save()
    parts = spark.read.schema("path string, part string, first long, last long, lines long, bytes long").json(f"{root}/list")
    files = parts.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "last", "part"))), lambda x: x["part"]).alias("parts"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(root)
        fs.create_dir(f"{base}/files", recursive=True)
        for batch in batches:
            sizes = []
            for path, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = f"{base}/new-{uuid.uuid4().hex}"
                with fs.open_output_stream(new) as out:
                    for name in names:
                        with fs.open_input_stream(name) as part:
                            while piece := part.read(CHUNK):
                                out.write(piece)
                    sizes.append(out.tell())
                # The move is one step, so a task that runs twice does no harm.
                fs.move(new, f"{base}/files/{file_name(path)}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    # Names of parts are few bytes, which would be read as one task, but files are many.
    files = files.repartition(4 * spark.sparkContext.defaultParallelism)
    files.mapInArrow(together, "path string, bytes long").write.parquet(f"{root}/sizes")
    fs, base = place(root)
    fs.create_dir(f"{base}/files", recursive=True)
    return root


def staged_files(root: str) -> str:
    return f"{root}/files"


def large(spark: SparkSession, root: str) -> list[str]:
    """The staged files that Spark's reader takes in blocks: at most one for each ``WHOLE`` bytes of all files."""
    sizes = spark.read.schema("path string, bytes long").parquet(f"{root}/sizes")
    return [f"{staged_files(root)}/{file_name(r.path)}" for r in sizes.where(F.col("bytes") > WHOLE).collect()]


def whole(spark: SparkSession, root: str, every: bool = False) -> DataFrame:
    """``path, text`` of the other staged files, or of ``every`` one where all are small by what they are."""
    sizes = importable(spark).read.schema("path string, bytes long").parquet(f"{root}/sizes").where(F.lit(every) | (F.col("bytes") <= WHOLE))
    return _read(sizes.select("path"), staged_files(root), file_name).select("path", F.col("content").cast("string").alias("text"))


def lines_of(texts: DataFrame) -> DataFrame:
    """``path, idx, raw`` of whole files, as ``gedcom.raw_lines`` has them."""
    body = F.regexp_replace("text", "^\ufeff", "")
    each = texts.select("path", body.alias("body")).where("body <> ''").select("path", F.posexplode(F.split(F.regexp_replace("body", r"\n\z", ""), "\n")).alias("idx", "raw"))
    return each.select("path", F.col("idx").cast("long").alias("idx"), F.regexp_replace("raw", r"\r\z", "").alias("raw"))


def meta_of(texts: DataFrame) -> DataFrame:
    """``path, has_bom, newline, trailing_newline`` of whole files, as ``gedcom.file_meta`` has them."""
    returns = F.col("text").rlike(r"\r(\n|\z)")
    return texts.where("text <> ''").select("path", F.startswith("text", F.lit("\ufeff")).alias("has_bom"), F.when(returns, F.lit("\r\n")).otherwise(F.lit("\n")).alias("newline"), F.endswith("text", F.lit("\n")).alias("trailing_newline"))


def _read(files: DataFrame, folder: str, name) -> DataFrame:
    """``path, content`` of files (``path``) below a folder, where ``name`` says; each is read whole, a few megabytes of them at once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(folder)
        for batch in batches:
            paths, held, size = [], [], 0
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name(path)}") as file:
                    held.append(file.read())
                paths.append(path)
                size += len(held[-1])
                if size >= BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], names=["path", "content"])
                    paths, held, size = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], names=["path", "content"])

    return files.select("path").repartition(4 * files.sparkSession.sparkContext.defaultParallelism).mapInArrow(read, "path string, content binary")


def contents(files: DataFrame, root: str) -> DataFrame:
    """``path, content`` of files of ``listed``."""
    root = root.rstrip("/")
    return _read(files, root, lambda path: path[len(root) + 1 :])


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, size`` of all files below a folder, by tasks: a row a folder, level by level. As in Spark's listings, names that begin with a dot or an underscore are left out."""
    root = root.rstrip("/")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                there = [x for x in fs.get_file_info(pafs.FileSelector(f"{base}{folder}")) if not x.base_name.startswith((".", "_"))]
                for i in range(0, len(there), ENTRIES):
                    some = there[i : i + ENTRIES]
                    sizes = [x.size if x.type == pafs.FileType.File else None for x in some]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x.base_name}" for x in some], pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    folders, found = importable(spark).createDataFrame([("",)], "path string"), None
    while found is None or not folders.isEmpty():
        level = cut(folders.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(look, "path string, size long"))
        folders, files = level.where("size IS NULL").select("path"), level.where("size IS NOT NULL")
        found = files if found is None else found.unionByName(files)
    return found.select(F.concat(F.lit(root), "path").alias("path"), "size")


def unquoted(uri: str) -> str:
    """The name of a file, from the URI that Spark gives for it."""
    return unquote(uri.rsplit("/", 1)[-1])


def named(rows: DataFrame) -> DataFrame:
    """Rows read from staged files, with the paths that were written instead of places of files."""
    name = F.url_decode(F.replace(F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/"), -1), F.lit("+"), F.lit("%2B")))
    return rows.withColumn("path", F.substring(name, F.lit(2), F.length(name)))


def discard(root: str) -> None:
    """Remove a staged write."""
    fs, base = place(root)
    fs.delete_dir(base)


def publish(spark: SparkSession, root: str, target: str, keep: str | None = None, parts: int = 1) -> DataFrame:
    """Move staged files into the folder ``target`` under the last part of their paths, each in one step; ``name, kept`` of every file.

    With more ``parts`` so many last ones are kept, as folders: a folder is listed by one task, so many files belong in
    several. A file that is there already is kept with ``keep`` behind its name, if that is given. Two paths of one name are
    refused. A task that runs again finds its file moved and leaves it.
    """
    names = spark.read.schema("path string").json(f"{root}/list").distinct().select("path", F.substring_index("path", "/", -parts).alias("name"))
    if not names.groupBy("name").count().where("count > 1").isEmpty():
        raise Refused("two paths end in one name")
    place(target)[0].create_dir(place(target)[1], recursive=True)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(root)
        goal, made = place(target)[1], set()
        for batch in batches:
            kept = []
            for path, name in zip(*batch.to_pydict().values(), strict=True):
                source = f"{base}/files/{file_name(path)}"
                fresh = fs.get_file_info(source).type == pafs.FileType.File
                there = fs.get_file_info(f"{goal}/{name}").type == pafs.FileType.File
                if fresh and there and keep is not None:
                    fs.copy_file(f"{goal}/{name}", f"{goal}/{name}{keep}")
                inner = name.rpartition("/")[0]
                if inner and inner not in made:
                    fs.create_dir(f"{goal}/{inner}", recursive=True)
                    made.add(inner)
                if fresh:
                    fs.move(source, f"{goal}/{name}")
                kept.append(keep is not None and fs.get_file_info(f"{goal}/{name}{keep}").type == pafs.FileType.File)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(kept, pa.bool_())], names=["name", "kept"])

    return cut(names.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(move, "name string, kept boolean"))
