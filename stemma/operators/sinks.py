"""Writers of small results: guarded reports, manifests, proposals, snapshots, line files with a dated copy.

Reports are written by the driver, which refuses more rows than a report holds; line files are written by tasks.
"""

from __future__ import annotations

import json
import shutil
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Damaged, Refused
from ..session import cut
from ..sources import gedcom, linefiles
from . import edit

#: Rows that a report may hold; more belong in a table.
MOST = 100_000


def _small(rows: DataFrame) -> list:
    """The rows of a report, or a refusal where they are too many for the driver."""
    found = rows.limit(MOST + 1).collect()
    if len(found) > MOST:
        raise Refused(f"more than {MOST} rows are no report")
    return found


def write_report(text: str, path: str | Path, force: bool = False) -> None:
    """A Markdown report; refuses text without a title, and to write over a file that is no report."""
    if not text.startswith("# "):
        raise Refused("a report begins with a title")
    target = Path(path)
    if target.exists() and not force and not target.read_text(encoding="utf-8").startswith("# "):
        raise Refused(f"{target} is not a report")
    target.write_text(text, encoding="utf-8")


def markdown_table(rows: DataFrame, title: str, columns: list[str] | None = None) -> str:
    """A titled table of an ordered, short result."""
    names = columns or rows.columns
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    body = [f"| {' | '.join(cell(r[c]) for c in names)} |" for r in _small(rows.select(*names))]
    return "\n".join([f"# {title}", "", f"| {' | '.join(names)} |", f"| {' | '.join('---' for _ in names)} |", *body, ""])


def manifest_lines(assets: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """``value``: a line a file, by path, with a remark line above it that names the notes that speak of it."""
    line = F.format_string("%s %12d  %s", "digest", "size", "path")
    if origins is None:
        return assets.orderBy("path").select(line.alias("value"))
    said = origins.groupBy(F.col("asset").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("note")), ", ").alias("notes"))
    both = assets.join(said, "path", "left").orderBy("path")
    return both.select(F.explode(F.array_compact(F.array(F.when(F.col("notes").isNotNull(), F.concat(F.lit("# "), "notes")), line))).alias("value"))


def proposals_yaml(rows: DataFrame, header: str = "") -> str:
    """Proposals as a list of entries; JSON values are valid YAML. ``accept`` stays open where it is null."""
    out = [f"# {h}".rstrip() for h in header.splitlines()]
    for r in _small(rows.select(F.to_json(F.struct("*")).alias("j"))):
        entry = json.loads(r.j)
        entry.setdefault("accept", None)
        for i, (k, v) in enumerate(entry.items()):
            out.append(f"{'- ' if i == 0 else '  '}{k}: {json.dumps(v, ensure_ascii=False)}")
    return "\n".join(out) + "\n"


def snapshot_json(entries: DataFrame, date: str, root: str) -> str:
    """Entries whose parents are known or known not to be, by person, keys in order."""
    kept = entries.where("status IN ('ready', 'stuck') AND fsftid IS NOT NULL").select(F.to_json(F.struct("*")).alias("j"))
    people = {(e := json.loads(r.j))["xref"]: {k: v for k, v in e.items() if k != "xref"} for r in _small(kept)}
    return json.dumps({"data": date, "arrel": root, "persones": people}, ensure_ascii=False, indent=1, sort_keys=True) + "\n"


def dated_copy(path: str | Path, now: datetime | None = None) -> Path:
    """A copy beside the file with the time in its name, before the file is written over."""
    source = Path(path)
    target = source.with_name(f"{source.stem}_{(now or datetime.now()):%Y%m%d-%H%M%S}{source.suffix}")
    shutil.copy2(source, target)
    return target


def staged_lines(lines: DataFrame, meta: DataFrame, folder: str) -> tuple[str, DataFrame]:
    """Write line files (``path, idx, raw``, numbered from 0) in a new folder below ``folder``, to be checked before they are used.

    The staged folder, and ``path, idx, raw`` as read again from it.
    """
    root = linefiles.stage(lines, meta, folder)
    return root, _read_again(lines.sparkSession, root, gedcom.raw_lines, linefiles.lines_of)


def _read_again(spark, root: str, of_large, of_whole) -> DataFrame:
    """What is in staged files: the few large ones through Spark's reader, the others, of which a folder may have many, by name."""
    read, files = of_whole(linefiles.whole(spark, root)), linefiles.large(spark, root)
    return read.unionByName(linefiles.named(of_large(spark, files))) if files else read


def checked(lines: DataFrame, meta: DataFrame, root: str, read: DataFrame | None = None) -> DataFrame:
    """``path, lines, read_again, same`` of a staged write; one that does not give back its lines, marks and newlines is removed and refused.

    ``read`` are the lines as read again, where the caller has kept them; else they are read here.
    """
    spark = lines.sparkSession
    report = cut(edit.reread(lines, _read_again(spark, root, gedcom.raw_lines, linefiles.lines_of) if read is None else read))
    told = _read_again(spark, root, gedcom.file_meta, linefiles.meta_of).select("path", F.struct("has_bom", "newline", "trailing_newline").alias("found"))
    shape = F.struct(F.coalesce("has_bom", F.lit(False)).alias("has_bom"), F.coalesce("newline", F.lit("\n")).alias("newline"), F.coalesce("trailing_newline", F.lit(True)).alias("trailing_newline"))
    # A file of one line without an end does not show its kind of newline.
    other = lines.groupBy("path").agg(F.count("*").alias("n")).join(meta, "path", "left").select("path", "n", shape.alias("wanted")).join(told, "path", "left")
    other = other.where(F.col("found").isNull() | (F.col("found.has_bom") != F.col("wanted.has_bom")) | (F.col("found.trailing_newline") != F.col("wanted.trailing_newline")) | ((F.col("found.newline") != F.col("wanted.newline")) & ((F.col("n") > 1) | F.col("wanted.trailing_newline"))))
    if not report.where("NOT same").isEmpty() or not other.isEmpty():
        linefiles.discard(root)
        raise Damaged("what was read again is not what was written")
    return report


def write_lines(lines: DataFrame, meta: DataFrame, folder: str, keep: str | None = None, parts: int = 1) -> DataFrame:
    """Line files into ``folder``: staged beside it, read again and compared, then moved into place; ``name, kept``.

    Marks, newlines and last newlines are as ``meta`` says. With ``keep`` a file that is replaced stays under its name
    with that behind it. Refused writes change nothing. The last ``parts`` of a path are its place in the folder.
    """
    root = linefiles.stage(lines, meta, folder)
    checked(lines, meta, root)
    done = linefiles.publish(lines.sparkSession, root, folder, keep, parts)
    linefiles.discard(root)
    return done


def flattened_places(lines: DataFrame, form: str = "Aldea, Ciutat, Codi Postal, Comtat, Estat, País") -> DataFrame:
    """Lines for an import: place strings without postal slot and empty levels. Refuses another layout in the header."""
    from ..functions.places import flattened

    if not lines.where("tag = 'FORM' AND level = 2 AND contains(value, ',')").where(F.col("value") != form).isEmpty():
        raise Refused("the header names another layout of places")
    place = F.col("tag") == "PLAC"
    return lines.withColumn("raw", F.when(place, F.concat(F.col("level").cast("string"), F.lit(" PLAC "), flattened(F.col("value")))).otherwise(F.col("raw")))


def fiche_markdown(title: str, fields: dict[str, str], labels: list[tuple[str, str]], kin: list[tuple[str, str, str]], note: str = "") -> str:
    """An index entry as a note: fields in the order of ``labels``, then kin ``(role, name, birthplace)`` in theirs."""
    out = [f"# {title}", ""]
    if note:
        out += [note, ""]
    rows = [f"| {label} | {fields[key]} |" for label, key in labels if fields.get(key)]
    out += ["| | |", "| --- | --- |", *rows, ""]
    named = [f"| {role} | {name} | {place} |" for role, name, place in kin if name.strip()]
    if named:
        out += ["| Vincle | Nom | Lloc de naixement |", "| --- | --- | --- |", *named, ""]
    return "\n".join(out)
