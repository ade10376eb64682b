"""Suffix-array dedup: repeated byte strings found by column-wise construction of a collection's BWT.

The engine inserts one symbol of every sequence each round, from the right: after round ``j`` the files hold
the Burrows-Wheeler transform, the longest common prefixes and the tail pointers of all suffixes of up to
``j`` symbols, in order. A round reads the files of the round before from front to back and writes new ones.
A symbol is eighty bytes (exactly numbered, never hashed), so each segment gives eighty sequences, one for
each phase, and a 400-byte string is exactly five symbols of one of them; a string is repeated if its suffix
has a common prefix of five symbols with a neighbour. (A string of 250 bytes is five symbols of fifty.) How segments of all documents come together is described in ``repeats``.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content_key, cut, spread, table, tidy
from .repeats import bytes_of, merge, repeated, unpacked

LENGTH = 400
#: The pipeline's length: fifty words of five bytes, blanks included, so that passages of more words go.
STAGE_LENGTH = 250
#: Bytes of a symbol: the largest of these that divides the length.
UNITS = (80, 50, 40, 16, 8, 4, 2, 1)
LOW = (1 << 32) - 1


class Files:
    """The external files of one generation, replaced by those of the next."""

    def __init__(self, folder: str):
        self.folder, self.turn = folder, 0

    def _path(self, name: str, turn: int) -> str:
        return os.path.join(self.folder, f"{name}-{turn}")

    def write(self, **columns: np.ndarray) -> None:
        """New files each round: writing over the old ones would make the file system flush them."""
        for name, column in columns.items():
            column.tofile(self._path(name, self.turn + 1))
            if self.turn:
                os.remove(self._path(name, self.turn))
        self.turn += 1

    def read(self, name: str, kind: type) -> np.ndarray:
        return np.fromfile(self._path(name, self.turn), kind)


def least_between(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum of ``values[left + 1 .. right]`` for each query, ``left < right``."""
    size, most = 16, np.iinfo(values.dtype).max
    padded = np.full((len(values) // size + 2) * size, most, values.dtype)
    padded[: len(values)] = values
    lane = np.arange(size)
    reach = right - left
    # Short ranges: one look at the next values. A range of one is the value itself.
    out = values[right].copy()
    short = np.flatnonzero((reach > 1) & (reach <= size))
    if len(short):
        at = left[short, None] + 1 + lane
        out[short] = np.where(lane < reach[short, None], padded[at], most).min(1)
    wide = np.flatnonzero(reach > size)
    if not len(wide):
        return out
    left, right = left[wide], right[wide]
    levels = [padded.reshape(-1, size).min(1)]
    while len(levels[-1]) > (half := 1 << (len(levels) - 1)):
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    first, last = (left + 1) // size, right // size

    def edge(block: np.ndarray) -> np.ndarray:
        at = block[:, None] * size + lane
        return np.where((at > left[:, None]) & (at <= right[:, None]), padded[at], most).min(1)

    got = np.minimum(edge(first), edge(last))
    count = last - first - 1
    inner = np.flatnonzero(count > 0)
    level = np.frexp(count[inner].astype(np.float64))[1] - 1
    for k in np.unique(level).tolist():
        i = inner[level == k]
        got[i] = np.minimum(got[i], np.minimum(levels[k][first[i] + 1], levels[k][last[i] - (1 << k)]))
    out[wide] = got
    return out


def column_wise(sequences: np.ndarray, bounds: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Common prefixes of neighbouring suffixes, in order, and the place of each suffix.

    ``sequences`` holds symbols (dense, from 0) of all sequences one after another; sequence ``d`` is
    ``bounds[d] : bounds[d + 1]``. The second result has, for each symbol, the place of the suffix that it begins.
    """
    n_docs = len(bounds) - 1
    size = np.diff(bounds)
    longest = int(size.max())
    files = Files(folder)
    place = np.arange(n_docs, dtype=np.int64)  # of each sequence's latest suffix
    last_symbol = np.where(size > 0, sequences[np.minimum(bounds[1:] - 1, len(sequences) - 1)], -1)
    # Empty suffixes first. F-column symbol (plus one) and the place of the tail form one sortable key.
    files.write(key=np.arange(n_docs, dtype=np.int64), lcp=np.zeros(n_docs, np.int16), bwt=last_symbol.astype(np.int32))
    for j in range(1, longest + 1):
        key, lcp, bwt = files.read("key", np.int64), files.read("lcp", np.int16), files.read("bwt", np.int32)
        live = np.flatnonzero(size >= j)
        tail = place[live]
        made = ((bwt[tail].astype(np.int64) + 1) << 32) | tail  # the BWT at a sequence's latest suffix is what comes next
        order = np.argsort(made)
        live, tail, made = live[order], tail[order], made[order]
        before = np.searchsorted(key, made)
        n_old, n_new = len(key), len(made)
        fresh = np.zeros(n_old + n_new, bool)
        at = before + np.arange(n_new)
        fresh[at] = True
        old_at = ~fresh
        every = np.empty(n_old + n_new, np.int64)
        every[at], every[old_at] = made, key
        prefix = np.empty(n_old + n_new, np.int16)
        prefix[old_at] = lcp
        # Each new suffix against its neighbours, and an old right neighbour against it.
        right_at = at[(at + 1 < len(every)) & ~fresh[np.minimum(at + 1, len(every) - 1)]] + 1
        for spot in (at, right_at):
            here, there = every[spot], every[spot - 1]
            same = (here >> 32) == (there >> 32)
            got = np.zeros(len(spot), np.int16)
            if same.any():
                got[same] = 1 + least_between(lcp, there[same] & LOW, here[same] & LOW)
            prefix[spot] = got
        # Tail pointers move with what was put in before them.
        shift = np.cumsum(np.bincount(before, minlength=n_old + 1)[:n_old])
        every += shift[every & LOW]
        letters = np.empty(n_old + n_new, np.int32)
        letters[old_at] = bwt
        up = bounds[live + 1] - j - 1
        letters[at] = np.where(size[live] > j, sequences[np.maximum(up, 0)], -1)
        place += shift[place]
        place[live] = at
        files.write(key=every, lcp=prefix, bwt=letters)
    key, lcp = files.read("key", np.int64), files.read("lcp", np.int16)
    where = np.zeros(len(sequences), np.int64)
    now, live = place, np.arange(n_docs)
    for i in range(longest):
        on = size[live] > i
        live, now = live[on], now[on]
        where[bounds[live] + i] = now
        now = key[now] & LOW
    return lcp, where


def ranks(data: np.ndarray, unit: int) -> np.ndarray:
    """Dense numbers of the ``unit`` bytes at each place where so many are left; equal numbers mean equal bytes."""
    out, size = data.astype(np.uint64), 1
    while size < min(unit, 8):
        out = (out[:-size] << np.uint64(8 * size)) | out[size:]
        size *= 2
    out = pd.factorize(out)[0].astype(np.int64)
    while size < unit:
        more = min(unit, 3 * size)
        n, many = len(data) - more + 1, int(out.max()) + 1
        middle = min(size, more - size)
        key = out[:n] * many + out[middle : middle + n]
        if more > 2 * size:
            key = (key if many < 1 << 21 else pd.factorize(key)[0].astype(np.int64)) * many + out[more - size : more - size + n]
        out, size = pd.factorize(key)[0].astype(np.int64), more
    return out


def engine(rows: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each row of bytes, whether the string of ``window`` bytes at each start also starts elsewhere."""
    unit = next(u for u in UNITS if window % u == 0)
    need = window // unit
    size = np.array([len(r) for r in rows], np.int64)
    start = np.cumsum(size) - size
    data = np.concatenate(rows)
    if size.max() < window:
        return [np.zeros(0, bool) for _ in rows]
    symbol = ranks(data, unit)
    # One sequence for each row and phase that has room for a window.
    row = np.repeat(np.arange(len(rows)), unit)
    phase = np.tile(np.arange(unit), len(rows))
    count = (size[row] - phase) // unit
    wide = count >= need
    row, phase, count = row[wide], phase[wide], count[wide]
    bounds = np.concatenate([[0], np.cumsum(count)])
    place = np.repeat(start[row] + phase, count) + unit * (np.arange(bounds[-1]) - np.repeat(bounds[:-1], count))
    with tempfile.TemporaryDirectory() as folder:
        lcp, where = column_wise(symbol[place], bounds, folder)
    hit = lcp >= need
    hit[:-1] |= hit[1:]
    flags = np.zeros(len(data), bool)
    flags[place] = hit[where]
    return [flags[a : a + max(0, n - window + 1)] for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def anchor_of(length: int) -> int:
    """Bytes of an anchor: two fifths of a string, so that hardly any anchor is shared by chance."""
    return max(1, 2 * length // 5)


def whole_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans shrunk to whole UTF-8 characters."""
    out = []
    for a, b in spans.tolist():
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b < len(text) and b > a and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def kept_bytes(text: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def without_repeats(docs: DataFrame, length: int = LENGTH, text_column: str = "text") -> DataFrame:
    """One row a distinct text: ``k1, k2`` (its content key), ``n_bytes, n_removed, n_spans, kept_sha256``."""
    texts, found = repeated(docs, text_column, length, anchor_of(length), bytes_of, engine)
    joined = texts.join(found.hint("shuffle_hash"), ["k1", "k2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                t, runs = unpacked(text.as_py()), merge(spans.as_py() or [])
                kept = kept_bytes(t, runs)
                rows.append((len(t), len(t) - len(kept), len(runs), sha256(kept).hexdigest()))
            n, removed, spans, sha = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = joined.select("k1", "k2", "t", "spans").mapInArrow(tidy(run), "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    # Copies of a text from several partitions give equal rows.
    return out.dropDuplicates(["k1", "k2"])


def stripped(docs: DataFrame, length: int = LENGTH, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated strings taken out of their texts, all other columns unchanged.

    Texts stay valid UTF-8: where a removed run begins or ends inside a character, that character stays. A
    null text stays null.
    """
    _, found = repeated(docs, text_column, length, anchor_of(length), bytes_of, engine)
    named = found.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), "spans")
    # Other columns travel in a struct, so no name can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), *content_key(F.col(text_column)))
    joined = rows.join(named, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left")

    @F.pandas_udf("string")
    def strip(texts, spans):
        out = []
        for text, some in zip(texts, spans, strict=True):
            if text is not None and some is not None and len(some):
                raw = text.encode()
                text = kept_bytes(raw, whole_characters(raw, merge(some))).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    stripped_ = joined.select("row", strip(F.col(f"row.`{text_column}`"), F.col("spans")).alias("text"))
    return stripped_.select(*[F.col("text").alias(c) if c == text_column else F.col(f"row.`{c}`") for c in docs.columns])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``. Null and empty texts: zeros and the hash of nothing; repeated rows each give a row."""
    docs = spread(table(spark, sf_dir, "documents"))
    # Cut, so that a partition with very many copies of one text can be split.
    return docs.select("doc_id", *content_key(F.col("text"))).join(cut(without_repeats(docs)), ["k1", "k2"]).drop("k1", "k2")
