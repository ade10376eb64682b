"""Repeated passages across a corpus: the part that the byte and the word operator share.

A passage is a window of ``W`` units (bytes or words). A window is repeated if its unit sequence also starts
anywhere else. All copies of a window must meet in one task; they do so through *anchors*:

1. In every window the ``K`` units with the smallest hash (leftmost at ties) are its anchor. Equal windows
   have equal anchors at equal places, so copies of a window always share an anchor. A run of consecutive
   windows with one anchor place is a *segment*; each window lies in exactly one segment.
2. Only anchors whose hash occurs twice or more can matter; counts are combined before they move.
3. Segments of such anchors with equal content form a class. Each class is cut out of one text that holds it
   and goes to the task of its anchor, in two copies if it occurs more than once. An anchor with more than
   ``MANY`` classes is dealt anew: its segments are cut into narrow pieces, equal pieces become one, and pieces
   meet by the content that their windows share; where that is too much again, by single windows. So no task
   gathers more than ``MANY`` segments, whatever the corpus holds.
4. The operator's own engine finds the repeated windows among the segments of a block of whole anchors.
5. Found windows go back to the segments of their class and so to the texts.

Texts are known by 128 bits of their content, so repeated rows and null ids need no special care, and copies
of a text are worked on once for each input partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, cut, importable, mix64, pieces, tidy, width

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Classes of one anchor above which its segments are dealt anew.
MANY = 512
#: Units that an engine gets at once, unless one anchor has more.
BLOCK_UNITS = 400_000

Engine = Callable[[list[np.ndarray], int], list[np.ndarray]]


class Powers:
    """Powers of the hash base and of its inverse, grown on demand and bounded by the longest text."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, BASE, np.uint64))])
                self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, INVERSE, np.uint64))])
        return self.up, self.down


def prefix_hash(units: np.ndarray, powers: Powers) -> np.ndarray:
    """Running sums of ``unit * base**place``; differences give the hash of any stretch."""
    up, _ = powers.get(len(units) + 1)
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * up[: len(units)], out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, at: np.ndarray | slice, size, powers: Powers) -> np.ndarray:
    """Hashes of the stretches of ``size`` units that begin at ``at``; a slice stands for all its places."""
    _, down = powers.get(len(sums))
    ends = sums[at.start + size : at.stop + size] if isinstance(at, slice) else sums[at + size]
    return mix64((ends - sums[at]) * down[at] + np.asarray(size, np.uint64))


#: Windows worked on at once; a place must fit beside the leading bits of its hash.
STRIDE = 1 << 19
PLACE = np.uint64((1 << 20) - 1)


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least leading bits in each run of ``w`` hashes, leftmost at ties: doubling, so log2(w) passes."""
    best = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach * 2 <= w:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if rest := w - reach:
        best = np.minimum(best[:-rest], best[rest:])
    return (best & PLACE).astype(np.int64)


def segments(units: np.ndarray, window: int, anchor: int, powers: Powers) -> tuple[np.ndarray, ...] | None:
    """Anchor hash, content hash, first window start, number of starts, anchor place in the segment; None for a short text.

    A segment also ends where a stride of windows ends: that splits it in two, which changes nothing else.
    """
    n = len(units) - window + 1
    if n <= 0:
        return None
    sums = prefix_hash(units, powers)
    out = []
    for at in range(0, n, STRIDE):
        many = min(STRIDE, n - at)
        h = stretch_hash(sums, slice(at, at + many + window - anchor), anchor, powers)
        best = sliding_argmin(h, window - anchor + 1)
        first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        count = np.diff(first, append=many)
        content = stretch_hash(sums, first + at, count + window - 1, powers)
        out.append((h[best[first]].view(np.int64), content.view(np.int64), first + at, count, best[first] - first))
    return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated(docs: DataFrame, text_column: str, window: int, anchor: int, to_units: Callable[[], Callable[[bytes], np.ndarray]], engine: Engine) -> tuple[DataFrame, DataFrame]:
    """``texts``: every distinct text at least once for each partition (``k1, k2, t``, for ``unpacked``); ``found``: ``k1, k2, spans``.

    ``spans`` holds pairs (first unit, unit after the last) of int32, little endian, as binary: stretches
    covered by repeated windows, not yet merged. Texts without repeated windows have no row.
    """
    importable(docs.sparkSession)
    source = docs.select(F.coalesce(text_column, F.lit("")).cast("binary").alias("t"), *content_key(F.col(text_column)))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text once, packed: texts are what moves most."""
        seen: set[tuple[int, int]] = set()
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            new, packed = [], []
            for i, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
                    packed.append(pack(batch.column(0)[i].as_py()))
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1).take(pa.array(new)), batch.column(2).take(pa.array(new))], names=["t", "k1", "k2"])

    texts = source.mapInArrow(tidy(distinct), "t binary, k1 long, k2 long")

    def cut_up(with_content: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            powers, units = Powers(), to_units()
            seen: dict[tuple[int, int], int] = {}
            names = ["a", "s", "k1", "k2", "lo", "n", "p"] if with_content else ["a"]

            def out(rows: list) -> pa.RecordBatch:
                columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

            for batch in batches:
                k1, k2 = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                rows, size = [], 0
                for first, part in pieces(batch.column(0)):
                    for i, text in enumerate(part, first):
                        # A text's second copy in this partition makes each of its anchors repeated; more add nothing.
                        times = seen.get((k1[i], k2[i]), 0)
                        seen[k1[i], k2[i]] = times + 1
                        if times > 1:
                            continue
                        with np.errstate(over="ignore"):
                            made = segments(units(text), window, anchor, powers)
                        if made is None:
                            continue
                        a, s, lo, n, p = made
                        m = len(a)
                        rows.append((a, s, np.full(m, k1[i]), np.full(m, k2[i]), lo.astype(np.int32), n.astype(np.int32), p.astype(np.int32)) if with_content else (a,))
                        size += m
                        if size > 100_000:
                            yield out(rows)
                            rows, size = [], 0
                if rows:
                    yield out(rows)

        return run

    # Both sides of this join are plain rows of a shuffle, so a hot anchor's partition can be split.
    often = cut(source.mapInArrow(tidy(cut_up(False)), "a long").groupBy("a").count().where("count > 1").select("a"))
    every = source.mapInArrow(tidy(cut_up(True)), "a long, s long, k1 long, k2 long, lo int, n int, p int")
    mine = cut(every.join(often, "a", "left_semi"))
    classes = cut(mine.groupBy("a", "s").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("c"), F.min(F.struct("k1", "k2", "lo", "n", "p")).alias("r")).select("a", "s", "c", "r.*"))
    dealt_texts = texts.select("k1", "k2", "t")
    hits = _settle(dealt_texts, classes, [max(1, window // 16), 1], window, to_units, engine, True)
    back = mine.join(hits.withColumnRenamed("lo", "off"), ["a", "s"]).select("k1", "k2", (F.col("lo") + F.col("off")).alias("lo"), "spans").distinct()
    found = back.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "spans")).alias("spans"))
    return dealt_texts, found


def _settle(texts: DataFrame, classes: DataFrame, steps: list[int], window: int, to_units: Callable[[], Callable[[bytes], np.ndarray]], engine: Engine, whole: bool) -> DataFrame:
    """Hits ``a, s, lo, spans`` of ``classes`` (``a, s, c, k1, k2, lo, n, p``), whose contents are in ``texts`` (``k1, k2, t``).

    Groups (``a``) of at most ``MANY`` classes go to the engine. Classes of larger groups are cut into pieces of
    ``steps[0]`` window starts, at places fixed relative to the anchor; a piece's group is the content that all its
    windows share, equal pieces become one class, and these are settled in turn, their texts being the segments.
    With a step of one a piece is one window, so that each group is one class and nothing is left to split.
    ``whole``: the texts are packed texts, not units.
    """
    spark = texts.sparkSession
    groups = cut(classes.groupBy("a").agg(F.count("*").alias("many"), F.sum("c").alias("total")).where("total > 1").select("a", (F.col("many") > MANY).alias("hot")))
    told = classes.join(groups, "a").select("k1", "k2", F.struct("a", "s", "c", "lo", "n", "p", "hot").alias("x"))
    # At most one entry for each segment of the text.
    wanted = told.groupBy("k1", "k2").agg(F.collect_list("x").alias("xs"))
    holding = texts.join(wanted.hint("shuffle_hash"), ["k1", "k2"])
    kind = to_units()(b"").dtype
    names = ["g", "a", "s", "c", "p", "hot", "b"]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = to_units() if whole else None
        done: set[tuple[int, int]] = set()

        def out(rows: list) -> pa.RecordBatch:
            columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=names)

        for batch in batches:
            rows, size = [], 0
            for t, k1, k2, xs in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                key = (k1.as_py(), k2.as_py())
                if key in done:
                    continue
                done.add(key)
                with np.errstate(over="ignore"):
                    u = units(unpacked(t.as_py())) if whole else np.frombuffer(t.as_py(), kind)
                for x in xs.as_py():
                    # A hot group's segments need not meet: they go on by content.
                    rows.append((x["s"] if x["hot"] else x["a"], x["a"], x["s"], x["c"], x["p"], x["hot"], u[x["lo"] : x["lo"] + x["n"] + window - 1].tobytes()))
                    size += len(rows[-1][-1])
                    if size > 1 << 20:
                        yield out(rows)
                        rows, size = [], 0
            if rows:
                yield out(rows)

    cut_outs = holding.select("t", "k1", "k2", "xs").mapInArrow(tidy(cut_out), "g long, a long, s long, c int, p int, hot boolean, b binary")
    dealt = cut_outs.repartition(width(spark), "g").sortWithinPartitions("g")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hits, and the segments of hot groups as they are."""
        held: list[tuple[int, int, int, np.ndarray]] = []
        units = 0
        last = None

        def out(a: list, s: list, spans: list, c: list, p: list, b: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(spans, pa.binary()), pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(b, pa.binary())], names=["a", "s", "spans", "c", "p", "b"])

        def flush() -> Iterator[pa.RecordBatch]:
            rows, owner, at = [], [], 0
            for k, (_, _, c, u) in enumerate(held):
                rows += [u] * c
                owner += [(k, at)]
                at += c
            if at > 1:
                flags = engine(rows, window)
                a, s, spans = [], [], []
                for (_, first), (ak, sk, _, _) in zip(owner, held, strict=True):
                    hit = np.flatnonzero(flags[first])
                    if len(hit):
                        edge = np.flatnonzero(np.diff(hit) > 1)
                        pairs = np.stack([hit[np.concatenate([[0], edge + 1])], hit[np.concatenate([edge, [len(hit) - 1]])] + window], 1)
                        a.append(ak), s.append(sk), spans.append(pairs.astype("<i4").tobytes())
                if a:
                    none = [None] * len(a)
                    yield out(a, s, spans, none, none, none)
            held.clear()

        for batch in batches:
            through: list[tuple] = []
            for g, a, s, c, p, hot, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if hot:
                    through.append((a, s, None, c, p, b))
                    continue
                if g != last and units > BLOCK_UNITS:
                    yield from flush()
                    units = 0
                last = g
                u = np.frombuffer(b, kind)
                held.append((a, s, c, u))
                units += c * len(u)
            if through:
                yield out(*map(list, zip(*through, strict=True)))
        if held:
            yield from flush()

    found = cut(dealt.mapInArrow(tidy(search), "a long, s long, spans binary, c int, p int, b binary"))
    hits = found.where("spans IS NOT NULL").select("a", "s", F.lit(0).alias("lo"), "spans")
    large = found.where("b IS NOT NULL")
    if not steps or large.isEmpty():
        return hits
    step = steps[0]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            rows = []
            for a, s, c, p, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                u = np.frombuffer(b, kind)
                n = len(u) - window + 1
                place = p if step > 1 else 0
                slot = np.arange((0 - place) // step, (n - 1 - place) // step + 1)
                start = place + slot * step  # of the slot; some of its window starts may lie outside the segment
                low, high = np.maximum(start, 0), np.minimum(start + step, n)
                with np.errstate(over="ignore"):
                    sums = prefix_hash(u, powers)
                    core = stretch_hash(sums, start + step - 1, window - step + 1, powers)
                    group = mix64(core + slot.view(np.uint64)) if step > 1 else core
                    content = stretch_hash(sums, low, high - low + window - 1, powers)
                m = len(slot)
                rows.append((group.view(np.int64), content.view(np.int64), np.full(m, a), np.full(m, s), np.full(m, c, np.int32), low.astype(np.int32), (high - low).astype(np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["g", "u", "a", "s", "c", "lo", "n"])

    parts = cut(large.select("a", "s", "c", "p", "b").mapInArrow(tidy(split), "g long, u long, a long, s long, c int, lo int, n int"))
    equal = parts.groupBy("g", "u").agg(F.least(F.sum("c"), F.lit(2)).cast("int").alias("c"), F.min(F.struct("a", "s", "lo", "n")).alias("r"))
    smaller = cut(equal.select(F.col("g").alias("a"), F.col("u").alias("s"), "c", F.col("r.a").alias("k1"), F.col("r.s").alias("k2"), "r.lo", "r.n", F.lit(0).alias("p")))
    below = _settle(large.select(F.col("a").alias("k1"), F.col("s").alias("k2"), F.col("b").alias("t")), smaller, steps[1:], window, to_units, engine, False)
    below = below.select(F.col("a").alias("g"), F.col("s").alias("u"), F.col("lo").alias("off"), "spans")
    return hits.unionByName(parts.join(below, ["g", "u"]).select("a", "s", (F.col("lo") + F.col("off")).alias("lo"), "spans"))


def unpacked(packed: bytes) -> bytes:
    """A text as ``repeated`` hands it out."""
    return zstandard.ZstdDecompressor().decompress(packed)


def merge(spans: list[dict]) -> np.ndarray:
    """Maximal runs (first, after last) of the units covered by the spans of one text, in order."""
    parts = [np.frombuffer(x["spans"], "<i4").reshape(-1, 2).astype(np.int64) + x["lo"] for x in spans]
    if not parts:
        return np.empty((0, 2), np.int64)
    every = np.concatenate(parts)
    every = every[np.argsort(every[:, 0], kind="stable")]
    top = np.maximum.accumulate(every[:, 1])
    new = np.concatenate([[True], every[1:, 0] > top[:-1]])
    first = np.flatnonzero(new)
    return np.stack([every[first, 0], top[np.concatenate([first[1:] - 1, [len(every) - 1]])]], 1)


#: Bytes of a word above which it is hashed by itself: sums of powers modulo 2**64 collide on some periodic strings of 1,024 bytes.
LONG_WORD = 256


def hash_words() -> Callable[[bytes], np.ndarray]:
    """Words of a text as 64-bit hashes of their bytes, all at once; long words one by one, by another hash."""
    powers, blank = Powers(), np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True

    def units(text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        edge = np.flatnonzero(np.diff(blank[data], prepend=True, append=True))
        start, size = edge[::2], edge[1::2] - edge[::2]
        with np.errstate(over="ignore"):
            # A byte counts as one more, so that a word of zeros is no empty word.
            out = stretch_hash(prefix_hash(data.astype(np.uint64) + np.uint64(1), powers), start, size, powers)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(text[start[i] : start[i] + size[i]])
        return out

    return units


def bytes_of() -> Callable[[bytes], np.ndarray]:
    """Bytes of a text as units of the anchor hash."""
    return lambda text: np.frombuffer(text, np.uint8)
