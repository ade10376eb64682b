"""Benchmark decontamination by a generalised suffix automaton of the test items.

Texts and items are normalised alike (``A-Z`` to small letters; words are runs of letters, digits and
everything beyond ASCII). The automaton of all items' word sequences reads a text's words one by one and
keeps the longest stretch that ends here and occurs in an item. A stretch of ``WINDOW`` words and more is
made of item windows only, so all of it is hit; an item of fewer words is one window, found among the
suffixes of the stretch by suffix links. Both tell which items they come from.

A map over texts against an automaton of bounded size. Items of more than ``BLOCK`` bytes in all are dealt
to several automata; each reads all texts, and what they find is united by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, content_key, cut, pieces, spread, table, written

WINDOW = 10
#: Bytes of item words that one automaton holds; the driver and a Python worker hold one at a time.
BLOCK = 1 << 20
#: Long items are cut into overlapping pieces of so many words.
PIECE = 4096

APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c < 0x30 or 0x39 < c < 0x61 or 0x7A < c < 0x80 else c for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def normalised(text: bytes) -> bytes:
    """Same length, words in small letters, every separator a blank."""
    return text.translate(_LOWER)


class Automaton:
    """Suffix automaton of several word sequences; states are numbers, words any hashable."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.goes: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            state = 0
            for word in words:
                state = self._grow(state, word)
        self.shortest = min([window, *(len(words) for _, words in items)])
        self._owners(items)

    def _state(self, size: int, link: int, goes: dict[bytes, int]) -> int:
        self.goes.append(goes)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The state of exactly the longest string of ``state`` with ``word`` behind it."""
        to = self.goes[state][word]
        if self.size[to] == self.size[state] + 1:
            return to
        twin = self._state(self.size[state] + 1, self.link[to], dict(self.goes[to]))
        self.link[to] = twin
        while state >= 0 and self.goes[state].get(word) == to:
            self.goes[state][word] = twin
            state = self.link[state]
        return twin

    def _grow(self, state: int, word: bytes) -> int:
        if word in self.goes[state]:
            return self._split(state, word)
        new = self._state(self.size[state] + 1, 0, {})
        while state >= 0 and word not in self.goes[state]:
            self.goes[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def _owners(self, items: list[tuple[str | None, list[bytes]]]) -> None:
        """Items of every window's state; for every state the state of its suffix of one window, and its nearest whole short item."""
        n = len(self.size)
        self.owners: dict[int, set[str | None]] = {}
        self.whole = bytearray(n)
        self.cut, self.near = [0] * n, [0] * n
        order = sorted(range(1, n), key=self.size.__getitem__)
        for state in order:
            up = self.link[state]
            if self.size[state] >= self.window:
                self.cut[state] = self.cut[up] if self.size[up] >= self.window else state
        for name, words in items:
            state = 0
            for word in words:
                state = self.goes[state][word]
                if self.size[state] >= self.window:
                    self.owners.setdefault(self.cut[state], set()).add(name)
            if len(words) < self.window:
                self.whole[state] = 1
                self.owners.setdefault(state, set()).add(name)
        for state in order:
            self.near[state] = state if self.whole[state] else self.near[self.link[state]]

    def read(self, words: list[bytes]) -> tuple[list[list[int]], set[str | None], int]:
        """Hit spans of words (half-open, apart from each other), the items found, and the longest stretch that hits."""
        known = bytes(map(self.goes[0].__contains__, words))
        spans: list[list[int]] = []
        seen: set[int] = set()
        longest = 0
        goes, link, size, window = self.goes, self.link, self.size, self.window
        for run in re.finditer(b"\x01{%d,}" % self.shortest, known):
            state = length = 0
            for i in range(run.start(), run.end()):
                word = words[i]
                to = goes[state].get(word)
                while to is None:  # the root knows every word of a run
                    state = link[state]
                    length = size[state]
                    to = goes[state].get(word)
                state, length = to, length + 1
                short = self.near[state] if length == size[state] else self.near[link[state]]
                if short:
                    seen.add(short)
                if length >= window:
                    seen.add(self.cut[state])
                    reach = length
                elif short:
                    reach = size[short]
                else:
                    continue
                longest = max(longest, reach)
                begin = i + 1 - reach
                while spans and spans[-1][0] >= begin:
                    spans.pop()
                if spans and spans[-1][1] >= begin:
                    spans[-1][1] = i + 1
                else:
                    spans.append([begin, i + 1])
        found: set[str | None] = set()
        for state in seen:
            if self.size[state] >= window:
                found |= self.owners[state]
                continue
            while state:  # shorter whole items at the end of this one
                found |= self.owners[state]
                state = self.near[self.link[state]]
        return spans, found, longest


def item_pieces(items: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """``item, words, bytes``: normalised words of every item; long ones in pieces that overlap by a window less one word."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.filter(F.split(F.translate(F.coalesce(text_column, F.lit("")), upper, upper.lower()), APART), lambda x: x != "")
    each = items.select(F.col(id_column).cast("string").alias("item"), words.alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)), F.lit(PIECE))
    cut_ = F.explode(F.transform(starts, lambda at: F.slice("all", at, PIECE + window - 1))).alias("words")
    return each.select("item", cut_).select("item", "words", F.octet_length(F.array_join("words", " ")).cast("long").alias("bytes"))


def _found(docs: DataFrame, block: DataFrame, keys: list[str], text_column: str, window: int) -> DataFrame:
    """``keys``, ``n_words``, ``spans`` (of words), ``items``, ``longest`` of every row of ``docs``, by one block of items."""
    rows = [(r.item, [w.encode() for w in r.words]) for r in block.select("item", "words").collect()]
    held = docs.sparkSession.sparkContext.broadcast(rows)

    def make():
        automaton = Automaton(held.value, window)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            last = batch.num_columns - 1
            for first, texts in pieces(batch.column(last), 8 << 20):
                words = [normalised(t).split() for t in texts]
                read = [automaton.read(w) for w in words]
                mine = [batch.column(i).slice(first, len(texts)) for i in range(last)]
                spans = pa.array([[{"a": a, "b": b} for a, b in s] for s, _, _ in read], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
                named = pa.array([sorted(x for x in f if x is not None) for _, f, _ in read], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*mine, pa.array(list(map(len, words)), pa.int64()), spans, named, pa.array([n for _, _, n in read], pa.int32())], names=[*keys, "n_words", "spans", "items", "longest"])

        return step

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return arrow_map(docs.select(*keys, text_column), make, f"{kinds}, n_words long, spans array<struct<a int, b int>>, items array<string>, longest int")


def _united(spans: str) -> F.Column:
    """Spans in order, those that overlap or touch made one."""
    step = lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["b"] >= s["a"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], s["b"]).alias("b")))),
    ).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<a int, b int>>"), step)


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, spans, items, longest`` of every row.

    ``spans`` are half-open, in words; ``longest`` is the longest stretch of words that occurs in an item and
    is a window at least (0: none). Null and empty texts, and texts without words, have no words; items without
    words are no items. Items that repeat an id are one item in the list; one without an id hits words, but is
    not listed. Repeated rows each give a row; an empty table of either kind gives no rows or no hits. Other
    columns are not read, whatever their names. Texts of any length are read whole.
    """
    found = cut(item_pieces(items, item_column, item_text_column, window))
    total = found.agg(F.sum("bytes").alias("n")).first().n or 0
    blocks = max(1, -(-total // BLOCK))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("__text"))
    if blocks == 1:
        return _found(rows, found, ["doc_id"], "__text", window)
    # Every text once, against one block after another; only texts that a block hits are kept.
    texts = rows.select(*content_key(F.col("__text")), "__text").dropDuplicates(["k1", "k2"])
    part = F.pmod(F.xxhash64("words"), F.lit(blocks))
    hits = [written(_found(texts, found.where(part == b), ["k1", "k2"], "__text", window).where("longest > 0").drop("n_words")) for b in range(blocks)]
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    # A text has at most one row a block.
    one = every.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    plain = _found(rows.withColumns(dict(zip(("k1", "k2"), content_key(F.col("__text")), strict=True))), found.where("false"), ["doc_id", "k1", "k2"], "__text", window).select("doc_id", "k1", "k2", "n_words")
    none = F.array()
    return plain.join(one.withColumn("spans", _united("spans")), ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", none).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest"))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of its spans, and what lies between them; the rest as it was. Of a text without other words nothing stays."""
    if not spans:
        return text
    where = [m.span() for m in _WORD.finditer(normalised(text))]
    if sum(b - a for a, b in spans) == len(where):
        return b""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : where[a][0]])
        at = where[b - 1][1]
    return b"".join([*out, text[at:]])


def cleaned(docs: DataFrame, items: DataFrame, longest: int = WINDOW, coverage: float = 0.8, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, text, n_removed``: spans of ``longest`` words and more go; of a text hit in more than ``coverage`` of its words nothing stays.

    Rows as in ``contamination``; a null text stays null. Ids must tell texts apart: texts and spans meet by id and content.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    named = rows.select(F.struct("doc_id", *content_key(F.col("text"))).alias("doc_id"), "text")
    found = contamination(named.dropDuplicates(["doc_id"]), items, item_column=item_column, item_text_column=item_text_column, window=window)
    both = rows.withColumn("__key", F.struct("doc_id", *content_key(F.col("text")))).join(found.select(F.col("doc_id").alias("__at"), "n_words", "spans"), F.col("__key").eqNullSafe(F.col("__at")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))
    gone = F.when(hit > coverage * F.col("n_words"), F.filter(F.array(F.struct(F.lit(0).alias("a"), F.col("n_words").cast("int").alias("b"))), lambda s: s["b"] > 0)).otherwise(F.filter("spans", lambda s: s["b"] - s["a"] >= longest))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, texts in pieces(batch.column(1), 8 << 20):
                spans = [[(s["a"], s["b"]) for s in row] for row in batch.column(2).slice(first, len(texts)).to_pylist()]
                null = batch.column(1).slice(first, len(texts)).is_null().to_pylist()
                out = [None if gone_ else without_spans(t, s).decode() for t, s, gone_ in zip(texts, spans, null, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(out, pa.string()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64())], names=["doc_id", "text", "n_removed"])

        return step

    return arrow_map(both.select("doc_id", "text", gone.alias("spans")), make, f"doc_id {kind}, text string, n_removed long")


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``; nulls, empty texts, repeated rows and ties as in ``contamination``."""
    found = contamination(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item, k, array_to_string(w[pos:pos + k - 1], ' ') AS g
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS pos FROM i WHERE len(w) > 0)
), dw AS (
  SELECT rid, k, pos, array_to_string(w[pos:pos + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)
), hit AS (
  SELECT rid, dw.k, pos, item FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g
), words AS (
  SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(pos, pos + k)) AS place FROM (SELECT DISTINCT rid, pos, k FROM hit)) GROUP BY rid
), named AS (
  SELECT rid, list(DISTINCT item) FILTER (WHERE item IS NOT NULL) AS items FROM hit GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(len(coalesce(items, [])) AS BIGINT) AS n_items,
       sha256(array_to_string(list_sort(coalesce(items, [])), ',')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN named USING (rid)"""
