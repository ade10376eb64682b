"""Quality rules: base counts, and divergence of a text's histograms from language references. Native only.

The method compares two histograms of a text, of character classes and of common words, with one reference
for each language by Jensen-Shannon distance (base 2, square root of the divergence, so between 0 and 1). Both
are learned from the corpus: the common words are the most frequent words of each language, in texts that are
long enough, and references are sums over all documents of a language that pass the base rule. A text is rejected
if it is farther than a threshold from *every* reference, in either histogram; texts below a histogram's minimum
length are not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, spread, table

#: Most frequent words of each language that count as common.
COMMON_WORDS = 12
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 200, 50
#: Chosen on labelled rows of one half of sf0.1 as the least that lose no clean row there; see the README.
MAX_CHARS_DISTANCE, MAX_WORDS_DISTANCE = 0.30, 0.29

#: Upper case, other letters, digits, sentence points, symbols, blanks, the rest.
CLASSES = 7


def spelled(bins: tuple[str, ...]) -> list[str]:
    """Common words as written: in small letters, with a capital, in capitals."""
    return sorted({f(w) for w in bins for f in (str.lower, lambda x: x[:1].upper() + x[1:], str.upper)})


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes in order."""

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        flagged = F.transform(s, lambda x, k: F.when(((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | ((k < last) & (F.get(s, F.least(k + 1, last))["h"] == x["h"])), x["i"]))
        places = F.array_sort(F.filter(flagged, lambda x: x.isNotNull()))
        return F.aggregate(places, F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("end")), lambda a, p: F.struct((a["sum"] + F.least(F.lit(WINDOW), p + F.lit(WINDOW) - a["end"])).alias("sum"), (p + F.lit(WINDOW)).alias("end")), lambda a: a["sum"])

    def count(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(marked, covered))

    return _bound(windows, count).cast("long")


def _words(text: Column) -> Column:
    return _bound(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, r"[\x20\x09-\x0D]+")))


def common_words(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", most: int = COMMON_WORDS) -> tuple[str, ...]:
    """The ``most`` frequent words of letters of each language (in small letters; of equal counts the first in code-point order), all languages together.

    Texts of ``MIN_WORDS`` words and more count. Counts are combined before they move; a row a language and word comes to the driver.
    """
    t = docs.where(F.col(lang_column).isNotNull()).select(F.col(lang_column).alias("lang"), _words(F.coalesce(text_column, F.lit(""))).alias("w")).where(F.size("w") >= MIN_WORDS)
    each = t.select("lang", F.explode("w").alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    each = each.select("lang", F.lower("w").alias("w"), "n").where(F.col("w").rlike(r"^\p{L}+$")).groupBy("lang", "w").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    return tuple(sorted({r.w for r in each.withColumn("nth", nth).where(F.col("nth") <= most).collect()}))


def features(docs: DataFrame, bins: tuple[str, ...] = (), id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", whole: bool = False) -> DataFrame:
    """One row a document: the base counts and verdict, and the two histograms (``chars``, ``common``: ``bins`` and the rest).

    ``doc_id`` is the id, or, with ``whole``, a struct of all columns.
    """
    t = docs.select((F.struct(*docs.columns) if whole else F.col(id_column)).alias("doc_id"), F.col(lang_column).alias("lang"), F.coalesce(text_column, F.lit("")).alias("t"))
    t = t.select("doc_id", "lang", "t", _words(F.col("t")).alias("w"))
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    found = F.transform(F.filter("w", lambda x: x.isin(*spelled(bins)) if bins else F.lit(False)), lambda x: F.lower(x))
    marks = F.regexp_replace("t", r"[\p{L}\x20\x09-\x0D]+", "")
    t = t.select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.when(F.size("w") > WINDOW, _repeat_words(hashes)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _bound(found, lambda c: F.array(*[F.size(c) - F.size(F.array_remove(c, w)) for w in bins]).cast("array<bigint>")).alias("counts"),
        F.length("t").cast("long").alias("n_chars"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).cast("long").alias("upper"),
        _bound(marks, lambda x: F.array(F.length(x), F.regexp_count(x, F.lit(r"\p{Nd}")), F.regexp_count(x, F.lit(r"[.,;:!?]")), F.regexp_count(x, F.lit(r"[#*$%&|<>]")))).alias("marks"),
    )
    t = t.select("*", *[F.get("marks", F.lit(i)).cast("long").alias(c) for i, c in enumerate(("n_marks", "digits", "points", "n_symbols"))])
    chars = F.array(F.col("upper"), F.col("word_chars") - F.col("n_marks") - F.col("upper"), F.col("digits"), F.col("points"), F.col("n_symbols"), F.col("n_chars") - F.col("word_chars"), F.col("n_marks") - F.col("digits") - F.col("points") - F.col("n_symbols"))
    rest = F.col("n_words") - F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    common = F.concat("counts", F.array(rest))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return t.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", failed.alias("base_failed"), chars.alias("chars"), common.alias("common"))


def references(found: DataFrame, bins: tuple[str, ...]) -> dict[str, tuple[list[float], list[float]]]:
    """Shares of each language's two histograms over all its documents that pass the base rule: one row a language."""
    # Conditional sums: a filter on the verdict would be pushed below the counts and compute them once more.
    fine = ~F.col("base_failed")
    rows = found.where(F.col("lang").isNotNull()).select("lang", fine.alias("fine"), "chars", "common", F.monotonically_increasing_id().alias("row"))
    pick = lambda name, i: F.sum(F.when(F.col("fine") & (F.col("row") >= 0), F.get(name, F.lit(i))))
    sums = [pick("chars", i).alias(f"a{i}") for i in range(CLASSES)] + [pick("common", i).alias(f"b{i}") for i in range(len(bins) + 1)]
    out = {}
    for row in rows.groupBy("lang").agg(*sums).collect():
        a, b = [row[f"a{i}"] for i in range(CLASSES)], [row[f"b{i}"] for i in range(len(bins) + 1)]
        if a[0] is not None:
            out[row.lang] = ([x / sum(a) for x in a], [x / sum(b) for x in b])
    return out


def distance(counts: Column, total: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance between a histogram of counts and fixed shares."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    parts = F.zip_with(counts, F.array(*map(F.lit, shares)), lambda c, q: term(c / F.greatest(total, F.lit(1)), q))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(found: DataFrame, known: dict[str, tuple[list[float], list[float]]], words_distance: float = MAX_WORDS_DISTANCE) -> DataFrame:
    """Adds the distances to the nearest reference (0 where there is none or the text is too short) and ``kept``."""
    least = lambda columns: F.least(*columns) if len(columns) > 1 else columns[0]
    zero = F.lit(0.0)
    langs = sorted(known)
    far = least([distance(F.col("chars"), F.col("n_chars"), known[k][0]) for k in langs]) if known else zero
    off = least([distance(F.col("common"), F.col("n_words"), known[k][1]) for k in langs]) if known else zero
    out = found.withColumn("chars_distance", F.when(F.col("n_chars") >= MIN_CHARS_JUDGED, far).otherwise(zero)).withColumn("words_distance", F.when(F.col("n_words") >= MIN_WORDS_JUDGED, off).otherwise(zero))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("chars_distance") <= MAX_CHARS_DISTANCE) & (F.col("words_distance") <= words_distance))


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Every row with its counts, distances and verdict. Null text: no words, so it fails; a null language gives no reference but is judged.

    Repeated rows each give a row and each count for the references; an empty table gives an empty result.
    """
    bins = common_words(docs, text_column, lang_column)
    found = cut(features(docs, bins, id_column, text_column, lang_column))
    return judge(found, references(found, bins))


def passing(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Three passes over the texts; only word counts move."""
    bins = common_words(docs, text_column, lang_column)
    known = references(features(docs, bins, id_column, text_column, lang_column), bins)
    judged = judge(features(docs, bins, id_column, text_column, lang_column, whole=True), known)
    # The row number keeps the filter above the counts: pushed below, it would compute them all once more.
    return judged.withColumn("__row", F.monotonically_increasing_id()).where("kept AND __row >= 0").select("doc_id.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; an empty table gives an empty result, repeated rows each give a row."""
    return quality(spread(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    def js(counts: str, total: str, ref: str) -> str:
        p, q = f"({counts}[i] / greatest({total}, 1)::DOUBLE)", f"{ref}[i]"
        m = f"(({p} + {q}) / 2)"
        return f"sqrt(greatest(list_sum(list_transform(range(1, len({ref}) + 1), lambda i: CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END)) / 2, 0))"

    return f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t
), often AS (
  SELECT lang, lower(x) AS x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM w WHERE lang IS NOT NULL AND len(w) >= {MIN_WORDS}) WHERE regexp_full_match(lower(x), '\\p{{L}}+') GROUP BY 1, 2
), learned AS (
  SELECT DISTINCT x FROM (SELECT x, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS nth FROM often) WHERE nth <= {COMMON_WORDS}
), bins AS (
  SELECT coalesce(list(x ORDER BY x), []) AS b, coalesce(list_concat(list_concat(list(x), list(upper(x[1:1]) || x[2:])), list(upper(x))), []) AS sp FROM learned
), grams AS (
  SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1
), again AS (
  SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), c AS (
  SELECT w.rid, doc_id, lang, len(w)::BIGINT AS n_words, length(t)::BIGINT AS n,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(again.n, 0)::BIGINT AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) AS up, length(regexp_replace(t, '[\\p{{L}}\\x20\\x09-\\x0D]+', '', 'g')) AS mk,
         length(t) - length(regexp_replace(t, '\\p{{Nd}}+', '', 'g')) AS dg, length(regexp_replace(t, '[^.,;:!?]+', '', 'g')) AS pt,
         list_transform(list_filter(w, lambda x: list_contains(sp, x)), lambda x: lower(x)) AS cw, b
  FROM w CROSS JOIN bins LEFT JOIN again USING (rid)
), f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
         [up, word_chars - mk - up, dg, pt, n_symbols, n - word_chars, mk - dg - pt - n_symbols] AS chars,
         list_append(list_transform(b, lambda y: len(list_filter(cw, lambda x: x = y))::BIGINT), n_words - len(cw)) AS common FROM c
), ra AS (
  SELECT lang, list_transform(a, lambda x: x / list_sum(a)::DOUBLE) AS ra FROM (SELECT lang, list(s ORDER BY i) AS a FROM (SELECT lang, i, sum(chars[i]) AS s FROM f, range(1, {CLASSES + 1}) r(i) WHERE lang IS NOT NULL AND NOT base_failed GROUP BY 1, 2) GROUP BY 1)
), rb AS (
  SELECT lang, list_transform(a, lambda x: x / list_sum(a)::DOUBLE) AS rb FROM (SELECT lang, list(s ORDER BY i) AS a FROM (SELECT lang, i, sum(common[i]) AS s FROM (SELECT lang, common, unnest(range(1, len(common) + 1)) AS i FROM f WHERE lang IS NOT NULL AND NOT base_failed) GROUP BY 1, 2) GROUP BY 1)
), d AS (
  SELECT rid, min({js("chars", "n", "ra")}) AS far, min({js("common", "n_words", "rb")}) AS off FROM f, ra JOIN rb USING (lang) GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (n < {MIN_CHARS_JUDGED} OR coalesce(far, 0) <= {MAX_CHARS_DISTANCE}) AND (n_words < {MIN_WORDS_JUDGED} OR coalesce(off, 0) <= {MAX_WORDS_DISTANCE}) AS kept
FROM f LEFT JOIN d USING (rid)"""


ORACLE_SQL = _oracle()
