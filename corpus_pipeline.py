"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept, and returns a
DataFrame with the columns of ``documents`` (the last: token ids), which is written as Parquet and read again.
Columns beyond those it reads go through every stage unchanged, whatever their names; an empty table gives an
empty one. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import near_copies, op01_suffix, op02_mix, op03_bpe, op05_quality
from stemma.llm.common import WORD, importable, table, written

#: No SQL: fingerprints, repeated strings, permutations and merges have no SQL form. Tests compare each stage with brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; a null or empty text is rejected. Null languages are judged by all references. Repeated rows share one verdict."""
    del spark, sf_dir
    return op05_quality.passing(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash fingerprints within three bits, or five-word shingles with a similarity of 0.8 or more.

    It is that of the smallest id (null last), then of the smallest content key; of repeated rows one stays. Texts
    without words, null ones among them, are copies of each other.
    """
    del spark, sf_dir
    return near_copies.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 250 bytes that occur twice go from every text, all their copies; a document of which no word is left goes.

    Null and empty texts go, as they have no word. Repeated rows of shorter texts stay, each of them.
    """
    del spark, sf_dir
    return _counted(op01_suffix.stripped(docs, op01_suffix.STAGE_LENGTH).where(F.col("text").rlike(WORD)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and pass that the mixture takes, its text cut to the words taken.

    Texts without words give no row. A null source is a source of its own. Rows of one id and text are
    interchangeable; which is cut is settled by their other columns.
    """
    del spark, sf_dir
    return _counted(op02_mix.mixed_texts(docs))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and what they decode to, as hash. A null text counts as empty; repeated rows each give a row."""
    del spark, sf_dir
    found = op03_bpe.encode(docs, public_tokenizers.path(op03_bpe.VOCABULARY))
    return found.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between two stages is written and read again."""
    docs = table(importable(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
