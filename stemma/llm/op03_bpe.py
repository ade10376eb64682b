"""BPE encoding and decoding by per-prefix dynamic programming (see ``bpe``).

A map over rows: no shuffle, memory bounded by one run of texts and two word caches of fixed size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .bpe import Bpe
from .common import arrow_map, pieces, spread, table

VOCABULARY = "word_bpe_49k.json"
#: The splitting pattern of this vocabulary; a fixed value of its format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose encodings a task keeps; when full, all are dropped and built again.
CACHE = 250_000


def normalise(text: str) -> str:
    """NFC and lower case, letter by letter: a final sigma is lowered like any other."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


class Encoder:
    """Encodes texts into ids and ids into text, as a word-level BPE vocabulary says."""

    def __init__(self, path: str, cache: int = CACHE):
        self.bpe, self.limit = Bpe(path), cache
        self.find = regex.compile(SPLIT).findall
        special = sorted(self.bpe.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        #: By word: ids as text, tokens as text, and their number.
        self.known: dict[str, tuple[str, str, int]] = {}

    def _word(self, word: str) -> tuple[str, str, int]:
        ids = self.bpe.encode(word.encode())
        if len(self.known) >= self.limit:
            self.known.clear()
        names = self.bpe.names
        made = self.known[word] = (" ".join(map(str, ids)), " ".join([names[i] for i in ids]), len(ids))
        return made

    def _plain(self, text: str) -> list[tuple[str, str, int]]:
        get, word = self.known.get, self._word
        return [get(w) or word(w) for w in self.find(normalise(text))]

    def words(self, text: str) -> list[tuple[str, str, int]]:
        if self.special is None or "<|" not in text:
            return self._plain(text)
        out: list[tuple[str, str, int]] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append((str(self.bpe.special[part]), part, 1))
            elif part:
                out += self._plain(part)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.words(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder, so tokens are joined by one space."""
        return " ".join(self.bpe.names[i] for i in ids)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row encoded and decoded again: ``doc_id, token_ids array<int>, decoded``.

    Null and empty texts: no tokens and an empty text. Repeated rows each give a row; an empty table none. A text of
    any length is encoded whole, in one piece of memory. Other columns are not looked at.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def make():
        encoder = Encoder(path)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, texts in pieces(batch.column(1), 1 << 20):
                found = [encoder.words(t.decode()) for t in texts]
                flat = np.array(" ".join([w[0] for words in found for w in words]).split(), np.int32)
                ends = np.concatenate([[0], np.cumsum([sum([w[2] for w in words]) for words in found])]).astype(np.int32)
                decoded = [" ".join([w[1] for w in words]) for words in found]
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), ids, pa.array(decoded, pa.string())], names=["doc_id", "token_ids", "decoded"])

        return step

    return arrow_map(docs.select(id_column, text_column), make, f"doc_id {kind}, token_ids array<int>, decoded string")


def digest(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The same encoding and decoding, reduced on the way to ``n_tokens, ids_sha256, decoded_sha256``."""
    kind = docs.schema[id_column].dataType.simpleString()

    def make():
        encoder = Encoder(path)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, texts in pieces(batch.column(1)):
                counts, ids, decoded = [], [], []
                for text in texts:
                    words = encoder.words(text.decode())
                    counts.append(sum([w[2] for w in words]))
                    ids.append(sha256(" ".join([w[0] for w in words]).encode()).hexdigest())
                    decoded.append(sha256(" ".join([w[1] for w in words]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return arrow_map(docs.select(id_column, text_column), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``. Empty and null texts: no tokens, hashes of the empty string."""
    return digest(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(VOCABULARY))
