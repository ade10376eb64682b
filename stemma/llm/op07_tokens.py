"""Token counts by compiled finite-state transducers.

Two deterministic machines run one after the other.

* The *splitter* reads one symbol a character (letter, digit, blank, other white space, apostrophe, ...)
  and annotates each transition with the pre-tokens it begins: at this character, or, where one character
  of look-ahead was needed, at the one before. Texts are cut into chunks of equal length; each chunk is
  run from *every* state at once, which gives its state map, and the maps compose by a parallel prefix
  scan into the state in which each chunk starts.
* The *counter* reads the bytes of a pre-token; its states hold what the prefix dynamic programme must
  remember, its transitions the change in the number of emitted tokens. It is determinised on demand,
  kept under a fixed number of states, and run in lockstep over all distinct pre-tokens of a batch.

A map over rows: no shuffle, tables of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .bpe import Bpe
from .common import arrow_map, mix64, pieces, spread, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 256
MAX_STATES = 40_000
CACHE = 200_000

# Symbols of the splitter.
(STMD, RV, E, L, LETTER, DIGIT, BLANK, SPACE, OTHER, QUOTE, END) = range(11)
# Its states.
(FRESH, IN_L, IN_N, IN_O, BLANK1, SPACE1, BLANKS, SPACES, MARK, MARK_RV, MARK_L) = range(11)
#: A pre-token begins at this character; at the one before.
HERE, BACK = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output by (state, symbol)."""
    goes, says = np.zeros((11, 11), np.uint8), np.zeros((11, 11), np.uint8)
    kind = {s: IN_L for s in (STMD, RV, E, L, LETTER)} | {DIGIT: IN_N, OTHER: IN_O, QUOTE: MARK, BLANK: BLANK1, SPACE: SPACE1}
    for state in range(11):
        for symbol in range(10):
            to, out = kind[symbol], HERE
            white, letter = symbol in (BLANK, SPACE), symbol <= LETTER
            if (state == IN_L and letter) or (state == IN_N and symbol == DIGIT) or (state == IN_O and symbol in (OTHER, QUOTE)):
                to, out = state, 0
            elif state == BLANK1 and not white:
                to, out = (IN_O if symbol == QUOTE else kind[symbol]), 0
            elif state in (BLANK1, SPACE1, BLANKS, SPACES) and white:
                to, out = (BLANKS if symbol == BLANK else SPACES), 0
            elif state == BLANKS:
                to, out = (IN_O if symbol == QUOTE else kind[symbol]), BACK
            elif state == SPACES:
                out = HERE | BACK
            elif state == MARK:
                if symbol == STMD:
                    to, out = FRESH, 0
                elif symbol in (RV, L):
                    to, out = (MARK_RV if symbol == RV else MARK_L), 0
                elif symbol in (OTHER, QUOTE):
                    to, out = IN_O, 0
            elif state in (MARK_RV, MARK_L):
                if symbol == (E if state == MARK_RV else L):
                    to, out = FRESH, 0
                elif letter:
                    to, out = IN_L, BACK
                else:
                    out = HERE | BACK
            goes[state, symbol], says[state, symbol] = to, out
        goes[state, END], says[state, END] = FRESH, BACK if state in (MARK_RV, MARK_L) else 0
    return goes, says


#: White space of the splitting pattern, by code point: fixed values.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def symbols() -> np.ndarray:
    """The splitter's symbol of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, symbol in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT)):
        for m in regex.finditer(pattern, everything):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = symbol  # a run that spans the surrogates can't begin below and end above: none are letters
    out[list(WHITE)] = SPACE
    for c, symbol in ((" ", BLANK), ("'", QUOTE), ("e", E), ("l", L), *((c, STMD) for c in "stmd"), *((c, RV) for c in "rv")):
        out[ord(c)] = symbol
    return out


def split(codes: np.ndarray, ends: np.ndarray, machine: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Where pre-tokens begin (boolean, by character).

    ``codes`` holds the code points of many texts one after another, ``ends`` the index after each text's
    last character, where the array has one spare place for the end symbol.
    """
    table_, goes, says = machine
    n = len(codes)
    chunks = -(-n // CHUNK)
    read = np.full(chunks * CHUNK, END, np.uint8)
    read[:n] = table_[codes]
    read[ends] = END
    read = np.ascontiguousarray(read.reshape(chunks, CHUNK).T)
    # State maps of all chunks, from every state.
    flat = goes.ravel()
    maps = np.broadcast_to((np.arange(11, dtype=np.uint8) * 11)[:, None], (11, chunks)).copy()
    step = flat * np.uint8(11)
    for row in read:
        maps = step[maps + row]
    maps //= 11
    # Inclusive prefix scan: after it, maps[:, k] leads over chunks 0..k.
    reach, k = 1, np.arange(chunks)
    while reach < chunks:
        earlier = maps[:, : chunks - reach].copy()
        maps[:, reach:] = maps[earlier, k[None, reach:]]
        reach *= 2
    state = np.zeros(chunks, np.uint8)
    state[1:] = maps[FRESH, :-1]
    # Now each chunk once, from its true state.
    out = np.empty((CHUNK, chunks), np.uint8)
    spoken, state = says.ravel(), state * np.uint8(11)
    for t, row in enumerate(read):
        at = state + row
        out[t], state = spoken[at], step[at]
    said = out.T.reshape(-1)
    begins = (said & HERE) > 0
    begins[:-1] |= (said[1:] & BACK) > 0
    return begins[:n]


class Counter:
    """The counting transducer over the bytes of a pre-token, determinised on demand.

    A state is the longest suffix read that begins some vocabulary item, and, for every place in it where
    an item may still begin, the last token of the prefix up to there and its count relative to the count
    now. Nothing older can matter. Transitions carry the change of the count.
    """

    def __init__(self, bpe: Bpe, most: int = MAX_STATES):
        self.bpe, self.most = bpe, most
        self.children: list[dict[int, int]] = [{}]
        self.item = [-1]
        for token, i in bpe.whole.items():
            node = 0
            for c in token.encode("latin-1"):
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.item.append(-1)
                node = nxt
            if i not in bpe.dead:
                self.item[node] = i
        self.reset()

    def reset(self) -> None:
        self.goes = np.full((1024, 256), -1, np.int32)
        self.says = np.zeros((1024, 256), np.int16)
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self._state(((0, -1, 0),))

    def _state(self, state: tuple) -> int:
        i = self.ids.get(state)
        if i is None:
            i = self.ids[state] = len(self.states)
            self.states.append(state)
            if i >= len(self.goes):
                self.goes = np.concatenate([self.goes, np.full_like(self.goes, -1)])
                self.says = np.concatenate([self.says, np.zeros_like(self.says)])
        return i

    def compile(self, state: int, byte: int) -> None:
        """One transition: items that end here, the one that fits, and what stays open."""
        open_, last, count = [], -1, 0
        for node, prior, back in self.states[state]:
            node = self.children[node].get(byte)
            if node is None:
                continue
            token = self.item[node]
            if token >= 0 and last < 0 and (prior < 0 or self.bpe.compatible(prior, token)):
                last, count = token, back + 1
            if self.children[node]:
                open_.append((node, prior, back))
        if last < 0:
            raise ValueError("the vocabulary lacks a byte")
        to = self._state((*((node, prior, back - count) for node, prior, back in open_), (0, last, 0)))
        self.goes[state, byte], self.says[state, byte] = to, count

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of every word, all words in lockstep."""
        if len(self.states) > self.most:
            self.reset()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        starts = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - np.fromiter(map(len, words), np.int64, len(words)))[order]
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for t in range(int(sizes[0]) if len(words) else 0):
            live = int(np.searchsorted(-sizes, -t, side="left"))  # words longer than t
            byte = data[starts[:live] + t]
            at = state[:live] * 256 + byte
            to = self.goes.ravel()[at]
            if (missing := to < 0).any():
                for pair in np.unique(at[missing]).tolist():
                    self.compile(*divmod(pair, 256))
                to = self.goes.ravel()[at]
            total[:live] += self.says.ravel()[at]
            state[:live] = to
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out


def same_bytes(data: np.ndarray, at: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> bool:
    """Whether each stretch of ``data`` equals its partner."""
    if not np.array_equal(size, other_size):
        return False
    for k in range(0, len(at), 1 << 16):
        n = size[k : k + (1 << 16)]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(data[np.repeat(at[k : k + (1 << 16)], n) + inner], data[np.repeat(other[k : k + (1 << 16)], n) + inner]):
            return False
    return True


class TokenCounter:
    """Counts the tokens of texts; strings of special tokens count one each."""

    def __init__(self, path: str):
        self.bpe = Bpe(path)
        self.counter = Counter(self.bpe)
        self.machine = (symbols(), *splitter())
        special = sorted(self.bpe.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)).encode()) if special else None
        self.known: dict[bytes, int] = {}

    def counts(self, texts: list[bytes]) -> list[int]:
        out = [0] * len(texts)
        parts, owner = [], []
        for i, text in enumerate(texts):
            cut = [text]
            if self.special is not None and b"<|" in text:
                cut = self.special.split(text)
                out[i] = len(cut) - 1
            for part in cut:
                if part:
                    parts.append(part)
                    owner.append(i)
        if parts:
            for i, n in zip(owner, self._parts(parts), strict=True):
                out[i] += n
        return out

    def _parts(self, parts: list[bytes]) -> list[int]:
        joined = b"\0".join(parts) + b"\0"
        data = np.frombuffer(joined, np.uint8)
        lead = (data & 0xC0) != 0x80
        where = np.flatnonzero(lead)
        codes = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        ends = np.searchsorted(where, stops)
        begins = split(codes, ends, self.machine)
        begins[ends] = True  # the spare place closes a text's last pre-token
        at = where[begins]
        size = np.diff(at, append=len(data))
        real = np.ones(len(at), bool)
        real[np.searchsorted(at, stops)] = False
        at, size = at[real], size[real]
        # Distinct pre-tokens by a polynomial hash of their bytes, which are compared afterwards.
        with np.errstate(over="ignore"):
            base = np.uint64(0x9E3779B97F4A7C15)
            powers = np.cumprod(np.full(len(data) + 1, base, np.uint64))
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=total[1:])
            # Hashes are brought to one common power: that of the end of the batch.
            h = mix64((total[at + size] - total[at]) * powers[len(data) - at] + size.astype(np.uint64))
        del powers, total
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if not same_bytes(data, at, size, at[first][inverse], size[first][inverse]):
            names = [joined[a : a + n] for a, n in zip(at.tolist(), size.tolist(), strict=True)]
            number = {w: i for i, w in enumerate(dict.fromkeys(names))}
            inverse = np.fromiter((number[w] for w in names), np.int64, len(names))
            first = np.unique(inverse, return_index=True)[1]
        words = [joined[a : a + n] for a, n in zip(at[first].tolist(), size[first].tolist(), strict=True)]
        known = self.known
        counts = [known.get(w, -1) for w in words]
        if new := [i for i, n in enumerate(counts) if n < 0]:
            if len(known) + len(new) > CACHE:
                known.clear()
            for i, n in zip(new, self.counter.count([words[i] for i in new]).tolist(), strict=True):
                counts[i] = n
                if len(known) < CACHE:
                    known[words[i]] = n
        per = np.array(counts, np.int64)[inverse]
        sums = np.concatenate([[0], np.cumsum(per)])
        edge = np.searchsorted(at, np.concatenate([[0], stops]))
        return (sums[edge[1:]] - sums[edge[:-1]]).tolist()


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row. Null and empty texts: zeros and false."""
    kind = docs.schema[id_column].dataType.simpleString()

    def make():
        counter = TokenCounter(path)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, texts in pieces(batch.column(1), 4 << 20):
                n = pa.array(counter.counts(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(list(map(len, texts)), pa.int64()), n, pa.array([x > limit for x in n.to_pylist()])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return step

    return arrow_map(docs.select(id_column, text_column), make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``; a null text counts as empty, repeated rows each give a row."""
    return count_tokens(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(VOCABULARY))
