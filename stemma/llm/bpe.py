"""Byte-pair encoding by dynamic programming over prefixes.

Greedy merging has a useful property: the encoding of every prefix of a string ends in exactly one
token, and that token follows from two local facts: it is a vocabulary item that ends there, and it may
stand beside the last token of the prefix before it. So one pass with an automaton that lists all
vocabulary items ending at each position, and a test on token pairs, gives the merge result without
running any merges.

Atoms are byte values as code points; where the vocabulary marks the end of a word, the last byte of a
word is the atom ``byte + 256``.
"""

from __future__ import annotations

import json

import ahocorasick


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A compiled vocabulary. ``encode`` takes the bytes of one pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        end = model.get("end_of_word_suffix") or ""
        self.word_end = bool(end)

        def atoms(token: str) -> str:
            closed = bool(end) and token.endswith(end)
            body = [letters[c] for c in (token[: -len(end)] if closed else token)]
            if closed:
                body[-1] += 256
            return "".join(map(chr, body))

        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        spelled = {t: atoms(t) for t in model["vocab"]}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made, pair_ids = model["vocab"][left + right], (model["vocab"][left], model["vocab"][right])
            self.merge.setdefault(pair_ids, (r, made))
            if made not in self.rank:
                self.rank[made], self.parts[made] = r, pair_ids
        self.whole = {a: model["vocab"][t] for t, a in spelled.items()}
        self.length = [0] * (max(self.names) + 1)
        for a, i in self.whole.items():
            self.length[i] = len(a)
        self.beside: dict[int, bool] = {}
        # An item that its own spelling does not encode to is never emitted, so it is left out.
        self.dead: set[int] = set()
        self._build()
        self.dead = {i for a, i in self.whole.items() if len(a) > 1 and self._path(a) != [i]}
        if self.dead:
            self._build()

    def _build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for a, i in self.whole.items():
            if i not in self.dead:
                self.automaton.add_word(a, i)
        self.automaton.make_automaton()

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border when ``left`` and ``right`` stand side by side.

        Both tokens are unfolded backwards in merge order. The border breaks if the two pieces that touch
        it merge before the later of them was swallowed by its own parent.
        """
        key = left << 20 | right
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            known = self.beside[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        rank, parts, merge = self.rank, self.parts, self.merge
        # When each piece beside the border is swallowed by its parent; at equal rank the left one goes first.
        until_left = until_right = 1 << 60
        while True:
            found = merge.get((left, right))
            if found and found[0] < until_left and found[0] <= until_right:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a >= b:
                until_left, left = a, parts[left][1]
            else:
                until_right, right = b, parts[right][0]

    def _path(self, text: str) -> list[int]:
        n, length, known = len(text), self.length, self.beside.get
        last = [-1] * n
        for at, token in self.automaton.iter(text):
            if last[at] >= 0:
                continue
            before = at - length[token]
            if before < 0:
                last[at] = token
            elif (prior := last[before]) >= 0:
                fits = known(prior << 20 | token)
                if self.compatible(prior, token) if fits is None else fits:
                    last[at] = token
        out, at = [], n - 1
        while at >= 0:
            token = last[at]
            if token < 0:
                raise ValueError("the vocabulary lacks a byte of this text")
            out.append(token)
            at -= length[token]
        return out[::-1]

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-token."""
        if not word:
            return []
        if self.word_end:
            return self._path(word[:-1].decode("latin-1") + chr(word[-1] + 256))
        return self._path(word.decode("latin-1"))
