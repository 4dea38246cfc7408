"""Token counts: the project's linear estimate, exact in hundredths, and merge tokenizers.

A merge tokenizer keeps the distinct pre-split pieces of a batch as symbol arrays, joins adjacent
symbols with the table of merge ranks, applies the lowest-ranked merges of every piece at once, and
repeats until no pair of any piece has a rank.  The estimate is such a tokenizer too: its symbols are
classes of characters, its merges join the letters of a word, and its symbols have weights.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import regex

# ---- fixed values: hundredths of a token ---------------------------------------------------------
NEWLINE, DIGIT, CJK, OTHER, WORD, MARKED = 164, 140, 51, 63, 109, 101
CJK_RANGES = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))
MARKED_RANGE = (0xC0, 0x1EF9)
# --------------------------------------------------------------------------------------------------

# classes of characters
SPACE_, NEWLINE_, DIGIT_, CJK_, OTHER_, WORD_, MARKED_ = range(7)
_CJK_CLASS = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, from the Unicode properties."""
    out = np.full(0x110000, OTHER_, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for m in regex.finditer(r"[\p{L}\p{N}]+", every):
        lo, hi = ord(m.group()[0]), ord(m.group()[-1])
        if lo < 0xD800 < 0xE000 <= hi:
            out[lo:0xD800] = WORD_
            out[0xE000 : hi + 1] = WORD_
        else:
            out[lo : hi + 1] = WORD_
    for m in regex.finditer(r"\p{White_Space}", every):
        out[ord(m.group())] = SPACE_
    marked = out[MARKED_RANGE[0] : MARKED_RANGE[1] + 1]
    marked[marked == WORD_] = MARKED_
    for a, b in CJK_RANGES:
        out[a : b + 1] = CJK_
    out[ord("0") : ord("9") + 1] = DIGIT_
    out[ord("\n")] = NEWLINE_
    return out


def class_codes(text: str) -> np.ndarray:
    return classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def costs(text: str) -> np.ndarray:
    """Hundredths of a token at each character; a word's cost is at its first character that is no digit."""
    k = class_codes(text)
    out = np.zeros(len(k), np.int64)
    for c, w in ((NEWLINE_, NEWLINE), (DIGIT_, DIGIT), (CJK_, CJK), (OTHER_, OTHER)):
        out[k == c] = w
    run = (k == WORD_) | (k == MARKED_) | (k == DIGIT_)
    if run.any():
        begins = run & ~np.concatenate(([False], run[:-1]))
        number = np.cumsum(begins) - 1  # of the run at each of its characters
        letter = np.flatnonzero((k == WORD_) | (k == MARKED_))
        if len(letter):
            own, first = np.unique(number[letter], return_index=True)
            marked = np.zeros(number[-1] + 1, bool)
            marked[number[k == MARKED_]] = True
            out[letter[first]] += np.where(marked[own], MARKED, WORD)
    return out


def estimate(text: str | None) -> int:
    """Tokens of a text by the estimate; 0 for null and empty texts."""
    return int(-(-int(costs(text).sum()) // 100)) if text else 0


@dataclass
class MergeTokenizer:
    """split: text -> pieces; symbols: piece -> symbol ids; pairs (sorted keys left << 32 | right) with
    rank and result; weights: of the symbols, 1 each if None."""

    split: Callable[[str], list[str]]
    symbols: Callable[[str], list[int]]
    pairs: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    weights: np.ndarray | None = None
    keep: int = 200_000
    seen: dict[str, int] = field(default_factory=dict)

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the distinct pieces after all merges, and the piece of each symbol."""
        arrays = [np.asarray(self.symbols(p), np.int64) for p in pieces]
        sym = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        own = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
        done_sym, done_own = [], []
        never = np.int64(1) << 62
        while len(sym) > 1:
            near = own[1:] == own[:-1]
            key = (sym[:-1] << 32) | sym[1:]
            at = np.searchsorted(self.pairs, key)  # the join of adjacent pairs with the ranks
            at[at == len(self.pairs)] = 0
            hit = near & (self.pairs[at] == key)
            rank = np.where(hit, self.ranks[at], never)
            least = np.full(int(own[-1]) + 1, never)
            np.minimum.at(least, own[:-1], rank)
            go = hit & (rank == least[own[:-1]])
            if not go.any():
                break
            # of overlapping pairs (as in a a a) every second one, from the left
            where = np.flatnonzero(go)
            new_run = np.concatenate(([True], np.diff(where) > 1))
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - start) % 2 == 0]
            sym[where] = self.results[at[where]]
            stay = np.ones(len(sym), bool)
            stay[where + 1] = False
            live = (least < never)[own]  # pieces without any ranked pair are finished
            fin = stay & ~live
            done_sym.append(sym[fin])
            done_own.append(own[fin])
            stay &= live
            sym, own = sym[stay], own[stay]
        done_sym.append(sym)
        done_own.append(own)
        return np.concatenate(done_sym), np.concatenate(done_own)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Weight of the symbols of each text (hundredths for the estimate)."""
        per_text = [self.split(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(p for ps in per_text for p in ps if p not in self.seen))
        for a in range(0, len(fresh), 20_000):
            part = fresh[a : a + 20_000]
            sym, own = self.merge(part)
            w = np.bincount(own, None if self.weights is None else self.weights[sym], len(part)).astype(np.int64)
            self.seen.update(zip(part, w.tolist()))
        out = np.array([sum(map(self.seen.__getitem__, ps)) for ps in per_text], np.int64)
        if len(self.seen) > self.keep:
            self.seen.clear()
        return out


@lru_cache(1)
def estimate_tokenizer() -> MergeTokenizer:
    """The estimate as a merge tokenizer: pieces are words with the digits taken out, single digits,
    CJK characters, other characters and line feeds; letters of a word merge into one symbol, which is
    marked if one of them is."""
    piece = regex.compile(rf"\n|[0-9]|[{_CJK_CLASS}]|[^\p{{L}}\p{{N}}\p{{White_Space}}{_CJK_CLASS}]|[[\p{{L}}\p{{N}}]--[{_CJK_CLASS}]]+", regex.V1)
    mixed = regex.compile(r"[0-9]")

    def split(text: str) -> list[str]:
        out: list[str] = []
        for p in piece.findall(text):
            if len(p) > 1 and mixed.search(p):
                out.extend(mixed.findall(p))
                p = mixed.sub("", p)
            if p:
                out.append(p)
        return out

    of = [(WORD_, WORD_, WORD_), (MARKED_, WORD_, MARKED_), (WORD_, MARKED_, MARKED_), (MARKED_, MARKED_, MARKED_)]
    keys = np.array([(a << 32) | b for a, b, _ in of], np.int64)
    order = np.argsort(keys)
    weights = np.zeros(7, np.int64)
    weights[[NEWLINE_, DIGIT_, CJK_, OTHER_, WORD_, MARKED_]] = NEWLINE, DIGIT, CJK, OTHER, WORD, MARKED
    return MergeTokenizer(split, lambda p: class_codes(p).tolist(), keys[order], order.astype(np.int64), np.array([r for *_, r in of], np.int64)[order], weights)


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; the folder is MARGINALIA_TOKENIZERS or /opt/tokenizers."""
    return os.path.join(os.environ.get("MARGINALIA_TOKENIZERS", "/opt/tokenizers"), name)


def byte_table() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + extra)] = b
            extra += 1
    return table


@lru_cache(2)
def merge_tokenizer(path: str) -> MergeTokenizer:
    """A byte-level BPE of the tokenizers library's format as a merge tokenizer."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
    results = np.array([vocab[a + b] for a, b in merges], np.int64)
    order = np.argsort(keys)
    of_byte = np.zeros(256, np.int64)
    for ch, b in byte_table().items():
        of_byte[b] = vocab[ch]
    pieces = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    return MergeTokenizer(pieces.findall, lambda p: of_byte[np.frombuffer(p.encode(), np.uint8)], keys[order], order.astype(np.int64), results[order])


def tiktoken_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
