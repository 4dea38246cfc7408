"""Splitting texts above a token limit at natural boundaries.

Prefix sums of the estimate over all characters, and one sorted array of boundaries (headings,
paragraphs, lines, sentences, words) per level.  A piece ends at the last boundary below the limit that
a binary search finds, the strongest level in the second half of the piece first; the next piece begins
at the first boundary from which no more than the overlap is shared, at a word where none of the others is near
enough.  A stretch without any boundary is
cut at the last character below the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from marginalia.llm.sentences import sentence_spans
from marginalia.llm.tokens import DIGIT, DIGIT_, MARKED, MARKED_, WORD, WORD_, class_codes, costs
from marginalia.tables import current_rows, filled, spread

LIMIT, OVERLAP = 450, 40
LEVELS = ("heading", "paragraph", "line", "sentence", "word", "hard")
_HEADING = regex.compile(r"(?m)^[ \t]{0,3}#{1,6}(?=[ \t])")
_BLANKS = regex.compile(r"\s+")
_NEWLINES = regex.compile(r"\r\n|\n|\r")
_LINE = regex.compile(r"(?:\r\n|\n|\r)")


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    tokens: int
    shared: int  # tokens shared with the piece before
    cut: str  # what its end is


class _Costs:
    """Hundredths of any stretch of a text in constant time, also where it begins or ends inside a word."""

    def __init__(self, text: str, each: np.ndarray | None = None) -> None:
        self.prefix = np.concatenate(([0], np.cumsum(costs(text) if each is None else each)))
        k = class_codes(text)
        letter = (k == WORD_) | (k == MARKED_)
        run = letter | (k == DIGIT_)
        n = len(k)
        inside = np.concatenate(([False], run[1:] & run[:-1], [False])) if n else np.zeros(1, bool)
        at = np.arange(n + 1)
        self.inside = inside
        self.begin = np.maximum.accumulate(np.where(inside, -1, at))  # where the run around a position begins and ends
        self.end = np.minimum.accumulate(np.where(inside, n, at)[::-1])[::-1]
        self.digits, self.letters, self.marked = (np.concatenate(([0], np.cumsum(x))) for x in (k == DIGIT_, letter, k == MARKED_))

    def _part(self, a: int, b: int) -> int:
        """Of a part of one run."""
        word = 0 if self.letters[a] == self.letters[b] else WORD if self.marked[a] == self.marked[b] else MARKED
        return DIGIT * int(self.digits[b] - self.digits[a]) + word

    def __call__(self, a: int, b: int) -> int:
        if a >= b:
            return 0
        e, s = int(self.end[a]) if self.inside[a] else a, int(self.begin[b]) if self.inside[b] else b
        if e > s:
            return self._part(a, b)
        return self._part(a, e) + int(self.prefix[s] - self.prefix[e]) + self._part(s, b)


def boundaries(text: str, sentences: bool = True) -> list[np.ndarray]:
    """Sorted positions of each level but the last; no level holds 0 or the end."""
    n = len(text)
    heading = [m.start() for m in _HEADING.finditer(text)]
    paragraph = [m.end() for m in _BLANKS.finditer(text) if len(_NEWLINES.findall(m.group())) > 1]
    line = [m.end() for m in _LINE.finditer(text)]
    sentence = [s for s, _ in sentence_spans(text)] if sentences else []
    k = class_codes(text)
    run = (k == WORD_) | (k == MARKED_) | (k == DIGIT_)
    word = np.flatnonzero(~(run[1:] & run[:-1])) + 1 if n > 1 else np.zeros(0, np.int64)
    out = []
    for x in (heading, paragraph, line, sentence, word):
        a = np.unique(np.asarray(x, np.int64))
        out.append(a[(a > 0) & (a < n)])
    return out


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[Piece]:
    """Pieces of a text; none for null and empty texts, one for a text within the limit.

    Every character is in a piece, no piece has more than `limit` tokens, and neighbours share at most
    `overlap` tokens.  `overlap` must be below `limit`, and `limit` at least 2 (the dearest character).
    """
    if limit < 2 or not 0 <= overlap < limit:
        raise ValueError("limit must be at least 2 and overlap below it")
    if not text:
        return []
    each = costs(text)
    whole = int(each.sum())
    n, most, share = len(text), limit * 100, overlap * 100
    if whole <= most:
        return [Piece(0, n, -(-whole // 100), 0, "end")]
    cost = _Costs(text, each)
    prefix = cost.prefix
    levels = boundaries(text)
    out: list[Piece] = []
    start, before = 0, 0
    while True:
        if cost(start, n) <= most:
            end, cut = n, "end"
        else:
            reach = int(np.searchsorted(prefix, prefix[start] + most, "right")) - 1  # the last position within the limit
            reach = min(max(reach, start + 1), n - 1)
            while reach > start + 1 and cost(start, reach) > most:
                reach -= 1
            half = int(np.searchsorted(prefix, prefix[start] + most // 2))
            end, cut = -1, ""
            for floor in (max(half, before), before):
                for name, at in zip(LEVELS, levels):
                    if floor == before and name != LEVELS[0] and end > 0:
                        break
                    if name == "word" and floor != before:
                        continue
                    j = int(np.searchsorted(at, reach, "right")) - 1
                    if j >= 0 and at[j] > max(floor, start, before):
                        end, cut = int(at[j]), name
                        break
                if end > 0:
                    break
            if end < 0:
                end, cut = reach, "hard"
        shared = cost(start, before) if out else 0
        out.append(Piece(start, end, int(-(-cost(start, end) // 100)), int(-(-shared // 100)), cut))
        if end == n:
            return out
        # step back by the overlap: to the first boundary from which at most `share` is repeated
        back = int(np.searchsorted(prefix, prefix[end] - share))
        nxt = end
        for name, at in zip(LEVELS, levels):
            if name == "word" and nxt < end and cut != "hard":
                break  # words only where nothing larger fits the overlap
            j = int(np.searchsorted(at, max(back, start + 1)))
            if j < len(at) and at[j] < end and cost(int(at[j]), end) <= share:
                nxt = min(nxt, int(at[j]))
        before = end
        start = nxt


def pieces(docs: DataFrame, text: str = "text", key: str = "id", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, only_oversized: bool = True) -> DataFrame:
    """Pieces of every text above the limit: key, piece_no, start_pos, end_pos, tokens, shared_tokens, cut, n_pieces, text.

    Texts that are null or blank have no pieces; so have texts within the limit, unless `only_oversized`
    is false, when they are one piece each.  Repeated keys are split each on their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                got = split_text(t, limit, overlap)
                if len(got) > 1 or not only_oversized:
                    rows.extend((k, i, p.start, p.end, p.tokens, p.shared, p.cut, len(got), t[p.start : p.end] if with_text else None) for i, p in enumerate(got))
            yield pd.DataFrame(rows, columns=["k", "piece_no", "start_pos", "end_pos", "tokens", "shared_tokens", "cut", "n_pieces", "text"])

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.filter(filled(docs[text])).select(docs[key].alias("k"), docs[text].alias("t"))
    out = spread(slim).mapInPandas(run, f"k {kind}, piece_no int, start_pos int, end_pos int, tokens int, shared_tokens int, cut string, n_pieces int, text string")
    out = out.withColumnRenamed("k", key)
    return out if with_text else out.drop("text")


def current_pieces(docs: DataFrame, **options) -> DataFrame:
    """Pieces of the current row of each id."""
    return pieces(current_rows(docs, "id", "text"), **options)
