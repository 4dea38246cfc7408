"""Per-document text statistics, and by them whether a text is prose, a list, a table or junk.

The statistics of a batch are worked out together: every character gets a class, and counts of documents
and lines are differences of cumulative sums over the classes.  The kind follows from them in three steps.

1. Rows: neighbouring lines whose delimiters agree in number, stand at the same offsets, or (one delimiter
   a line) whose lengths recur; cells must be short and the rows no sentences.
2. Junk: shares of damaged, encoded, random, symbol-only and repeated characters.
3. The rest is cut into stretches.  A stretch is an entry or a sentence by a linear score of its size in
   words, its final mark, its share of common words and its separators, against a threshold that the layout
   moves: recurring line lengths, periodic indentation, evenly short lines and missing final marks raise it for
   lines that stand by themselves.  The text is of the kind that most of its characters are of.

Common words are function words of twelve languages and grammatical endings of Japanese, Chinese and Korean;
no word of any subject is listed.  A language without listed words is judged by the other signals.

Defined results: null, empty and blank texts have no kind and zero counts.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.tables import spread

# ---- fixed values: function words by language ----------------------------------------------------
COMMON = {
    "en": "the a and or of to in is are was be it that for with on at by not no yes who what if when",
    "vi": "là và của các một không được cho với trong khi nếu đã phải này thì la va cua mot khong duoc cho voi khi neu",
    "fr": "le la les un une des et ou est sont a dans pour pas que qui oui non si du",
    "de": "der die das den ein eine und oder ist sind nicht mit auf von zu im wer wenn ja nein",
    "es": "el los las una y o es son en con por para se del sí",
    "it": "il gli di che è e non per con sono della nel si al",
    "pt": "os as um uma é são em não com mas do da no se ao",
    "nl": "het een en van niet met op voor zijn dat aan bij wordt",
    "pl": "i w z na nie się że jest są do po jak od przez",
    "ru": "и в не на с что по это как из у за от для к но",
    "tr": "ve bir bu için ile da de çok ne olarak",
    "ar": "في من على إلى أن لا ما هذا هذه التي الذي مع عن",
}
#: Chinese function words; particles before a Japanese predicate; endings of Korean words.
COMMON_ZH = "的|了|是|在|不|把|被|请|要|会|有|就|都|与|或|从|到|对|将|也|没|可以|吗|谁|为"
COMMON_JA = "[はがをにでへもと](?=[^ぁ-ん\\s]|[^はがをにでへもと][ぁ-ん])|ます|です|ない|した"
COMMON_KO = "[은는을를](?=\\s)|에서?(?=\\s)|[다요까](?=[.!?…\"'”」)]*\\Z)"
#: Weights of the score of a stretch.
SIZE, FINAL, ASKED, SHARED, PARTED, BASE = 0.25, 1.0, 0.5, 0.9, 1.5, 2.0
#: How far the layout can move the threshold, and what several final marks in one line add.
LAYOUT, RUNNING = 0.6, 0.5
# --------------------------------------------------------------------------------------------------
FEATURES = (
    "n_chars", "n_words", "mean_word_length", "n_lines", "symbol_ratio", "digit_ratio", "punctuated_line_share", "common_word_share", "bullet_line_share",
    "short_line_share", "duplicate_line_share", "delimiter_alignment", "indent_periodicity", "length_autocorrelation", "compressibility",
)
KINDS = ("prose", "list", "table", "junk")

_rx = lru_cache(None)(regex.compile)
_COMMON = frozenset(w for words in COMMON.values() for w in words.split())
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_BREAK = regex.compile(r"\r\n|[\r\x0b\x0c\x85\u2028\u2029]")
_CJK = regex.compile(r"[぀-ヿ㐀-䶿一-鿿\uF900-\uFAFFｦ-ﾟ]")
_KANA = regex.compile(r"[ぁ-ん]")
_HANGUL = regex.compile(r"[가-힯]")
_LETTER = regex.compile(r"\p{L}")
_ZH, _JA, _KO = regex.compile(COMMON_ZH), regex.compile(COMMON_JA), regex.compile(COMMON_KO)
_CODE = regex.compile(r"(?<![A-Za-z0-9])[A-Z]{1,4}-?[A-Z]?[0-9][A-Za-z0-9-]*")
_MARK = regex.compile(r"[ \t　]*(?:[-*+•‣◦–—][ \t]+(?:\[[ xX]?\][ \t]*)?|・[ \t]*|\(?\d{1,3}[.)）．、][ \t　]*|\(?[a-zA-Z][.)][ \t]+|[①-⑳][ \t]*|\[[ xX]?\][ \t]+|[☐☑✓✔▪●○■□][ \t]*)")
_LINK = regex.compile(r"\[([^\[\]\n]*+)\]\([^()\n]*+\)")
_CONTROL = regex.compile(r"<\|[^|>\s]*+\|>|[\p{So}\u200D\uFE0F]+\s*\Z")
_URL = regex.compile(r"(?i)<?https?://[!-;=?-~]+>?|(?<![a-z0-9_.+-])[a-z0-9_.+-]++@[a-z0-9-]+(?:\.[a-z0-9-]+)+")
_FINALS, _ASKS, _CLOSERS = frozenset(".!?…。！？｡．\u061F\u0964\u17D4"), frozenset("!?！？\u061F"), "\"'\u201D\u2019\u00BB\u00AB\u201C\u300D\u300F\uFF09)]"
_PARTS = frozenset("/|·»›")
_HEAD = regex.compile(r"[ \t]*#{1,6}\s")
_PART = regex.compile(r"(?<!\s)\s+[·|»›→/–—•>~]+\s+|[,;、，；|•·]\s*|\t+|／")
_STRETCH = regex.compile(r"(?:[。！？｡؟។]|[.!?…]+(?=[\"'”’»」』）)\]]*(?:\s|\Z)))[.!?…。！？｡]*[\"'”’»」』）)\]]*")
_MOJI = regex.compile(r"[\u00C2-\u00F4][\u0080-\u00BF\u0152\u0153\u0160\u0161\u0178\u017D\u017E\u0192\u02C6\u02DC\u2013-\u203A\u20AC\u2122\uFFFD]")
_MOJI_SECOND = np.array([0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E, 0x192, 0x2C6, 0x2DC, 0x20AC, 0x2122, 0xFFFD], np.uint32)
_DAMAGE = regex.compile(r"[\uFFFD\u0080-\u009F\u0000-\u0008\u000E-\u001F\p{Co}\p{Cn}]")
_ENCODED = regex.compile(r"(?:[A-Za-z0-9+/_-]{28,}={0,2})|(?:\b[0-9a-fA-F]{4}\b[ \t]*){4,}|(?:\b[0-9a-fA-F]{2}\b[ \t:]*){8,}|(?:%[0-9A-Fa-f]{2}){3,}|(?:\\[ux][0-9A-Fa-f]{2,4}){3,}")
_TAG = regex.compile(r"</?[A-Za-z][^<>\n]*+>|&(?:#\d+|[a-z]+);|<!--.*?-->", regex.S)
_LOG = regex.compile(
    r"^\W*(?:\d{4}-\d\d-\d\d[T ])?\d{1,2}:\d\d:\d\d(?:[.,]\d+)?\b.*(?:\[|\b(?:DEBUG|INFO|WARN|ERR|ERROR|TRACE|FATAL)\b|0x[0-9a-f]+|=)|^\s*at [\w.$<>]+\(|^\s*File \"|^Traceback|^\s*(?:GET|POST|PUT) /|\b0x[0-9a-fA-F]{6,}\b.*=|"
    r"^\s*[{}\[\]();]+,?\s*$|^\s*\"[\w-]+\"\s*:|^\s*[.#]?[\w-]+\s*\{|^\s*(?:var|let|const|function|import|return|if|for)\b.*[;{]\s*$"
)
_LOG_HINT = regex.compile(r"\d:\d\d:\d\d|0x[0-9a-fA-F]|[{}\"]|\bat |Traceback|(?:GET|POST|PUT) /|^\s*[\[\]();]+,?\s*$|;\s*$", regex.M)
_ODD_IN_WORD = regex.compile(r"(?<=[\p{Latin}\p{M}])[{}|¦~#!;^\\<>$%@*=+_0-9&](?=\p{Latin})|(?<=[぀-ヿ一-鿿가-힯])[{}|¦~#!;^\\<>$@*=](?=[぀-ヿ一-鿿가-힯\s]|\Z)|(?<=\s|^)[{}|¦~#;^\\](?=[\p{L}])")
_REAL = regex.compile(r"[\p{L}\p{M}'’]{3,}[.,;:!?]?")


# -- statistics of a batch -------------------------------------------------------------------------


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each character of the basic plane: 1 letter, 2 mark, 3 decimal digit, 4 other number, 5 symbol or
    punctuation, 6 white space, 0 other; 8 more for final marks, 16 more for what closes behind them."""
    first = {"L": 1, "M": 2, "N": 4, "S": 5, "P": 5}
    out = np.zeros(0x10000, np.uint8)
    for k in range(0x10000):
        c = chr(k)
        cat = unicodedata.category(c)
        out[k] = 6 if c.isspace() and not 0x1C <= k <= 0x1F else 3 if cat == "Nd" else first.get(cat[0], 0)
    for c in ".!?…。！？｡．؟।។":
        out[ord(c)] |= 8
    for c in "\"'”’»«“」』）)]":
        out[ord(c)] |= 16
    return out


def _class_of(cp: np.ndarray) -> np.ndarray:
    table = _classes()
    out = table[np.minimum(cp, 0xFFFF)]
    for k in np.unique(cp[cp > 0xFFFF]):
        cat = unicodedata.category(chr(k))
        out[cp == k] = 3 if cat == "Nd" else {"L": 1, "M": 2, "N": 4, "S": 5, "P": 5}.get(cat[0], 0)
    return out


def _autocorrelation(x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Greatest autocorrelation of lags 1 to 3 of the values of each of n documents (`of`: ascending); 1 where all
    values are equal, 0 below four values."""
    count = np.bincount(of, minlength=n)
    d = x - (np.bincount(of, x, n) / np.maximum(1, count))[of]
    v = np.bincount(of, d * d, n)
    best = np.full(n, -1.0)
    for k in (1, 2, 3):
        same = of[k:] == of[:-k]
        best = np.maximum(best, np.bincount(of[k:][same], (d[k:] * d[:-k])[same], n) / np.where(v > 1e-9, v, 1))
    return np.where(count < 4, 0.0, np.where(v <= 1e-9, 1.0, best))


def profiles(texts: list[str | None], sizes: list[int]) -> tuple[pd.DataFrame, list[list[str]], list[list[bool]]]:
    """FEATURES of each text (composed; sizes are those of the texts as stored), its lines that aren't blank, and
    which of them are rows."""
    n = len(texts)
    flat = [_BREAK.sub("\n", t) if t and not t.isprintable() else (t or "") for t in texts]
    lens = np.fromiter((len(t) + 1 for t in flat), np.int64, n)
    cp = np.frombuffer(("\n".join(flat) + "\n").encode("utf-32-le", "replace"), np.uint32)
    raw = _class_of(cp)
    cls = raw & 7
    ends = np.cumsum(lens)
    starts = ends - lens

    def total(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(hit)])
        return c[b] - c[a]

    word = (cls >= 1) & (cls <= 4)
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    n_words, in_words = total(opens, starts, ends), total(word, starts, ends)
    size = np.array(sizes, np.int64)
    # lines
    l1 = np.flatnonzero(cp == 10)
    l0 = np.concatenate([[0], l1[:-1] + 1])
    doc = np.searchsorted(ends, l1, side="right")
    solid = np.flatnonzero(cls != 6)
    a, b = np.searchsorted(solid, l0), np.searchsorted(solid, l1)
    full = b > a
    l0, l1, doc, a, b = l0[full], l1[full], doc[full], a[full], b[full]
    first, last = (solid[a], solid[b - 1]) if len(a) else (a, a)
    inner = np.flatnonzero((cls != 6) & (raw & 16 == 0))  # without white space and closing marks
    at = np.searchsorted(inner, l1) - 1
    final = np.zeros(len(l0), bool)
    if len(inner):
        final = (raw[inner[np.maximum(at, 0)]] & 8 > 0) & (at >= 0) & (inner[np.maximum(at, 0)] >= l0)
    n_lines = np.bincount(doc, minlength=n)
    joined = "\n".join(flat) + "\n"
    lines: list[list[str]] = [[] for _ in range(n)]
    for k, i, j in zip(doc.tolist(), l0.tolist(), l1.tolist()):
        lines[k].append(joined[i:j])
    marked = np.fromiter((bool(_MARK.match(x)) for own in lines for x in own), bool, len(l0))
    width = (last - first + 1).astype(float)
    indent = (first - l0 + 2 * marked).astype(float)
    k_ = np.maximum(1, n_lines)
    # rows are looked for where delimiters or gaps come in two lines or more
    delimited = np.isin(cp, [ord(c) for c in "|\t;,"])
    gap = np.zeros(len(cp), bool)
    gap[1:] = (cp[1:] == 32) & (cp[:-1] == 32) | (cp[1:] == 0x3000)
    nxt = np.append(cp[1:], 32)
    moji = (cp >= 0xC2) & (cp <= 0xF4) & ((nxt >= 0x80) & (nxt <= 0xBF) | np.isin(nxt, _MOJI_SECOND) | (nxt >= 0x2013) & (nxt <= 0x203A))
    out_of_place = (cp == 0xFFFD) | (cp >= 0x80) & (cp <= 0x9F) | (cls == 0) & (cp != 0x200D)
    cand = np.bincount(doc, (total(delimited | gap, l0, l1) > 0), n) if len(l0) else np.zeros(n)
    length_ac = _autocorrelation(width, doc, n) if len(l0) else np.zeros(n)
    rows = [table_lines(own) if c >= 2 else [False] * len(own) for own, c in zip(lines, cand.tolist())]
    common, dup, packed = np.zeros(n), np.zeros(n), np.zeros(n)
    for k, t in enumerate(flat):
        if n_lines[k]:
            common[k] = sum(w in _COMMON for w in _WORD.findall(t.lower()))
            dup[k] = 1 - len({x.strip() for x in lines[k]}) / len(lines[k])
            data = t.encode("utf-8", "replace")
            packed[k] = len(zlib.compress(data, 6)) / len(data)
    some = n_lines > 0
    d_ = np.maximum(1, size)
    out = pd.DataFrame({
        "n_chars": size, "n_words": np.where(some, n_words, 0), "mean_word_length": np.where(n_words > 0, in_words / np.maximum(1, n_words), 0.0), "n_lines": n_lines,
        "symbol_ratio": np.where(some, total(cls == 5, starts, ends) / d_, 0.0), "digit_ratio": np.where(some, total(cls == 3, starts, ends) / d_, 0.0),
        "punctuated_line_share": np.bincount(doc, final, n) / k_, "common_word_share": np.where(n_words > 0, common / np.maximum(1, n_words), 0.0),
        "bullet_line_share": np.bincount(doc, marked, n) / k_, "short_line_share": np.bincount(doc, width <= 30, n) / k_, "duplicate_line_share": dup,
        "delimiter_alignment": np.fromiter((sum(r) / len(r) if r else 0.0 for r in rows), float, n),
        "indent_periodicity": _autocorrelation(indent, doc, n) if len(l0) else np.zeros(n), "length_autocorrelation": length_ac, "compressibility": packed,
    })
    for c in out.columns[4:]:
        out[c] = np.floor(out[c] * 1e4 + 0.5) / 1e4
    out["mean_word_length"] = np.floor(out["mean_word_length"] * 1e4 + 0.5) / 1e4
    # how even the lines are: what regular layout, used below, is made of besides the features
    mean = np.bincount(doc, width, n) / k_
    out["_even"] = 1 - np.minimum(1, np.sqrt(np.bincount(doc, (width - mean[doc]) ** 2, n) / k_) / np.maximum(1, mean))
    out["_damaged"] = total(moji | out_of_place, starts, ends)
    out["_letters"] = total(cls == 1, starts, ends)
    out["_solid"] = total(cls != 6, starts, ends)
    out["_finals"] = total((raw & 8 > 0) & (np.append(cls[1:] == 6, True) | (cp >= 0x3002)), starts, ends)
    out["_parted"] = total(np.isin(cp, [ord(c) for c in ",;|·•、，；／"]), starts, ends) / np.maximum(1, n_words)
    kana = (cp >= 0x3041) & (cp <= 0x3096)
    out["_hiragana"] = total(kana, starts, ends) / np.maximum(20, total(kana | (cp >= 0x30A1) & (cp <= 0x30FA) | (cp >= 0x3400) & (cp <= 0x9FFF), starts, ends))
    return out, lines, rows


# -- rows ------------------------------------------------------------------------------------------


def _last(s: str) -> str:
    """The last character before closing marks and white space; '' if there is none."""
    return s.rstrip().rstrip(_CLOSERS)[-1:]


def _runs(ok: list[bool]) -> Iterator[tuple[int, int]]:
    k, n = 0, len(ok)
    while k < n:
        if ok[k]:
            end = k
            while end < n and ok[end]:
                end += 1
            yield k, end
            k = end
        else:
            k += 1


def _told(rows: list[str]) -> float:
    """Share of rows that read as sentences."""
    return sum(_last(r) in _FINALS and score(r) > 0 for r in rows) / len(rows)


def _lag(x: list[int]) -> float:
    return float(_autocorrelation(np.array(x, float), np.zeros(len(x), np.int64), 1)[0])


def table_lines(lines: list[str]) -> list[bool]:
    """Lines whose cells stand under each other: the same number of a delimiter, or gaps at the same offsets,
    in at least three lines on end (two behind a rule of dashes)."""
    n = len(lines)
    out = [False] * n
    for d in ("|", "\t", ";", ","):
        counts = [x.count(d) for x in lines]
        least, slack, k = (1 if d == "\t" else 2), (1 if d == "|" else 0), 0
        while k < n:
            if counts[k] < least:
                k += 1
                continue
            end = k
            while end < n and abs(counts[end] - counts[k]) <= slack:
                end += 1
            rows = lines[k:end]
            if end - k >= 3 or (d == "|" and end - k >= 2 and any("--" in r for r in rows)):
                cells = [x.strip() for r in rows for x in r.split(d)]
                glued = d != "," or sum(", " in r for r in rows) < 0.5 * len(rows)
                if glued and sum(len(x) <= 40 for x in cells) > 0.9 * len(cells) and (d not in ",;" or _told(rows) < 0.3):
                    out[k:end] = [True] * (end - k)
            k = max(end, k + 1)
    # two columns: one delimiter a line, where it has no blanks beside it, or its offsets or the lines' lengths recur
    for d in ("|", ";", ","):
        for k, end in _runs([x.count(d) == 1 and not o for x, o in zip(lines, out)]):
            rows = lines[k:end]
            if len(rows) < 3:
                continue
            same = Counter(r.index(d) for r in rows).most_common(1)[0][1] >= 0.5 * len(rows)
            spaced = sum(d + " " in r for r in rows) / len(rows)
            glued = d != "," and sum(" " + d in r or d + " " in r for r in rows) < 0.5 * len(rows)
            if same or glued or _lag([len(r) for r in rows]) >= 0.5:
                cells = [x.strip() for r in rows for x in r.split(d)]
                if sum(0 < len(x) <= 40 for x in cells) > 0.9 * len(cells) and _told(rows) < 0.3 and (d == "|" or spaced < 0.5):
                    out[k:end] = [True] * len(rows)
    # columns parted by runs of blanks
    for k, end in _runs([not o and ("  " in (t := x.strip()) or "　" in t) for x, o in zip(lines, out)]):
        rows = [lines[i] for i in range(k, end)]
        if len(rows) < 3:
            continue
        most, hits = Counter(len(_rx(r" {2,}|　+").split(r.strip())) for r in rows).most_common(1)[0]
        ends = Counter(m.start() for r in rows for m in _rx(r"(?<=\S {2,})\S").finditer(r))
        aligned = max(ends.values(), default=0) >= 0.5 * len(rows)
        if (aligned or (most >= 3 and hits >= 0.5 * len(rows))) and _told(rows) < 0.3:
            out[k:end] = [True] * len(rows)
    return out


# -- junk ------------------------------------------------------------------------------------------


def _repeat_share(text: str, lines: list[str], packed: float) -> float:
    """Share of characters in lines, stretches or words that come again and again, or in one unit of any length
    over and over (the period is the first that most characters agree with; looked for only where the text packs to
    about a third, as such a text does)."""
    whole = sum(map(len, lines)) or 1
    best = 0.0
    if len(lines) >= 4:
        best = max(best, sum(len(k) * n for k, n in Counter(x.strip() for x in lines).items() if n >= 4) / whole)
    units = [x.strip() for x in stretches("\n".join(lines))]
    if len(units) >= 4:
        best = max(best, sum(len(k) * n for k, n in Counter(units).items() if n >= 4) / whole)
    words = text.split()
    if len(words) >= 8:
        k, n = Counter(words).most_common(1)[0]
        if n > 0.5 * len(words):
            best = max(best, n * len(k) / max(1, sum(map(len, words))))
        # a phrase over and over: the distance at which the rarest of the most frequent words comes again
        at = [i for i, w in enumerate(words) if w == words[0]]
        for p in {j - i for i, j in zip(at, at[1:])}:
            if len(words) >= 4 * p and sum(x == y for x, y in zip(words, words[p:])) > 0.9 * (len(words) - p):
                best = 1.0
    body = text.strip()
    for run in _rx(r"(?s)(.{1,12}?)\1{9,}").finditer(body):
        if run[1].strip() and not _rx(r"[-=_*|:.\s]+").fullmatch(run[1]):
            best = max(best, len(run.group()) / max(1, len(body)))
    if best < 0.6 and packed < 0.35 and len(body) >= 40:  # longer units: the smallest shift under which the text is nearly itself
        cp = np.frombuffer(body.encode("utf-32-le", "replace"), np.uint32)
        for p in np.flatnonzero(cp[1 : len(cp) // 4 + 1] == cp[0]) + 1:
            if (cp[p : 2 * p] == cp[:p]).mean() > 0.9 and (cp[p:] == cp[:-p]).mean() > 0.95:
                return 1.0
    return best


@lru_cache(50_000)
def _odd_word(w: str) -> bool:
    """A Latin word that nobody wrote: no vowel, or long runs of consonants."""
    if len(w) < 3 or not w.isalpha() or w.isupper():
        return False
    b = "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c)).replace("đ", "d").replace("ł", "l").replace("ı", "i")
    if not _rx(r"[a-zßøæœþð]+").fullmatch(b):
        return False
    b = _rx(r"szcz|sch|sz|cz|rz|dz|ch|ck|th|ph|gh|ng|ij").sub("h", b)
    return not _rx(r"[aeiouyøæœ]").search(b) or bool(_rx(r"[bcdfghjklmnpqrstvwxzß]{5}").search(b)) or bool(_rx(r"[jqxvwz][jqxvkzf]|[^aeiouyct]{2}q|q[^u]").search(b))


def _junk_share(lines: list[str], f: dict[str, float]) -> float:
    """Share of characters that are damaged, encoded, random or left by machines."""
    body = "\n".join(lines)
    plain_lines = not f["delimiter_alignment"] and "](" not in body  # the statistics are those of these lines
    if "](" in body:
        body = _LINK.sub(r"\1", body)
    body = body.strip()
    if not body:
        return 0.0
    tokens = body.split()
    n = max(1, sum(map(len, tokens)))
    share = 0.0
    if f["_damaged"]:
        damaged = sum(len(m.group()) for m in _MOJI.finditer(body)) + len(_DAMAGE.findall(body))
        share = min(1.0, 3.0 * damaged / n) if damaged / n > 0.04 else 0.0
    address = "://" in body or "@" in body
    if "%" in body or "\\" in body or f["digit_ratio"] > 0.1 or max(map(len, tokens)) >= 28:
        share = max(share, sum(len(m.group().replace(" ", "")) for m in _ENCODED.finditer(_URL.sub(" ", body) if address else body)) / n)
    if "<" in body or "&" in body:
        share = max(share, sum(len(m.group()) for m in _TAG.finditer(body)) / n)
    if _LOG_HINT.search(body):
        share = max(share, sum(len(x) for x in lines if _LOG.search(x)) / max(1, sum(map(len, lines))))
    letters = int(f["_letters"]) if plain_lines else len(_LETTER.findall(body))
    if 2 * letters < n:  # symbols in place of letters
        marks = len(_rx(r"[\p{S}\p{P}]").findall(_rx(r"(?m)[|:]?[ \t]*-{2,}|^[ \t]*[-*+>#|]+|\|").sub(" ", body)))
        if marks > letters and letters + marks > 20 and len(_rx(r"\p{L}{3,}").findall(body)) < 3:
            share = max(share, 0.95)
    if letters and f["symbol_ratio"] + f["digit_ratio"] > 0.02 and len(_ODD_IN_WORD.findall(body)) / letters > 0.035:  # codes, links and file names hold such characters too
        plain = _rx(r"https?://\S+|(?<![\w.+-])[\w.+-]++@[\w.-]+|(?<![\w/.-])[\w/.-]++(?<=\.\w{2,4})\b|<\|[^|>\s]*+\|>").sub(" ", body)
        if len(_ODD_IN_WORD.findall(_CODE.sub("", plain))) / letters > 0.035:
            share = max(share, 0.9)
    plain = _rx(r"https?://\S+|(?<![\w.+-])[\w.+-]++@[\w.-]+|`[^`\n]*`").sub(" ", body) if address or "`" in body else body
    latin = _rx(r"[\p{Latin}\p{M}]+").findall(_CODE.sub(" ", plain)) if f["common_word_share"] < 0.12 else []
    if len(latin) >= 6 and sum(map(len, latin)) > 0.5 * letters and sum(w.lower() in _COMMON for w in latin) < 0.12 * len(latin):
        if sum(map(_odd_word, latin)) > 0.25 * len(latin):
            share = max(share, 0.9)
    if len(tokens) >= 12 and n < 3 * len(tokens) and sum(len(t) <= 2 for t in tokens) > 0.8 * len(tokens) and not _CJK.search(body) and not _rx(r"\d{2}").search(body):
        if sum(bool(_REAL.fullmatch(t)) for t in tokens) < 0.1 * len(tokens):
            share = max(share, 0.9)
    return min(1.0, share)


# -- stretches -------------------------------------------------------------------------------------


def stretches(s: str) -> list[str]:
    """Runs of text up to a final mark; those of at most two words, such as abbreviations, go with the next."""
    out, at, start = [], 0, 0
    for m in _STRETCH.finditer(s):
        piece = s[start : m.end()]
        if m.group()[0] == "." and len(piece.split()) <= 2 and m.end() < len(s.rstrip()) and s[m.end() : m.end() + 1] != "\n" and len(piece.split()[-1:][0] if piece.split() else "") <= 4:
            continue
        out.append(piece)
        start = m.end()
    if s[start:].strip():
        out.append(s[start:])
    return [x for x in out if x.strip()]


def _phrase(s: str) -> str:
    """A stretch without its marker, link target, emphasis and code numbers."""
    if "](" in s:
        s = _LINK.sub(r"\1", s)
    if "@" in s or "://" in s:
        s = _URL.sub(" ", s)
    if m := _MARK.match(s):
        s = s[m.end() :]
    s = _CODE.sub("", s)
    if "<|" in s or not s.isascii():
        s = _CONTROL.sub("", s)
    return s.strip(" \t\n*_`|")


def _size(p: str) -> float:
    """Size of a phrase in words; scripts without spaces by characters, short syllables by letters."""
    n = len(_CJK.findall(p)) if not p.isascii() else 0
    words = [w for w in _WORD.findall(p) if not w.isdigit()]
    if n >= 3 and 2 * n > sum(map(len, words)):
        return n / 2.4
    return min(len(words), sum(map(len, words)) / 4.5)


def score(s: str) -> float:
    """Above 0 where a stretch reads as a sentence, below where it reads as an entry."""
    p = _phrase(s)
    if not p:
        return -BASE
    end = _last(p)
    final = end in _FINALS
    words = [w for w in _WORD.findall(p.lower()) if not w.isdigit()]
    if not words:
        return -BASE
    letters = sum(map(len, words))
    n = 0 if p.isascii() else len(_CJK.findall(p))
    if n >= 2 and 2 * n > letters:
        size = n / 2.4
        if _KANA.search(p):
            common = len(_JA.findall(p)) + (final and not _rx(r"[^ぁ-ん。．.！？!?]").search(p))
        elif _rx("[ァ-ヶ]").search(p):  # katakana without hiragana: names
            common, size = 0, size / 2
        else:
            common = len(_ZH.findall(p))
    else:
        size = min(len(words), letters / 4.5)
        common = len(_KO.findall(p)) if not p.isascii() and _HANGUL.search(p) else sum(w in _COMMON for w in words)
    parted = len(_rx(r"\s[/|·»›]\s").findall(p)) if _PARTS & set(p) else 0
    return SIZE * min(size, 12) + FINAL * final + ASKED * (end in _ASKS) + SHARED * min(common, 3) - PARTED * min(parted, 2) - BASE


def _in_a_row(s: str) -> int:
    """How many entries a text of entries in a row has; 0 if it is none."""
    parts = [x.strip() for x in _PART.split(s) if x and x.strip()] if len(s) > 12 else []
    if len(parts) < 5 or sum(map(_size, parts)) > 4.5 * len(parts):
        return 0
    return len(parts) if sum(len(x) <= 60 and score(x) <= 0.25 for x in parts) >= 0.8 * len(parts) else 0


def kind_of(text: str, lines: list[str], rows: list[bool], f: dict[str, float]) -> str:
    """prose, list, table or junk, from a text's lines, which of them are rows, and its FEATURES."""
    if f["delimiter_alignment"] == f["bullet_line_share"] == f["_damaged"] == 0 and f["symbol_ratio"] < 0.1 and f["digit_ratio"] < 0.1 and f["compressibility"] >= 0.5:
        # running text of common words (or kana) with a final mark every few words
        gap = f["n_words"] / f["_finals"] if f["common_word_share"] >= 0.08 and f["_finals"] else f["_letters"] / f["_finals"] / 2.4 if f["_hiragana"] >= 0.35 and f["_finals"] else 0
        if f["_parted"] <= (0.16 if f["common_word_share"] >= 0.08 else 3.0) and 5.5 <= gap <= 18 or (3 <= gap <= 40 and f["punctuated_line_share"] > 0.6 and f["short_line_share"] <= 0.34):
            return "prose"
    loose = [x for x, r in zip(lines, rows) if not r]
    size = sum(map(len, lines))
    if _junk_share(loose, f) * sum(map(len, loose)) > 0.5 * size:
        return "junk"
    if f["delimiter_alignment"] and f["symbol_ratio"] > 0.3:
        symbols = [x for x, r in zip(lines, rows) if r and not _rx(r"\w").search(x)]
        if symbols and _junk_share(symbols, f) * sum(map(len, symbols)) > 0.5 * size:
            return "junk"
    if f["compressibility"] < 0.5 and _repeat_share(text, lines, f["compressibility"]) > 0.6:
        return "junk"
    # what the layout says about lines that stand by themselves: even, recurring and periodic lines are entries
    regular = 0.0
    if f["n_lines"] >= 4:
        regular = 0.4 * max(0.0, f["_even"]) + 0.3 * max(0.0, f["length_autocorrelation"]) + 0.3 * max(0.0, f["indent_periodicity"])
    shift = LAYOUT * (regular * f["short_line_share"] + 0.5 * (1 - f["punctuated_line_share"]) * (f["n_lines"] >= 3))
    mass = dict.fromkeys(KINDS, 0.0)
    n_sentences = n_entries = lead = 0
    groups: list[list[str]] = []
    run: list[str] = []
    for line, is_row in zip(lines, rows):
        if is_row:
            mass["table"] += len(line.strip())
        head = _HEAD.match(line)
        if is_row or head or _MARK.match(line):
            if run:
                groups.append(run)
            run = [] if is_row or head else [line]
            continue
        if run and line.count(",") + line.count("|") + line.count("、") + line.count("·") >= 4 and _in_a_row(line):
            groups += [run, [line]]
            run = []
            continue
        run.append(line)
    if run:
        groups.append(run)
    for group in groups:
        joined = "\n".join(group)
        if "](" in joined:
            joined = _LINK.sub(r"\1", joined)
        if "<|" in joined:
            joined = _CONTROL.sub("", joined)
        spans = stretches(joined)
        scores = [score(x) for x in spans]
        if sum(len(x) for x, y in zip(spans, scores) if y > 0.5 and len(_PART.split(x)) < 5) < 0.3 * len(joined) and (n := _in_a_row(joined)):
            mass["list"] += len(joined.strip())
            n_entries += n
            continue
        alone = len(spans) == 1
        if not alone:  # several final marks in one line: running text
            ended = [_last(x) in _FINALS for x in spans]
            with_next = [a and b and "\n" not in y[: len(y) - len(y.lstrip())] for a, b, y in zip(ended, ended[1:], spans[1:])]
            scores = [y + RUNNING * (a or b) for y, a, b in zip(scores, [False, *with_next], [*with_next, False])]
        for x, y in zip(spans, scores):
            own = [z for z in x.split("\n") if z.strip()]
            if len(own) > 1:
                sizes = sorted(_size(_phrase(z)) for z in own)
                if len(own) >= 3 and sizes[len(sizes) // 2] <= 4 or y <= 0:  # entries on lines of their own, without marks
                    for z in own:
                        if score(z) > shift:
                            mass["prose"] += len(z.strip())
                            n_sentences += 1
                        else:
                            mass["list"] += len(z.strip())
                            n_entries += 1
                    continue
            if y > (shift if alone or y <= 0 else 0.0):
                mass["prose"] += len(x.strip())
                n_sentences += 1
                if n_entries == 0 and n_sentences == 1:
                    lead = len(x.strip())
            else:
                mass["list"] += len(x.strip())
                n_entries += 1
    if mass["table"] == mass["list"] == 0:
        return "prose"
    if n_entries < 2:
        mass["list"] = 0.0
    if n_sentences == 1 and lead and (n_entries >= 3 or sum(rows) >= 3):  # a lead-in changes nothing
        mass["prose"] -= lead
    mass["list"] *= 1.5  # entries are short beside sentences
    mass["table"] *= 1.2
    return max(("prose", "table", "list"), key=lambda k: mass[k])


def _all(texts: list[str | None]) -> tuple[pd.DataFrame, list[str | None]]:
    plain = [unicodedata.normalize("NFC", t) if t and not t.isascii() else t for t in texts]
    f, lines, rows = profiles(plain, [len(t) if t else 0 for t in texts])
    records = f.to_dict("records")
    kinds = [kind_of(t, own, r, rec) if own else None for t, own, r, rec in zip(plain, lines, rows, records)]
    return f, kinds


def classify(text: str | None) -> str | None:
    """prose, list, table or junk; None for null, empty and blank texts."""
    return _all([text])[1][0]


def features(text: str | None) -> tuple:
    """FEATURES of a text, all but n_chars zero for null, empty and blank texts."""
    f = _all([text])[0].iloc[0]
    return tuple(int(f[c]) if c.startswith("n_") else float(f[c]) for c in FEATURES)


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind and FEATURES of every row."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                f, kinds = _all(part["t"].where(part["t"].notna(), None).tolist())
                out = f[[*FEATURES]].copy()
                out.insert(0, "kind", kinds)
                out.insert(0, "k", part["k"].to_numpy())
                yield out

    types = ", ".join(f"{c} {'bigint' if c.startswith('n_') else 'double'}" for c in FEATURES)
    return spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInPandas(run, f"k {key_type}, kind string, {types}").withColumnRenamed("k", key)
