"""Index terms: folded words, English ones stemmed, and character pairs of CJK runs."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

from marginalia.functions.columns import CJK, fold_text

_RUNS = regex.compile(f"[{CJK}]+|[^{CJK}]+")
_IS_CJK = regex.compile(f"[{CJK}]")
_VOWEL = "aeiouy"
# ---- fixed values: exceptions and endings of the English stemmer -----------------------------------
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
# ----------------------------------------------------------------------------------------------------


def _region(w: str, start: int) -> int:
    m = regex.compile(r"[aeiouy][^aeiouy]").search(w, start)
    return m.end() if m else len(w)


def _short(w: str) -> bool:
    return bool(regex.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))


@lru_cache(100_000)
def stem(word: str) -> str:
    """The English (Porter2) stem of a lower-case word."""
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.removeprefix("'")
    if len(w) <= 2:
        return w
    w = regex.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    m = regex.match("gener|commun|arsen", w)
    r1 = m.end() if m else _region(w, 0)
    r2 = _region(w, r1)
    w = regex.sub(r"'s'$|'s$|'$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and regex.search("[aeiouy].+s$", w):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w
    # past and progressive
    if w.endswith(("eed", "eedly")):
        cut = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(cut) >= r1:
            w = w[: -len(cut)] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                base = w[: -len(end)]
                if regex.search("[aeiouy]", base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif regex.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                        w = w[:-1]
                    elif r1 >= len(w) and _short(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for end, new in STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and not (end == "ogi" and w[-4:-3] != "l") and not (end == "li" and w[-3:-2] not in "cdeghkmnrt"):
                w = w[: -len(end)] + new
            break
    for end, new in STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + new
            break
    for end in STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def terms_text(text: str | None) -> list[str]:
    """Terms of a text in order; null and empty texts have none."""
    out: list[str] = []
    for run in _RUNS.findall(unicodedata.normalize("NFKC", text or "")):
        if _IS_CJK.match(run):
            letters = regex.sub(r"[^\p{L}\p{N}]", "", run)
            out.extend([letters] if len(letters) == 1 else [letters[k : k + 2] for k in range(len(letters) - 1)])
        else:
            for w in regex.findall(r"[\p{L}\p{N}]+", fold_text(run)):
                out.append(stem(w) if w.isascii() and regex.search("[a-z]", w) else w)
    return out
