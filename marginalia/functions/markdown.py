"""Markdown documents: metadata block, headings, sections, chunks, links, first sentence."""

from __future__ import annotations

import json
import posixpath
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from urllib.parse import unquote

import regex
import yaml

from marginalia.functions.columns import CJK, EMPHASIS, INLINE, TOKEN_CJK, TOKEN_DIGIT, TOKEN_MARKED, TOKEN_NEWLINE, TOKEN_OTHER, TOKEN_WORD

# ---- fixed values ---------------------------------------------------------------------------------
CHUNK_MIN, CHUNK_MAX, CHUNK_LINE_CHARS = 150, 450, 1350
SENTENCE_MIN, SENTENCE_MAX = 40, 200
ABBREVIATIONS = frozenset("e.g i.e etc vs approx no fig mr dr ms".split())
# ---------------------------------------------------------------------------------------------------

_CJK = regex.compile(f"[{CJK}]")
_OTHER = regex.compile(rf"[^\p{{L}}\p{{N}}\p{{White_Space}}{CJK}]")
_RUN = regex.compile(rf"[[\p{{L}}\p{{N}}]--[{CJK}]]+", regex.V1)
_MARKED = regex.compile("[À-ỹ]")
_INLINE, _EMPHASIS = regex.compile(INLINE), regex.compile(EMPHASIS)


def tokens(text: str | None) -> int:
    """The linear token estimate of a text."""
    if not text:
        return 0
    runs = [r for r in _RUN.findall(text) if not (r.isascii() and r.isdigit())]
    marked = sum(1 for r in runs if _MARKED.search(r))
    n = TOKEN_NEWLINE * text.count("\n") + TOKEN_DIGIT * sum(text.count(d) for d in "0123456789") + TOKEN_CJK * len(_CJK.findall(text)) + TOKEN_OTHER * len(_OTHER.findall(text))
    return -(-(n + TOKEN_MARKED * marked + TOKEN_WORD * (len(runs) - marked)) // 100)


# -- metadata ----------------------------------------------------------------------------------------


class _Core(yaml.SafeLoader):
    """YAML with the core schema only: dates, on/off and sexagesimals stay text."""


_Core.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^[-+]?[0-9]+$|^0o[0-7]+$|^0x[0-9a-fA-F]+$", "-+0123456789"),
    ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$", "-+0123456789."),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
):
    _Core.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", __import__("re").compile(_pattern), list(_first))


@dataclass(frozen=True)
class Parsed:
    """state: absent, unterminated, invalid or valid."""

    state: str
    raw: str | None
    meta: str | None  # JSON of the ordered map
    body: str


def parse_document(text: str) -> Parsed:
    """Metadata block and body of a document; never fails on content."""
    t = text.removeprefix("\ufeff")
    first = regex.match(r"---[ \t]*(?:\r\n|\n|\r|\Z)", t)
    if not first:
        return Parsed("absent", None, None, t)
    close = regex.compile(r"(?:(?<=\n)|(?<=\r))(?:---|\.\.\.)[ \t]*(?:\r\n|\n|\r|\Z)").search(t, first.end())
    if not close:
        return Parsed("unterminated", None, None, t)
    raw, body = t[first.end() : close.start()], t[close.end() :]
    try:
        value = yaml.load(raw, _Core)  # noqa: S506: the loader is a safe one
    except yaml.YAMLError:
        return Parsed("invalid", raw, None, body)
    if value is None:
        value = {}
    if not isinstance(value, dict):
        return Parsed("invalid", raw, None, body)
    return Parsed("valid", raw, json.dumps({str(k): v for k, v in value.items()}, ensure_ascii=False, default=str), body)


# -- headings and sections ---------------------------------------------------------------------------


def _lines(body: str) -> list[str]:
    return body.split("\n") if body else []


def _open_lines(body: str):
    """(number, line, whether outside of fences) of each line; a fence's own lines are inside."""
    fence = ""
    for n, line in enumerate(_lines(body), 1):
        t = line.lstrip()
        mark = next((f for f in ("```", "~~~") if t.startswith(f)), "")
        if fence:
            yield n, line, False
            if mark == fence:
                fence = ""
        elif mark:
            fence = mark
            yield n, line, False
        else:
            yield n, line, True


def headings(body: str | None) -> list[tuple[int, str, int]]:
    """(level, text, line) of the # headings outside of fences."""
    out = []
    for n, line, plain in _open_lines(body or ""):
        if plain and (m := regex.match(r"(#{1,6})[ \t]+(.*)", line)):
            out.append((len(m[1]), m[2].strip().rstrip("#").strip(), n))
    return out


def _found(body: str | None, wanted: str, fold) -> tuple[list[tuple[int, str, int]], int | None]:
    """The headings, and which of them is the first to hold the folded text."""
    heads = headings(body)
    want = fold(wanted.strip().lstrip("#").strip())
    return heads, next((k for k, (_, text, _) in enumerate(heads) if want in fold(text)), None)


def section_heading(body: str | None, wanted: str, fold) -> str | None:
    heads, k = _found(body, wanted, fold)
    return None if k is None else heads[k][1]


def section(body: str | None, wanted: str, fold) -> str | None:
    """From the first heading that holds the folded text to the next of the same or a higher level."""
    heads, k = _found(body, wanted, fold)
    if k is None:
        return None
    level, _, at = heads[k]
    end = next((line for lev, _, line in heads[k + 1 :] if lev <= level), None)
    return "\n".join(_lines(body)[at - 1 : end - 1 if end else None])


def cut_to_tokens(text: str | None, budget: int) -> tuple[str, bool]:
    """The first lines within a token budget, and whether something was cut; a first line above the
    budget is cut at three characters a token."""
    text = text or ""
    if tokens(text) <= budget:
        return text, False
    out, used = [], 0
    for line in text.splitlines(keepends=True):
        t = tokens(line)
        if used + t > budget:
            if not out:
                out.append(line[: budget * 3])
            break
        out.append(line)
        used += t
    return "".join(out).rstrip(), True


def first_h1(body: str | None) -> str | None:
    for n, line, plain in _open_lines(body or ""):
        if plain and line.startswith("# ") and (h := clean(line[2:].strip().rstrip("#").strip())):
            return h
    return None


def clean(s: str) -> str:
    """Inline markdown as plain text."""
    return " ".join(_EMPHASIS.sub(r"\1", _INLINE.sub(r"\1\2\3\4", s)).split())


# -- chunks ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Chunk:
    ord: int
    heading: str
    text: str
    start_line: int
    end_line: int
    tokens: int


def _sections(lines: list[str]) -> list[tuple[str, int, int]]:
    """(heading path, first line, line after the last) of what lies between ## and ### headings; the path of a ###
    begins with the ## above it."""
    marks = [(1, 0, "")] if lines else []
    plain = {n for n, _, ok in _open_lines("\n".join(lines)) if ok}
    for n, line in enumerate(lines, 1):
        if n in plain and (m := regex.match(r"#(#{1,2}) (.*)", line)):
            marks.append((n, len(m[1]), m[2].strip().rstrip("#").strip()))
    out, above = [], ""
    for (n, level, text), end in zip(marks, [*(m[0] for m in marks[1:]), len(lines) + 1]):
        if level == 1:
            above = text
        path = f"{above} > {text}" if level == 2 and above else f" > {text}" if level == 2 else text
        out.append((path.removeprefix(" > "), n, end))
    return out


def _reach(sums: list[int], at: int, most: int) -> int:
    """The last position up to which no more than `most` has come since `at`."""
    return bisect_right(sums, sums[at] + most) - 1


def chunks(body: str | None) -> list[Chunk]:
    """Sections at ## and ### outside of fences; small ones are joined to the one before while it is
    below CHUNK_MIN and both fit CHUNK_MAX; large ones are cut at lines, and huge lines at characters.

    Both are cuts in prefix sums: of the sections' sizes, and of the lines' sizes within a large section.
    """
    lines = (body or "").splitlines()
    joined = lambda a, b: "\n".join(lines[a - 1 : b - 1]) + "\n"
    sections = [x for x in _sections(lines) if joined(x[1], x[2]).strip()]
    sums = [0, *accumulate(tokens(joined(a, b)) for _, a, b in sections)]
    spans: list[tuple[str, str, int, int]] = []
    at = 0
    while at < len(sections):
        heading, first, end = sections[at]
        if sums[at + 1] - sums[at] > CHUNK_MAX:
            spans += [(heading, t, a, b) for t, a, b in _cut(lines, first, end)]
            at += 1
            continue
        stop = max(at + 1, min(bisect_left(sums, sums[at] + CHUNK_MIN), _reach(sums, at, CHUNK_MAX)))
        spans.append((heading, joined(first, sections[stop - 1][2]), first, sections[stop - 1][2] - 1))
        at = stop
    kept = [(h, t.strip(), a, b) for h, t, a, b in spans if t.strip()]
    return [Chunk(k, h, t, a, b, tokens(t)) for k, (h, t, a, b) in enumerate(kept)]


def _cut(lines: list[str], first: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(text, first line, last line) of the parts of the lines from `first` to before `end`."""
    own = [x + "\n" for x in lines[first - 1 : end - 1]]
    sums = [0, *accumulate(map(tokens, own))]
    at = 0
    while at < len(own):
        stop = _reach(sums, at, CHUNK_MAX)
        if stop == at:
            line = own[at]
            yield from ((line[k : k + CHUNK_LINE_CHARS], first + at, first + at) for k in range(0, len(line), CHUNK_LINE_CHARS))
            stop += 1
        else:
            yield "".join(own[at:stop]), first + at, first + stop - 1
        at = stop


# -- links -------------------------------------------------------------------------------------------

_LINK = regex.compile(r"(?<!\\)!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(\s*(<[^>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
_WIKI = regex.compile(r"!?\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]+))?\]\]")
_CODE = regex.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)", regex.S)


def links(body: str | None) -> list[tuple[str, str, str, int]]:
    """(raw target, text, kind, line) of links, images and wiki links; code is ignored."""
    plain = "\n".join(line if ok else "" for _, line, ok in _open_lines(body or ""))
    plain = _CODE.sub(lambda m: regex.sub(r"[^\n]", " ", m.group()), plain)
    found = [(m.start(), m[1].strip(), (m[2] or m[1]).strip(), "wiki") for m in _WIKI.finditer(plain)]
    rest = _WIKI.sub(lambda m: " " * len(m.group()), plain)
    found += [(m.start(), m[2].strip("<>"), regex.sub(r"[*_`]", "", m[1]), "markdown") for m in _LINK.finditer(rest)]
    return [(raw, text, kind, plain.count("\n", 0, at) + 1) for at, raw, text, kind in sorted(found)]


def resolve_link(source: str, target: str) -> str | None:
    """The id a markdown link in document `source` leads to; null for addresses, other files and what lies above the
    collection.  A folder stands for its index."""
    address, _, _ = target.strip().replace("?", "#").partition("#")
    if not address or regex.match(r"[\w+.-]{2,}:|//", address, regex.A):
        return None
    try:
        address = unquote(address, errors="strict")
    except UnicodeDecodeError:
        pass
    at = posixpath.normpath(address.lstrip("/") or "." if address.startswith("/") else posixpath.join(posixpath.dirname(source), address))
    if at.split("/")[0] == ".." or "\\" in at:
        return None
    if at == "." or address.endswith("/"):
        return posixpath.normpath(posixpath.join(at, "index"))
    return at[:-3] if at.endswith(".md") and not at.endswith("/.md") and at != ".md" else None


# -- first sentence ----------------------------------------------------------------------------------


#: The blocks of a document: those without sentences of their own first, then list items, then lines of text.
_BLOCKS = regex.compile(
    r"""(?mx)
    ^[ \t]*(?P<fence>```|~~~) [\s\S]*? (?: \n[ \t]*(?P=fence)[^\n]* | \Z )
  | ^[ \t]*:::[^\n]+ (?: [\s\S]*? \n[ \t]*:::[ \t]*$ | [\s\S]*\Z )
  | ^[ \t]*<(?!http)(?P<tag>[A-Za-z][\w-]*) [^\n]* (?: (?<=/>|</(?P=tag)>)[ \t]*$ | [\s\S]*? </(?P=tag)>[^\n]* | $ )
  | ^[ \t]*(?: [#|>] | !\[ | \[!\[ | <(?!http) | (?:import|export)[ ] | \{/\* | -{3} | ={3} | ::: ) [^\n]*
  | ^[ \t]*(?:[-*+]|\d+[.)])[ ]+(?P<item>[^\n]+)
  | (?P<blank>^[ \t]*$)
  | (?P<text>^[^\n]+)
    """
)
_END = regex.compile(r"[。！？]|[.!?](?=\s|\Z)")


def first_sentence(body: str | None) -> str | None:
    """The first meaningful sentence: of a paragraph, else of a list item.  Code, tables, headings, HTML,
    admonitions and images are skipped; a paragraph needs eight letters."""
    found: dict[str, list[list[str]]] = {"text": [[]], "item": []}
    for m in _BLOCKS.finditer("\n".join((body or "").splitlines())):
        if m["text"]:
            found["text"][-1].append(m["text"])
            continue
        found["text"].append([])  # whatever else comes ends a paragraph
        if m["item"]:
            found["item"].append([m["item"]])
    for kind in ("text", "item"):
        for lines in found[kind]:
            t = clean(" ".join(lines))
            if len(regex.findall(r"\p{L}", t)) >= 8:
                return _shown(t)
    return None


def _shown(text: str) -> str:
    """The first sentence of a text, or more until it is SENTENCE_MIN wide (a CJK character counts three); at most
    SENTENCE_MAX characters, then cut at a blank."""
    ends = (m.end() for m in _END.finditer(text) if m.group() != "." or not _abbreviated(text, m.start()))
    end = next((e for e in ends if e + 2 * len(_CJK.findall(text, 0, e)) >= SENTENCE_MIN), len(text))
    s = text[:end].strip()
    if len(s) <= SENTENCE_MAX:
        return s
    whole = regex.match(rf"(?s).{{1,{SENTENCE_MAX - 1}}}(?=\s)", s)
    return (whole.group() if whole else s[: SENTENCE_MAX - 1]).rstrip(",;: ") + "…"


def _abbreviated(text: str, at: int) -> bool:
    """Whether the full stop belongs to a single letter or a known abbreviation."""
    word = text[:at].rsplit(maxsplit=1)[-1:] if not text[at - 1 : at].isspace() else []
    return bool(word) and (len(word[0]) == 1 or word[0].lower().lstrip("(") in ABBREVIATIONS)
