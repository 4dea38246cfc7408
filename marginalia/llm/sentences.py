"""Sentence units of markdown texts in spaced and spaceless scripts.

The text is cut into blocks first (paragraphs, list items, quotations); headings, table rows and
fenced code have no units.  Within a block every terminator, and every closing quote or bracket that
follows one, opens a *gap*; in spaceless scripts without terminators a final form does too.

Spaced scripts: the full stops of a block make a lattice.  Each is the end of a sentence, part of an
abbreviation, of an ordinal, an initial or inside of a token, at a cost by the shape of the words around it;
costs of neighbours depend on each other, and the cheapest path decides.

Spaceless scripts: the words on both sides of a gap are those of the cheapest paths through dictionary
lattices, backwards to where the kana began and forwards to where a new one begins.  Their classes (final
form or particle; opening, linking or joining word) and the mark between them make the costs of ending and
of going on.

Defined results: null, empty and blank texts have no units; a block without a final mark is one unit;
a unit without any letter or number is dropped; positions count Unicode code points.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import regex

# ---- fixed values: word lists of the languages covered -----------------------------------------
#: Abbreviations that never end a sentence.
ABBR_NEVER = frozenset(
    "dr mr mrs ms prof st approx sec secs vol vols fig figs rm vs e.g i.e cf ca env chap abs hr fr mme mlle mm "
    "ts pgs gs ths bs ks tp q bzw z.b d.h u.a vgl ggf inkl zzgl ref eq dept est gen sen rep capt lt col sgt mt ft "
    "tx tt p pp al resp max min tel str nr art inkl evtl bd hrsg av bd boul".split()
)
#: Abbreviations only before a number.
ABBR_NUMBER = frozenset("no nos nr p pp s art abs sec vol chap fig rm bd kap ziff st pos tab eq ch".split())
#: Abbreviations that end a sentence before a capital.
ABBR_SOMETIMES = frozenset("a.m p.m etc inc ltd co corp u.k u.s u.s.a v.v jr sr usw bros llc plc e.u approx.".split())
#: German words after an ordinal such as `12.`
ORDINAL_NEXT = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember "
    "quartal stock etage tag woche monat jahr jahrhundert kapitel auflage klasse".split()
)
#: Japanese words that carry a sentence on after a closed quotation or bracket.
JA_JOIN = (
    "という といった といい といって という とか との とは とも とされ として とのこと と って などと など を が は に の も で へ や "
    "だと です だ である でした だった より から まで ので のに けれど けど し ながら にて には では"
).split()
#: Japanese words that open a sentence, though some begin like a joining word.
JA_OPEN = (
    "とても とくに ところで ところが とりあえず ともかく となり とき でも ですから ですが だから だが だけど もう もし もちろん もっと もともと "
    "はい はじめに のち やはり やっと やがて しかし したがって しばらく からだ まず また まだ それ そこ その そして なお なぜ なに "
    "さらに ただし つまり たとえば いいえ すると ここ この どの どこ どう あの あれ ある いつ いま おそらく できれば には かつ"
).split()
#: Japanese and Chinese openings that carry on after an ellipsis.
ELLIPSIS_JOIN_JA = ("それでも", "それから", "そして", "しかし", "けれど", "でも", "すると", "やがて", "また")
ELLIPSIS_JOIN_ZH = ("然后", "但是", "但", "不过", "还是", "就", "于是", "结果", "而", "却", "最后", "接着", "后来", "可是", "所以")
#: Forms that end a Japanese sentence.
JA_FINAL = ("た", "だ", "る", "い", "です", "ます", "ん", "か", "よ", "ね", "う", "く", "す", "つ", "ぬ", "む", "ぶ", "ぐ")
#: Polite forms that end a Japanese sentence even without a mark.
JA_POLITE = "です ます ました ません でした ください ませんでした ましょう".split()
#: Forms after which a Japanese sentence goes on.
JA_MID = "が を に で と は も へ の から まで より や ば て ながら ので のに けど けれど し つつ たり とか など って".split()
#: Words that open a sentence after an unmarked end.
JA_START = "私 私たち 彼 彼女 今日 明日 昨日 今年 去年 次 次に 最初 最後 最後に 今 その後 この間 これ それ あれ ここ そこ この その 同じ".split()
#: Chinese words after a closed quotation or bracket that go on, and words that open a sentence.
ZH_JOIN = "的 后 之 地 得".split()
ZH_START = "我 我们 你 他 她 他们 今天 明天 昨天 这 那 因为 如果 虽然 请 首先 其次 另外 同时 每".split()
#: Particles that end a Chinese sentence.
ZH_FINAL = "吗 呢 吧 啊 呀 嘛 了".split()
#: Thai words that end a sentence before a blank, and words that open one after it.
TH_FINAL = "ครับ ค่ะ คะ นะ จ้ะ แล้ว".split()
TH_START = "ดังนั้น อย่างไรก็ตาม นอกจากนี้ จากนั้น ต่อมา เมื่อวาน พรุ่งนี้ วันนี้ เขา เธอ ผม ฉัน เรา พวกเขา ทำไม".split()
#: Words of a Chinese clause that reports speech.
ZH_REPORT = regex.compile(r"写道|写着|说道|说过|问道|答道|喊道|叫道|回答|表示|指出|强调|提醒|解释|宣布|补充|记录|说$|问$|说，|问，|写$|写下|告诉|嘱咐|要求")
#: Korean words that carry on after a closed quotation and a space.
KO_JOIN = ("라고", "이라고", "하고", "라며", "이라며", "라는", "이라는", "고 ", "란 ")
#: Words that report speech after a capitalised name.
LATIN_REPORT = regex.compile(
    r"\p{Lu}[\p{L}\p{M}'’-]*(?:\s+\p{Lu}[\p{L}\p{M}'’-]*){0,2}\s+(?:said|says|asked|asks|wrote|writes|replied|answered|noted|shouted|added|"
    r"nói|hỏi|viết|ghi|đáp|sagte|fragte|schrieb|rief|dit|demande|écrit|répond)\b"
)
# -------------------------------------------------------------------------------------------------

_rx = lru_cache(None)(regex.compile)
PAIRS = {"「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "“": "”", "„": "“", "«": "»", "‹": "›", "〔": "〕", "［": "］"}
CLOSES = {v: k for k, v in PAIRS.items()}
QUOTES = frozenset("「『“„«‹\"")
STRONG = "。！？｡．؟।॥។៕။።՜։།۔"
TERM = frozenset(".!?…‥⋯" + STRONG)
_EVENT = regex.compile(r'[.!?…。！？｡．‥⋯؟।॥។៕။።՜։།۔]+|["“”„«»‹›「」『』（）()\[\]【】《》〈〉〔〕［］]')
_CJK = r"぀-ヿ㐀-䶿一-鿿\uF900-\uFAFFｦ-ﾟ"
_IS_CJK = regex.compile(f"[{_CJK}]")
_KANA = regex.compile(r"[぀-ヿ]")
_HANGUL = regex.compile(r"[가-힯ᄀ-ᇿ]")
_UPPER = regex.compile(r"\p{Lu}|\p{Lt}")
_LOWER = regex.compile(r"\p{Ll}")
_CAMEL = regex.compile(r"\p{Ll}{1,2}\p{Lu}")
_LETTER = regex.compile(r"\p{L}")
_WORDLIKE = regex.compile(r"[\p{L}\p{N}]")
_SEPARATOR = regex.compile(r"[\s\"“”„«»()（）「」『』\[\]]")
_BEFORE = regex.compile(r"(?r)[\s\"“”„«»()（）「」『』\[\]]")
_HIRAGANA = regex.compile(r"[ぁ-ゖー]")
_KATAKANA = regex.compile(r"[ァ-ヶーｦ-ﾟ]")
_CHUNK = regex.compile(f"(?:(?![ぁ-ゖ])[{_CJK}])*[ぁ-ゖ\u3099\u309A]*")
_THAI = regex.compile(r"[฀-๿]")
_VOWEL = regex.compile(r"[aeiouyæøœ]")
_WORD_AFTER = regex.compile(r"[\p{L}\p{M}]+")

_LINE = regex.compile(r"[^\r\n  \x0b\x0c\x85]*(?:\r\n|[\r\n  \x0b\x0c\x85]|\Z)")
_FENCE = regex.compile(r"[ \t]*(`{3,}|~{3,})(.*)", regex.S)
_HEADING = regex.compile(r"[ \t]{0,3}#{1,6}(?:\s|\Z)")
_RULE = regex.compile(r"[ \t]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_SETEXT = regex.compile(r"[ \t]{0,3}(?:=+|-+)[ \t]*\Z")
_QUOTE = regex.compile(r"[ \t]*(?:>[ \t]?)+")
_BULLET = regex.compile(r"[ \t　]*(?:[-*+•‣◦▪●○–—][ \t　]+|・[ \t　]*)(?:\[[ xX]\][ \t]+)?")
_ORDERED = regex.compile(r"[ \t　]*(?:(\d{1,9})[.)](?=[ \t　])|([０-９]{1,3})[．.）)]|[(（](\d{1,3})[)）](?=[ \t　])|([①-⑳]))[ \t　]*")
_TABLE_RULE = regex.compile(r"[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*\Z")


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(offset, content) of each block; list markers and quotation marks inside are blanked, so that
    positions stay those of the text."""
    lines = [(m.start(), m.group().rstrip("\r\n  \x0b\x0c\x85"), m.end()) for m in _LINE.finditer(text) if m.end() > m.start()]
    fence, cur, cur_at, number, in_list = "", [], 0, None, False

    def flush():
        nonlocal cur
        if cur:
            out = (cur_at, "".join(cur))
            cur = []
            return [out]
        return []

    for k, (at, line, end) in enumerate(lines):
        bare, lead = line, 0
        if q := _QUOTE.match(bare):
            lead = q.end()
            bare = bare[lead:]
        if fence:
            m = _FENCE.fullmatch(bare)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            continue
        m = _FENCE.fullmatch(bare)
        if m and not (m[1][0] == "`" and "`" in m[2]):
            yield from flush()
            fence = m[1]
            continue
        if not bare.strip():
            yield from flush()
            continue
        if _HEADING.match(bare):
            yield from flush()
            in_list, number = False, None
            continue
        if cur and _SETEXT.match(bare) and not in_list and len(bare.strip()) >= 2:
            cur = []  # the block was a heading
            continue
        if _RULE.match(bare):
            yield from flush()
            continue
        s = bare.lstrip()
        if s.startswith("|") or (s.count("|") >= 2 and s.rstrip().endswith("|")):
            yield from flush()
            continue
        if "|" in s and (_TABLE_RULE.match(bare) or (k + 1 < len(lines) and "|" in lines[k + 1][1] and _TABLE_RULE.match(lines[k + 1][1]))):
            yield from flush()
            continue
        mark = _BULLET.match(bare)
        if mark is None and (m := _ORDERED.match(bare)) and m.end() <= len(bare):
            n = next((int(g) for g in m.groups()[:3] if g), None)
            if not cur or m[4] or n == 1 or (in_list and n is not None and (number is None or 0 < n - number <= 3)) or (in_list and n is None):
                mark, number = m, n
                in_list = True
        elif mark is not None:
            in_list, number = True, None
        if mark is not None:
            yield from flush()
            lead += mark.end()
            # a list in a list item
            rest = line[lead:]
            if inner := _BULLET.match(rest):
                lead += inner.end()
        elif not cur and not bare[:1].isspace():
            in_list, number = False, None
        if not cur:
            cur_at = at
        cur.append(" " * lead + line[lead:] + text[at + len(line) : end])
    yield from flush()


def _pairs(s: str) -> dict[int, int]:
    """Positions of opening quotes and brackets with those of their closing ones; both ways.  A closing mark
    takes the last open one of its kind; what opened behind that and never closed is given up."""
    match: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()

    def close(want: str, at: int) -> None:
        while stack[-1][0] != want:
            opened[stack.pop()[0]] -= 1
        match[stack[-1][1]], match[at] = at, stack[-1][1]
        opened[stack.pop()[0]] -= 1

    last_quote = s.rfind('"')
    for m in _EVENT.finditer(s):
        c, i = m.group(), m.start()
        if c[0] in TERM:
            continue
        if c == '"':
            before, after = (s[i - 1] if i else " "), (s[i + 1] if i + 1 < len(s) else " ")
            opens = not opened['"']
            if not opens and before.isspace() and not after.isspace() and stack[-1][0] == '"' and i < last_quote:
                k = i - 1
                while k > stack[-1][1] and s[k].isspace():
                    k -= 1
                opens = k == stack[-1][1]
            if opens:
                stack.append((c, i))
                opened[c] += 1
            else:
                close('"', i)
            continue
        if c == "“" and opened["„"]:
            want = "„"
        elif c in PAIRS:
            stack.append((c, i))
            opened[c] += 1
            continue
        else:
            want = CLOSES.get(c)
            if c == "”" and not opened[want] and opened["„"]:
                want = "„"
        if want and opened[want]:
            close(want, i)
    return match


# -- spaceless scripts: dictionary lattices ---------------------------------------------------------


def _dictionary(**classes: list[str] | tuple[str, ...]) -> dict[str, tuple[float, str]]:
    out: dict[str, tuple[float, str]] = {}
    for name, words in classes.items():
        for w in words:
            out[w] = (0.9 if name == "open" else 1.0, name)
    return out


@lru_cache(None)
def _dictionaries() -> dict[str, tuple[dict[str, tuple[float, str]], int]]:
    both = {
        "head_ja": _dictionary(join=JA_JOIN, open=[*JA_START, *JA_OPEN], link=ELLIPSIS_JOIN_JA),
        "head_zh": _dictionary(join=ZH_JOIN, open=ZH_START, link=ELLIPSIS_JOIN_ZH),
        "tail_ja": _dictionary(final=JA_FINAL, mid=JA_MID, polite=JA_POLITE),
        "tail_zh": _dictionary(final=ZH_FINAL),
        "head_th": _dictionary(open=TH_START),
        "tail_th": _dictionary(final=TH_FINAL),
    }
    return {k: (d, max(map(len, d))) for k, d in both.items()}


def _forward(chunk: str, words: str) -> tuple[list[int], list[str]]:
    """Of each position of a chunk, where the word that ends there on the cheapest path begins, and its class."""
    known, longest = _dictionaries()[words]
    n = len(chunk)
    cost, back, kind = [0.0] * (n + 1), [0] * (n + 1), [""] * (n + 1)
    for j in range(1, n + 1):
        c = chunk[j - 1]
        cost[j], back[j], kind[j] = cost[j - 1] + (2.0 if "぀" <= c <= "ヿ" or "ก" <= c <= "๿" else 1.1), j - 1, "other"
        for i in range(max(0, j - longest), j):
            w = known.get(chunk[i:j])
            if w and cost[i] + w[0] < cost[j] - 1e-9:
                cost[j], back[j], kind[j] = cost[i] + w[0], i, w[1]
    return back, kind


@lru_cache(100_000)
def _first_class(chunk: str, words: str, whole: bool) -> str | None:
    """Class of the first word on the cheapest path; None if a longer chunk might change it."""
    back, kind = _forward(chunk, words)
    n, longest = len(chunk), _dictionaries()[words][1]
    first = [0] * (n + 1)
    for j in range(1, n + 1):
        first[j] = first[back[j]] or j
    if whole or len(set(first[max(1, n - longest + 1) :])) == 1:
        return kind[first[n]]
    return None


@lru_cache(100_000)
def lattice(chunk: str, words: str) -> tuple[tuple[str, str], ...]:
    """(word, class) on the cheapest path through the lattice of a chunk: words of the dictionary named, and
    single characters outside of it, at more than a word costs; kana most, since they belong to some word."""
    back, kind = _forward(chunk, words)
    out, at = [], len(chunk)
    while at:
        out.append((chunk[back[at] : at], kind[at]))
        at = back[at]
    return tuple(reversed(out))


def opening_word(s: str, at: int = 0, words: str = "head_ja") -> str:
    """Class of the first word at a position: join, open, link or other.  The lattice grows until all of its paths
    begin with the same word, at most to where kana end."""
    size = 16
    while True:
        chunk = _CHUNK.match(s, at, min(len(s), at + size)).group()
        if not chunk:
            return "other"
        if got := _first_class(unicodedata.normalize("NFC", chunk), words, len(chunk) < size):
            return got
        size *= 2


def final_word(s: str, at: int, words: str = "tail_ja") -> str:
    """Class of the last word before a position: final, polite, mid, other, or '' where no kana stands there."""
    k = at
    while k and "ぁ" <= s[k - 1] <= "\u309A":
        k -= 1
    if k == at:
        return "other" if k and _KATAKANA.match(s[k - 1]) else ""
    return lattice(unicodedata.normalize("NFC", s[k:at]), words)[-1][1]


def _skip(s: str, j: int) -> int:
    while j < len(s) and s[j].isspace():
        j += 1
    return j


def _spaceless_gap(s: str, i: int, j: int, mark: str) -> bool:
    """Whether a sentence ends between s[:i] and s[j:], by the costs of ending and of going on.  mark: full (a full
    stop), dots (an ellipsis) or none."""
    japanese = bool(_KANA.search(s, max(0, i - 1), i)) or bool(_HIRAGANA.search(s, j, min(len(s), j + 1)))
    end, on = {"full": (0.0, 3.0), "dots": (0.5, 1.0), "none": (2.5, 0.0)}[mark]
    first = opening_word(s, j, "head_ja" if japanese else "head_zh")
    if not japanese and first == "other":
        first = "link" if opening_word(s, j, "head_ja") == "link" else first
    elif japanese and first == "other" and opening_word(s, j, "head_zh") == "link":
        first = "link"
    if first == "join":
        end += 2.0
    elif first == "link":
        end += 3.0 if mark == "dots" else 0.0
        on += 0.0 if mark == "dots" else 1.0
    elif first == "open":
        on += 1.0
    last = final_word(s, i) if japanese else ("final" if s[i - 1 : i] in ZH_FINAL else "")
    if last == "polite":
        on += 2.0
    elif last == "final":
        on += 1.0
    elif last in ("mid", "other"):
        end += 1.0
    return end < on


def _unmarked(s: str) -> list[int]:
    """Positions in a block without terminators at which a sentence ends all the same: behind a polite Japanese form
    or a Chinese question particle before a blank or an opening word, and at blanks of Thai between a final particle or
    an opening word."""
    out = []
    if _KANA.search(s):
        for m in _rx("(?:" + "|".join(sorted(JA_POLITE, key=len, reverse=True)) + ")[かよね]*").finditer(s):
            j = m.end()
            k = j
            while k < len(s) and s[k] in " \t　":
                k += 1
            if k < len(s) and _IS_CJK.match(s[k]) and (k > j and opening_word(s, k) != "join" or k == j and opening_word(s, j) in ("open", "link")):
                out.append(j)
    elif _THAI.search(s):
        for m in _rx(r"(?<=[฀-๿])[ \t]+(?=[฀-๿])").finditer(s):
            a = s.rfind(" ", 0, m.start()) + 1
            b = s.find(" ", m.end())
            before, after = lattice(s[a : m.start()], "tail_th"), lattice(s[m.end() : b if b > 0 else len(s)], "head_th")
            if before[-1][1] == "final" or after[0][1] == "open":
                out.append(m.start())
    elif _IS_CJK.search(s):
        for m in _rx("[吗呢吧](?=[ \t　]|\\p{Han})").finditer(s):
            k = _skip(s, m.end())
            if k > m.end() or opening_word(s, k, "head_zh") in ("open", "link"):
                out.append(m.end())
    return out


def _last_quotation(s: str, open_at: int, pairs: dict[int, int], last: dict[int, int]) -> int:
    """Where the last of quotations one after the other opens; `last` remembers it for all of them."""
    chain = []
    while open_at not in last:
        chain.append(open_at)
        j = _skip(s, pairs[open_at] + 1)
        if j == len(s) or s[open_at] not in QUOTES or s[j] not in QUOTES or pairs.get(j, 0) <= j or not (_IS_CJK.match(s, open_at + 1) or j == pairs[open_at] + 1):
            last[open_at] = open_at
            break
        open_at = j
    for k in chain:
        last[k] = last[open_at]
    return last[open_at]


def _closed_gap(s: str, open_at: int, start: int, pairs: dict[int, int], last: dict[int, int]) -> bool:
    """Whether a sentence ends after the quotation or bracket that opens at `open_at`; of quotations one after the
    other, what follows the last decides."""
    open_at = _last_quotation(s, open_at, pairs, last)
    at = pairs[open_at] + 1
    j = _skip(s, at)
    if j == len(s):
        return True
    c, spaced, quote = s[j], j > at, s[open_at] in QUOTES
    if c in ",;:、，；：%-–—·/" or c in TERM:
        return False
    if c in PAIRS or c == '"':
        return True
    if _HANGUL.match(c):
        return spaced and not s.startswith(KO_JOIN, j) if quote else spaced
    if _IS_CJK.match(c):
        if _KANA.match(c):
            return opening_word(s, j) != "join"
        if not quote:
            return True
        end = next((m.start() for m in _EVENT.finditer(s, j) if m.group()[0] in TERM), len(s))
        if _KANA.search(s, j, end):
            return True
        if _skip(s, start) >= open_at:
            return not ZH_REPORT.search(s, j, end)
        return opening_word(s, j, "head_zh") != "join"
    if _LOWER.match(c) and not _CAMEL.match(s, j):
        return False
    if quote and LATIN_REPORT.match(s, j) and _skip(s, start) >= open_at:
        return False
    return True


# -- spaced scripts: a lattice of terminators ------------------------------------------------------

#: Costs: what is ruled out, what is unlikely, and what the neighbours change.
NEVER, RATHER_NOT, NEAR = 4.0, 1.5, 0.5


def _stop_costs(s: str, i: int, at: int, token: str, before: str, composed: bool) -> tuple[float, float, str]:
    """(cost of an end, cost of going on, what it is then) of the full stop at i, with the token before it, the last
    character of the one before that, and whether the token is composed, as addresses and names of files are."""
    j = _skip(s, at)
    if j == len(s):
        return 0.0, NEVER, "inside"
    c, spaced = s[j], j > at
    prev = s[i - 1] if i else " "
    low = token.lower().lstrip("'’*_-–—/:;,>#")
    if low not in ABBR_NEVER and low not in ABBR_SOMETIMES:  # an abbreviation right after an unspaced sentence end
        last = _rx(r"[.!?…]+").split(low)[-1]
        if last != low and len(low) - len(last) > 3 and (last in ABBR_NEVER or last in ABBR_NUMBER):
            low, token = last, token[-len(last) :]
    small = bool(_LOWER.match(c)) and not _CAMEL.match(s, j)
    if not spaced:
        if c.isdigit() or _LOWER.match(c) and not (_CAMEL.match(s, j) and len(low) > 2 and low.isalpha()):
            return NEVER, 0.0, "decimal" if c.isdigit() else "inside"
        if composed and not _rx(r"\d\.\d+\Z|°").search(token):
            return NEVER, 0.0, "inside"
        if _UPPER.match(c):
            word = _rx(r"[\p{L}\p{M}]+\Z").search(token)
            if word and len(word.group()) == 1 and not token[:-1].endswith(("°", "%")):
                return NEVER, 0.0, "initial"
            if low in ABBR_NEVER:
                return NEVER, 0.0, "abbreviation"
            return (0.0, NEVER, "inside") if _WORDLIKE.match(prev) or prev in "%°)）]”»’'" or _rx(r"\p{M}").match(prev) else (NEVER, 0.0, "inside")
        if _HANGUL.match(c) or _IS_CJK.match(c):
            return (0.0, NEVER, "inside") if _HANGUL.match(prev) else (NEVER, 0.0, "inside")
        if c in PAIRS or c == '"':
            return (0.0, NEVER, "inside") if _WORDLIKE.match(prev) and low not in ABBR_NEVER else (NEVER, 0.0, "inside")
        return NEVER, 0.0, "inside"
    if _HANGUL.match(prev) or _IS_CJK.match(prev):
        return 0.0, NEVER, "inside"
    if low in ABBR_NEVER and not (low in ABBR_NUMBER and not c.isdigit() and low in ("no", "nos")):
        return NEVER, 0.0, "abbreviation"
    if low in ABBR_NUMBER and c.isdigit():
        return NEVER, 0.0, "abbreviation"
    if small:
        return NEVER, 0.0, "inside"
    if low in ABBR_SOMETIMES:
        return (NEVER, 0.0, "abbreviation") if c.isdigit() else (0.0, RATHER_NOT, "abbreviation")
    letters = _rx(r"(?<![\p{L}\p{M}\p{N}°%])\p{L}\p{M}*\Z").search(token)
    if letters and not _rx(r"[°%]").search(token[-2:]):  # an initial, or a part of `d. h.`
        if low[:-1].endswith(".") and _UPPER.match(c) and len(low) > 3:
            return 0.0, RATHER_NOT, "initial"
        return RATHER_NOT + NEAR, 0.0, "initial"
    if low.isdigit() and len(low) <= 2:
        if (w := _WORD_AFTER.match(s, j)) and w.group().lower() in ORDINAL_NEXT:
            return NEVER, 0.0, "ordinal"
        return 0.0, RATHER_NOT, "ordinal"
    if token.isalpha() and 2 <= len(token) <= 5 and not token.isupper() and token.isascii() and not before.isdigit():  # unseen abbreviations have their shapes
        if not _VOWEL.search(low):
            return RATHER_NOT, NEAR, "abbreviation"
        if c.isdigit() and token[0].isupper() and _rx(r"[bcdfghjklmnpqrstvwz]{2}\Z").search(low) and low[-1] != low[-2]:
            return RATHER_NOT, NEAR, "abbreviation"
    return 0.0, NEVER, "inside"


def _stops(s: str, marks: list[tuple[int, int]]) -> set[int]:
    """Those of the single full stops of a block that end a sentence: the cheapest path through all of them.  Stops that
    aren't near the one before cost the same whatever that one is, so the path is that of each run of near ones."""
    out: set[int] = set()
    joint: list[int] | None = None
    seen = token = 0
    run: list[tuple[int, float, float, str, bool]] = []  # of near stops: position, costs, state, begins in lower case
    for n, (i, at) in enumerate(marks):
        sep = _BEFORE.search(s, seen, i)  # what lies before the last stop has been looked at
        token = sep.end() if sep else token
        seen, begin = i, token
        composed = False
        if at < len(s) and not s[at].isspace():  # only then does it matter
            if joint is None:
                joint = [m.start() for m in _rx(r"[/@_\\=]|\w\.\w").finditer(s, overlapped=True)]
            k = bisect_left(joint, begin)
            composed = k < len(joint) and joint[k] < i - (s[joint[k]] not in "/@_\\=") * 2
        first = begin
        if n >= 8:  # of a token with many stops the last parts tell all but whether it is composed
            begin = max(begin, marks[n - 8][0])
        end, on, state = _stop_costs(s, i, at, s[begin:i], s[first - 2 : first - 1] if first > 1 else "", composed)
        if run and i - run[-1][0] > 4:
            out |= _ends(run)
            run = []
        run.append((i, end, on, state, s[begin : begin + 1].islower()))
    return out | _ends(run)


def _ends(run: list[tuple[int, float, float, str, bool]]) -> set[int]:
    """The ends on the cheapest path through stops near to each other: a sentence of one short token is rare, initials
    and parts of abbreviations come together."""
    if len(run) < 2:
        return {i for i, end, on, _, _ in run if end < on}
    path = [(run[0][1], run[0][2], True, True)]  # cost of end, cost of going on, and whether an end came before each
    for (_, _, _, last, _), (_, end, on, state, low) in zip(run, run[1:]):
        e, o = path[-1][:2]
        ee, oe = e + end + NEAR * low, o + end
        eo, oo = e + on, o + on - NEAR * (state == last != "inside")
        path.append((min(ee, oe), min(eo, oo), ee < oe, eo < oo))
    out, ends = set(), path[-1][0] < path[-1][1]
    for (i, *_), step in zip(reversed(run), reversed(path)):
        if ends:
            out.add(i)
        ends = step[2] if ends else step[3]
    return out


def _gap(s: str, i: int, at: int, seps: list[int]) -> bool:
    """Whether the run of terminators s[i:at], outside of quotes and brackets and no single full stop, ends a
    sentence.  `seps` is filled when first needed."""
    run = s[i:at]
    j = _skip(s, at)
    if j == len(s):
        return True
    c, spaced = s[j], j > at
    if set(run) <= set(".…‥⋯"):
        if _HANGUL.match(c):
            return spaced
        if _IS_CJK.match(c):
            k = i
            while k and s[k - 1].isspace():
                k -= 1
            return _spaceless_gap(s, k, j, "dots")
        if c in ",;:、，；：)]）":
            return False
        return not _LOWER.match(c) or bool(_CAMEL.match(s, j))
    if any(x in STRONG for x in run):
        if c in ",、，;；)）]」』" or (run == "．" and c.isdigit()):
            return False
        return _spaceless_gap(s, i, j, "full") if _IS_CJK.match(c) else True
    # ! and ?
    if not spaced:
        if c in ",;:)]" or c in "/=&%-":
            return False
        if c.isdigit() or _LOWER.match(c) and not _CAMEL.match(s, j):
            return False
        if not seps:
            seps += [-1, *(m.start() for m in _SEPARATOR.finditer(s))]
        return "://" not in s[seps[bisect_left(seps, i) - 1] + 1 : i]
    return c not in ",;:"


def _cuts(s: str) -> list[int]:
    """Where the sentences of a block end."""
    events: list[tuple[int, int, int]] = []  # position, end, and the closing mark's position for quotes and brackets
    pairs: dict[int, int] = {}
    found = [m.span() for m in _EVENT.finditer(s)]
    if not any(s[i] in TERM for i, _ in found):
        return _unmarked(s)
    if any(s[i] not in TERM for i, _ in found):
        pairs = _pairs(s)
    pos = 0
    for i, at in found:
        if i < pos:
            continue
        if s[i] in TERM:
            if not (at < len(s) and pairs.get(at, at) < at):
                events.append((i, at, -1))
        elif pairs.get(i, -1) > i:
            events.append((i, pairs[i] + 1, pairs[i]))
            pos = pairs[i] + 1
    stops = _stops(s, [(i, at) for i, at, close in events if close < 0 and s[i:at] == "."])
    cuts: list[int] = []
    start, seps, last = 0, [], {}
    for i, at, close in events:
        if close < 0:
            if i in stops if s[i:at] == "." else _gap(s, i, at, seps):
                cuts.append(at)
                start = at
            continue
        k = close
        while k > i + 1 and (s[k - 1].isspace() or s[k - 1] in CLOSES or s[k - 1] == '"'):
            k -= 1
        if k > i + 1 and s[k - 1] in TERM and _closed_gap(s, i, start, pairs, last):
            cuts.append(at)
            start = at
    return cuts


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit of a text."""
    out: list[tuple[int, int]] = []
    if not text or text.isspace():
        return out
    for base, s in blocks(text):
        a = 0
        for b in (*_cuts(s), len(s)):
            piece = s[a:b]
            lead = len(piece) - len(piece.lstrip())
            body = piece.strip()
            if body and _WORDLIKE.search(body):
                out.append((base + a + lead, base + a + lead + len(body)))
            a = b
    return out
