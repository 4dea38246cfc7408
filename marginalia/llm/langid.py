"""Language of texts and of their segments by character models.

One interpolated Kneser-Ney model of order 4 per language, all of them in common sorted key arrays: a
key packs up to four characters into 64 bits, and each order holds one row of probabilities and one row
of back-off weights (a column per language) for every key any language has seen.  A segment gets the
language of the lowest length-normalised cross-entropy; it is rejected when even that one is above the
limit of the language, or when the runner-up is as likely.  The limit is calibrated on held-out segments, between a
high quantile of those of the language and a low quantile of those of all other languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex

LANGS = ("en", "vi", "ja", "zh", "fr", "de", "ko")
ORDER = 4
VOCABULARY = 6000  # of the uniform distribution below order 1

_NOISE = regex.compile(r"https?://[!-~]+|(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]{1,64}@[A-Za-z0-9.-]+|`[^`\n]*`|(?<![A-Za-z0-9_./%-])[A-Za-z0-9_./%-]*[0-9][A-Za-z0-9_./%-]*|[^\p{L}\p{M}'’]+")
_SPACELESS = regex.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")
_SPACES = regex.compile(r" {2,}")
_MARKS = regex.compile(r"\p{M}+")

#: Names of the languages' labels, lower case, region codes cut off (fixed values).
LABEL_NAMES = {
    "en": "en eng english anglais englisch tiếng-anh 英語 英语 영어",
    "vi": "vi vie vietnamese vietnamien vietnamesisch tiếng-việt tieng-viet ベトナム語 越南语 베트남어",
    "ja": "ja jpn japanese japonais japanisch tiếng-nhật 日本語 日语 일본어 jp",
    "zh": "zh zho chi chinese chinois chinesisch tiếng-trung 中文 汉语 漢語 中国語 중국어 cn zh-hans zh-hant 普通话 简体中文 繁體中文",
    "fr": "fr fra fre french français francais französisch tiếng-pháp フランス語 法语 프랑스어",
    "de": "de deu ger german allemand deutsch tiếng-đức ドイツ語 德语 독일어",
    "ko": "ko kor korean coréen koreanisch tiếng-hàn 韓国語 韩语 한국어 한국말 kr",
}
_LABELS = {name: code for code, names in LABEL_NAMES.items() for name in names.split()}
#: Labels that say the language isn't known.
UNKNOWN_LABELS = frozenset("und unknown ? ?? ??? n/a na none null - -- x xx xxx zxx mis unk unspecified undefined tbd other".split())


def label_code(label: str | None) -> str | None:
    """The language that a label names; None if it names none.  Any case; region codes are cut off."""
    import unicodedata

    if label is None:
        return None
    s = regex.sub(r"[\s_-]+", "-", unicodedata.normalize("NFC", label).strip().lower())
    return _LABELS.get(s) or _LABELS.get(s.split("-")[0] if regex.fullmatch(r"[a-z]{2,3}-[a-z0-9]{2,8}(-[a-z0-9]+)*", s) else s)


def label_missing(label: str | None) -> bool:
    """Null, blank or a word for `not known`."""
    return label is None or not label.strip() or label.strip().lower() in UNKNOWN_LABELS


def clean(text: str) -> str:
    """Letters of a segment in lower case, words parted by one space; codes, numbers and links dropped."""
    import unicodedata

    return _SPACES.sub(" ", _NOISE.sub(" ", unicodedata.normalize("NFC", text)).lower()).strip()


def unmarked(text: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", text))).replace("đ", "d").replace("ß", "ss")


def _codes(segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the 4-grams that end at each character, the segment of each, and each segment's length."""
    lens = np.fromiter((len(s) + 1 for s in segments), np.int64, len(segments))
    flat = np.frombuffer("".join("   " + s + " " for s in segments).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    high = flat > 0xFFFF
    if high.any():  # kept apart within any script of theirs, on code points that no text has
        flat[high] = 0xD800 + (flat[high] - 0x10000) % 0x2100
    ends = np.cumsum(lens + 3)
    keep = np.ones(len(flat), bool)
    starts = ends - lens - 3
    for k in range(3):
        keep[starts + k] = False
    keys = flat.copy()
    for k in (1, 2, 3):
        keys[k:] |= flat[:-k] << np.uint64(16 * k)
    return keys[keep], np.repeat(np.arange(len(segments)), lens), lens


def _mask(order: int) -> np.uint64:
    return np.uint64(0xFFFFFFFFFFFFFFFF) if order == 4 else np.uint64((1 << (16 * order)) - 1)


@dataclass
class CharModels:
    """keys, probs and backs by order (index 0: order 1); `limit` per language is the calibrated bound."""

    langs: tuple[str, ...]
    keys: list[np.ndarray]
    probs: list[np.ndarray]
    backs: list[np.ndarray]
    limit: np.ndarray

    @staticmethod
    def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, want)
        at[at == len(keys)] = 0
        return at, keys[at] == want

    def _prob(self, order: int, want: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full((len(want), len(self.langs)), 1.0 / VOCABULARY, np.float32)
        at, hit = self._find(self.keys[order - 1], want)
        out = self.probs[order - 1][at]
        if not hit.all():
            miss = ~hit
            low = self._prob(order - 1, want[miss] & _mask(order - 1) if order > 1 else want[miss])
            if order > 1:
                ctx, known = self._find(self.keys[order - 2], want[miss] >> np.uint64(16))
                low = low * np.where(known[:, None], self.backs[order - 2][ctx], np.float32(1))
            else:
                low = low * np.float32(0.5)
            out[miss] = low
        return out

    def entropy(self, segments: list[str], block: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per character of each cleaned segment under each model, and the lengths."""
        sums, lens = np.zeros((len(segments), len(self.langs))), np.fromiter((len(s) + 1 for s in segments), np.int64, len(segments))
        at = 0
        while at < len(segments):
            size, end = 0, at
            while end < len(segments) and (end == at or size + lens[end] <= block):
                size += int(lens[end])
                end += 1
            keys, seg, _ = _codes(segments[at:end])
            for k in range(0, len(keys), block):  # one very long segment still goes in blocks
                part = keys[k : k + block]
                logs = np.log(self._prob(ORDER, part))
                own = seg[k : k + block]
                for j in range(len(self.langs)):
                    sums[at:end, j] += np.bincount(own, logs[:, j], end - at)
            at = end
        return -sums / lens[:, None], lens

    def choose(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language of each cleaned segment (-1: rejected), its confidence, and the log-likelihoods."""
        if not segments:
            return np.zeros(0, int), np.zeros(0), np.zeros((0, len(self.langs)))
        order = {x: k for k, x in enumerate(dict.fromkeys(segments))}  # equal segments are scored once
        ent, lens = self.entropy(list(order))
        of = np.fromiter((order[x] for x in segments), np.int64, len(segments))
        ent, lens = ent[of], lens[of]
        ll = -ent * lens[:, None]
        top = ll.argmax(1)
        conf = 1 / np.exp(np.clip(ll * 0.5 - (ll.max(1) * 0.5)[:, None], -700, 0)).sum(1)  # tempered: characters aren't independent
        ok = (ent[np.arange(len(top)), top] <= self.limit[top]) & (lens > 1) & (conf > 0.5)
        return np.where(ok, top, -1), np.where(ok, conf, 0.0), ll


def _train(rows: list[tuple[str, list[str]]], langs: tuple[str, ...]) -> CharModels:
    counts = []
    for _, segs in rows:
        k = _codes(segs)[0] if segs else np.zeros(0, np.uint64)
        counts.append(np.unique(k, return_counts=True))
    keys: list[np.ndarray] = [None] * ORDER  # type: ignore[list-item]
    cnt: list[np.ndarray] = [None] * ORDER  # type: ignore[list-item]
    for order in range(ORDER, 0, -1):
        union = np.unique(np.concatenate([np.zeros(1, np.uint64), *(k for k, _ in counts)]))  # never empty
        c = np.zeros((len(union), len(langs)))
        for j, (k, n) in enumerate(counts):
            c[np.searchsorted(union, k), j] = n
        keys[order - 1], cnt[order - 1] = union, c
        # continuation counts of the next lower order: distinct characters to the left
        counts = [np.unique(k & _mask(order - 1), return_counts=True) for k, _ in counts] if order > 1 else counts
    probs: list[np.ndarray] = [None] * ORDER  # type: ignore[list-item]
    backs: list[np.ndarray] = [np.ones((len(k), len(langs)), np.float32) for k in keys]
    for order in range(1, ORDER + 1):
        c = cnt[order - 1]
        n1, n2 = (c == 1).sum(0), (c == 2).sum(0)
        d = np.where(n1 > 0, n1 / np.maximum(1, n1 + 2 * n2), 0.5).clip(0.1, 0.95)
        ctx, inv = np.unique(keys[order - 1] >> np.uint64(16), return_inverse=True) if order > 1 else (np.zeros(1, np.uint64), np.zeros(len(c), int))
        total, kinds = np.zeros((len(ctx), len(langs))), np.zeros((len(ctx), len(langs)))
        np.add.at(total, inv, c)
        np.add.at(kinds, inv, c > 0)
        back = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        low = np.full((len(c), len(langs)), 1.0 / VOCABULARY)
        if order > 1:
            low = probs[order - 2][np.searchsorted(keys[order - 2], keys[order - 1] & _mask(order - 1))]
            at, hit = CharModels._find(keys[order - 2], ctx)
            backs[order - 2][at[hit]] = back[hit]
        probs[order - 1] = (np.maximum(c - d, 0) / np.maximum(total, 1)[inv] + back[inv] * low).astype(np.float32)
    return CharModels(langs, keys, probs, backs, np.full(len(langs), 99.0))


def _own(rows: list[tuple[str, list[str]]], langs: tuple[str, ...]) -> list[tuple[str, list[str]]]:
    """The rows with only those segments whose 4-grams are more frequent in the label's language than in
    any other.  Frequencies, unlike conditional probabilities, stay small in a language that saw a few
    texts by a wrong label."""
    flat = [(k, s) for k, (_, segs) in enumerate(rows) for s in segs]
    if not flat:
        return rows
    code = {x: j for j, x in enumerate(langs)}
    of = np.array([code[rows[k][0]] for k, _ in flat])
    keys, seg, lens = _codes([s for _, s in flat])
    union, inv = np.unique(keys, return_inverse=True)
    freq = np.zeros((len(union), len(langs)))
    np.add.at(freq, (inv, of[seg]), 1)
    logs = np.log((freq + 0.02) / np.maximum(freq.sum(0), 1000))
    score = np.stack([np.bincount(seg, logs[inv, j], len(flat)) for j in range(len(langs))], 1)
    out: list[tuple[str, list[str]]] = [(lang, []) for lang, _ in rows]
    rest = score.copy()
    rest[np.arange(len(of)), of] = -np.inf
    for (k, s), own, other in zip(flat, score[np.arange(len(of)), of], rest.max(1)):
        if own > other + 2:
            out[k][1].append(s)
    return [r for r in out if r[1]]


#: Quantiles of held-out cross-entropies that the limits are between (of the language's own segments, and of others'), and
#: how far on the way to the second.
OWN_QUANTILE, OTHER_QUANTILE, TOWARDS_OTHERS = 0.995, 0.005, 0.5


def train(labelled: list[tuple[str, list[str]]], langs: tuple[str, ...] = LANGS, seed: int = 7) -> CharModels:
    """Models from (language, cleaned segments) of labelled texts.

    Labels may be wrong and texts mixed: segments that are more usual in another language are dropped
    first, twice.  Vietnamese, French and German are also shown without their marks.  A tenth of the texts is held
    out to calibrate the rejection: the limit of a language is TOWARDS_OTHERS of the way from OWN_QUANTILE of the cross-entropies of
    its held-out segments to OTHER_QUANTILE of those of the other languages' segments under its model (with one
    language only, it is the uniform distribution's cross-entropy instead).  A language without texts rejects everything.
    """
    rng = np.random.default_rng(seed)
    kept = _own(_own(labelled, langs), langs)

    def model_of(rows: list[tuple[str, list[str]]]) -> CharModels:
        by = {x: [s for lang, segs in rows if lang == x for s in segs] for x in langs}
        return _train([(x, by[x] + ([u for s in by[x] if (u := unmarked(s)) != s] if x in ("vi", "fr", "de") else [])) for x in langs], langs)

    model = model_of(kept)
    pick = rng.random(len(kept)) < 0.1
    seen = {lang for lang, _ in kept}
    for x in seen - {lang for (lang, _), p in zip(kept, pick) if p}:  # at least one text of each language
        own = [k for k, (lang, _) in enumerate(kept) if lang == x]
        if len(own) > 1:
            pick[own[-1]] = True
    held = [r for r, p in zip(kept, pick) if p]
    rest = model_of([r for r, p in zip(kept, pick) if not p]) if held else model
    flat = [(lang, s) for lang, segs in held or kept for s in segs if len(s) >= 12 or (len(s) >= 5 and _SPACELESS.search(s))]
    limit = np.zeros(len(langs))
    if flat:
        ent, _ = rest.entropy([s for _, s in flat])
        of = np.array([lang for lang, _ in flat])
        for j, x in enumerate(langs):
            if x in seen:
                told = ent.argmin(1) == j  # segments that another language explains better have a wrong label
                own, other = ent[(of == x) & told, j], ent[(of != x) & ~told, j]
                most = float(np.quantile(other, OTHER_QUANTILE)) if len(other) else float(np.log(VOCABULARY))
                least = float(np.quantile(own, OWN_QUANTILE)) if len(own) else 0.0
                limit[j] = min(most, least + TOWARDS_OTHERS * (most - least))
    model.limit = limit
    return model


#: A segment counts for another language than that of its text if it is exp(MARGIN) times as likely there.
MARGIN = 5.0


def languages(model: CharModels, segments: list[str], sizes: list[int]) -> list[tuple[str | None, float, list[str], list[tuple[str | None, float]]]]:
    """For each text of sizes[k] consecutive cleaned segments: its language, the confidence, all languages
    it is written in, and language and confidence of each segment.

    The text's language is that of most segments (ties: of most letters).  Another language is in the
    text if at least two segments are in it; segments too short to tell follow the text.
    """
    top, conf, ll = model.choose(segments)
    out, at = [], 0
    for n in sizes:
        t, c, w = top[at : at + n].copy(), conf[at : at + n].copy(), ll[at : at + n]
        own = segments[at : at + n]
        letters = np.array([len(s) for s in own])
        short = np.array([len(s) < (5 if _SPACELESS.search(s) else 12) for s in own], bool)
        at += n
        if not (t >= 0).any():
            out.append((None, 0.0, [], [(None, 0.0)] * n))
            continue
        for _ in range(2):
            votes = np.bincount(t[t >= 0], minlength=len(model.langs)) + np.bincount(t[t >= 0], letters[t >= 0], len(model.langs)) * 1e-7
            main = int(votes.argmax())
            weak = (t >= 0) & (t != main)
            weak[weak] = (w[weak, t[weak]] - w[weak, main] <= MARGIN) | short[weak]
            t[weak] = main
        votes = np.bincount(t[t >= 0], minlength=len(model.langs))
        inside = [main, *(j for j in np.argsort(-votes, kind="stable") if j != main and votes[j] >= 2)]
        share = float(c[t == main].mean()) * float(votes[main] / votes.sum())
        out.append((model.langs[main], round(share, 4), [model.langs[j] for j in inside], [(model.langs[j] if j >= 0 else None, round(float(x), 4)) for j, x in zip(t, c)]))
    return out
