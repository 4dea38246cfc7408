"""Sentences, splitting, token counts and encoding on small texts; no Spark."""

import random
import time

import pytest
import regex

from marginalia.llm import encode, split, tokens
from marginalia.llm.sentences import final_word, lattice, opening_word, sentence_spans


def units(text):
    return [text[a:b] for a, b in sentence_spans(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Hill met us at 9:30 a.m. in Rm. 4. He left.", ["Dr. Hill met us at 9:30 a.m. in Rm. 4.", "He left."]),
        ("The truck leaves at 6 a.m. The door shuts.", ["The truck leaves at 6 a.m.", "The door shuts."]),
        ("It costs 3.5 kg vs. 4.1 kg, i.e. more. No. 5 is old. No. We go.", ["It costs 3.5 kg vs. 4.1 kg, i.e. more.", "No. 5 is old.", "No.", "We go."]),
        ('"Is it sealed?" asked the clerk. The sign says "Keep shut." We wait ... and go.', ['"Is it sealed?" asked the clerk.', 'The sign says "Keep shut."', "We wait ... and go."]),
        ("The box is dry.The line is dead... Did you see?!Each one.", ["The box is dry.", "The line is dead...", "Did you see?!", "Each one."]),
        ("Shipping to the U.K. depot takes days. Open https://a.example/b.html first.", ["Shipping to the U.K. depot takes days.", "Open https://a.example/b.html first."]),
        ("Am 12. Juni kommt d. h. bald Fr. Dr. Ulm. Ca. 3 kg.", ["Am 12. Juni kommt d. h. bald Fr. Dr. Ulm.", "Ca. 3 kg."]),
        ("« Scannez deux fois. » a noté la direction. Voir p. 3, chap. 2.", ["« Scannez deux fois. » a noté la direction.", "Voir p. 3, chap. 2."]),
        ('TP. Hồ Tây và Q. Năm dùng chung. PGS. Lạc nói: "Đừng mở!" Không.', ["TP. Hồ Tây và Q. Năm dùng chung.", 'PGS. Lạc nói: "Đừng mở!"', "Không."]),
        ("「開けるな！」「もう開けた。」という話が残る。（予備を置く。）次です。", ["「開けるな！」「もう開けた。」という話が残る。", "（予備を置く。）", "次です。"]),
        ("重さは2.4kg（箱を除く。）とされる。少し待って……それでも出荷する。切れた……。", ["重さは2.4kg（箱を除く。）とされる。", "少し待って……それでも出荷する。", "切れた……。"]),
        ("“请扫两遍。”夜班这样写道。等了一会儿……然后发出了。真的要扔掉吗？！", ["“请扫两遍。”夜班这样写道。", "等了一会儿……然后发出了。", "真的要扔掉吗？！"]),
        ('"두 번 읽으세요."라고 적었습니다. 비율이 올랐다. 네!', ['"두 번 읽으세요."라고 적었습니다.', "비율이 올랐다.", "네!"]),
    ],
)
def test_sentences(text, want):
    assert units(text) == want


def test_markdown_has_only_prose_units():
    text = "# Head\n\nFirst line\ngoes on. Second.\n\n- item one\n- [ ] item two.\n  2) deep\n\n> quoted text\n\n| a | b |\n|---|---|\n| c. | d. |\n\n```\ncode. Code.\n```\nlast"
    assert units(text) == ["First line\ngoes on.", "Second.", "item one", "item two.", "deep", "quoted text", "last"]


def test_ordinal_at_a_line_start_is_no_list_item():
    assert units("Bis zum\n12. Juni wird geprüft.") == ["Bis zum\n12. Juni wird geprüft."]


@pytest.mark.parametrize("text", [None, "", "  \n\t ", "　", "```\nonly code", "---\n\n***"])
def test_no_units(text):
    assert sentence_spans(text) == []


def test_spans_are_ordered_trimmed_and_fast_on_odd_texts():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice('ab. "「」。（）!?\n#-|1…あ漢，A') for _ in range(rng.randint(0, 120)))
        last = 0
        for a, b in sentence_spans(t):
            assert last <= a < b <= len(t) and t[a:b] == t[a:b].strip()
            last = b
    for long in ("(" * 20_000, '"「」' * 5_000, "a." * 20_000, "x" * 100_000, "。" * 20_000, "\n" * 20_000, " " * 20_000 + "x", "ますそ" * 8000, "「あ。」" * 6000, "……漢" * 9000, "あ" * 20_000 + "。"):
        began = time.time()
        sentence_spans(long)
        assert time.time() - began < 5, long[:4]


def test_lattice_prefers_longer_words():
    assert opening_word("という話") == "join"
    assert opening_word("とても良い") == "open"
    assert opening_word("二回") == "other"


def brute(text):
    cjk = lambda c: any(a <= ord(c) <= b for a, b in tokens.CJK_RANGES)
    total = 164 * text.count("\n") + sum(140 for c in text if c in "0123456789") + 51 * sum(map(cjk, text))
    total += 63 * sum(1 for c in text if not cjk(c) and not regex.match(r"[\p{L}\p{N}\p{White_Space}]", c))
    for w in regex.findall(r"[\p{L}\p{N}]+", "".join(" " if cjk(c) else c for c in text)):
        if w.strip("0123456789"):
            total += 101 if any(0xC0 <= ord(c) <= 0x1EF9 for c in w.strip("0123456789")) else 109
    return total


def odd_texts(n=300, seed=5):
    rng = random.Random(seed)
    alphabet = "ab1 \n.漢é가ば・-½²Ａ１é​😀"
    return ["", " ", "\n\n", "12", "a1b2", "1a", "日本語abc"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_estimate_equals_brute_force_in_all_three_ways():
    texts = odd_texts()
    want = [brute(t) for t in texts]
    assert [int(tokens.costs(t).sum()) for t in texts] == want
    assert tokens.estimate_tokenizer().counts(texts).tolist() == want
    assert tokens.estimate(None) == tokens.estimate("") == 0


def test_merges_equal_the_library():
    path = tokens.tokenizer_file("byte_bpe_50k.json")
    texts = odd_texts() + ["aaaaaaaaaaaaaaaa", "Don't we've IT'S", "x" * 500, "  two  blanks ", "漢字" * 100, "<|endoftext|>"]
    want = [len(x) for part in encode.encode(texts, path) for x in part]
    assert tokens.merge_tokenizer(path).counts([*texts, None]).tolist() == [*want, 0]


@pytest.mark.parametrize("text", odd_texts(60, 9) + ["word " * 900, "x" * 40_000, "a1" * 2000, "\n" * 900, "漢" * 3000, "# A\n\nb c.\n\n" * 300])
def test_pieces_cover_the_text_within_the_limits(text):
    pieces = split.split_text(text, 45, 8)
    if not text:
        assert pieces == []
        return
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    for p in pieces:
        assert tokens.estimate(text[p.start : p.end]) == p.tokens <= 45
    for p, q in zip(pieces, pieces[1:]):
        assert p.start < q.start <= p.end < q.end
        assert tokens.estimate(text[q.start : p.end]) == q.shared <= 8
    assert (len(pieces) > 1) == (tokens.estimate(text) > 45)


def test_pieces_of_text_without_sentences_share_words():
    text = " ".join(f"word{k % 7}" for k in range(3000))
    got = split.split_text(text)
    assert len(got) > 5 and all(0 < p.shared <= 40 for p in got[1:])


def test_costs_of_any_stretch():
    rng = random.Random(4)
    for t in [*odd_texts(40, 3), "a1" * 30, "1" * 40, "12ab34é5" * 6]:
        cost = split._Costs(t)
        for _ in range(40):
            a, b = sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))
            assert cost(a, b) == int(tokens.costs(t[a:b]).sum()), (t, a, b)


def test_long_runs_are_split_in_linear_time():
    began = time.time()
    for t in ("1" * 300_000, "a" * 300_000, "a1" * 150_000):
        split.split_text(t)
    assert time.time() - began < 10


def test_pieces_end_at_natural_boundaries():
    text = "\n\n".join(f"## Part {k}\n\n" + "The crew checks every box at noon. " * 12 for k in range(8))
    cuts = {p.cut for p in split.split_text(text)}
    assert cuts <= {"heading", "paragraph", "sentence", "end"}
    with pytest.raises(ValueError, match="limit"):
        split.split_text("a", 5, 5)


def test_encoding_round_trip_and_offsets():
    path = tokens.tokenizer_file("byte_bpe_50k.json")
    texts = [*odd_texts(), "👩‍🔧 <|endoftext|> ok", None]
    for t, ids in zip(texts, [x for part in encode.encode(texts, path, 40) for x in part]):
        t = t or ""
        assert encode.decode(ids, path) == t
        starts, ends = encode.offsets(ids, t, path)
        assert len(starts) == len(ids) and (not ids or (starts[0] == 0 and ends[-1] == len(t)))
        assert all(a < b for a, b in zip(starts, ends)) and all(s <= e for s, e in zip(starts[1:], ends))
    assert "�" in encode.decode(next(x for part in encode.encode(["😀"], path) for x in part)[:1], path)


#: Texts with the number of their sentences: abbreviations and languages that the operator was not built on.
HELD_OUT = [
    ("See Sect. 4 of the atlas. Pt. 3 lists rivers.", 2),
    ("The bldg. on Elm Blvd. is old. Nobody lives there.", 2),
    ("Gov. Reyes met Lt. Gov. Oduya at 4 p.m. on Tuesday. They spoke briefly.", 2),
    ("Vgl. Abs. 3 Satz 2. Das gilt bis zum 3. Oktober.", 2),
    ("Il dott. Bianchi arrivò alle 9.30. La visita durò un'ora.", 2),
    ("El Sr. Gómez vive en la c. Mayor. Tiene 3.5 hectáreas.", 2),
    ("J. R. R. Tolkien wrote it. C. S. Lewis read it.", 2),
    ("It weighs 3.5 kg. The lid is loose. Version 2.0.1 works.", 3),
    ("Он приехал в 5 ч. утра. Дождь шёл весь день.", 2),
    ("猫はソファで眠っています 明日は山へ行きます", 2),
    ("猫が寝ていますそして犬が走ります", 2),
    ("你吃饭了吗 我们走吧", 2),
    ("你知道吗因为下雨我们没去", 2),
    ("火山喷发了。幸存者逃往高地！村庄怎么样？", 3),
    ("ឆ្មាដេក។ ភ្លៀងធ្លាក់។", 2),
    ("แมวนอนบนโซฟา เมื่อวานฝนตกหนัก พรุ่งนี้เราจะออกเดินทาง", 3),
    ("बिल्ली सो रही है। कल बारिश हुई।", 2),
    ("“来了吗？”他问。“来了。”她说。", 2),
    ("彼は「もう行く。」と言った。雨だった。", 2),
    ("待っている……しかし来ない。", 1),
    ("雨が止んだ……猫が鳴いた。", 2),
    ("هل نام القط؟ نزل المطر أمس.", 2),
    ("We measured 4.2 cm vs. 3.9 cm. Approx. 5 of 9 passed, e.g. Nos. 3 and 7. Fine.", 3),
    ("The firm Acme Inc. sells nails. It moved to St. Gallen in Sept. 2019.", 2),
    ("Visit www.example.org/a.b for more. Or don't!", 2),
    ("고양이가 잔다. 비가 온다! 정말?", 3),
    ("Ông Nguyễn V. An đến TP. Huế. Trời mưa.", 2),
    ("She said \"Wait.\" and left. He stayed.", 2),
    ("(This is odd.) That is not.", 2),
    ("What?! No way... really. Yes.", 3),
]


def test_held_out_sentences():
    wrong = [(n, units(t)) for t, n in HELD_OUT if len(units(t)) != n]
    assert len(wrong) <= 0.1 * len(HELD_OUT), wrong


def test_lattices_on_both_sides_of_a_gap():
    assert lattice("それでも", "head_ja") == (("それでも", "link"),)
    assert [k for _, k in lattice("行きましたから", "tail_ja")][-1] == "mid"
    assert final_word("雨が止んだ", 5) == "final" and final_word("待って", 3) == "mid" and final_word("漢字", 2) == ""
    assert opening_word("然后发出", 0, "head_zh") == "link" and opening_word("的门", 0, "head_zh") == "join"
    assert opening_word("あ" * 5000) == "other"
    assert units("少し待って……それて\u3099も出る。") == ["少し待って……それて\u3099も出る。"]


def test_no_cap_on_quotations_or_brackets():
    assert units("「はい。」" * 40 + "と言った。次だ。") == ["「はい。」" * 40 + "と言った。", "次だ。"]
    deep = "(" * 60 + "a." + ")" * 60
    assert units(f"{deep} b can. Next one.") == [f"{deep} b can.", "Next one."]
