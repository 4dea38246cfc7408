"""Languages, text kinds and mixing on small inputs; no Spark."""

import itertools
import random

import numpy as np
import pytest

from marginalia.llm import langid, mix, quality

EN = "The night shift checks every box at the second depot. Who pays when the kettle is late? We bring labels to the office. Nobody had ordered the heater."
FR = "La direction garde toujours un câble de réserve. Qui a déplacé le carton hors du magasin? Si le filtre est abîmé, écrivez à la comptabilité."
JA = "夜勤班は正午までに本社で荷物を一つずつ確認します。なぜ加湿器は遅れたのか？古い札は機械で読めないので、新しい札が必要だ。"
VI = "Ca đêm kiểm tra từng thùng hàng tại kho lạnh. Vì sao nồi cơm đến muộn? Nếu quạt điện bị hỏng, hãy gửi yêu cầu cho phòng kế toán."


def segments(text):
    import regex

    return [langid.clean(s) for s in regex.split(r"(?<=[.?。？])\s*", text) if s]


@pytest.fixture(scope="module")
def models():
    rows = [(lang, segments(t)) for lang, t in (("en", EN), ("fr", FR), ("ja", JA), ("vi", VI)) for _ in range(12)]
    rows += [("fr", segments(EN))]  # a wrong label
    return langid.train(rows)


def test_held_out_sentences(models):
    held = [("en", "The crew keeps one kettle at the office."), ("fr", "La direction écrit à la comptabilité."), ("ja", "本社は新しい荷物を確認します。"), ("vi", "Phòng kế toán kiểm tra quạt điện."), ("vi", "phong ke toan kiem tra quat dien")]
    top, conf, _ = models.choose([langid.clean(t) for _, t in held])
    assert [models.langs[k] for k in top] == [x for x, _ in held]
    assert (conf > 0.5).all()


def test_rejection_and_empty_segments(models):
    top, conf, _ = models.choose(["", "ῥᾴδιον γὰρ ἔσται τοῖς"])
    assert top.tolist() == [-1, -1] and conf.tolist() == [0, 0]
    assert models.choose([])[0].tolist() == []


def test_probabilities_sum_to_at_most_one(models):
    chars = sorted({c for t in (EN, JA) for c in t.lower()})
    keys = np.array([(ord("t") << 32) | (ord("h") << 16) | ord(c) for c in chars], np.uint64) | (np.uint64(ord(" ")) << np.uint64(48))
    assert (models._prob(4, keys).sum(0) <= 1.0001).all()


def test_mixed_texts(models):
    a, b = segments(EN), segments(JA)
    (main, conf, langs, each), (one, *_), (none, *_rest) = langid.languages(models, [*a, *b[:2], *a, b[0], ""], [len(a) + 2, len(a) + 1, 1])
    assert (main, langs, one, none) == ("en", ["en", "ja"], "en", None)
    assert 0 < conf <= 1 and len(each) == len(a) + 2


@pytest.mark.parametrize(("label", "code"), [("EN", "en"), ("en_GB", "en"), ("Tiếng Việt", "vi"), ("日本語", "ja"), ("zh-Hans-CN", "zh"), ("deu", "de"), ("vi/en", None), ("mul", None), ("", None), (None, None)])
def test_labels(label, code):
    assert langid.label_code(label) == code


PROSE = ["No.", "What happens then?!", EN, FR, JA, VI, "- The crew checks every box.\n- We bring labels to the office.", "THE CREW CHECKS EVERY BOX AT NOON.", "# Title\n\n" + EN + "\n\n- kettle\n- box\n", EN + "<|im_end|>"]
LISTS = ["- kettle\n- box\n- night shift\n- heater K-1", "kettle\nbox / shelf\nheater K-20\nnight shift\nlabel roll", "kettle, box, heater, night shift, label roll, front desk", "We sell these.\n1. kettle\n2. box\n3. heater\n4. label roll", "電気ケトル\n値札 / 契約担当\n梱包室\n在庫の決まり\n加湿器"]
TABLES = ["| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |", "sku;name;qty\nK-1;kettle;3\nK-2;box;5\nK-3;heater;7", "K-1\tkettle\t3\nK-2\tbox\t5\nK-3\theater\t7", "K-1    12.5   33.1\nK-22    2.5    3.1\nK-333  99.0    8.8", "sku,name,place\nK-1,交換用フィルター,港の店舗\nK-2,値札,本社\nK-3,掃除機,本社"]
JUNK = ["�" * 80, "hahaha" * 30, "Back to top\n" * 12, "lorem " * 60, "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgdGV4dCBmb3IgdGVzdA" * 4, "12:01:02.123 [w1] ERR 0x1f2e3d4c rc=2\n" * 6, "PhÃ²ng káº¿ toÃ¡n kiá»ƒm tra quáº¡t Ä‘iá»‡n. KhÃ´ng.", "sdkfj qwxzv dkfjw; xcvqz jkqwe; zxcvj qjxkz wvzxq", "<div class='a'><br/><td>&nbsp;</td></div>" * 6]


@pytest.mark.parametrize(("text", "kind"), [*((t, "prose") for t in PROSE), *((t, "list") for t in LISTS), *((t, "table") for t in TABLES), *((t, "junk") for t in JUNK)])
def test_kinds(text, kind):
    assert quality.classify(text) == kind


def test_empty_texts_have_no_kind_and_zero_features():
    for t in (None, "", " \n　"):
        assert quality.classify(t) is None
        assert len(quality.features(t)) == len(quality.FEATURES) and not any(quality.features(t)[1:])
    named = dict(zip(quality.FEATURES, quality.features(TABLES[1])))
    assert named["delimiter_alignment"] == 1 and named["n_lines"] == 4


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for t in ("x" * 30_000, "a@" * 10_000, "ab " * 10_000, "{" * 10_000, "1 " * 10_000, "[" * 20_000, "a" + " " * 20_000, "a. " * 10_000):
        quality.classify(t)
        langid.clean(t)
    assert time.time() - began < 20


def test_knapsack_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        lens = rng.sample(range(1, 15), 3)
        counts = [rng.randint(0, 4) for _ in lens]
        budget = rng.randint(0, 60)
        best = max(s for n in itertools.product(*(range(c + 1) for c in counts)) if (s := sum(a * b for a, b in zip(n, lens))) <= budget)
        got = mix.knapsack(lens, counts, budget)
        assert sum(a * b for a, b in zip(got, lens)) == best and all(g <= c for g, c in zip(got, counts))


def test_fit_reaches_the_greatest_sum_and_is_unbiased():
    rng = np.random.default_rng(2)
    lens = np.arange(1, 900)
    counts = rng.integers(1, 40, len(lens))
    total = int((lens * counts).sum())
    for budget in (0, 1, 17, total // 3, total - 1, total, total * 2):
        take = mix.fit(lens, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        assert int((take * lens).sum()) == min(budget, total)
    take = mix.fit(lens, counts, total // 2)
    assert abs((take * lens).sum() / take.sum() - (counts * lens).sum() / counts.sum()) < 40
    assert mix.fit(np.array([0, 5]), np.array([3, 1]), 4).tolist() == [0, 0]
    assert mix.fit(np.array([4, 6]), np.array([10**6, 10**6]), 4_000_003).dot([4, 6]) == 4_000_002


def test_fit_equals_brute_force_whatever_the_window():
    assert mix.fit(np.array([140_000, 300_000]), np.array([2, 1]), 290_000).tolist() == [2, 0]
    rng = random.Random(5)
    for k in range(150):
        lens = np.array(sorted(rng.sample(range(1, 60) if k % 2 else range(1_000, 90_000), rng.randint(1, 4))))
        counts = np.array([rng.randint(1, 3) for _ in lens])
        budget = rng.randint(1, int((lens * counts).sum()))
        best = max(t for n in itertools.product(*(range(c + 1) for c in counts)) if (t := int(np.dot(n, lens))) <= budget)
        take = mix.fit(lens, counts, budget, window=rng.choice((8, 64, 1 << 15)))
        assert int(take.dot(lens)) == best and (take <= counts).all()


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("K-01;kettle\nK-02;box\nK-03;night heater", "table"),
        ("K-01 | kettle\nK-02 | box\nK-03 | label roll", "table"),
        ("kettle;red-1\nbox;blue-3-xx\nheater;red-2\nroll;green-8x\nshelf;blue-44\nfan;black-x-12", "table"),
        ("\n".join(["Home page", "Read more here", "Contact us now", "Back to the top"] * 6), "junk"),
        ("We met at noon; nobody was late.\nWe wrote it down; it was long.\nWe left at two; it was raining.", "prose"),
        ("kettle | red\nbox | blue and green\nheater unit | black\nroll | white", "list"),
        ("kettle, red\nbox, blue\nheater, green\nroll, black", "list"),
    ],
)
def test_two_columns_and_several_repeated_lines(text, kind):
    assert quality.classify(text) == kind


#: Wording and languages that the operator was not built on.
HELD_OUT_PROSE = [
    "Gardeners prune roses each spring. Sparrows build nests under eaves. Rivers carry silt toward oceans.",
    "Il gatto dorme sul divano. La pioggia cade da ieri sera. Domani partiremo presto verso le montagne.",
    "Nonostante la tempesta, i pescatori uscirono all'alba. Tornarono soltanto tre barche.",
    "Kot śpi na kanapie. Od wczoraj pada deszcz. Jutro wcześnie wyruszymy w góry. Mimo burzy rybacy wypłynęli o świcie.",
    "Кот спит на диване. Вчера весь день шёл дождь. Завтра рано утром мы отправимся в горы.",
    "Рыбаки вышли в море на рассвете. Вернулись только три лодки.",
    "القط ينام على الأريكة. هطل المطر منذ مساء أمس. سنغادر غدا مبكرا نحو الجبال.",
    "El perro corre por la playa. Nadie sabía dónde estaban las llaves. ¿Vendrás mañana?",
    "Os pescadores saíram de madrugada. Só três barcos voltaram. A vila inteira esperava no cais.",
    "De kat slaapt op de bank. Gisteren regende het de hele dag. Morgen vertrekken we vroeg.",
    "Kedi kanepede uyuyor. Dün akşamdan beri yağmur yağıyor. Yarın erkenden dağlara gideceğiz.",
    "Photosynthesis converts sunlight into sugar. Mitochondria release energy. Cells divide.",
    "Volcanoes erupt without warning. Ash buried entire villages. Survivors fled toward higher ground. Scientists monitor tremors daily.",
    "Ancient astronomers charted eclipses carefully. Their tables predicted lunar cycles.",
    "猫はソファで眠っている。昨日から雨が降り続いた。明日の朝早く山へ出発する予定だ。",
    "火山は突然噴火し、村全体が灰に埋もれた。生き残った人々は高台へ逃げた。",
    "猫在沙发上睡觉。昨天下了一整天雨。明天一早我们出发去山里。",
    "火山突然爆发，整个村庄被灰烬掩埋。幸存者逃往高地。",
    "고양이가 소파에서 잔다. 어제부터 비가 내렸다. 내일 아침 일찍 산으로 떠난다.",
    "Con mèo ngủ trên ghế. Mưa rơi suốt đêm qua. Sáng mai chúng tôi lên núi sớm.",
    "Die Katze schläft auf dem Sofa. Seit gestern regnet es. Morgen brechen wir früh auf.",
    "Les pêcheurs partirent à l'aube. Trois barques revinrent. Le village entier attendait.",
    "Kucing itu tidur di sofa. Hujan turun sejak kemarin. Besok kami berangkat pagi.",
    "Katten sover på soffan. Det har regnat sedan igår. Imorgon åker vi tidigt.",
    "Gardeners prune roses each spring.\nSparrows build nests under eaves.\nRivers carry silt toward distant oceans.\nFarmers rotate crops every season.",
    "แมวนอนบนโซฟา ฝนตกตั้งแต่เมื่อวาน พรุ่งนี้เราจะออกเดินทางแต่เช้า",
    "Macska alszik a kanapén. Tegnap óta esik az eső. Holnap korán indulunk a hegyekbe.",
]
HELD_OUT_OTHERS = [
    ("list", "- tulip bulbs\n- garden hose\n- watering can\n- rose shears\n- gloves"),
    ("list", "apples, pears, quinces, walnuts, dried figs, honey"),
    ("list", "гвозди\nмолоток\nпила\nотвёртка\nклей"),
    ("list", "pomodori\nolio d'oliva\nbasilico fresco\nmozzarella\npane"),
    ("list", "1. Volcano\n2. Glacier\n3. River delta\n4. Coral reef\n5. Desert dune"),
    ("list", "りんご\nみかん\nぶどう\n柿\n梨"),
    ("list", "사과\n배\n포도\n감\n귤"),
    ("list", "- Berlin.\n- Hamburg.\n- München.\n- Köln.\n- Dresden."),
    ("table", "city;country;people\nOslo;Norway;709000\nBergen;Norway;291000\nTurku;Finland;195000"),
    ("table", "Planet     Moons   Mass\nMars       2       0.64\nVenus      0       4.87\nSaturn     146     568"),
    ("table", "nombre | edad | ciudad\n--- | --- | ---\nAna | 31 | Lima\nLuis | 28 | Quito"),
    ("table", "Zeit\tOrt\tGrad\n08:00\tHafen\t12\n09:00\tBerg\t7\n10:00\tTal\t15"),
    ("junk", "xkq vbnz qwrt zxcv pllk hgfd mnbv qazx wsxc edcv rfvb tgbn"),
    ("junk", "Click here to continue\nClick here to continue\nClick here to continue\nClick here to continue\nClick here to continue\nClick here to continue\nClick here to continue\nClick here to continue\nClick here to continue\n"),
    ("junk", "%7B%22a%22%3A%20%22b%22%7D%7B%22a%22%3A%20%22b%22%7D"),
    ("junk", "0x7ffee4 0x7ffee8: {}[]();;{}[]();; ##@@!!~~^^"),
]


def test_kinds_of_held_out_wording():
    cases = [("prose", t) for t in HELD_OUT_PROSE] + HELD_OUT_OTHERS
    wrong = [(want, got, t) for want, t in cases if (got := quality.classify(t)) != want]
    assert len(wrong) <= 0.05 * len(cases), wrong


def test_layout_decides_between_entries_and_sentences():
    even = "\n".join(f"quiet river stone {k}" for k in range(12))
    f = dict(zip(quality.FEATURES, quality.features(even)))
    assert f["length_autocorrelation"] > 0.1 and f["punctuated_line_share"] == 0 and quality.classify(even) == "list"
    rows = "\n".join(f"{'  ' * (k % 2)}- branch {k}" for k in range(10))
    assert dict(zip(quality.FEATURES, quality.features(rows)))["indent_periodicity"] > 0.5


def test_batches_equal_single_texts():
    texts = [None, "", *PROSE, *LISTS, *TABLES, *JUNK, "a\r\nb\u2028c", "e\u0301t\u00e9.", "😀 ok"]
    f, kinds = quality._all(texts)
    assert kinds == [quality.classify(t) for t in texts]
    assert [tuple(r) for r in f[[*quality.FEATURES]].itertuples(index=False)] == [quality.features(t) for t in texts]


UNSEEN = {
    "es": ["El perro corre por la playa mientras llueve.", "Nadie sabía dónde estaban las llaves de la casa.", "Mañana saldremos temprano hacia las montañas."],
    "it": ["Il gatto dorme sul divano da ieri sera.", "Nonostante la tempesta i pescatori uscirono all'alba.", "Domani partiremo presto verso le montagne."],
    "pt": ["Os pescadores saíram de madrugada e voltaram tarde.", "O preço do pão subiu outra vez este mês.", "Ninguém sabia onde estavam as chaves."],
    "nl": ["De kat slaapt al de hele dag op de bank.", "Morgen vertrekken we vroeg naar de bergen.", "Niemand wist waar de sleutels waren."],
    "id": ["Kucing itu tidur di sofa sejak kemarin sore.", "Besok kami berangkat pagi menuju pegunungan.", "Harga roti naik lagi bulan ini."],
    "ru": ["Кот спит на диване со вчерашнего вечера."], "zz": ["xkq vbnz qwrt zxcv pllk hgfd mnbv"],
}


def test_unseen_languages_are_rejected(data):
    pd = pytest.importorskip("pandas")
    from marginalia.llm.sentences import sentence_spans

    docs = pd.read_parquet(f"{data.replace('sf0.001', 'sf0.01')}/docs.parquet", columns=["lang", "text"]).dropna()
    labelled = [(code, [c for a, b in sentence_spans(t) if (c := langid.clean(t[a:b]))]) for label, t in zip(docs["lang"], docs["text"]) if (code := langid.label_code(label))]
    model = langid.train(labelled[::2])
    foreign = [langid.clean(t) for texts in UNSEEN.values() for t in texts]
    assert (model.choose(foreign)[0] >= 0).mean() <= 0.1
    own = [(code, s) for code, segs in labelled[1::2] for s in segs if len(s) >= 12]
    top, _, _ = model.choose([s for _, s in own])
    assert (top >= 0).mean() > 0.99


def test_supplementary_characters_are_told_apart():
    a, b = langid._codes(["𐐨𐐩"])[0], langid._codes(["𐐪𐐫"])[0]
    assert a[0] != b[0] and len(set(langid._codes(["𝒜𝒷😀"])[0].tolist())) == 4
