"""Scalar functions and markdown parsing on small values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import columns as C
from marginalia.functions import markdown as M
from marginalia.functions.terms import stem, terms_text


def one(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_fold(spark):
    values = [None, "", "ABC", "Điện Máy", "ｋｈảｏ", "が㎏", "Ｅ́"]
    assert one(spark, values, C.fold) == [None, "", "abc", "dien may", "khao", "がkg", "e"]
    latin = ["Điện Máy", "ÀÉÎõü", "ｋｈảｏ　ｓáｔ", "plain"]
    assert one(spark, latin, C.fold_native) == [C.fold_text(x) for x in latin]


def test_tags_and_ids(spark):
    assert one(spark, [None, "", " --a__B  c- ", "x　y"], C.normalize_tag) == [None, "", "a-b-c", "x-y"]
    assert one(spark, ["a/b.md", "./a.md", "../a.md", "a//b.md", "/a.md", "a.txt", None], C.concept_id) == ["a/b", "a", None, None, None, None, None]
    assert one(spark, ["./a/b.md", "/x", None], C.normalize_id) == ["a/b", "x", None]
    assert one(spark, ["a/b/c", "c", "", None], C.id_dir) == ["a/b", "", "", None]
    assert one(spark, ["a/index", "log", "a/logs"], C.is_reserved) == [True, True, False]
    kinds = ["help/faq", "docs/guides/linux", "adr-1", "x/adr/y", "a/b", "guides/api/x", "my-changelog", "policies"]
    assert one(spark, kinds, C.guess_type) == ["FAQ", "Guide", "Decision", "Decision", "Document", "Reference", "Release Notes", "Document"]
    assert one(spark, ["getting-started_guide", "--"], C.title_from_name) == ["Getting started guide", "--"]
    assert one(spark, ["Case Study", "Policy", "Process", "Guide"], C.type_dir) == ["case-studies", "policies", "processes", "guides"]


def test_values(spark):
    assert one(spark, ["2026-01-01", "2026-99-99T1", "2026-1-1", "x2026-01-01", None], C.is_iso_date) == [True, True, False, False, False]
    assert one(spark, ["12", " 12", "1e3", ".5", "x", None], C.number_of_text) == [12.0, None, 1000.0, 0.5, None, None]
    assert one(spark, [0.0, 45000.0, 45000.5, -1.0, None], C.excel_date, "double") == ["1899-12-30", "2023-03-15", "2023-03-15 12:00:00", None, None]
    assert one(spark, [3.0, 3.5, None], C.fmt_num, "double") == ["3", "3.5", None]
    assert one(spark, ["1.234,5 and 7."], C.numbers_in) == [[7.0, 12345.0]]
    assert one(spark, ["2,647 and 2.647, 1.5.", None, "x"], C.numbers_in) == [[1.5, 2.647, 15.0, 2647.0], None, []]
    assert one(spark, ["日本", "Điện", "plain", "12", None], C.detect_lang) == ["ja", "vi", "en", None, None]
    assert one(spark, ["**b** [t](u) ![i](j) [[a|b]] [[c#d]] x[^1] <b>y</b>"], C.clean_inline) == ["b t i b c x y"]
    json = lambda f: lambda c: f(F.parse_json(c))
    assert one(spark, ['"a"', "1", "true", "null", "[1]", '{"a":1}'], json(C.scalar_text)) == ["a", "1", "true", None, None, None]
    assert one(spark, ['"1"', "1", "1.5", "true"], json(C.as_number)) == [None, 1.0, 1.5, None]


def test_vectors(spark):
    v = one(spark, [[3.0, 4.0], [0.0, 0.0], None], C.l2_normalize, "array<float>")
    assert v == [[0.6, 0.8], [0.0, 0.0], None]


TOKENS = [None, "", "hello world", "日本語", "a1b2 12", "x\ny", "điện máy", "don't stop.", "½ ²"]


def test_tokens_agree(spark):
    assert one(spark, TOKENS, C.estimate_tokens) == [M.tokens(t) for t in TOKENS]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 é漢\n.,"))
def test_chunks_keep_all_lines(body):
    got = M.chunks(body)
    assert [c.ord for c in got] == list(range(len(got)))
    assert "".join("".join(c.text for c in got).split()) == "".join(body.split())
    assert all(c.start_line <= c.end_line and c.tokens == M.tokens(c.text) for c in got)


def test_chunk_rules():
    big = "word " * 200
    got = M.chunks(f"intro\n## A\nshort\n### B\nshort too\n## C\n{big}\n## D\n" + "\n".join([big] * 4))
    assert [c.heading for c in got] == ["", "D", "D"]
    assert got[0].text.startswith("intro\n## A") and "## C" in got[0].text  # joined while below 150
    assert all(c.tokens <= 450 for c in got)
    assert len(M.chunks("x" * 3000 + " y" * 900)) > 1
    assert M.chunks("```\n## no heading\n```\ntext")[0].heading == ""
    assert M.chunks(None) == M.chunks(" \n") == []


@pytest.mark.parametrize(
    ("text", "state", "body"),
    [("x", "absent", "x"), ("---\na: 1\n---\nB", "valid", "B"), ("\ufeff---\r\na: 1\r\n---\r\nB", "valid", "B"), ("---\na: 1\n", "unterminated", "---\na: 1\n"), ("---\n- 1\n---\n", "invalid", ""), ("---\na: [\n---\nB", "invalid", "B"), ("---\n---\nB", "valid", "B"), ("----\nB", "absent", "----\nB")],
)
def test_metadata_block(text, state, body):
    p = M.parse_document(text)
    assert (p.state, p.body) == (state, body)


def test_yaml_keeps_texts():
    assert M.parse_document("---\nd: 2026-01-01\no: on\nt: 12:30\nn: 1.5\nb: true\nz: ~\nl: [a, 1]\n---\n").meta == '{"d": "2026-01-01", "o": "on", "t": "12:30", "n": 1.5, "b": true, "z": null, "l": ["a", 1]}'


def test_sections_and_cuts():
    body = "# T\na\n## One two\nb\n### Sub\nc\n## Three\nd\n```\n## no\n```\n"
    assert M.headings(body) == [(1, "T", 1), (2, "One two", 3), (3, "Sub", 5), (2, "Three", 7)]
    assert M.section(body, "ONE", C.fold_text) == "## One two\nb\n### Sub\nc"
    assert M.section(body, "none", C.fold_text) is None
    text, cut = M.cut_to_tokens("one two three\n" * 50, 20)
    assert cut and M.tokens(text) <= 20 and text.startswith("one")
    assert M.cut_to_tokens(None, 5) == ("", False)
    assert M.cut_to_tokens("x" * 500 + "1" * 400, 10)[0] == "x" * 30


def test_links():
    body = "[a](b.md) ![i](c.png \"t\") [[W|w]] `[no](x.md)`\n```\n[no](y.md)\n```\n[b [c]](<d e.md>)"
    assert M.links(body) == [("b.md", "a", "markdown", 1), ("c.png", "i", "markdown", 1), ("W", "w", "wiki", 1), ("d e.md", "b [c]", "markdown", 5)]
    r = lambda t, s="a/b": M.resolve_link(s, t)
    assert [r("c.md"), r("../c.md#x"), r("/x/y.md?q"), r("d/"), r("../../c.md"), r("http://x/y.md"), r("#a"), r("c.png"), r("c%20d.md"), r("", "x")] == ["a/c", "c", "x/y", "a/d/index", None, None, None, None, "a/c d", None]


def test_first_sentence():
    body = "# H\n\n<div>\nskip\n</div>\n\n| a |\n\n:::note\nskip this text\n:::\n\nUse the short form, e.g. this one, when you label a thing. Then more.\n"
    assert M.first_sentence(body) == "Use the short form, e.g. this one, when you label a thing."
    assert M.first_sentence("- a list item that is long enough to be one. Yes") == "a list item that is long enough to be one."
    assert M.first_sentence("# only\n\n![x](y)") is None
    assert M.first_sentence("word " * 100).endswith("…") and len(M.first_sentence("word " * 100)) <= 200
    wide = "Der Fluss fließt. " + "Eine lange Zeile ohne Ende, " * 3
    assert M.first_sentence(f"<p>no</p>\n~~~\ncode. Code here.\n~~~\n> quoted text here\n\n{wide}") == wide.strip()
    assert M.first_sentence("<div><b>x</b>\n\ninside text is skipped too.\n</div>\n\nWas danach kommt, ist der Text, der zählt.") == "Was danach kommt, ist der Text, der zählt."
    assert M.first_sentence("火山は突然噴火した。次の文。") == "火山は突然噴火した。次の文。"
    assert M.first_sentence(None) is None and M.first_sentence("```\nnever closed, all of it code") is None
    assert M.first_h1("```\n# no\n```\n# Yes *it* is #\n") == "Yes it is"


def test_terms():
    assert [stem(w) for w in ("running", "policies", "connection", "happily", "generously", "skies", "hopping", "hoping")] == ["run", "polici", "connect", "happili", "generous", "sky", "hop", "hope"]
    assert terms_text("Running 日本語 Máy, x") == ["run", "日本", "本語", "may", "x"]
    assert terms_text(None) == terms_text("!!") == []
