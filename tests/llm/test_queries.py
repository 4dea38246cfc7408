"""The operators on tables: production data at the smallest scale, odd rows, empty tables, clashing names."""

import math

import pytest
from pyspark.sql import functions as F

from marginalia.llm import corpus, encode, langid, mix, quality, queries, split, tags, tokens

DOCS = "id string, mtime_ns bigint, tokens bigint, lang string, type string, text string, k string, t string, rank_ int"
LONG = "The crew checks every box at noon and writes a note. " * 60


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [
        ("a/1", 1, 5, "en", "X", "old", "k", "t", 1),
        ("a/1", 2, 5, "en", "X", LONG, "k", "t", 1),
        ("a/1", 2, 5, "en", "X", LONG, "k", "t", 1),
        ("a/2", None, None, None, None, None, None, None, None),
        ("a/3", 7, 0, "?", "", "", "", "", 0),
        ("a/4", 7, -4, "fr", None, "　\n", None, None, None),
        (None, 9, 1, "en", "X", "no id", "k", "t", 1),
        ("b", 1, 16, "EN", "X", "Two boxes came. One was open. We sent it back.", "k", "t", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_pieces(odd_docs, no_docs):
    got = split.current_pieces(odd_docs).orderBy("piece_no").collect()
    assert {r["id"] for r in got} == {"a/1"} and len(got) > 1 and got[0]["text"] == LONG[: got[0]["end_pos"]]
    assert ids(split.current_pieces(odd_docs, only_oversized=False).filter("piece_no = 0")) == ["a/1", "b"]
    assert split.current_pieces(no_docs).count() == 0


def test_token_counts(odd_docs, no_docs):
    got = {r["id"]: r for r in corpus.token_counts(odd_docs).collect()}
    assert sorted(got) == ["a/1", "a/2", "a/3", "a/4", "b"]
    assert got["a/1"]["counted"] == tokens.estimate(LONG) and not got["a/1"]["usable"]
    assert got["a/2"]["budgeted"] == got["a/3"]["budgeted"] == 0
    assert got["b"]["budgeted"] == (16 if got["b"]["usable"] else got["b"]["counted"])
    budget = corpus.token_budget(odd_docs).collect()
    assert sum(r["documents"] for r in budget) == 5
    assert {r["lang"] for r in budget} == {"en", "fr", None}  # EN and en add up, `?` is no language
    assert corpus.token_budget(no_docs).count() == 0


def test_sentences(odd_docs, no_docs):
    from marginalia.tables import current_rows

    got = corpus.sentences(current_rows(odd_docs, "id", "text"))
    assert got.filter("id = 'b'").count() == 3 and got.filter("id = 'a/1'").count() == 60
    assert set(ids(got)) == {"a/1", "b"}
    assert corpus.sentences(current_rows(no_docs, "id", "text")).count() == 0


def test_languages(spark, odd_docs, no_docs):
    fr = "Les cartons sont arrivés au magasin. La direction garde un câble. Qui a noté le poids ?"
    rows = odd_docs.select("id", "lang", "text").unionByName(spark.createDataFrame([(f"fr/{i}", "fr", f"{fr} {i}") for i in range(12)] + [(f"en/{i}", "en", LONG[: 53 * 8] + str(i)) for i in range(12)], "id string, lang string, text string"))
    mixed = spark.createDataFrame([("mix", "en", LONG[: 53 * 3] + "\n\n" + fr), ("none", None, fr)], "id string, lang string, text string")
    models = corpus.language_models(rows)
    got = {(r["id"], r["lang"]) for r in corpus.language_corrections(mixed, models).collect()}
    assert got == {("mix", "en"), ("mix", "fr"), ("none", "fr")}
    assert corpus.language_corrections(no_docs, models).count() == 0
    assert corpus.text_languages(mixed, models, segments=True).filter("lang is not null").count() == 9
    empty = corpus.language_models(no_docs)  # nothing to learn from: everything is rejected
    assert corpus.text_languages(mixed, empty).filter("language is not null").count() == 0


def test_label_expression_equals_the_function(spark):
    labels = [None, "", " ", "EN", "en_GB", "Tiếng Việt", "zh-Hans-CN", "vi/en", "und", "?", "日本語", "eng", "français", "xx-yy"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string").select("i", corpus.label_sql(F.col("x")).alias("c"), corpus.label_missing_sql(F.col("x")).alias("m")).orderBy("i").collect()
    assert [r["c"] for r in rows] == [langid.label_code(x) for x in labels]
    assert [r["m"] for r in rows] == [langid.label_missing(x) for x in labels]


TERMS = [("store-policy", ["house rule of stores", "店舗規程", ""], None), ("store-audit", None, "x"), ("finance-audit", ["kiểm toán tài chính", None], "x"), (None, ["nothing"], None), (" ", ["blank"], None)]
VALUES = {
    "Store Policy": "store-policy", "stroe-policy": "store-policy", "＃ｓｔｏｒｅ－ｐｏｌｉｃｙ": "store-policy", "policy, store": "store-policy", "店舗規程（社内）": "store-policy", "st0r3-p0l1cy": "store-policy",
    "finan. audit": "finance-audit", "Kiem toan tai chinh": "finance-audit", "re: FinanceAudit": "finance-audit", "finance-audits/2025": "finance-audit", "house rule off stores": "store-policy",
    "audit": "(none)", "store": "(none)", "chess club": "(none)", "2025-01-01": "(none)", "???": "(none)", "店舗": "(none)", "nothing": "(none)",
}


def test_tags(spark):
    terms = spark.createDataFrame(TERMS, "tag string, synonyms array<string>, facet string")
    rows = [("d", i, v, None, "x") for i, v in enumerate(VALUES)] + [("d", 0, "Store Policy", None, "x"), ("e", 1, None, "store-policy", "x"), ("e", 2, " ", None, "x"), ("e", 3, "store-policy", "store-policy", "x"), ("e", 4, "store-policy", "finance-audit", "x"), ("e", 5, "chess", "old", "x")]
    doc_tags = spark.createDataFrame(rows, "doc_id string, ord int, tag string, canonical string, key string")
    got = {r["tag"]: r["canonical"] for r in tags.resolve(doc_tags, terms).collect()}
    assert {k: got[k] for k in VALUES} == VALUES
    found = {(r["doc_id"], r["ord"]): r["canonical"] for r in tags.misplaced(doc_tags, terms).collect()}
    assert found == {**{("d", i): v for i, v in enumerate(VALUES.values())}, ("e", 4): "store-policy", ("e", 5): "(none)"}
    assert tags.misplaced(doc_tags.limit(0), terms).count() == 0
    assert set(r["canonical"] for r in tags.resolve(doc_tags, terms.limit(0)).collect()) == {"(none)"}


def test_ties_mean_none(spark):
    terms = spark.createDataFrame([("board-one", None), ("board-two", ["board"]), ("board-six", ["board"])], "tag string, synonyms array<string>")
    doc_tags = spark.createDataFrame([("d", 1, "board", None)], "doc_id string, ord int, tag string, canonical string")
    assert tags.resolve(doc_tags, terms).first()["canonical"] == "(none)"


def test_encoding(spark):
    rows = [(1, "hi <|endoftext|>", 0), (2, "", 0), (3, None, 0), (4, "  ", 0), (4, "  ", 0), (5, "x" * 200_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, k int")
    got = [(r["doc_id"], r["ids"]) for r in encode.encoded(docs).orderBy("doc_id").collect()]
    path = tokens.tokenizer_file("byte_bpe_50k.json")
    assert [g[1] for g in got[1:3]] == [[], []] and len(got) == 6
    assert all(encode.decode(i, path) == (t or "") for (_, i), (_, t, _) in zip(got, rows))
    off = encode.encoded_offsets(docs)
    assert off.filter("not round_trip").count() == 0
    assert encode.encoded(docs.limit(0)).count() == 0


def test_mixture(spark):
    rows = [(i, "box " * (i % 7 + 1) + str(i), s) for i, s in enumerate(["Big One"] * 300 + ["big_one", "small"] + ["small"] * 9 + [None, "other"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big-one", 1.0, 2), ("SMALL", 3.0, 3), ("gone", 1.0, None), ("idle", 0.0, 1), (None, 5.0, 1), ("null", None, 1)], "source string, weight double, max_repeats int")
    chosen, report = mix.mixture(docs, targets)
    rep = {r["source"]: r for r in report.collect()}
    assert sorted(rep) == ["big-one", "gone", "idle", "null", "small"]
    assert {s for s, r in rep.items() if not r["reachable"]} == {"gone", "small"}
    assert math.isclose(sum(r["target_share"] for r in rep.values()), 1) and math.isclose(sum(r["reached_share"] for r in rep.values()), 1)
    got = {r["source"]: (r["size"], r["most"]) for r in chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("size"), F.max("copies").alias("most")).collect()}
    assert got["big-one"] == (rep["big-one"]["reached_tokens"], 1) and got["small"] == (rep["small"]["reached_tokens"], 3)
    assert abs(got["big-one"][0] - rep["big-one"]["target_tokens"]) <= 1
    none, empty = mix.mixture(docs.limit(0), targets)
    assert none.count() == 0 and {r["source"] for r in empty.collect()} == set(rep)


def test_mixture_repeats_whole_passes(spark):
    docs = spark.createDataFrame([(i, f"box box {i:02} ", "a") for i in range(10)] + [(100 + i, f"box box {i:02}. ", "b") for i in range(90)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 1)], "source string, weight double, max_repeats int")
    chosen, report = mix.mixture(docs, targets)
    copies = [r["copies"] for r in chosen.filter("source = 'a'").collect()]
    assert len(copies) == 10 and max(copies) - min(copies) <= 1 and min(copies) >= 4
    assert all(abs(r["reached_share"] - 0.5) < 0.01 for r in report.collect())


def test_mixture_counts_equal_texts_as_one(spark):
    docs = spark.createDataFrame([(i, "same text", "a") for i in range(50)] + [(100 + i, f"other {i}", "a") for i in range(5)] + [(200 + i, f"b text {i}", "b") for i in range(50)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2), ("b", 1.0, None)], "source string, weight double, max_repeats int")
    chosen, report = mix.mixture(docs, targets)
    got = {r["doc_id"]: r["copies"] for r in chosen.filter("source = 'a'").collect()}
    assert got == {0: 2, **{100 + i: 2 for i in range(5)}}
    row = report.filter("source = 'a'").first()
    assert (row["documents"], row["texts"], row["reachable"]) == (55, 6, True)


def test_statistics(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a;b;c\nd;e;f\ng;h;i", 1)], "doc_id bigint, text string, kind int")
    got = {r["doc_id"]: r for r in quality.statistics(docs).collect()}
    assert got[1]["kind"] is None and got[3]["kind"] == "table" and got[3]["n_lines"] == 3
    assert quality.statistics(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_and_found_ones_have_the_columns_asked_for(spark, data, name):
    want = {
        "p1_found": ["id"], "p2_found": ["id"], "p3_found": ["doc_id", "ord", "canonical"], "p4_found": ["id", "lang"], "p5_found": ["id", "start_pos", "end_pos"],
        "p6_ids": ["doc_id", "ids"], "p7_found": ["source"], "p8_found": ["doc_id", "kind"],
    }
    df = queries.QUERIES[name](spark, data)
    assert df.columns == want.get(name, df.columns)
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        keys = [tuple(r) for r in rows]
        assert len(keys) == len(set(keys))


def test_nothing_outside_imports_the_package():
    import pathlib
    import re

    root = pathlib.Path(queries.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"marginalia\.llm|from \.llm|import llm", p.read_text()), p
