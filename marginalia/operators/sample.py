"""Stratified passages, held-out documents, batches, question checks, and retrieval scores."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import columns as C


@dataclass(frozen=True)
class Settings:
    langs: tuple[str, ...] = ("en", "vi", "ja")
    max_passages: int = 400
    heldout_share: float = 0.15
    min_heldout_docs: int = 20
    batch_passages: int = 10
    batch_tokens: int = 6000
    min_chunk_tokens: int = 40
    per_document: int = 4
    per_chunk: int = 2
    min_pairs: int = 300


def passage_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def stratified(chunks: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008: frozen
    """At most max_passages passages, drawn in turn from the strata (top folder, language): within a
    stratum by rank in the document, then hash.  Chunks have doc_id, ord, tokens, text, lang."""
    c = chunks.filter((F.col("tokens") >= s.min_chunk_tokens) & C.blank_to_null(F.col("text")).isNotNull())
    lang = F.coalesce(F.lower(F.regexp_extract(C.blank_to_null(F.col("lang")), "^([^-_]+)", 1)), C.detect_lang(F.substring("text", 1, 2000)), F.lit("other"))
    top = F.when(F.col("doc_id").contains("/"), F.substring_index("doc_id", "/", 1)).otherwise("")
    c = c.withColumns({"key": F.concat("doc_id", F.lit("#"), F.col("ord").cast("string")), "top": top, "passage_lang": lang})
    c = c.withColumn("hash", passage_hash(F.col("key")))
    c = c.withColumn("rank_in_doc", F.row_number().over(Window.partitionBy("doc_id").orderBy("hash"))).filter(F.col("rank_in_doc") <= s.per_document)
    # ranks above max_passages are never drawn, so each task keeps at most that many of a stratum
    c = c.withColumn("turn", F.row_number().over(Window.partitionBy("top", "passage_lang").orderBy("rank_in_doc", "hash"))).filter(F.col("turn") <= s.max_passages)
    return c.orderBy("turn", "top", "passage_lang").limit(s.max_passages)


def heldout(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008: frozen
    """doc_id and heldout: of n documents ordered by hash the first max(share, min(min_heldout, n/4)), but
    not all.

    The hash's first four digits are counted, the one bucket that the last held-out document falls into is
    ranked, and every other bucket is in or out as a whole: no global sort.
    """
    d = docs.select("doc_id").distinct().withColumn("hash", passage_hash(F.col("doc_id"))).withColumn("bucket", F.substring("hash", 1, 4))
    sizes = sorted((r["bucket"], r["count"]) for r in d.groupBy("bucket").count().collect())  # at most 65,536 rows
    n = sum(c for _, c in sizes)
    want = min(max(math.ceil(n * s.heldout_share), min(s.min_heldout_docs, n // 4)), max(n - 1, 0))
    edge, left = "", want
    for bucket, size in sizes:
        if left < size:
            edge = bucket
            break
        left -= size
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("hash"))
    inside = d.filter(F.col("bucket") == edge).withColumn("heldout", rank <= left).select("doc_id", "heldout")
    return d.filter(F.col("bucket") != edge).select("doc_id", (F.col("bucket") < edge).alias("heldout")).unionByName(inside)


def batches(passages: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008: frozen
    """key and batch: passages (key, turn, tokens) packed in order, a batch being closed at its passages or tokens.  They
    are a plan of at most max_passages rows, which one task holds; more are an error."""
    passages = passages.orderBy("turn", "key").limit(s.max_passages + 1)
    rows = F.array_sort(F.collect_list(F.struct("turn", "key", F.col("tokens").cast("bigint").alias("tokens"))))
    start = F.struct(F.lit(1).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("t"), F.array().cast("array<struct<key:string,batch:int>>").alias("out"))

    def step(a, p):
        full = (a["n"] > 0) & ((a["n"] >= s.batch_passages) | (a["t"] + p["tokens"] > s.batch_tokens))
        b = F.when(full, a["batch"] + 1).otherwise(a["batch"])
        item = F.array(F.struct(p["key"].alias("key"), b.alias("batch")))
        return F.struct(b.alias("batch"), F.when(full, 1).otherwise(a["n"] + 1).alias("n"), F.when(full, p["tokens"]).otherwise(a["t"] + p["tokens"]).alias("t"), F.concat(a["out"], item).alias("out"))

    checked = passages.agg(rows.alias("rows")).withColumn("rows", F.when(F.size("rows") <= s.max_passages, F.col("rows")).otherwise(F.raise_error(F.lit(f"more than {s.max_passages} passages"))))
    packed = checked.select(F.aggregate("rows", start, step).alias("x"))
    return packed.select(F.explode("x.out").alias("o")).select("o.key", "o.batch")


# -- questions ---------------------------------------------------------------------------------------

#: Least and greatest length by kind and language: words, or characters in Japanese (fixed values).
LENGTHS = {("keyword", "ja"): (2, 25), ("keyword", "vi"): (2, 12), ("keyword", ""): (2, 8), ("", "ja"): (5, 60), ("", "vi"): (3, 40), ("", ""): (3, 30)}
COPY_WORDS, COPY_SYLLABLES, COPY_CHARS = 5, 8, 12


def bounds(kind: str, lang: str) -> tuple[int, int]:
    k = "keyword" if kind == "keyword" else ""
    return LENGTHS.get((k, lang), LENGTHS[(k, "")])


def shingles(c: Column, n: int) -> Column:
    """Distinct runs of n words of a normalized text; none for shorter texts."""
    w = F.split(c, " ")
    return F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " ")))).otherwise(F.array().cast("array<string>"))


def copied(questions: DataFrame, passages: DataFrame, n: int = COPY_WORDS) -> DataFrame:
    """The questions (q_id, q) that share a run of n words with any passage (p_id, text).

    Each side gives its distinct runs; a semi join on the run finds the questions, and no pair is ever
    formed, however many passages hold the same run.
    """
    a = questions.select("q_id", C.question_normalize(F.col("q")).alias("norm")).select("q_id", F.explode(shingles(F.col("norm"), n)).alias("run"))
    b = passages.select(C.question_normalize(F.col("text")).alias("norm")).select(F.explode(shingles(F.col("norm"), n)).alias("run")).distinct()
    return a.join(b, "run", "left_semi").select("q_id").distinct()


def copied_from_others(rows: DataFrame, asked: Column, n: int = COPY_WORDS) -> DataFrame:
    """The asked rows (id, text) that share a run of n words with any row but themselves.

    A run is another's too if its least and greatest id differ, which partial aggregates tell: neither
    pairs nor lists of ids are formed.
    """
    runs = lambda df: df.select("id", C.question_normalize(F.col("text")).alias("norm")).select("id", F.explode(shingles(F.col("norm"), n)).alias("run"))
    shared = runs(rows).groupBy("run").agg(F.min("id").alias("least"), F.max("id").alias("greatest")).filter("least <> greatest")
    return runs(rows.filter(asked)).join(shared, "run", "left_semi").select("id").distinct()


def shares_run(q: str | None, text: str | None, n: int, chars: bool) -> bool:
    """Whether two normalized texts share a run of n words or, if characters count, of COPY_CHARS characters beside
    blanks.  Either is gone through once, so the time is in proportion to their lengths."""
    if q is None or text is None:
        return False
    a, b = q.split(" "), text.split(" ")
    runs = {" ".join(a[i : i + n]) for i in range(len(a) - n + 1)}
    heads = {r.partition(" ")[0] for r in runs}
    if runs and any(w in heads and " ".join(b[i : i + n]) in runs for i, w in enumerate(b[: max(0, len(b) - n + 1)])):
        return True
    a, b, k = "".join(a), "".join(b), COPY_CHARS
    pieces = {a[i : i + k] for i in range(len(a) - k + 1)} if chars else ()
    return bool(pieces) and any(b[i : i + k] in pieces for i in range(len(b) - k + 1))


@lru_cache(1)
def _shares_run_udf():
    @F.pandas_udf("boolean")
    def shares_run_(q: pd.Series, text: pd.Series, n: pd.Series, chars: pd.Series) -> pd.Series:
        return pd.Series([shares_run(*x) for x in zip(q, text, n, chars)], dtype=bool)

    return shares_run_


def check_questions(questions: DataFrame, passages: DataFrame, langs: list[str]) -> DataFrame:
    """q_id and the problems of each question (q_id, passage, kind, lang, q) by its passage (key, lang,
    title, text): unknown passage, language rules, script, length, copying, repetition."""
    p = passages.select(F.col("key").alias("passage"), F.col("lang").alias("p_lang"), "title", "text")
    j = questions.withColumns({"l": F.lower("lang"), "norm": C.question_normalize(F.col("q"))})
    # the first of equal questions, by a partial minimum: equal questions never meet in one task; passages have no part in it
    j = j.join(j.groupBy("norm").agg(F.min("q_id").alias("first_id")), "norm", "left")
    again = F.col("q_id") > F.col("first_id")
    j = j.join(p, "passage", "left").withColumns({"p_norm": C.question_normalize(F.col("text")), "t_norm": C.question_normalize(F.col("title"))})
    cjk = C.is_cjk(F.col("q"))
    size = F.when(cjk, F.length(F.regexp_replace("q", r"\s", ""))).otherwise(F.size(F.split(F.trim("q"), r"\s+")))
    pick = lambda i: F.coalesce(*[F.when(F.when(F.col("kind") == "keyword", "keyword").otherwise("").eqNullSafe(k) & ((F.col("l") == x) if x else F.lit(True)), v[i]) for (k, x), v in LENGTHS.items()])
    vi = C.detect_lang(F.col("q")) == "vi"
    script = F.when(F.col("l") == "ja", cjk).when((F.col("l") == "vi") & (F.col("kind") == "vague"), ~cjk).when(F.col("l") == "vi", vi & ~cjk).when(F.col("l") == "en", ~cjk & ~F.coalesce(vi, F.lit(False))).otherwise(True)
    listed = F.col("l").isin(langs)
    rule = (
        F.when((F.col("kind") == "natural") & (F.col("p_lang") != "other") & (F.col("l") != F.col("p_lang")), "natural questions use the passage's language")
        .when((F.col("kind") == "cross") & ((F.col("l") == F.col("p_lang")) | ~listed), "cross questions use another listed language")
        .when(F.col("kind").isin("keyword", "vague") & (F.col("l") != F.col("p_lang")) & ~listed, "the language is not listed")
    )
    copy = _shares_run_udf()("norm", "p_norm", F.when(F.col("p_lang") == "vi", COPY_SYLLABLES).otherwise(COPY_WORDS), C.is_cjk(F.col("text")))
    long_title = (F.size(F.split("t_norm", " ")) >= F.when(F.col("p_lang") == "vi", 6).otherwise(3)) | (C.is_cjk(F.col("title")) & (F.length("t_norm") >= 8))
    problems = F.when(F.col("text").isNull(), F.array(F.lit("unknown passage"))).otherwise(
        F.array_compact(
            F.array(
                rule, F.when(~F.coalesce(script, F.lit(False)), "the text does not look like its language"), F.when((size < pick(0)) | (size > pick(1)), "length"),
                F.when(copy, "copies the passage"), F.when((F.col("kind") != "keyword") & long_title & F.col("norm").contains(F.col("t_norm")), "repeats the title"),
                F.when(F.lower("q").contains(".md"), "mentions a file name"), F.when(again, "duplicate of another question"),
            )
        )
    )
    return j.select("q_id", problems.alias("problems"))


def fresh_questions(questions: DataFrame, known: DataFrame) -> DataFrame:
    """The first of each normalized question that the known set (q) doesn't hold."""
    q = questions.withColumn("norm", C.question_normalize(F.col("q")))
    # a partial aggregate: equal questions, however many, never meet in one task
    first = q.groupBy("norm").agg(F.min_by(F.struct(*questions.columns), "q_id").alias("x")).select("norm", "x.*")
    return first.join(known.select(C.question_normalize(F.col("q")).alias("norm")), "norm", "left_anti").drop("norm")


# -- scores ------------------------------------------------------------------------------------------


def retrieval_scores(ranked: DataFrame) -> DataFrame:
    """bucket (all, same, cross), n, r_at_1, r_at_3, mrr of questions with the rank of their document
    (1-based; null or above 10: not found) and whether languages differ (null: unknown)."""
    r = F.when(F.col("rank") <= 10, F.col("rank"))
    bucket = F.array_compact(F.array(F.lit("all"), F.when(F.col("cross"), "cross").when(~F.col("cross"), "same")))
    at = lambda k: F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0))
    return ranked.select(F.explode(bucket).alias("bucket"), r.alias("r")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), at(1).alias("r_at_1"), at(3).alias("r_at_3"), F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))).alias("mrr"))


GATE_GAIN, GATE_LOSS = 0.02, 0.01


def gate(base: dict, tuned: dict, general_base: dict, general_tuned: dict) -> dict:
    """Whether a tuned model passes: R@1 gains at least 2 points, cross-language R@1 isn't lower, and the
    general set loses at most 1 point."""
    e = 1e-9
    cross = base.get("cross") is None or tuned.get("cross") is None or tuned["cross"] >= base["cross"] - e
    gain, loss = tuned["r_at_1"] - base["r_at_1"], general_base["r_at_1"] - general_tuned["r_at_1"]
    return {"gain": gain, "cross_kept": cross, "loss": loss, "passed": gain >= GATE_GAIN - e and cross and loss <= GATE_LOSS + e}


def category_results(results: DataFrame) -> DataFrame:
    """category, total, passed, regressions and improvements of replayed cases (category, passed,
    baseline_passed)."""
    now, then = F.col("passed"), F.col("baseline_passed")
    return results.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(now).alias("passed"), F.count_if(~now & then).alias("regressions"), F.count_if(now & ~then).alias("improvements"))


def numbers(text: str) -> set[float]:
    """Numbers of an answer: without separators, and as written where that is a number."""
    out: set[float] = set()
    for found in regex.findall(r"[0-9][0-9.,]*", text):
        written = found.rstrip(".,")
        out.add(float(regex.sub("[.,]", "", written)))
        if "," not in written and written.count(".") <= 1:
            out.add(float(written))
    return out


def judge_case(expected: dict, ids: list[str], text: str) -> bool:
    """Whether recorded answers are met: all expected ids, all expected values (numbers or texts), and the
    rank of an id."""
    ok = all(i in ids for i in expected.get("ids", []))
    found = numbers(text)
    ok &= all((float(v) in found) if isinstance(v, int | float) else str(v).lower() in text.lower() for v in expected.get("values", []))
    if r := expected.get("rank"):
        ok &= r["id"] in ids[: r["k"]]
    return bool(ok)


def status(questions: DataFrame) -> DataFrame:
    """lang, kind (train or heldout) and rows of questions (lang, heldout)."""
    kind = F.when(F.coalesce("heldout", F.lit(False)), "heldout").otherwise("train")
    return questions.groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


def answered(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """q_id, key and heldout of the questions (q_id, passage) on passages (key, heldout); questions on others are left
    out."""
    p = passages.select("key", F.coalesce("heldout", F.lit(False)).alias("heldout"))
    return questions.join(p, questions["passage"] == p["key"]).select("q_id", "key", "heldout")
