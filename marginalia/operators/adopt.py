"""Filling in missing metadata, and proposals for a vocabulary."""

from __future__ import annotations

from dataclasses import replace

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.bundle import Bundle
from marginalia.functions import columns as C
from marginalia.functions.terms import terms_text
from marginalia.operators.lint import first_h1_of


def plan(b: Bundle, level: int = 1, today: str = "2026-01-01") -> DataFrame:
    """id, the fields a level needs filled where missing, and which were filled (`generated`)."""
    d = b.docs.filter(~F.coalesce("reserved", F.lit(False))).join(first_h1_of(b.docs), "id", "left")
    missing = lambda c: C.blank_to_null(F.col(c)).isNull()
    fills = {"type": C.guess_type(F.col("id")), "title": F.coalesce("h1", C.title_from_name(C.id_name(F.col("id")))), "description": F.col("sentence")}
    if level >= 2:
        fills |= {"lang": C.detect_lang(F.substring("body", 1, 2000)), "status": F.lit("draft"), "updated": F.lit(today)}
    out = d.select("id", *[F.coalesce(C.blank_to_null(F.col(c)), v).alias(c) for c, v in fills.items()], F.array_compact(F.array(*[F.when(missing(c) & v.isNotNull(), F.lit(c)) for c, v in fills.items()])).alias("generated"))
    return out.filter(F.size("generated") > 0)


def adopted(b: Bundle, level: int = 1, today: str = "2026-01-01") -> Bundle:
    """The collection as it would be with the plan carried out: fields filled, and a block where there was none.  Blocks
    that can't be read stay as they are."""
    filled = plan(b, level, today).drop("generated")
    names = [c for c in filled.columns if c != "id"]
    joined = b.docs.alias("d").join(filled.alias("f"), F.col("d.id") == F.col("f.id"), "left")
    able = F.coalesce(F.col("d.fm_state").isin("valid", "absent"), F.lit(False))
    cols = [
        F.when(able, F.coalesce(F.col(f"f.{c}"), F.col(f"d.{c}"))).otherwise(F.col(f"d.{c}")).alias(c) if c in names else F.when(F.col("d.fm_state") == "absent", "valid").otherwise(F.col("d.fm_state")).alias(c) if c == "fm_state" else F.col(f"d.{c}")
        for c in b.docs.columns
    ]
    return replace(b, docs=joined.select(*cols))


def report(b: Bundle, level: int = 1, today: str = "2026-01-01") -> dict:
    """What the plan would do: documents, fields filled, listings to write, descriptions too short to help, the level
    before and after, and how many findings of each rule up to that level would remain."""
    from marginalia.operators import lint

    p = plan(b, level, today).select(F.explode("generated").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    changes = {r["field"]: r["n"] for r in p.collect()}
    before = lint.summary(lint.lint(lint.Context(b)), level).first()
    after = adopted(b, level, today)
    listings = lint.index_plan(lint.Context(after)).select("folder").distinct().count()
    # with the listings written no index is missing
    left = lint.lint(lint.Context(after, disabled=frozenset({"missing-index", "stale-index"}))).filter(F.col("level") <= level)
    remaining = {r["rule"]: r["findings"] for r in lint.counts(left).collect()}
    return {
        "documents": plan(b, level, today).count(), "changes": changes, "listings": listings, "level_before": before["level"], "level_after": lint.summary(left, level).first()["level"],
        "weak_descriptions": remaining.get("description-too-short", 0), "remaining": remaining,
    }


@F.pandas_udf(T.StringType())
def term_key(s):
    return s.map(lambda t: "-".join(terms_text(t)), na_action="ignore")


def tag_groups(tags: DataFrame) -> DataFrame:
    """key, tag (the most used spelling; ties: without _, shorter, lower case, text), variants and
    documents of each group of spellings of one tag; a document counts once a group."""
    t = tags.select("doc_id", "ord", F.trim("tag").alias("tag"), term_key(F.col("norm")).alias("key")).filter("key <> ''")
    once = t.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("ord", "tag"))).filter("n = 1")
    use = once.groupBy("key", "tag").agg(F.count(F.lit(1)).alias("uses"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("uses")).alias("a"), F.col("tag").contains("_").alias("b"), F.length("tag").alias("c"), F.col("tag").rlike(r"\p{Lu}").alias("d"), F.col("tag"))))
    g = use.groupBy("key").agg(F.sum("uses").alias("documents"), ranked.alias("r"))
    return g.select("key", F.get("r", F.lit(0))["tag"].alias("tag"), F.transform(F.slice("r", 2, 1_000_000), lambda x: x["tag"]).alias("variants"), "documents")


def suggest(groups: list) -> str:
    """A vocabulary document: one term per group, its variants as synonyms."""
    import yaml

    terms = {g["tag"]: {"synonyms": list(g["variants"])} if g["variants"] else {} for g in groups}
    return "---\n" + yaml.safe_dump({"terms": terms}, allow_unicode=True, sort_keys=False) + "---\n"


def set_key(text: str, key: str, value: str) -> str:
    """A document's text with one top-level metadata key set; every other byte stays."""
    m = regex.match(r"(---[ \t]*(?:\r\n|\n))(.*?)(^(?:---|\.\.\.)[ \t]*(?:\r\n|\n|\Z))", text, regex.S | regex.M)
    line = f"{key}: {value}"
    if not m:
        return f"---\n{line}\n---\n{text}"
    end = "\r\n" if m[1].endswith("\r\n") else "\n"
    old = regex.search(rf"^{regex.escape(key)}[ \t]*:.*?(?:\r\n|\n)(?:[ \t]+.*(?:\r\n|\n)|-[ \t].*(?:\r\n|\n))*", m[2], regex.M)
    block = m[2][: old.start()] + line + end + m[2][old.end() :] if old else m[2] + line + end
    return m[1] + block + m[3] + text[m.end() :]


def remove_key(text: str, key: str) -> str:
    m = regex.match(r"(---[ \t]*(?:\r\n|\n))(.*?)(^(?:---|\.\.\.)[ \t]*(?:\r\n|\n|\Z))", text, regex.S | regex.M)
    if not m:
        return text
    block = regex.sub(rf"^{regex.escape(key)}[ \t]*:.*?(?:\r\n|\n)(?:[ \t]+.*(?:\r\n|\n)|-[ \t].*(?:\r\n|\n))*", "", m[2], count=1, flags=regex.M)
    return m[1] + block + m[3] + text[m.end() :]
