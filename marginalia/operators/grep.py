"""Accent-insensitive regular-expression search over metadata and bodies, with context lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.bundle import Bundle
from marginalia.functions.columns import fold_text
from marginalia.operators.query import Filter, matching
from marginalia.operators.scope import EVERYTHING, Scope, glob_predicate

LINE_CHARS = 220


@dataclass(frozen=True)
class Pattern:
    """The folded pattern; `literal` if it is no regular expression, or one with look-around or references."""

    text: str
    literal: bool


def compile_pattern(pattern: str, compat: bool = False) -> Pattern:
    """Folded outside of escapes, so that \\S keeps its meaning; `compat` folds escapes too."""
    p = pattern.strip()
    if not p:
        raise ValueError("the pattern is empty")
    folded = fold_text(p) if compat else "".join(x if x.startswith("\\") else fold_text(x) for x in regex.split(r"(\\[pP]\{[^}]*\}|\\.)", p) if x)
    try:
        regex.compile(folded, regex.I | regex.M)
    except regex.error:
        return Pattern(fold_text(p), True)
    if regex.search(r"\(\?(?:<?[=!]|P=)|\\[1-9]", folded):
        return Pattern(fold_text(p), True)
    return Pattern(folded, False)


def line_hits(docs: DataFrame, p: Pattern, key: str = "id", text: str = "whole") -> DataFrame:
    """key, line (number), text and hit of each line of the documents with a match, only matching lines
    being hits.  A match over several lines counts on its first.  Null texts match nothing."""
    rx, literal = p.text, p.literal

    def run(batches):
        find = regex.compile(regex.escape(rx) if literal else rx, regex.I | regex.M)
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                folded = fold_text(t)
                starts = [m.start() for m in find.finditer(folded) if m.end() > m.start() or m.start() < len(folded)]
                if not starts:
                    continue
                breaks = np.flatnonzero(np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
                at = (np.unique(np.searchsorted(breaks, starts)) + 1).tolist()
                if at:
                    rows.append((k, at, t.split("\n")))
            yield pd.DataFrame(rows, columns=["k", "hits", "lines"])

    slim = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return slim.mapInPandas(run, f"k {docs.schema[key].dataType.simpleString()}, hits array<int>, lines array<string>").withColumnRenamed("k", key)


def native_hits(docs: DataFrame, p: Pattern, key: str = "id", text: str = "whole") -> DataFrame:
    """The same without Python, for patterns that can't match a line feed and Latin text: key, line, text."""
    from marginalia.functions.columns import fold_native

    rx = "(?iu)" + (r"\Q" + p.text.replace("\\E", "") + r"\E" if p.literal else p.text)
    lines = docs.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    return lines.filter(fold_native(F.col("text")).rlike(rx)).select(key, (F.col("line") + 1).alias("line"), "text")


def counts(hits: DataFrame, key: str = "id") -> DataFrame:
    return hits.select(key, F.size("hits").alias("matches"))


def totals(hits: DataFrame) -> DataFrame:
    return hits.agg(F.coalesce(F.sum(F.size("hits")), F.lit(0)).alias("total_lines"), F.count(F.lit(1)).alias("total_docs"))


def with_context(hits: DataFrame, context: int = 1, key: str = "id", most: int | None = None) -> DataFrame:
    """key, line, text (at most LINE_CHARS characters) and hit; windows of `context` lines around the hits,
    merged, no line twice; with `most` only the first lines of each document."""
    c = max(0, min(5, context))
    near = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(F.greatest(h - c, F.lit(1)), F.least(h + c, F.size("lines")))))))
    near = F.slice(near, 1, most) if most else near
    rows = hits.select(key, "hits", "lines", F.explode(near).alias("line"))
    return rows.select(key, "line", F.substring(F.get("lines", F.col("line") - 1), 1, LINE_CHARS).alias("text"), F.array_contains("hits", F.col("line")).alias("hit"))


def budgeted(hits: DataFrame, limit: int = 40, context: int = 1, key: str = "id") -> DataFrame:
    """The first rows of the best documents (most matching lines, then key) within an output budget: a
    document's head costs one, each line one.

    The budget is at most 200, so at most 200 documents and 200 lines of each are looked at; they are taken
    by a top-k before the running sum, which then is small whatever the input.
    """
    n = max(1, min(200, limit))
    top = hits.withColumn("matches", F.size("hits")).orderBy(F.desc("matches"), key).limit(n)
    lines = with_context(top, context, key, n).join(top.select(key, "matches"), key)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("matches"), key, "line")
    first = F.row_number().over(Window.partitionBy(key).orderBy("line")) == 1
    cost = F.sum(F.when(F.col("first"), 2).otherwise(1)).over(w)
    return lines.withColumn("first", first).withColumn("cost", cost).filter(F.col("cost") <= n).drop("first", "cost")


def corpus(b: Bundle, path: str | None = None, f: Filter | None = None, scope: Scope = EVERYTHING) -> DataFrame:
    """The documents searched, with `whole`: the metadata block as written, and the body behind it, so that lines are
    numbered as in the file."""
    d = matching(b, f or Filter(), scope)
    block = F.coalesce("fm_raw", F.lit("")) if "fm_raw" in d.columns else F.lit("")
    d = d.withColumn("whole", F.concat(block, F.coalesce("body", F.lit(""))))
    return d.filter(glob_predicate(path, F.col("id"))) if path else d


def run(b: Bundle, pattern: str, path: str | None = None, context: int = 1, files_only: bool = False, limit: int = 40, f: Filter | None = None, scope: Scope = EVERYTHING) -> dict:
    p = compile_pattern(pattern)
    hits = line_hits(corpus(b, path, f, scope), p).persist()
    try:
        t = totals(hits).first()
        n = max(1, min(200, limit))
        docs = counts(hits).orderBy(F.desc("matches"), "id").limit(n).collect()
        lines = [] if files_only else budgeted(hits, limit, context).orderBy(F.desc("matches"), "id", "line").collect()
    finally:
        hits.unpersist()
    shown = sum(x["hit"] for x in lines)
    cut = t["total_docs"] > len(docs) if files_only else shown < t["total_lines"]
    hint = None if t["total_docs"] and not cut else "more lines match; narrow the path or the pattern" if cut else "nothing matches; try fewer or shorter words"
    return {
        "docs": [{"id": d["id"], "matches": d["matches"], "lines": [(x["line"], x["text"], x["hit"]) for x in lines if x["id"] == d["id"]]} for d in docs if files_only or any(x["id"] == d["id"] for x in lines)],
        "total_lines": t["total_lines"], "total_docs": t["total_docs"], "truncated": cut, "literal": p.literal, "hint": hint,
    }
