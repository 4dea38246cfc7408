"""Mixing sources to target weights.

Equal texts of a source are one text, whatever their ids, since the number of repeats is a limit per text.
Texts are counted by source and exact token length.  For each source the target is met by whole passes over
its texts and a rest; the rest is filled in proportion over all lengths but for a window of its last tokens,
which bounded-knapsack dynamic programming over the lengths still available fits.  Where the window can't be
filled to the last token it is widened, in the end to the whole rest, so that the sum is always the greatest
there is.  Texts are then chosen by seeded order within source and length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.encode import DEFAULT, token_lengths
from marginalia.tables import cut_lineage

BUCKETS = 64
WINDOW = 1 << 15  #: tokens of the rest that the dynamic programming fits at first


def source_key(c: Column) -> Column:
    """Spellings of a source that are the same: outer spaces, case, and runs of spaces, _ and - don't count."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")), r"[\p{IsWhite_Space}_-]+", "-")


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take for the greatest sum not above the budget.

    Bounded counts are split in powers of two; the reachable sums are the bits of one integer per item.  Only every
    k-th of these integers is kept, about the root of their number, and the others are worked out again on the way back.
    """
    items: list[tuple[int, int, int]] = []
    for k, (w, c) in enumerate(zip(lengths, counts)):
        c = min(c, budget // w if w > 0 else 0)
        size = 1
        while c > 0:
            take = min(size, c)
            items.append((k, take, take * w))
            c -= take
            size *= 2
    full = (1 << (budget + 1)) - 1
    every = max(1, int(len(items) ** 0.5))
    kept, reach, used = [1], 1, 0
    for k, (_, _, w) in enumerate(items, 1):
        reach |= (reach << w) & full
        used = k
        if k % every == 0:
            kept.append(reach)
        if reach >> budget & 1:
            break
    at, out = reach.bit_length() - 1, [0] * len(lengths)
    for block in range((used - 1) // every if used else -1, -1, -1):
        steps = [kept[block]]
        for _, _, w in items[block * every : min(used, (block + 1) * every)]:
            steps.append(steps[-1] | (steps[-1] << w) & full)
        for i in range(len(steps) - 1, 0, -1):
            if not steps[i - 1] >> at & 1:
                k, take, w = items[block * every + i - 1]
                out[k] += take
                at -= w
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many texts of each length to take, so that their sum is the greatest not above the budget: in proportion
    but for the last `window` tokens, which the knapsack fits.  A window that can't be filled is widened until it can
    or holds the whole budget, where the knapsack's sum is the greatest possible."""
    take = np.zeros(len(lengths), np.int64)
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    some = (lengths > 0) & (counts > 0)
    if budget <= 0 or not some.any():
        return take
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    unit = int(np.gcd.reduce(lengths[some]))
    budget = budget // unit * unit
    order = np.argsort(-lengths, kind="stable")
    order = order[some[order]]
    window = min(window, max(2 * int(lengths.max()), budget // 50))  # the knapsack's part of the choice stays small
    while True:
        take[:] = 0
        goal, done, due = max(0, budget - window), 0, 0.0
        for k in order if goal else ():  # in proportion, the error carried to shorter lengths
            w, c = int(lengths[k]), int(counts[k])
            due += goal / total * w * c
            take[k] = n = int(min(c, max(0, (due - done) // w)))
            done += n * w
        for k in order if goal else ():  # what rounding left beyond the window
            n = int(min(counts[k] - take[k], max(0, goal - done) // lengths[k]))
            take[k] += n
            done += n * int(lengths[k])
        rest = budget - done
        usable = [k for k in order if lengths[k] <= rest and counts[k] > take[k]]
        got = knapsack([int(lengths[k]) // unit for k in usable], [int(counts[k] - take[k]) for k in usable], rest // unit)
        for k, n in zip(usable, got):
            take[k] += n
        if goal == 0 or int((lengths * take).sum()) == budget:
            return take
        window *= 4


def texts_of(docs: DataFrame, targets: DataFrame, name: str = DEFAULT, seed: int = 11) -> DataFrame:
    """source (its key), doc_id (the smallest of the text), documents (how many), n_tokens, bucket and seeded order of
    each different text of a listed source.  A null text counts as an empty one."""
    listed = targets.select(source_key(F.col("source")).alias("source")).distinct()
    slim = docs.select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce("text", F.lit("")).alias("text")).join(listed, "source", "left_semi")
    n = token_lengths(slim.withColumn("digest", F.sha2("text", 256)), ["doc_id", "source", "digest"], name=name)
    own = n.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("documents"), F.max("n_tokens").alias("n_tokens"))
    h = F.xxhash64(F.col("digest"), F.lit(seed))
    return own.withColumns({"bucket": F.pmod(h, F.lit(BUCKETS)).cast("int"), "seeded": h})


def plan(texts: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, n_tokens, passes, below, edge, rest: of each length the buckets below `below` are taken once more than
    the whole passes, and `rest` texts of bucket `edge`; report: one row per source of the targets).

    A target is weight / (sum of weights) of the tokens of all documents of listed sources, each once.
    Null and negative weights count as 0; repeated spellings of a source in the targets add up, with the
    greatest number of repeats; null repeats are unbounded.
    """
    t = targets.select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), "max_repeats")
    t = t.filter("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.when(F.count("max_repeats") == F.count(F.lit(1)), F.max("max_repeats")).alias("max_repeats"))
    weights = F.sum("weight").over(Window.partitionBy(F.lit(0)))  # the targets are a small table
    t = t.withColumn("share", F.when(weights > 0, F.col("weight") / weights).otherwise(0.0))
    # kept: it is read several times, and the texts must not be tokenized again
    hist = cut_lineage(texts.groupBy("source", "n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("documents").alias("documents")))
    by = hist.groupBy("source", "n_tokens").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    sums = by.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("documents")).alias("tokens"), F.sum("documents").alias("documents"), F.sum(F.col("n_tokens") * F.col("n")).alias("text_tokens"), F.sum("n").alias("texts"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per listed source
    head = t.join(sums, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens", "documents", "text_tokens", "texts")})
    head = head.withColumn("target", F.col("share") * F.coalesce(total, F.lit(0)))
    names = ["weight", "share", "target", "max_repeats", "documents", "tokens", "texts", "text_tokens"]
    both = by.select("source", "n_tokens", "n", *(F.lit(None).cast(head.schema[c].dataType).alias(c) for c in names))
    both = both.unionByName(head.select("source", F.lit(None).cast("bigint").alias("n_tokens"), F.lit(None).cast("bigint").alias("n"), *names))
    listed = both.join(head.select("source"), "source", "left_semi")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        top = pdf[pdf["n_tokens"].isna()].iloc[0]
        h = pdf[pdf["n_tokens"].notna()].sort_values("n_tokens")
        lens, counts = h["n_tokens"].to_numpy(np.int64), h["n"].to_numpy(np.int64)
        most = None if pd.isna(top["max_repeats"]) else max(0, int(top["max_repeats"]))
        tokens, own, target = int(top["tokens"]), int(top["text_tokens"]), float(top["target"])
        want = int(round(target))
        passes = want // own if own else 0
        rest = want - passes * own
        if most is not None and passes >= most:
            passes, rest = most, 0
        take = fit(lens, counts, rest)
        out = pd.DataFrame({"source": top["source"], "n_tokens": lens, "passes": passes, "take": take})
        out = out[(out["take"] > 0) | (passes > 0)]
        last = {c: top[c] for c in ("source", *names)} | {
            "passes": passes, "reached": passes * own + int((lens * take).sum()), "reachable": not (tokens * most < target if most is not None else tokens == 0 and target > 0),
        }
        out = pd.concat([out.astype(object), pd.DataFrame([last]).astype(object)], ignore_index=True)
        return out[[f.split()[0] for f in schema]].astype({c.split()[0]: "Int64" for c in schema if c.endswith(("bigint", " int"))})

    schema = ["source string", "n_tokens bigint", "passes bigint", "take bigint", "weight double", "share double", "target double", "max_repeats int", "documents bigint", "tokens bigint", "texts bigint", "text_tokens bigint", "reached bigint", "reachable boolean"]
    planned = cut_lineage(listed.groupBy("source").applyInPandas(one, ", ".join(schema)))
    # the bucket in which the texts taken of a length end
    upto = F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("bucket"))
    edges = hist.join(planned.filter("n_tokens is not null").select("source", "n_tokens", "passes", "take"), ["source", "n_tokens"]).withColumn("upto", upto)
    chosen = edges.groupBy("source", "n_tokens", "passes").agg(
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("take"), F.col("bucket") + 1)), F.lit(0)).alias("below"),
        F.coalesce(F.max(F.when((F.col("upto") > F.col("take")) & (F.col("upto") - F.col("n") < F.col("take")), F.col("bucket"))), F.lit(-1)).alias("edge"),
        F.coalesce(F.max(F.when((F.col("upto") > F.col("take")) & (F.col("upto") - F.col("n") < F.col("take")), F.col("take") - F.col("upto") + F.col("n"))), F.lit(0)).alias("rest"),
    )
    return chosen, planned.filter("n_tokens is null").drop("n_tokens", "take")


def report(planned: DataFrame) -> DataFrame:
    """One row per source of the targets: target and reached shares (of all reached tokens) and sizes."""
    whole = F.sum("reached").over(Window.partitionBy(F.lit(0)))  # one row per listed source
    return planned.select(
        "source", "weight", F.col("share").alias("target_share"), F.col("target").alias("target_tokens"), "max_repeats", "documents", "tokens", "texts", "text_tokens", "passes",
        F.col("reached").alias("reached_tokens"), F.when(whole > 0, F.col("reached") / whole).otherwise(0.0).alias("reached_share"), "reachable",
    )


def mixture(docs: DataFrame, targets: DataFrame, name: str = DEFAULT, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(one row per chosen text: doc_id, source, n_tokens, copies; report).  A text under several ids comes with its
    smallest id.  Documents of null or unlisted sources, and texts without tokens beyond whole passes, have no row."""
    texts = cut_lineage(texts_of(docs, targets, name, seed))
    chosen, planned = plan(texts, targets)
    joined = texts.join(chosen, ["source", "n_tokens"])
    sure = joined.filter("bucket <> edge").withColumn("copies", F.col("passes") + (F.col("bucket") < F.col("below")).cast("int"))
    w = Window.partitionBy("source", "n_tokens", "bucket").orderBy("seeded", "doc_id")
    edge = joined.filter("bucket = edge").withColumn("copies", F.col("passes") + (F.row_number().over(w) <= F.col("rest")).cast("int"))
    cols = ["doc_id", "source", "n_tokens", "copies"]
    return sure.select(*cols).unionByName(edge.select(*cols)).filter("copies > 0"), report(planned)
