"""The text operators over the documents in force: sentences, languages and token budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.langid import LABEL_NAMES, LANGS, UNKNOWN_LABELS, CharModels, clean, languages, train
from marginalia.llm.sentences import sentence_spans
from marginalia.llm.tokens import estimate_tokenizer, merge_tokenizer, tokenizer_file
from marginalia.tables import current_rows, filled, run_sql, spread

#: Labelled texts per language that the language models are trained on, and their characters in all: what the driver
#: collects.  Texts of any length take part; one that would go beyond the characters left is passed over.
TRAIN_PER_LANGUAGE, TRAIN_CHARS = 400, 8_000_000


def _chunks(pdf: pd.DataFrame, column: str, budget: int = 3_000_000) -> Iterator[pd.DataFrame]:
    """Runs of rows of at most `budget` characters (a longer text is a run of its own)."""
    sizes = pdf[column].str.len().fillna(0).to_numpy()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            yield pdf.iloc[start:i]
            start, total = i, 0
        total += n
    if start < len(pdf):
        yield pdf.iloc[start:]


def sentences(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, sentence_no, start_pos and end_pos of every sentence unit; no rows for null and blank texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _chunks(batch, "t"):
                spans = [sentence_spans(t) for t in pdf["t"]]
                n = [len(s) for s in spans]
                flat = np.array([p for s in spans for p in s], np.int32).reshape(-1, 2)
                no = np.concatenate([np.arange(k, dtype=np.int32) for k in n]) if n else np.zeros(0, np.int32)
                yield pd.DataFrame({"k": np.repeat(pdf["k"].to_numpy(), n), "sentence_no": no, "start_pos": flat[:, 0], "end_pos": flat[:, 1]})

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.filter(filled(docs[text])).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return spread(slim).mapInPandas(run, f"k {kind}, sentence_no int, start_pos int, end_pos int").withColumnRenamed("k", key)


def label_sql(label: Column) -> Column:
    """The language a label names, as an expression; null if none."""
    names = F.create_map(*[F.lit(x) for code, many in LABEL_NAMES.items() for n in many.split() for x in (n, code)])
    s = F.regexp_replace(F.lower(F.trim(label)), r"[\s_-]+", "-")
    return F.coalesce(names[s], F.when(s.rlike(r"^[a-z]{2,3}-[a-z0-9]{2,8}(-[a-z0-9]+)*$"), names[F.substring_index(s, "-", 1)]))


def label_missing_sql(label: Column) -> Column:
    return label.isNull() | ~label.rlike(r"[^\p{IsWhite_Space}]") | F.lower(F.trim(label)).isin(*sorted(UNKNOWN_LABELS))


def language_models(docs: DataFrame, text: str = "text", label: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> CharModels:
    """Models trained on a bounded sample: of each language the `per_language` labelled texts with the smallest hashes,
    as far as they have TRAIN_CHARS characters together."""
    rows = run_sql(
        f"""SELECT code, t FROM (
                SELECT code, t, sum(length(t)) OVER (PARTITION BY code ORDER BY length(t), h, t) AS upto FROM (
                    SELECT code, t, xxhash64(t) AS h, row_number() OVER (PARTITION BY code ORDER BY xxhash64(t), t) AS rank FROM <<labelled>>) WHERE rank <= {int(per_language)})
            WHERE upto <= {TRAIN_CHARS}""",
        labelled=docs.select(label_sql(F.col(label)).alias("code"), F.col(text).alias("t")).filter(F.col("code").isNotNull() & filled(F.col("t"))),
    ).collect()
    rows.sort(key=lambda r: (r.code, r.t))
    return train([(r.code, [c for a, b in sentence_spans(r.t) if (c := clean(r.t[a:b]))]) for r in rows], LANGS)


def text_languages(docs: DataFrame, models: CharModels, key: str = "id", text: str = "text", keep: tuple[str, ...] = (), segments: bool = False) -> DataFrame:
    """key, the columns `keep`, language, confidence and languages (all that the text is in) of each row; with
    `segments` instead key, segment_no, start_pos, end_pos, lang and confidence of each sentence.

    A text without sentences (headings, tables or code only) is judged as one segment.  The language is null
    where every segment is rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _chunks(batch, "t"):
                spans = [sentence_spans(t) or [(0, len(t))] for t in pdf["t"]]
                flat = [clean(t[a:b]) for t, own in zip(pdf["t"], spans) for a, b in own]
                got = languages(shared.value, flat, [len(s) for s in spans])
                if segments:
                    rows = [(k, i, a, b, lang, conf) for k, own, (_, _, _, each) in zip(pdf["k"], spans, got) for i, ((a, b), (lang, conf)) in enumerate(zip(own, each))]
                    yield pd.DataFrame(rows, columns=["k", "segment_no", "start_pos", "end_pos", "lang", "confidence"])
                else:
                    out = pdf.drop(columns="t")
                    out["language"] = [g[0] for g in got]
                    out["confidence"] = [g[1] for g in got]
                    out["languages"] = [g[2] for g in got]
                    yield out

    kind = docs.schema[key].dataType.simpleString()
    slim = spread(docs.filter(filled(docs[text])).select(F.col(key).alias("k"), *keep, F.col(text).alias("t")))
    if segments:
        return slim.mapInPandas(run, f"k {kind}, segment_no int, start_pos int, end_pos int, lang string, confidence double").withColumnRenamed("k", key)
    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInPandas(run, f"k {kind}{extra}, language string, confidence double, languages array<string>").withColumnRenamed("k", key)


def language_corrections(docs: DataFrame, models: CharModels, key: str = "id", text: str = "text", label: str = "lang") -> DataFrame:
    """key, lang: for a missing or wrong label the text's language, for a mixed text each of its languages."""
    got = text_languages(docs, models, key, text, keep=(label,))
    wrong = label_missing_sql(F.col(label)) | ~label_sql(F.col(label)).eqNullSafe(F.col("language"))
    rows = got.filter("language is not null").withColumn("out", F.when(F.size("languages") > 1, F.col("languages")).when(wrong, F.array("language")))
    return rows.select(key, F.explode("out").alias("lang"))


def counted(docs: DataFrame, keep: tuple[str, ...], text: str = "text", bpe: str | None = None) -> DataFrame:
    """The columns `keep` and `counted` (tokens by the estimate), with `bpe` also `bpe_tokens` by that
    vocabulary, of every row; 0 for null and empty texts.  Both come from merge tokenizers."""
    path = tokenizer_file(bpe) if bpe else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _chunks(batch, "__t"):
                texts = pdf["__t"].tolist()
                out = pdf.drop(columns="__t")
                out["counted"] = -(-estimate_tokenizer().counts(texts) // 100)
                if path:
                    out["bpe_tokens"] = merge_tokenizer(path).counts(texts)
                yield out

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "counted bigint", *(["bpe_tokens bigint"] if bpe else [])])
    return spread(docs.select(*keep, F.col(text).alias("__t"))).mapInPandas(run, schema)


def usable_tokens(stored: Column, count: Column) -> Column:
    """Whether a stored count is positive and within a tenth of the counted one."""
    return F.coalesce((stored > 0) & (F.abs(stored - count) * 10 <= count), F.lit(False))


def token_counts(docs: DataFrame, bpe: str | None = None) -> DataFrame:
    """id, lang, type, tokens (stored), counted, usable, and budgeted (the stored count where usable, else
    the counted one) of the current row of each id; texts that are null or blank count 0."""
    rows = counted(current_rows(docs, "id", "lang", "type", "tokens", "text"), ("id", "lang", "type", "tokens"), bpe=bpe)
    ok = usable_tokens(F.col("tokens"), F.col("counted"))
    return rows.withColumns({"usable": ok, "budgeted": F.when(ok, F.col("tokens")).otherwise(F.col("counted"))})


def token_budget(docs: DataFrame, bpe: str = "byte_bpe_50k.json") -> DataFrame:
    """Documents and tokens by source (first segment of id), language and type.  The language is that which the label
    names, so that its spellings add up; labels that name none stay as they are, trimmed, missing ones null."""
    lang = F.when(label_missing_sql(F.col("lang")), None).otherwise(F.coalesce(label_sql(F.col("lang")), F.trim("lang")))
    rows = token_counts(docs, bpe).withColumns({"source": F.substring_index("id", "/", 1), "lang": lang})
    return rows.groupBy("source", "lang", "type").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("budgeted").alias("tokens"), F.sum("bpe_tokens").alias("bpe_tokens"), F.sum(F.when(~F.col("usable"), 1).otherwise(0)).alias("recounted")
    )
