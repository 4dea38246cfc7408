"""Queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.columns import estimate_tokens as _estimate
from marginalia.llm import corpus, encode, mix, quality, split, tags
from marginalia.llm.tokens import CJK_RANGES
from marginalia.tables import current_rows, filled, table


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.current_pieces(table(spark, d, "docs"))


def p1_checked(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each id checked by expressions of Spark: whether they cover the text, keep to the limit and share no
    more than the overlap."""
    docs = table(spark, d, "docs")
    whole = current_rows(docs, "id", "text").select("id", F.length("text").alias("size"))
    w = Window.partitionBy("id").orderBy("piece_no")
    p = split.current_pieces(docs).withColumn("before", F.lag("end_pos", 1, 0).over(w))
    p = p.withColumn("shared", _estimate(F.substring("text", F.lit(1), F.col("before") - F.col("start_pos"))))
    own = p.groupBy("id").agg(
        F.min("start_pos").alias("first"), F.max("end_pos").alias("last"), F.bool_and(F.col("start_pos") <= F.col("before")).alias("joined"),
        F.bool_and(_estimate(F.col("text")) <= split.LIMIT).alias("within_limit"), F.bool_and((F.col("shared") <= split.OVERLAP) | (F.col("before") <= F.col("start_pos"))).alias("within_overlap"),
    )
    return own.join(whole, "id").select("id", ((F.col("first") == 0) & (F.col("last") == F.col("size")) & F.col("joined")).alias("covers"), "within_limit", "within_overlap")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.current_pieces(table(spark, d, "docs"), with_text=False).filter("piece_no = 0").select("id")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.token_counts(table(spark, d, "docs")).select("id", "tokens", "counted", "usable", "budgeted")


def p2_budget(spark: SparkSession, d: str) -> DataFrame:
    return corpus.token_budget(table(spark, d, "docs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = current_rows(table(spark, d, "docs"), "id", "tokens", "text").filter(filled(F.col("text")))
    counts = corpus.counted(rows, ("id", "tokens"))
    return counts.filter(~corpus.usable_tokens(F.col("tokens"), F.col("counted"))).select("id")


def p3_resolved(spark: SparkSession, d: str) -> DataFrame:
    return tags.resolve(table(spark, d, "doc_tags"), table(spark, d, "terms"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    rows = tags.applied(table(spark, d, "doc_tags"), table(spark, d, "terms"))
    return rows.filter(F.col("canonical") == tags.NONE).groupBy("tag").agg(F.count(F.lit(1)).alias("uses"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return tags.misplaced(table(spark, d, "doc_tags"), table(spark, d, "terms"))


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs")
    return corpus.text_languages(current_rows(docs, "id", "text"), corpus.language_models(docs), segments=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs")
    return corpus.language_corrections(current_rows(docs, "id", "lang", "text"), corpus.language_models(docs))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sentences(current_rows(table(spark, d, "docs"), "id", "text")).select("id", "start_pos", "end_pos")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(table(spark, d, "documents"))


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded_offsets(table(spark, d, "documents"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mix.report(mix.plan(mix.texts_of(table(spark, d, "documents"), targets), targets)[1])


def p7_targets(spark: SparkSession, d: str) -> DataFrame:
    """Those columns of the report that SQL can express."""
    return p7_shares(spark, d).select("source", "target_share", "max_repeats", "documents", "texts")


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """Of each source: whether no text comes more often than allowed, whether the copies add up to the size reported,
    and whether that is no more than the target."""
    docs = table(spark, d, "documents")
    chosen, told = mix.mixture(docs, table(spark, d, "mix_targets"))
    texts = chosen.join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")), "doc_id").groupBy("source", "digest").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("size"))
    most = texts.groupBy("source").agg(F.max("copies").alias("most"), F.sum("size").alias("size"))
    ok = told.join(most, "source", "left")
    return ok.select(
        "source", (F.coalesce("most", F.lit(0)) <= F.coalesce("max_repeats", "most", F.lit(0))).alias("within_limit"), (F.coalesce("size", F.lit(0)) == F.col("reached_tokens")).alias("adds_up"),
        (F.col("reached_tokens") <= F.col("target_tokens") + 1).alias("within_target"),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_shares(spark, d).filter("not reachable").select("source")


def p8_features(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Those of the statistics that SQL can express."""
    return p8_features(spark, d).select("doc_id", "n_chars", "n_words", "mean_word_length", "n_lines", "symbol_ratio", "digit_ratio", "punctuated_line_share", "short_line_share", "common_word_share")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_features(spark, d).filter("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p1_checked, p2_found, p2_counts, p2_budget, p3_found, p3_resolved, p3_unmatched, p4_found, p4_segments,
        p5_found, p6_ids, p6_offsets, p7_found, p7_shares, p7_targets, p7_limits, p7_mixture, p8_found, p8_features, p8_counts,
    )
}

# ---- SQL (DuckDB) --------------------------------------------------------------------------------
_CJK = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)
_CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mtime_ns DESC NULLS LAST) AS rank_ FROM docs WHERE id IS NOT NULL) WHERE rank_ = 1)"
_FILLED = r"text IS NOT NULL AND regexp_matches(text, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\v]')"


def _n(pattern: str, of: str = "text") -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


_OPEN = f"regexp_replace(text, '[{_CJK}]', ' ', 'g')"
_ALL_WORDS = f"len(list_filter(regexp_extract_all({_OPEN}, '[\\p{{L}}\\p{{N}}]+'), lambda x: regexp_replace(x, '[0-9]', '', 'g') <> ''))"
_MARKED = f"len(list_filter(regexp_extract_all({_OPEN}, '[\\p{{L}}\\p{{N}}]+'), lambda x: regexp_matches(x, '[À-ỹ]')))"
_SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_OTHER = _n(rf"[^\p{{L}}\p{{N}}{_SPACE}{_CJK}]")
_NEWLINES = "(length(text) - length(replace(text, chr(10), '')))"
_HUNDREDTHS = f"(164 * {_NEWLINES} + 140 * {_n('[0-9]')} + 51 * {_n(f'[{_CJK}]')} + 63 * {_OTHER} + 101 * {_MARKED} + 109 * ({_ALL_WORDS} - {_MARKED}))"
_COUNT = f"((({_HUNDREDTHS}) + 99) // 100)"

ORACLE = {
    "p1_found": f"SELECT id FROM {_CURRENT} WHERE {_FILLED} AND {_HUNDREDTHS} > 45000",
    "p1_checked": f"SELECT id, true AS covers, true AS within_limit, true AS within_overlap FROM {_CURRENT} WHERE {_FILLED} AND {_HUNDREDTHS} > 45000",
    "p2_found": f"SELECT id FROM (SELECT id, tokens, {_COUNT} AS n FROM {_CURRENT} WHERE {_FILLED}) WHERE tokens IS NULL OR tokens <= 0 OR abs(tokens - n) * 10 > n",
    "p2_counts": f"""SELECT id, tokens, counted, usable, CASE WHEN usable THEN tokens ELSE counted END AS budgeted FROM (
        SELECT id, tokens, n AS counted, coalesce(tokens > 0 AND abs(tokens - n) * 10 <= n, false) AS usable
        FROM (SELECT id, tokens, CAST(coalesce({_COUNT}, 0) AS BIGINT) AS n FROM {_CURRENT}))""",
}


def _tags_oracle(select: str) -> str:
    """The mapping by brute force: every value against every reference key."""
    f, w = tags.fold_sql("name", True), tags.words_sql
    return f"""
    WITH names AS (
        SELECT tag AS term, tag AS name FROM terms WHERE trim(tag) <> ''
        UNION ALL SELECT term, name FROM (SELECT tag AS term, unnest(synonyms) AS name FROM terms WHERE trim(tag) <> '') WHERE trim(name) <> ''
    ), told AS (SELECT term, {w(f, True)} AS words FROM names UNION SELECT term, {w(f, True, "-")} FROM names
    ), lists AS (SELECT term, string_split(words, ' ') AS ws FROM told
    ), turned AS (
        SELECT term, ws FROM lists UNION SELECT term, list_concat([ws[-1]], ws[:-2]) FROM lists WHERE len(ws) > 1
        UNION SELECT term, list_concat(ws[2:], [ws[1]]) FROM lists WHERE len(ws) > 1
    ), refs AS (
        SELECT DISTINCT term, replace(array_to_string(ws, ''), 'の', '') AS key, ws[1] AS first_word, replace(array_to_string(ws[2:], ''), 'の', '') AS other_words FROM turned
    ), folded AS (SELECT tag, {tags.fold_sql("tag", True)} AS f FROM (SELECT DISTINCT tag FROM doc_tags WHERE trim(tag) <> '')
    ), vals AS (
        SELECT tag, {tags.key_sql(w("f", True))} AS key, regexp_extract(f, '^([a-z]{{3,}})[.] *[^.]+$', 1) AS prefix,
            {tags.key_sql(w("regexp_extract(f, '^[a-z]{3,}[.] *([^.]+)$', 1)", True))} AS other_words FROM folded
    ), scored AS (
        SELECT v.tag, r.term, CASE
            WHEN v.key = r.key OR (regexp_matches(v.key, '[a-z]') AND translate(v.key, '{tags.LEET_FROM}', '{tags.LEET_TO}') = r.key) THEN 0
            WHEN v.prefix <> '' AND v.other_words <> '' AND v.other_words = r.other_words AND starts_with(r.first_word, v.prefix) THEN 1
            WHEN NOT regexp_matches(v.key, '{tags._CJK}') AND levenshtein(v.key, r.key) <= {tags.edits_sql("r.key", True)} THEN 1 + levenshtein(v.key, r.key) END AS score
        FROM vals v, refs r WHERE v.key <> '' AND r.key <> ''
    ), best AS (SELECT tag, term, min(score) AS score FROM scored WHERE score IS NOT NULL GROUP BY tag, term
    ), one AS (SELECT tag, min(score) AS score FROM best GROUP BY tag
    ), sure AS (SELECT b.tag, min(b.term) AS canonical, min(b.score) AS score FROM best b JOIN one o ON b.tag = o.tag AND b.score = o.score GROUP BY b.tag HAVING count(*) = 1
    ), resolved AS (SELECT v.tag, coalesce(s.canonical, '{tags.NONE}') AS canonical, CAST(s.score AS INTEGER) AS score FROM vals v LEFT JOIN sure s ON v.tag = s.tag
    ), keyed AS (SELECT doc_id, ord, max(row(tag, canonical)) AS x FROM doc_tags GROUP BY doc_id, ord
    ), flat AS (SELECT DISTINCT doc_id, ord, tag, canonical AS stored FROM doc_tags)
    {select}"""


ORACLE |= {
    "p3_resolved": _tags_oracle("SELECT tag, canonical, score FROM resolved"),
    "p3_unmatched": _tags_oracle(f"SELECT f.tag, count(*) AS uses FROM flat f JOIN resolved r ON f.tag = r.tag WHERE r.canonical = '{tags.NONE}' GROUP BY f.tag"),
    "p3_found": _tags_oracle("SELECT f.doc_id, f.ord, r.canonical FROM flat f JOIN resolved r ON f.tag = r.tag WHERE f.stored IS DISTINCT FROM r.canonical"),
}

_WHITE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_FINALS, _CLOSERS = ".!?…。！？｡．؟।។", "\"''’»«“”」』）)\\]"
_SHARE = "CASE WHEN {n} = 0 THEN 0.0 ELSE floor(CAST({x} AS DOUBLE) / {n} * 10000 + 0.5) / 10000 END"


def _share(x: str, n: str) -> str:
    return _SHARE.format(x=x, n=n)


_SYMBOLS, _DIGITS = _n(r"[\p{S}\p{P}]", "t"), _n(r"\p{Nd}", "t")
ORACLE["p8_counts"] = rf"""
    WITH plain AS (
        SELECT doc_id, coalesce(length(text), 0) AS n_chars, nfc_normalize(text) AS raw,
            regexp_replace(nfc_normalize(text), '\r\n|[\r\x{{0B}}\x{{0C}}\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g') AS t FROM documents
    ), cut AS (
        SELECT *, t IS NOT NULL AND regexp_matches(t, '[^{_WHITE}]') AS told, regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}]+') AS ws,
            list_transform(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_WHITE}]')), lambda x: regexp_replace(x, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')) AS ls FROM plain
    ), counted AS (
        SELECT doc_id, n_chars, told, ws, CASE WHEN told THEN len(ls) ELSE 0 END AS n_lines, CASE WHEN told THEN len(ws) ELSE 0 END AS n_words,
            list_sum(list_transform(ws, lambda w: length(w))) AS in_words, {_SYMBOLS} AS marks,
            {_DIGITS} AS digits, len(list_filter(ls, lambda x: regexp_matches(x, '[{_FINALS}][{_WHITE}{_CLOSERS}]*$'))) AS finals,
            len(list_filter(ls, lambda x: length(x) <= 30)) AS short,
            len(list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: list_contains([{", ".join(f"'{w}'" for w in sorted(quality._COMMON))}], w))) AS common FROM cut
    )
    SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, CAST(n_words AS BIGINT) AS n_words, {_share("in_words", "n_words")} AS mean_word_length, CAST(n_lines AS BIGINT) AS n_lines,
        CASE WHEN told THEN {_share("marks", "n_chars")} ELSE 0.0 END AS symbol_ratio, CASE WHEN told THEN {_share("digits", "n_chars")} ELSE 0.0 END AS digit_ratio,
        {_share("finals", "n_lines")} AS punctuated_line_share, {_share("short", "n_lines")} AS short_line_share, {_share("common", "n_words")} AS common_word_share FROM counted"""

_KEY = f"regexp_replace(lower(regexp_replace(source, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')), '[{_WHITE}_-]+', '-', 'g')"
ORACLE["p7_targets"] = f"""
    WITH t AS (SELECT {_KEY} AS source, greatest(coalesce(weight, 0), 0) AS w, max_repeats AS m FROM mix_targets WHERE source IS NOT NULL
    ), d AS (SELECT {_KEY} AS source, coalesce(text, '') AS text FROM documents
    ), n AS (SELECT source, count(*) AS documents, count(DISTINCT text) AS texts FROM d GROUP BY source)
    SELECT t.source, sum(w) / (SELECT sum(w) FROM t) AS target_share, CASE WHEN count(m) = count(*) THEN max(m) END AS max_repeats,
        CAST(coalesce(max(documents), 0) AS BIGINT) AS documents, CAST(coalesce(max(texts), 0) AS BIGINT) AS texts FROM t LEFT JOIN n ON t.source = n.source GROUP BY t.source"""
ORACLE["p7_limits"] = f"SELECT DISTINCT {_KEY} AS source, true AS within_limit, true AS adds_up, true AS within_target FROM mix_targets WHERE source IS NOT NULL"
