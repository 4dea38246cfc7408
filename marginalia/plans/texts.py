"""Queries over texts: scalar functions, search, markdown, links, conversion, quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.bundle import DOC_COLUMNS
from marginalia.functions import columns as C
from marginalia.functions import markdown as M
from marginalia.functions.fields import COLUMNS as FIELD_COLUMNS
from marginalia.operators import access, adopt, grep, lint
from marginalia.operators import query as Q
from marginalia.plans.base import CJK, SPACE, blank, plain, query
from marginalia.plans.reads import ACTIVE
from marginalia.sources import files, tabular
from marginalia.tables import run_sql, table

A, B = C.fold_table()
FOLDED_TITLE = f"translate(regexp_replace(lower(title), '[̀-ͯ]', '', 'g'), '{A}', '{B}')"
WORDS = f"len(list_filter(regexp_extract_all(regexp_replace(body, '[{CJK}]', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+'), lambda x: regexp_replace(x, '[0-9]', '', 'g') <> ''))"
MARKED = f"len(list_filter(regexp_extract_all(regexp_replace(body, '[{CJK}]', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+'), lambda x: regexp_matches(x, '[À-ỹ]')))"
TOKENS = (
    f"(164 * (length(body) - length(replace(body, chr(10), ''))) + 140 * len(regexp_extract_all(body, '[0-9]')) + 51 * len(regexp_extract_all(body, '[{CJK}]')) "
    f"+ 63 * len(regexp_extract_all(body, '[^\\p{{L}}\\p{{N}}{SPACE}{CJK}]')) + 101 * {MARKED} + 109 * ({WORDS} - {MARKED}) + 99) // 100"
)


@query("SELECT DISTINCT doc_id, ord, folded FROM doc_tags WHERE folded <> ''")
def fold(b):
    """The project's own folded forms."""
    return b.tags.select("doc_id", "ord", "folded").filter("folded <> ''")


@query(f"SELECT id, {FOLDED_TITLE} AS folded FROM d WHERE title IS NOT NULL")
def fold_native(b):
    return b.docs.filter("title is not null").select("id", C.fold_native(F.col("title")).alias("folded"))


@query("SELECT DISTINCT doc_id, ord, norm FROM doc_tags WHERE norm <> ''")
def normalize_tag(b):
    return b.tags.select("doc_id", "ord", "norm").filter("norm <> ''")


@query(f"SELECT id, {TOKENS} AS tokens FROM d WHERE body IS NOT NULL")
def estimate_tokens(b):
    return b.docs.filter("body is not null").select("id", C.estimate_tokens(F.col("body")).alias("tokens"))


@query(f"SELECT id, coalesce(regexp_matches(title, '[{CJK}]'), false) AS cjk FROM d")
def is_cjk(b):
    return b.docs.select("id", C.is_cjk(F.col("title")).alias("cjk"))


@query(r"SELECT id, coalesce(regexp_matches(updated, '(?s)^[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt ].*)?$'), false) AS iso FROM d")
def is_iso_date(b):
    return b.docs.select("id", C.is_iso_date(F.col("updated")).alias("iso"))


@query("SELECT id, CASE WHEN contains(id, '/') THEN regexp_replace(id, '/[^/]*$', '') ELSE '' END AS dir, string_split(id, '/')[-1] AS name FROM d")
def id_dir_name(b):
    return b.docs.select("id", C.id_dir(F.col("id")).alias("dir"), C.id_name(F.col("id")).alias("name"))


@query("SELECT path, CASE WHEN path LIKE '%.md' AND NOT regexp_matches(path, '(^|/)(\\.{1,2})?(/|$)|\\\\|^/') THEN regexp_replace(path, '\\.md$', '') END AS concept FROM d")
def concept_id(b):
    return b.docs.select("path", C.concept_id(F.col("path")).alias("concept"))


@query("SELECT id, string_split(id, '/')[-1] IN ('index', 'log') AS reserved FROM d")
def is_reserved(b):
    return b.docs.select("id", C.is_reserved(F.col("id")).alias("reserved"))


@query("SELECT id, coalesce(map {'faq': 'FAQ', 'policies': 'Policy', 'guides': 'Guide', 'sop': 'Playbook', 'announcements': 'Post', 'meetings': 'Meeting Note'}[split_part(id, '/', 1)], 'Document') AS type FROM d")
def guess_type(b):
    """Only the first folder of these ids has a known name."""
    return b.docs.select("id", C.guess_type(F.col("id")).alias("type"))


@query("SELECT id, upper(left(x, 1)) || substring(x, 2) AS title FROM (SELECT id, trim(translate(string_split(id, '/')[-1], '-_', '  ')) AS x FROM d)")
def title_from_name(b):
    return b.docs.select("id", C.title_from_name(C.id_name(F.col("id"))).alias("title"))


@query("SELECT id, sha256(body) AS hash FROM d WHERE body IS NOT NULL")
def content_hash(b):
    return b.docs.filter("body is not null").select("id", C.content_hash(F.col("body")).alias("hash"))


@query(f"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(title, '{C.INLINE}', '\\1\\2\\3\\4', 'g'), '{C.EMPHASIS}', '\\1', 'g'), '[{SPACE}]+', ' ', 'g')) AS plain FROM d WHERE title IS NOT NULL""")
def clean_inline(b):
    return b.docs.filter("title is not null").select("id", C.clean_inline(F.col("title")).alias("plain"))


@query(f"SELECT id, coalesce(CASE WHEN NOT {blank('title')} THEN trim(title) END, CASE WHEN NOT {blank('description')} THEN trim(description) END, string_split(id, '/')[-1]) AS shown FROM d")
def mapped_title(b):
    return b.docs.select("id", C.first_filled(F.col("title"), F.col("description"), C.id_name(F.col("id"))).alias("shown"))


@query(r"SELECT id, regexp_replace(regexp_replace(lower(id), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM d")
def slug(b):
    return b.docs.select("id", C.slug(F.col("id")).alias("slug"))


NUMBERS = "list_transform(regexp_extract_all(text, '[0-9][0-9.,]*'), lambda x: rtrim(x, '.,'))"


@plain(f"""SELECT doc_id, list_sort(list_distinct(list_filter(list_concat(list_transform({NUMBERS}, lambda x: try_cast(regexp_replace(x, '[.,]', '', 'g') AS DOUBLE)),
    list_transform({NUMBERS}, lambda x: try_cast(x AS DOUBLE))), lambda x: x IS NOT NULL))) AS numbers FROM documents WHERE text IS NOT NULL""")
def numbers_in(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", C.numbers_in(F.col("text")).alias("numbers"))


@plain("SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS shown FROM part")
def fmt_num(spark, d):
    return table(spark, d, "part").select("p_partkey", C.fmt_num(F.col("p_retailprice")).alias("shown"))


@plain("SELECT p_partkey, CAST(DATE '1899-12-30' + (40000 + p_partkey % 9000)::INT AS VARCHAR) AS day FROM part")
def excel_date(spark, d):
    return table(spark, d, "part").select("p_partkey", C.excel_date((40000 + F.col("p_partkey") % 9000).cast("double")).alias("day"))


@query()
def terms(b):
    """Index terms of the titles."""
    return b.docs.filter("title is not null").select("id", adopt.term_key(F.col("title")).alias("terms"))


# -- search ------------------------------------------------------------------------------------------

#: The metadata block in front of a body.
BLOCK = "CASE WHEN fm_state = 'valid' THEN '---' || chr(10) || concat_ws('', " + ", ".join(f"'{c}: ' || {c} || chr(10)" for c in DOC_COLUMNS if c in FIELD_COLUMNS) + ") || '---' || chr(10) ELSE '' END"
LINES = f", w AS (SELECT id, {BLOCK} || coalesce(body, '') AS whole FROM n), l AS (SELECT id, unnest(string_split(whole, chr(10))) AS line, unnest(range(1, len(string_split(whole, chr(10))) + 1)) AS no FROM w), h AS (SELECT id, no, line FROM l WHERE regexp_matches(lower(line), 'warranty (card|claim)|price tag|type: faq'))"


def _hits(b):
    return grep.line_hits(grep.corpus(b), grep.compile_pattern("Warranty (card|claim)|price tag|type: faq"))


@query(LINES + " SELECT id, count(*) AS matches FROM h GROUP BY id")
def grep_counts(b):
    return grep.counts(_hits(b))


@query(LINES + " SELECT count(*) AS total_lines, count(DISTINCT id) AS total_docs FROM h")
def grep_totals(b):
    return grep.totals(_hits(b))


@query(LINES + " SELECT l.id, l.no AS line, substring(l.line, 1, 220) AS text, h.no IS NOT NULL AS hit FROM l LEFT JOIN h ON l.id = h.id AND l.no = h.no WHERE EXISTS (SELECT 1 FROM h x WHERE x.id = l.id AND abs(x.no - l.no) <= 1)")
def grep_context(b):
    return grep.with_context(_hits(b), 1)


@query(LINES + " SELECT id, no AS line, line AS text FROM h")
def grep_native(b):
    """The way without Python, on the same lines."""
    return grep.native_hits(grep.corpus(b), grep.compile_pattern("warranty (card|claim)|price tag|type: faq"))


@query(LINES + """, r AS (SELECT l.id, l.no, substring(l.line, 1, 220) AS text, h.no IS NOT NULL AS hit, (SELECT count(*) FROM h x WHERE x.id = l.id) AS m FROM l LEFT JOIN h ON l.id = h.id AND l.no = h.no
    WHERE EXISTS (SELECT 1 FROM h x WHERE x.id = l.id AND abs(x.no - l.no) <= 1)), s AS (SELECT *, sum(CASE WHEN first_ THEN 2 ELSE 1 END) OVER (ORDER BY m DESC, id, no ROWS UNBOUNDED PRECEDING) AS cost
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY no) = 1 AS first_ FROM r)) SELECT id, no AS line, text, hit, m AS matches FROM s WHERE cost <= 40""")
def grep_budget(b):
    return grep.budgeted(_hits(b), 40, 1)


@query(LINES + " SELECT id, count(*) AS matches FROM h GROUP BY id ORDER BY matches DESC, id LIMIT 20")
def grep_rank(b):
    return grep.counts(_hits(b)).orderBy(F.desc("matches"), "id").limit(20)


# -- markdown ----------------------------------------------------------------------------------------


@query()
def chunk_body(b):
    return b.chunks()


@query(f"SELECT id, true AS complete, true AS in_order, true AS within FROM n WHERE NOT {blank('body')}")
def chunk_checked(b):
    """The chunks of each document, checked: together they hold all of its text, in order of lines, and only pieces of
    one long line are above the limit."""
    d = Q.matching(b, Q.Filter()).filter(F.col("body").rlike(r"[^\p{IsWhite_Space}]"))
    solid = lambda c: F.regexp_replace(c, r"\p{IsWhite_Space}+", "")
    rows = F.array_sort(F.collect_list(F.struct("ord", "text", "start_line", "end_line")))
    own = b.chunks().groupBy(F.col("doc_id").alias("id")).agg(rows.alias("x"), F.bool_and((C.estimate_tokens(F.col("text")) <= M.CHUNK_MAX) | (F.col("start_line") == F.col("end_line"))).alias("within"))
    starts = F.transform("x", lambda c: c["start_line"])
    return own.join(d.select("id", "body"), "id").select("id", (solid(F.array_join(F.transform("x", lambda c: c["text"]), "")) == solid(F.col("body"))).alias("complete"), (F.array_sort(starts) == starts).alias("in_order"), "within")


@query()
def first_sentence(b):
    return lint.first_h1_of(b.docs)


@plain()
def link_extract(spark, d):
    """Links of the corpus with the ids they lead to."""
    docs = table(spark, d, "documents").select(F.regexp_replace("path", r"\.md$", "").alias("id"), F.col("text").alias("body"))
    from marginalia.bundle import Bundle

    return Bundle(docs, docs, docs).links()


LINKED = r"""WITH x AS (SELECT regexp_replace(path, '\.md$', '') AS src, unnest(regexp_extract_all(text, '\[[^\[\]\n]+\]\(\./[a-z0-9-]+\.md\)')) AS m FROM documents),
    l AS (SELECT src, regexp_replace(src, '/[^/]*$', '') || '/' || regexp_extract(m, '\(\./([a-z0-9-]+)\.md\)', 1) AS target FROM x)
    """


@plain(LINKED + "SELECT src, target, count(*) AS count FROM l WHERE src <> target GROUP BY src, target")
def edge_merge(spark, d):
    return access.merged_edges(link_extract(spark, d).filter("kind = 'markdown'"))


@plain(LINKED + ", ids AS (SELECT DISTINCT regexp_replace(path, '\\.md$', '') AS id FROM documents) SELECT src, target FROM l WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.id = l.target)")
def j_broken(spark, d):
    known = table(spark, d, "documents").select(F.regexp_replace("path", r"\.md$", "").alias("id")).distinct()
    return access.broken(link_extract(spark, d).filter("kind = 'markdown'"), known).select("src", "target")


@plain()
def html_to_markdown(spark, d):
    """Pages made of the documents, and back."""
    docs = table(spark, d, "documents").filter("text is not null")
    page = F.concat(F.lit("<html><head><title>"), F.col("doc_id").cast("string"), F.lit("</title></head><body><nav>menu</nav><article><p>"), F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), F.lit("</p></article></body></html>"))
    return files.convert_files(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), page.cast("binary").alias("content"))).select("path", "status", "title", F.length("converted").alias("chars"))


@plain()
def parse_document(spark, d):
    docs = table(spark, d, "docs").select("id", "title", "lang", "text").distinct()
    whole = F.concat(F.lit("---\ntitle: "), F.to_json(F.struct("title")), F.lit("\nlang: "), F.coalesce("lang", F.lit("~")), F.lit("\n---\n"), F.coalesce("text", F.lit("")))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            got = [M.parse_document(t) for t in pdf["t"]]
            yield pd.DataFrame({"id": pdf["id"], "state": [g.state for g in got], "meta": [g.meta for g in got], "chars": [len(g.body) for g in got]})

    return docs.select("id", whole.alias("t")).mapInPandas(run, "id string, state string, meta string, chars int")


# -- tables ------------------------------------------------------------------------------------------


@plain("SELECT unnest(['row_no', 'month', 'units', 'region']) AS name, unnest(['bigint', 'string', 'bigint', 'string']) AS type")
def infer_type(spark, d):
    sales = table(spark, d, "sales").select(*[F.col(c).cast("string") for c in ("row_no", "month", "units", "region")])
    kinds = tabular.infer(sales)
    return spark.createDataFrame(list(kinds.items()), "name string, type string")


@plain("SELECT row_no, units, revenue, nullif(trim(region), '') AS region FROM sales")
def load_rows(spark, d):
    raw = table(spark, d, "sales").select(*[F.col(c).cast("string").alias(c) for c in ("row_no", "units", "revenue", "region")])
    return tabular.typed(raw, {"row_no": "bigint", "units": "bigint", "revenue": "bigint", "region": "string"})


# -- quality rules -----------------------------------------------------------------------------------

WEIGHT = f"length(description) + 2 * length(regexp_replace(description, '[^{CJK}]', '', 'g'))"
ISO = r"regexp_matches({0}, '(?s)^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([Tt ].*)?$')"
LOWT = "translate(trim({0}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CHECKS = {
    "missing-frontmatter": "fm_state = 'absent'", "invalid-frontmatter": "fm_state IN ('unterminated', 'invalid')", "missing-type": blank("type"), "doc-too-long": "tokens > 8000",
    "missing-title": blank("title"), "missing-description": blank("description"), "description-repeats-title": f"{LOWT.format('description')} = {LOWT.format('title')}",
    "description-too-short": f"NOT {blank('description')} AND {WEIGHT} < 20", "description-too-long": "length(description) > 300", "missing-lang": blank("lang"), "missing-status": blank("status"),
    "missing-updated": blank("updated"), "invalid-status": f"NOT {blank('status')} AND status NOT IN ('stable', 'deprecated', 'draft')", "invalid-updated": f"NOT {blank('updated')} AND NOT {ISO.format('updated')}",
    "invalid-effective-range": f"coalesce(NOT {ISO.format('effective_from')}, false) OR coalesce(NOT {ISO.format('effective_to')}, false) OR coalesce({ISO.format('effective_from')} AND {ISO.format('effective_to')} AND effective_from > effective_to, false)",
}
#: Findings on metadata are those of documents whose block can be read, outside of _meta/.
USABLE = "fm_state = 'valid' AND NOT starts_with(id, '_meta/')"
RULES_SQL = " UNION ALL ".join(f"SELECT '{k}' AS rule, path FROM n WHERE ({v})" + ("" if k in ("missing-frontmatter", "invalid-frontmatter", "doc-too-long") else f" AND {USABLE}") for k, v in CHECKS.items())
FOLDERS = f"SELECT DISTINCT array_to_string(string_split(id, '/')[1:k], '/') AS folder FROM (SELECT id, unnest(range(0, len(string_split(id, '/')))) AS k FROM n WHERE {USABLE})"
ALL_RULES = f"""{RULES_SQL}
    UNION ALL SELECT 'missing-tags', path FROM n WHERE id NOT IN (SELECT doc_id FROM c) AND {USABLE}
    UNION ALL SELECT 'unknown-tag', path FROM (SELECT DISTINCT path, tag FROM c JOIN n ON n.id = c.doc_id WHERE c.canonical IS NULL AND {USABLE})
    UNION ALL SELECT 'non-canonical-tag', path FROM (SELECT DISTINCT path, tag, c.canonical FROM c JOIN n ON n.id = c.doc_id WHERE c.canonical <> c.norm AND {USABLE})
    UNION ALL SELECT 'missing-index', CASE WHEN folder = '' THEN 'index.md' ELSE folder || '/index.md' END FROM ({FOLDERS})
        WHERE folder NOT IN (SELECT CASE WHEN contains(id, '/') THEN regexp_replace(id, '/[^/]*$', '') ELSE '' END FROM d WHERE id = 'index' OR id LIKE '%/index')"""


#: The documents hold no links and no index or log documents, so no finding comes from those.
@query(f"SELECT rule, path, count(*) AS findings FROM ({ALL_RULES}) GROUP BY rule, path")
def lint_(b):
    return lint.lint(lint.Context(b)).groupBy("rule", "path").agg(F.count(F.lit(1)).alias("findings"))


LEVELS = " ".join(f"WHEN '{r}' THEN {level}" for r, (level, _) in lint.RULES.items())
ERRORS = ", ".join(f"'{r}'" for r, (_, severity) in lint.RULES.items() if severity == "error")
FOUND = f"(SELECT rule, CASE rule {LEVELS} END AS level, rule IN ({ERRORS}) AS error FROM ({ALL_RULES}))"


@query(f"SELECT rule, level, CASE WHEN error THEN 'error' ELSE 'warning' END AS severity, count(*) AS findings FROM {FOUND} GROUP BY ALL")
def lint_counts(b):
    return lint.counts(lint.lint(lint.Context(b)))


@query(f"SELECT count(*) FILTER (error) AS errors, count(*) FILTER (NOT error) AS warnings, coalesce(min(CASE WHEN error THEN level END) - 1, 2) AS level FROM {FOUND} WHERE level <= 2")
def lint_summary(b):
    return lint.summary(lint.lint(lint.Context(b)))


@query(f"SELECT path, tag FROM (SELECT DISTINCT path, tag FROM c JOIN n ON n.id = c.doc_id WHERE c.canonical IS NULL AND {USABLE})")
def lint_unknown_tag(b):
    return lint._tags(lint.Context(b))[1].select("path", F.col("message").alias("tag")).distinct()


@query("""SELECT doc_id, len(x) AS before, len(list_distinct(x)) AS after FROM (SELECT doc_id, list(coalesce(canonical, tag)) AS x, list(tag ORDER BY ord, tag) AS y, list(coalesce(canonical, tag) ORDER BY ord, tag) AS z FROM c GROUP BY doc_id) WHERE y <> z OR len(x) <> len(list_distinct(x))""")
def tags_dedup(b):
    return lint.canonical_plan(b).select("doc_id", F.size("before").alias("before"), F.size("after").alias("after"))


DIR = "CASE WHEN contains(id, '/') THEN regexp_replace(id, '/[^/]*$', '') ELSE '' END"


@query(f"""SELECT f.folder, CASE WHEN x.id IS NOT NULL THEN '- [' || coalesce(title, string_split(id, '/')[-1]) || '](./' || string_split(id, '/')[-1] || '.md)' END AS line
    FROM ({FOLDERS}) f LEFT JOIN (SELECT *, {DIR} AS dir FROM n) x ON x.dir = f.folder WHERE f.folder NOT IN (SELECT {DIR} FROM d WHERE id = 'index' OR id LIKE '%/index')""")
def fix_safe(b):
    return lint.index_plan(lint.Context(b))


@query()
def adopt_plan(b):
    return adopt.plan(b, 2)


@query()
def vocab_report(b):
    return adopt.tag_groups(b.tags)


@query(f"SELECT n.id, x.k AS documents FROM n JOIN (SELECT customer, count(*) AS k FROM n WHERE {ACTIVE} AND customer IS NOT NULL GROUP BY customer) x ON x.customer = n.customer")
def j_customer(b):
    """Documents with the number of documents in force of their customer."""
    d = Q.matching(b, Q.Filter())
    per = d.filter(Q.active_on("2025-06-01")).filter("customer is not null").groupBy("customer").agg(F.count(F.lit(1)).alias("documents"))
    return run_sql("SELECT d.id, p.documents FROM <<d>> d JOIN <<p>> p ON d.customer = p.customer", d=d.select("id", "customer"), p=per)
