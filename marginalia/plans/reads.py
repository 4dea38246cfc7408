"""Queries over metadata: filters, scopes, facets, sums, sorting, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import columns as C
from marginalia.functions import fields as metadata
from marginalia.functions.fields import EXTRA
from marginalia.operators import access
from marginalia.operators import query as Q
from marginalia.operators.scope import Scope, glob_predicate
from marginalia.plans.base import SPACE, blank, query

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ACTIVE = "(status IS NULL OR status = 'stable') AND coalesce(effective_from <= '2025-06-01', true) AND coalesce(effective_to >= '2025-06-01', true)"


def ids(df: DataFrame) -> DataFrame:
    return df.select("id")


@query(f"SELECT split_part(id, '/', 1) AS source, count(*) AS documents, max(updated) AS newest FROM n WHERE lang IN ('en', 'vi') AND {ACTIVE} AND coalesce(lower(trim(status)) <> 'deprecated', true) GROUP BY 1")
def flagship(b):
    d = Q.matching(b, Q.Filter(lang=("en", "vi"), status_not=("deprecated",), active_on="2025-06-01"))
    return d.groupBy(F.substring_index("id", "/", 1).alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.max("updated").alias("newest"))


@query(f"SELECT id FROM n WHERE {LOW.format('trim(type)')} IN ('policy', 'faq')")
def f_type(b):
    return ids(Q.matching(b, Q.Filter(type=("Policy", "faq"))))


@query(f"SELECT id FROM n WHERE {LOW.format('trim(status)')} = 'stable'")
def f_status(b):
    return ids(Q.matching(b, Q.Filter(status=("stable",))))


@query(f"SELECT id FROM n WHERE NOT coalesce({LOW.format('trim(status)')} IN ('deprecated', 'draft'), false)")
def f_status_not(b):
    return ids(Q.matching(b, Q.Filter(status_not=("deprecated", "Draft"))))


@query("SELECT id FROM n WHERE lang IN ('en', 'ja')")
def f_lang(b):
    return ids(Q.matching(b, Q.Filter(lang=("en", "ja"))))


@query(f"SELECT id FROM n WHERE {LOW.format('trim(type)')} IN ('policy', 'faq') AND {LOW.format('trim(status)')} = 'stable' AND lang = 'en'")
def f_prefilter(b):
    """Type, status and language in one request; the language is a plain comparison."""
    return ids(Q.matching(b, Q.Filter(type=("Policy", "FAQ"), status=("stable",), lang=("en",))))


@query("SELECT id FROM n WHERE regexp_matches(id, '^policies/[^/]*/[^/]*1$') OR id = 'faq/hub' OR starts_with(id, 'faq/hub/')")
def f_path(b):
    return ids(Q.matching(b, Q.Filter()).filter(glob_predicate("policies/*/*1", F.col("id")) | glob_predicate("./faq/hub.md", F.col("id"))))


TAG_KEYS = "k AS (SELECT doc_id, folded AS key FROM c UNION SELECT doc_id, canonical FROM c WHERE canonical IS NOT NULL)"


@query(f", {TAG_KEYS} SELECT id FROM n WHERE id IN (SELECT doc_id FROM k WHERE key = 'product-contract') AND id IN (SELECT doc_id FROM k WHERE key = 'warehouse-inspection')")
def f_tags_all(b):
    return ids(Q.matching(b, Q.Filter(tags_all=("Product Contract", "warehouse_inspection"))))


@query(f", {TAG_KEYS} SELECT id FROM n WHERE id IN (SELECT doc_id FROM k WHERE key IN ('product-contract', 'hop-dong-san-pham'))")
def f_tags_any(b):
    return ids(Q.matching(b, Q.Filter(tags_any=("product-contract", "Hợp đồng sản phẩm"))))


@query(f"SELECT id FROM n WHERE {LOW.format('trim(department)')} IN ('finance', 'sales') AND {LOW.format('trim(currency)')} = 'usd'")
def f_fields(b):
    return ids(Q.matching(b, Q.Filter(fields={"department": ["Finance", "sales"], "currency": ["USD"]})))


@query("SELECT id FROM n WHERE contains(lower(concat_ws(' ', id, coalesce(title, ''), coalesce(description, ''))), 'item-0000')")
def f_text(b):
    return ids(Q.matching(b, Q.Filter(text="ITEM-0000")))


@query("SELECT id FROM n WHERE updated >= '2025-03-01' AND updated <= '2025-09-30'")
def f_updated(b):
    return ids(Q.matching(b, Q.Filter(updated_from="2025-03-01", updated_to="2025-09-30")))


@query("SELECT id FROM n WHERE contract_value >= 100000 AND contract_value <= 5000000")
def f_ranges(b):
    return ids(Q.matching(b, Q.Filter(ranges={"contract_value": {"from": "100000", "to": "5000000"}})))


NUMERIC = r"regexp_matches({0}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')"


@query(f"SELECT id, coalesce(CASE WHEN {NUMERIC.format('x')} THEN try_cast(x AS DOUBLE) >= 90.0 ELSE x >= '90' END, false) AS at_least FROM (SELECT id, coalesce(CAST(contract_value AS VARCHAR), title) AS x FROM n)")
def range_cmp(b):
    x = F.coalesce(F.col("contract_value").cast("string"), F.col("title"))
    return Q.matching(b, Q.Filter()).select("id", Q.in_range(x, "90", None).alias("at_least"))


@query(f"SELECT id FROM n WHERE {ACTIVE}")
def f_active_on(b):
    return ids(Q.matching(b, Q.Filter(active_on="2025-06-01")))


EXTRA_SQL = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{k}=' || {c} END" for k, c in (*((k, k) for k in EXTRA), ("generated_by", "generated.by"), ("generated_at", "generated.at")))


@query(f"SELECT id, title, coalesce(array_to_string(list_sort(list_filter([{EXTRA_SQL}], lambda x: x IS NOT NULL)), ','), '') AS extra FROM n")
def project_row(b):
    """The key-sorted extra fields as one text: those kept as columns and those only in the metadata block."""
    rows = Q.project(b, Q.matching(b, Q.Filter()))
    return rows.select("id", "title", F.array_join(F.transform(F.map_entries("extra"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("extra"))


@query("SELECT id FROM n WHERE lang = 'vi' AND updated >= '2025-01-01' AND trim(lower(department)) IN ('quality', 'sales') AND generated.at >= '2024-06-01'")
def unknown_args_to_fields(b):
    r = Q.request_of({"lang": "vi", "department": ["Quality", "sales"], "generated_at_from": "2024-06-01", "updated_from": "2025-01-01"})
    return ids(Q.matching(b, r))


@query("SELECT id FROM n WHERE translate(trim(generated.by), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IS NOT NULL AND generated.at >= '2025-01-01' AND generated.at <= '2025-12-31'")
def f_ranges_any(b):
    """A range of a field that only the metadata block has."""
    return ids(Q.matching(b, Q.Filter(ranges={"generated_at": {"from": "2025-01-01", "to": "2025-12-31"}})).filter(metadata.scalar(b.docs, "generated_by").isNotNull()))


@query("SELECT field, value, count(*) AS count FROM (SELECT unnest(['generated_by', 'generated_at', 'department', 'contract_value']) AS field, unnest([generated.by, generated.at, department, CAST(contract_value AS VARCHAR)]) AS value FROM n) WHERE value IS NOT NULL GROUP BY field, value")
def facet_any(b):
    return Q.facet_values(b, Q.matching(b, Q.Filter()), ["generated_by", "generated_at", "department", "contract_value"])


@query("SELECT id FROM n ORDER BY generated.at ASC NULLS LAST, id LIMIT 40")
def sort_field_any(b):
    d = Q.matching(b, Q.Filter())
    return d.orderBy(*Q.order_by(d, "generated_at")).limit(40).select("id")


@query("SELECT id FROM d WHERE (starts_with(id, 'policies/') OR regexp_matches(id, '^contracts/[^/]*/note-.*$')) AND NOT starts_with(id, 'policies/hub/')")
def scope_path(b):
    return ids(Q.visible(b, Scope(allow=("policies", "contracts/*/note-**"), deny=("policies/hub",))))


@query(f"SELECT id FROM d WHERE coalesce(reserved, false) OR coalesce({LOW.format('trim(status)')} IN ('stable', 'draft'), false)")
def scope_meta_in(b):
    return ids(Q.visible(b, Scope(within={"status": ["stable", "DRAFT"]})))


@query(f"SELECT id FROM d WHERE coalesce(reserved, false) OR NOT coalesce({LOW.format('trim(region)')} = 'us', false)")
def scope_meta_notin(b):
    return ids(Q.visible(b, Scope(without={"region": ["us"]})))


@query(f"SELECT id, coalesce(reserved, false) AS reserved FROM d WHERE (coalesce(reserved, false) OR coalesce({LOW.format('trim(lang)')} = 'en', false)) AND NOT starts_with(id, 'faq/')")
def scope_reserved(b):
    return Q.visible(b, Scope(deny=("faq",), within={"lang": ["EN"]})).select("id", F.coalesce("reserved", F.lit(False)).alias("reserved"))


@query("SELECT DISTINCT c.doc_id AS id FROM c JOIN n ON n.id = c.doc_id WHERE lower(trim(c.tag)) IN ('product-contract', 'finance-audit')")
def value_matches(b):
    from marginalia.operators.scope import value_matches as match

    per = b.tags.groupBy("doc_id").agg(F.collect_list("tag").alias("tags"))
    hit = per.filter(match(F.col("tags"), ["Product-Contract", " finance-audit "], many=True)).select(F.col("doc_id").alias("id"))
    return ids(Q.matching(b, Q.Filter())).join(hit, "id", "left_semi")


@query(f"SELECT count(*) AS total FROM n WHERE {ACTIVE}")
def count_total(b):
    return Q.matching(b, Q.Filter(active_on="2025-06-01")).agg(F.count(F.lit(1)).alias("total"))


@query("SELECT 'tags' AS field, tag AS value, count(*) AS count FROM c JOIN n ON n.id = c.doc_id WHERE lang = 'en' GROUP BY tag")
def facet(b):
    return Q.facet_values(b, Q.matching(b, Q.Filter(lang=("en",))), ["tags"])


@query("SELECT field, value, count(*) AS count FROM (SELECT unnest(['type', 'lang', 'status', 'currency']) AS field, unnest([type, lang, status, currency]) AS value FROM n) WHERE value IS NOT NULL GROUP BY field, value")
def multi_facet(b):
    return Q.facet_values(b, Q.matching(b, Q.Filter()), ["type", "lang", "status", "currency"])


@query("SELECT coalesce(sum(CAST(contract_value AS DOUBLE)), 0) AS total, count(contract_value) AS contributing FROM n WHERE type = 'Contract'")
def sum_field(b):
    return Q.sum_of(Q.matching(b, Q.Filter()).filter("type = 'Contract'"), "contract_value")


@query("SELECT currency AS unit, count(*) AS count FROM n WHERE contract_value IS NOT NULL GROUP BY currency")
def sum_units(b):
    return Q.sum_units(Q.matching(b, Q.Filter()), "contract_value")


def _ranked(b, sort: str, limit: int) -> DataFrame:
    top = Q.matching(b, Q.Filter()).select("id", "contract_value", "updated").orderBy(*Q.order_by(b.docs, sort)).limit(limit)
    return top.select("id")


@query("SELECT id FROM n ORDER BY contract_value ASC NULLS LAST, id LIMIT 40")
def sort_field(b):
    return _ranked(b, "contract_value", 40)


@query("SELECT id FROM n ORDER BY updated DESC NULLS FIRST, id DESC LIMIT 40")
def sort_field_down(b):
    return _ranked(b, "-updated", 40)


@query("SELECT count(*) AS total, least(count(*), 50) AS shown, greatest(count(*) - 50, 0) AS more FROM n WHERE lang = 'ja'")
def limit_more(b):
    return Q.page(Q.matching(b, Q.Filter(lang=("ja",))))


@query("SELECT count(*) AS docs, (SELECT count(*) FROM d WHERE coalesce(reserved, false)) AS reserved, CAST(sum(greatest(coalesce(tokens, 0), 0)) AS BIGINT) AS tokens FROM n")
def stats(b):
    return access.totals(b.docs)


@query("SELECT coalesce(type, '(none)') AS type, count(*) AS documents FROM n GROUP BY 1")
def stats_types(b):
    return access.counts_by(b.docs, "type")


@query("SELECT coalesce(lang, '(none)') AS lang, count(*) AS documents FROM n GROUP BY 1")
def stats_langs(b):
    return access.counts_by(b.docs, "lang")


@query("SELECT split_part(id, '/', 1) AS source, CASE WHEN sum(greatest(coalesce(tokens, 0), 0)) <= 30000 THEN 'full' WHEN count(*) % 2 = 0 THEN 'retrieval' ELSE 'lexical' END AS mode FROM n GROUP BY 1")
def mode_for(b):
    t = F.sum(F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)))
    return Q.matching(b, Q.Filter()).groupBy(F.substring_index("id", "/", 1).alias("source")).agg(access.mode_for(t, F.count(F.lit(1)) % 2 == 0).alias("mode"))


DETECT = "CASE WHEN regexp_matches({0}, '[" + C.CJK + "]') THEN 'ja' WHEN regexp_matches(lower({0}), '[" + C.VIETNAMESE + r"]') THEN 'vi' WHEN regexp_matches({0}, '\p{{L}}') THEN 'en' END"


@query(f"""SELECT lang, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT coalesce(CASE WHEN NOT {blank("lang")} AND code <> '' THEN code END, {DETECT.format("substring(body, 1, 2000)")}) AS lang, greatest(coalesce(tokens, 0), 1) AS w
    FROM (SELECT *, lower(regexp_extract(trim(lang), '^([^-_]*)', 1)) AS code FROM n)) WHERE lang IS NOT NULL GROUP BY lang""")
def content_langs(b):
    return access.content_langs(b.docs)


@query(f"SELECT id, {DETECT.format('body')} AS lang FROM n")
def detect_lang(b):
    return Q.matching(b, Q.Filter()).select("id", C.detect_lang(F.col("body")).alias("lang"))


@query("""SELECT field, value, count(*) AS count FROM (SELECT unnest(['type', 'lang', 'status']) AS field, unnest([type, lang, status]) AS value FROM n) WHERE value IS NOT NULL GROUP BY field, value
    UNION ALL SELECT 'facet', facet, count(DISTINCT doc_id) FROM c JOIN terms ON terms.tag = c.canonical JOIN n ON n.id = c.doc_id WHERE facet IS NOT NULL GROUP BY facet""")
def catalog_facets(b):
    return access.catalog_facets(b, Q.matching(b, Q.Filter()))


@query("SELECT terms.tag, facet, coalesce(x.k, 0) AS documents FROM terms LEFT JOIN (SELECT canonical, count(DISTINCT doc_id) AS k FROM c JOIN n ON n.id = c.doc_id GROUP BY canonical) x ON x.canonical = terms.tag")
def vocab_usage(b):
    return access.vocabulary_usage(b, Q.matching(b, Q.Filter()))


@query("""SELECT key, count(*) AS documents FROM (SELECT id, unnest(['department', 'region', 'customer', 'effective_from', 'effective_to', 'contract_value', 'currency', 'generated_by', 'generated_at']) AS key,
    unnest([department, region, customer, effective_from, effective_to, CAST(contract_value AS VARCHAR), currency, generated.by, generated.at]) AS x FROM n) WHERE x IS NOT NULL
    GROUP BY key HAVING count(*) >= greatest((SELECT count(*) FROM n) // 10, 1) ORDER BY documents DESC, key LIMIT 12""")
def frequent_fields(b):
    return access.frequent_fields(b, Q.matching(b, Q.Filter()))


@query(f", h AS (SELECT {DETECT.format('x')} AS lang FROM (SELECT concat_ws(' ', title, description) AS x FROM n ORDER BY id LIMIT 200)) SELECT lang, count(*) AS documents FROM h WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 0.1 * (SELECT count(*) FROM h WHERE lang IS NOT NULL)")
def detected_langs(b):
    return access.detected_langs(Q.matching(b, Q.Filter()))


@query("SELECT kind, name, count(*) AS documents, max(title) AS title FROM (SELECT CASE WHEN contains(rest, '/') THEN 'dir' ELSE 'doc' END AS kind, split_part(rest, '/', 1) AS name, CASE WHEN contains(rest, '/') THEN NULL ELSE title END AS title FROM (SELECT substring(id, 10) AS rest, title FROM n WHERE starts_with(id, 'policies/'))) GROUP BY kind, name")
def list_dir(b):
    return access.list_dir(b, "./policies/")


@query("SELECT id, title, type, description FROM n")
def catalog(b):
    return access.catalog_rows(b)


@query("SELECT id, array_to_string(string_split(body, chr(10))[2:4], chr(10)) AS content FROM d WHERE body IS NOT NULL")
def get_lines(b):
    return access.lines_of(b.docs.filter("body is not null"), 2, 4)


_MARK = f"CASE WHEN regexp_matches(x, '^[{SPACE}]*```') THEN '`' WHEN regexp_matches(x, '^[{SPACE}]*~~~') THEN '~' ELSE '' END"
#: A fold over the lines: whether a fence is open (and of which kind), and the headings found so far.
_FOLD = f"""list_reduce(string_split(body, chr(10)), lambda a, x: CASE WHEN left(a, 1) <> '-' THEN CASE WHEN {_MARK} = left(a, 1) THEN '-' || substring(a, 2) ELSE a END
    WHEN {_MARK} <> '' THEN {_MARK} || substring(a, 2) WHEN regexp_matches(x, '^#{{1,6}}[ \t]') THEN a || chr(1) || x ELSE a END, '-')"""


@query(f"""SELECT id, length(regexp_extract(h, '^(#+)', 1)) AS level, regexp_replace(regexp_replace(regexp_replace(h, '^#+[ \t]+|[{SPACE}]+$', '', 'g'), '#+$', ''), '[{SPACE}]+$', '') AS text
    FROM (SELECT id, unnest(string_split(substring({_FOLD}, 3), chr(1))) AS h FROM n WHERE body IS NOT NULL) WHERE h <> ''""")
def headings(b):
    return access.headings_of(Q.matching(b, Q.Filter()).filter("body is not null")).select("id", "level", "text")


@query()
def get_section(b):
    return access.sections_of(Q.matching(b, Q.Filter()), "scope")


@query(f"SELECT id, true AS is_front, true AS within FROM n WHERE body IS NOT NULL")
def cut_to_tokens(b):
    """Whether what is left of each body is its front, and within the budget or one line of three characters a token."""
    d = Q.matching(b, Q.Filter()).filter("body is not null")
    got = access.cut_bodies(d, 100).join(d.select("id", "body"), "id")
    return got.select("id", F.col("body").startswith(F.col("content")).alias("is_front"), ((C.estimate_tokens(F.col("content")) <= 100) | ((F.length("content") <= 300) & ~F.col("content").contains("\n"))).alias("within"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
