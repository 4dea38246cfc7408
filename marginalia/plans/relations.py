"""Queries that join, rank, pack and sample, SQL through the gate, vectors, and the stream extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.bundle import from_testdata
from marginalia.functions import columns as C
from marginalia.operators import access, sample, sync, vectors
from marginalia.operators import query as Q
from marginalia.operators.scope import Scope
from marginalia.operators.sqlgate import Gate
from marginalia.plans.reads import DETECT
from marginalia.plans.base import blank, ORACLE, plain, query
from marginalia.streaming.ingest import windowed
from marginalia.tables import run_sql, table

# -- joins -------------------------------------------------------------------------------------------


@query("SELECT n.id, count(t.tag) AS tags FROM n LEFT JOIN t ON t.doc_id = n.id GROUP BY n.id")
def j_tags(b):
    per = b.tags.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("tags"))
    return Q.matching(b, Q.Filter()).select("id").join(per, "id", "left").withColumn("tags", F.coalesce("tags", F.lit(0)))


@query("SELECT doc_id, ord, canonical FROM c")
def j_vocab(b):
    return b.tags.select("doc_id", "ord", "canonical")


EDGES = "WITH e AS (SELECT 's/' || l_suppkey AS src, 'p/' || l_partkey AS target FROM lineitem), m AS (SELECT src, target, count(*) AS count FROM e GROUP BY src, target)"


def _edges(spark, d) -> DataFrame:
    return access.merged_edges(table(spark, d, "lineitem").select(F.concat(F.lit("s/"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p/"), F.col("l_partkey")).alias("target")))


def _nodes(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.concat(F.lit("s/"), F.col("s_suppkey")).alias("id")).unionByName(table(spark, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey")).alias("id")))


NODES = "g AS (SELECT 's/' || s_suppkey AS id FROM supplier UNION ALL SELECT 'p/' || p_partkey FROM part)"


@plain(EDGES + " SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM m UNION ALL SELECT target, 0, 1 FROM m) GROUP BY id")
def graph(spark, d):
    return access.degrees(_edges(spark, d))


@plain(EDGES + f", {NODES}, k AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM m UNION ALL SELECT target FROM m) GROUP BY id) SELECT g.id, coalesce(degree, 0) AS degree FROM g LEFT JOIN k ON g.id = k.id ORDER BY degree DESC, g.id LIMIT 50")
def graph_topn(spark, d):
    return access.top_nodes(_nodes(spark, d), _edges(spark, d), 50)


@plain(EDGES + " SELECT src, target, count FROM m WHERE src LIKE 's/1%' AND target LIKE 'p/2%'")
def j_links_docs(spark, d):
    kept = _nodes(spark, d).filter("id like 's/1%' or id like 'p/2%'")
    return access.kept_edges(_edges(spark, d), kept).select("src", "target", "count")


@plain(EDGES + " SELECT src, target FROM m WHERE target IN (SELECT 'p/' || p_partkey FROM part WHERE p_size > 25) AND src IN (SELECT 's/' || s_suppkey FROM supplier WHERE s_acctbal > 0)")
def j_backlinks(spark, d):
    e = _edges(spark, d).withColumns({"text": F.lit(""), "line": F.lit(1)})
    big = table(spark, d, "part").filter("p_size > 25").select(F.concat(F.lit("p/"), F.col("p_partkey")).alias("target"))
    seen = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s/"), F.col("s_suppkey")).alias("id"))
    return access.backlinks(e.join(big, "target", "left_semi"), seen).select("src", "target")


@plain("SELECT n.n_name AS raw, CASE WHEN x.k = 1 THEN x.id END AS target FROM nation n LEFT JOIN (SELECT string_split(id, '/')[-1] AS name, min(id) AS id, count(*) AS k FROM (SELECT r_name || '/' || n_name AS id FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'ASIA/' || n_name FROM nation WHERE n_nationkey % 5 = 0) GROUP BY 1) x ON x.name = n.n_name")
def j_wikilink(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    ids = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat_ws("/", "r_name", "n_name").alias("id")).unionByName(n.filter("n_nationkey % 5 = 0").select(F.concat(F.lit("ASIA/"), "n_name").alias("id")))
    links = n.select(F.lit("start").alias("src"), F.col("n_name").alias("raw"), F.lit(None).cast("string").alias("target"), F.lit("wiki").alias("kind"), F.lit("").alias("text"), F.lit(1).alias("line"))
    return access.resolve_wiki(links, ids).select("raw", "target")


@query("SELECT id, CASE WHEN id IN (SELECT DISTINCT doc_id FROM t) THEN 1 ELSE 0 END AS exists FROM n")
def links_out(b):
    """Every document as a link to its tags' rows: whether the target exists."""
    links = Q.matching(b, Q.Filter()).select(F.lit("x").alias("src"), F.col("id").alias("target"), F.col("id").alias("raw"), F.lit("").alias("text"), F.lit("markdown").alias("kind"), F.lit(1).alias("line"))
    known = b.tags.select(F.col("doc_id").alias("id")).distinct()
    return access.outgoing(links, known).select(F.col("target").alias("id"), F.col("exists").cast("int").alias("exists"))


@plain("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j_chunk_missing_vec(spark, d):
    chunks = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    have = table(spark, d, "orders").select(F.col("o_custkey").alias("chunk_id"), F.when(F.col("o_orderstatus") == "F", "m").otherwise("other").alias("model"))
    return vectors.missing(chunks, have, "m").select(F.col("id").alias("c_custkey"))


SUPERSEDES = "s AS (SELECT id, substring(id, 1, length(id) - 1) || '0' AS old FROM n WHERE id NOT LIKE '%0')"


def _supersedes(b) -> DataFrame:
    return Q.matching(b, Q.Filter()).filter("id not like '%0'").select("id", F.expr("concat(substring(id, 1, length(id) - 1), '0')").alias("old"))


@query(f", {SUPERSEDES} SELECT 'unknown-supersedes' AS rule, n.path, s.old AS message FROM s JOIN n ON n.id = s.id WHERE s.old NOT IN (SELECT id FROM n) UNION SELECT 'superseded-still-stable', n.path, s.old FROM s JOIN n ON n.id = s.id JOIN n o ON o.id = s.old WHERE o.status = 'stable'")
def j_supersedes(b):
    from functools import reduce

    from marginalia.operators import lint

    parts = lint._supersedes(lint.Context(b, supersedes=_supersedes(b)))
    return reduce(DataFrame.unionByName, parts).select("rule", "path", "message").distinct()


SCHEMA_ROWS = [("Contract", "customer", "string", True, []), ("Contract", "contract_value", "string", False, []), ("Policy", "region", "string", False, ["north", "south"])]


@query("""SELECT rule, path, field FROM (SELECT 'schema-missing-field' AS rule, path, 'customer' AS field FROM n WHERE fm_state = 'valid' AND type = 'Contract' AND customer IS NULL
    UNION ALL SELECT 'schema-wrong-type', path, 'contract_value' FROM n WHERE fm_state = 'valid' AND type = 'Contract' AND contract_value IS NOT NULL
    UNION ALL SELECT 'schema-not-allowed', path, 'region' FROM n WHERE fm_state = 'valid' AND type = 'Policy' AND region IS NOT NULL AND region NOT IN ('north', 'south'))""")
def j_type_schema(b):
    from functools import reduce

    from marginalia.operators import lint

    schemas = b.spark.createDataFrame(SCHEMA_ROWS, "type string, field string, kind string, required boolean, allowed array<string>")
    parts = lint._schemas(lint.Context(b, schemas=schemas))
    return reduce(DataFrame.unionByName, parts).select("rule", "path", F.col("message").alias("field"))


@plain("SELECT DISTINCT path FROM docs WHERE path NOT IN (SELECT path FROM documents WHERE path IS NOT NULL)")
def j_materialized(spark, d):
    return sync.without_imported(table(spark, d, "docs").select("path").distinct(), table(spark, d, "documents").select(F.col("path").alias("source_path")))


@plain("SELECT doc_id FROM documents WHERE path NOT IN (SELECT path FROM docs)")
def j_orphans(spark, d):
    return sync.orphans(table(spark, d, "documents").select("doc_id", F.col("path").alias("source_path")), table(spark, d, "docs").select("path").distinct()).select("doc_id")


LISTED = """WITH one AS (SELECT * FROM (SELECT path, hash, size, mtime_ns, row_number() OVER (PARTITION BY path ORDER BY mtime_ns DESC NULLS LAST, hash) AS k FROM docs WHERE path IS NOT NULL) WHERE k = 1),
    old AS (SELECT * FROM (SELECT path, hash, size, mtime_ns, row_number() OVER (PARTITION BY path ORDER BY mtime_ns DESC NULLS LAST, hash) AS k FROM docs WHERE path IS NOT NULL AND (status IS NULL OR status <> 'stable')) WHERE k = 1)"""


@plain(LISTED + """ SELECT coalesce(one.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'new' WHEN one.path IS NULL THEN 'removed'
    WHEN one.size IS NOT DISTINCT FROM old.size AND one.mtime_ns IS NOT DISTINCT FROM old.mtime_ns THEN 'unchanged' WHEN one.hash IS NOT DISTINCT FROM old.hash THEN 'touched' ELSE 'changed' END AS action
    FROM one FULL JOIN old ON one.path = old.path""")
def j_change_detect(spark, d):
    docs = table(spark, d, "docs").filter("path is not null")
    cols = ("path", "hash", "size", "mtime_ns")
    return sync.changes(docs.select(*cols), docs.filter("status is null or status <> 'stable'").select(*cols))


@plain("""WITH p AS (SELECT sku AS target, CAST(price_vnd AS VARCHAR) AS source_hash, CASE WHEN price_jpy IS NULL THEN 'x' END AS error FROM price_list),
    e AS (SELECT sku AS target, CAST(max(qty) AS VARCHAR) AS source_hash, CAST(min(qty) AS VARCHAR) AS body_hash, CAST(max(qty) AS VARCHAR) AS disk_hash FROM inventory GROUP BY sku)
    SELECT coalesce(p.target, e.target) AS target, CASE WHEN p.target IS NULL THEN 'orphan' WHEN p.error IS NOT NULL THEN 'error' WHEN e.target IS NULL THEN 'new' WHEN e.disk_hash IS DISTINCT FROM e.body_hash THEN 'edited'
    WHEN p.source_hash IS NOT DISTINCT FROM e.source_hash THEN 'unchanged' ELSE 'update' END AS action FROM p FULL JOIN e ON p.target = e.target""")
def sink_import(spark, d):
    planned = table(spark, d, "price_list").select(F.col("sku").alias("target"), F.col("price_vnd").cast("string").alias("source_hash"), F.when(F.col("price_jpy").isNull(), "x").alias("error"))
    there = table(spark, d, "inventory").groupBy(F.col("sku").alias("target")).agg(F.max("qty").cast("string").alias("source_hash"), F.min("qty").cast("string").alias("body_hash"), F.max("qty").cast("string").alias("disk_hash"))
    return sync.import_actions(planned, there)


@plain("WITH f AS (SELECT sku AS id, price_vnd AS v FROM price_list WHERE status = 'active'), g AS (SELECT sku AS id FROM price_list WHERE status IS NULL) SELECT sku AS id, qty AS v FROM (SELECT sku, max(qty) AS qty FROM inventory GROUP BY sku) WHERE sku NOT IN (SELECT id FROM f) AND sku NOT IN (SELECT id FROM g) UNION ALL SELECT id, v FROM f")
def sink_index(spark, d):
    """The table after a sync: old rows kept, rewritten and gone."""
    p = table(spark, d, "price_list").select(F.col("sku").alias("id"), F.col("price_vnd").alias("v"), "status")
    old = table(spark, d, "inventory").groupBy(F.col("sku").alias("id")).agg(F.max("qty").alias("v"))
    return sync.merged(old, p.filter("status = 'active'").select("id", "v"), p.filter("status is null").select("id"))


# -- sets --------------------------------------------------------------------------------------------


@query("SELECT DISTINCT 'unknown-tag' AS rule, path, tag AS message FROM c JOIN n ON n.id = c.doc_id WHERE c.canonical IS NULL AND fm_state = 'valid'")
def dedup_diagnostics(b):
    """A document can have a tag twice: its findings come once."""
    from marginalia.operators import lint

    return lint.distinct(lint._tags(lint.Context(b))[1]).select("rule", "path", "message")


@plain("""WITH q AS (SELECT doc_id AS q_id, trim(regexp_replace(lower(source), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm FROM documents WHERE source IS NOT NULL)
    SELECT min(q_id) AS q_id FROM q WHERE norm NOT IN (SELECT trim(regexp_replace(lower(source), '[^\\p{L}\\p{N}]+', ' ', 'g')) FROM mix_targets) GROUP BY norm""")
def dedup_questions(spark, d):
    q = table(spark, d, "documents").filter("source is not null").select(F.col("doc_id").alias("q_id"), F.col("source").alias("q"))
    return sample.fresh_questions(q, table(spark, d, "mix_targets").select(F.col("source").alias("q"))).select("q_id")


# -- ranks and packs ---------------------------------------------------------------------------------

def _passages(docs: DataFrame) -> DataFrame:
    """Documents as passages, three to a document of the sample."""
    return docs.select(F.concat(F.lit("d"), F.expr("doc_id div 3")).alias("doc_id"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("tokens"), "text", "lang")


#: The plan drawn from all documents, its language by label, else as detected.
PLAN = f"""p AS (SELECT 'd' || (doc_id // 3) || '#' || doc_id AS key, 'd' || (doc_id // 3) AS doc, n_chars AS tokens, coalesce(nullif(CASE WHEN NOT {blank("lang")} THEN lower(regexp_extract(trim(lang), '^([^-_]+)', 1)) END, ''), {DETECT.format("substring(text, 1, 2000)")}, 'other') AS lang
        FROM documents WHERE n_chars >= 40 AND NOT {blank("text")}),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY sha256(key)) AS rank_in_doc FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rank_in_doc, sha256(key)) AS turn FROM r WHERE rank_in_doc <= 4)"""


@plain(f"WITH {PLAN} SELECT key, turn FROM s ORDER BY turn, lang LIMIT 60")
def stratified_rr(spark, d):
    return sample.stratified(_passages(table(spark, d, "documents")), sample.Settings(max_passages=60)).select("key", "turn")


@plain("SELECT CAST(doc_id AS VARCHAR) AS doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR))) <= (SELECT CAST(least(greatest(ceil(count(*) * 0.15), least(20, count(*) // 4)), count(*) - 1) AS BIGINT) FROM documents) AS heldout FROM documents")
def heldout_split(spark, d):
    return sample.heldout(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id")))


@plain(f"""WITH RECURSIVE {PLAN}, o AS (SELECT *, row_number() OVER (ORDER BY turn, lang, key) AS rn FROM (SELECT * FROM s ORDER BY turn, lang LIMIT 400)),
    b AS (SELECT rn, key, 1 AS batch, 1 AS n, CAST(tokens AS BIGINT) AS t FROM o WHERE rn = 1 UNION ALL
        SELECT o.rn, o.key, CASE WHEN b.n >= 10 OR b.t + o.tokens > 6000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n >= 10 OR b.t + o.tokens > 6000 THEN 1 ELSE b.n + 1 END,
            CASE WHEN b.n >= 10 OR b.t + o.tokens > 6000 THEN CAST(o.tokens AS BIGINT) ELSE CAST(b.t + o.tokens AS BIGINT) END FROM b JOIN o ON o.rn = b.rn + 1)
    SELECT key, batch FROM b""")
def batch_pack(spark, d):
    """The plan drawn from all documents, packed in its order."""
    plan = sample.stratified(_passages(table(spark, d, "documents")))
    return sample.batches(plan.select(F.struct("turn", "top", "passage_lang").alias("turn"), "key", "tokens"))


@plain("""SELECT doc_id AS q_id, CAST(doc_id AS VARCHAR) AS key, heldout FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR))) <= (SELECT CAST(least(greatest(ceil(count(*) * 0.15), least(20, count(*) // 4)), count(*) - 1) AS BIGINT) FROM documents) AS heldout, text FROM documents)
    WHERE text IS NOT NULL""")
def j_answers_passages(spark, d):
    """Questions on all documents, split as their passages are; those without text are no passages."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    p = sample.heldout(docs.select("doc_id")).join(docs.filter("text is not null").select("doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "key")
    return sample.answered(table(spark, d, "documents").select(F.col("doc_id").alias("q_id"), F.col("doc_id").cast("string").alias("passage")), p)


QUERY_VECS = "q AS (SELECT vec_id AS query_id, embedding AS qvec FROM embeddings WHERE vec_id % 20 = 0)"
SCORES = f", {QUERY_VECS}, s AS (SELECT query_id, vec_id AS chunk_id, CAST(label AS VARCHAR) AS doc_id, list_cosine_similarity(CAST(qvec AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings)"
BEST = SCORES + ", a AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS n FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM a WHERE n <= 2)"


def _queries(b) -> DataFrame:
    return b.vectors.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))


@query(BEST + " SELECT query_id, chunk_id, doc_id, rank FROM b WHERE rank <= 8", name="topk_per_doc")
def _topk(b):
    return vectors.search(b.vectors, _queries(b), 8, 2).select("query_id", "chunk_id", "doc_id", "rank")


@query(BEST.replace("n <= 2", "n <= 1") + " SELECT query_id, chunk_id, doc_id, round(score, 6) AS score, rank FROM b WHERE rank <= 8", name="search")
def _search(b):
    return vectors.search(b.vectors, _queries(b), 8, 1).select("query_id", "chunk_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(SCORES + " SELECT chunk_id, round(score, 5) AS score FROM s WHERE query_id = 0", name="j_query_vectors")
def _all_scores(b):
    one = b.vectors.filter("chunk_id = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    return vectors.scores(b.vectors, one).select("chunk_id", F.round("score", 5).alias("score"))


@query("SELECT vec_id AS chunk_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS squares, CASE WHEN list_inner_product(embedding, embedding) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS unit FROM embeddings", name="dot")
def _dot(b):
    return b.vectors.select("chunk_id", F.round(C.dot(F.col("vec"), F.col("vec")), 4).alias("squares"), F.round(C.dot(C.l2_normalize(F.col("vec")), C.l2_normalize(F.col("vec"))), 6).alias("unit"))


@query("RECURSIVE " + BEST + """, h AS (SELECT query_id, rank, chunk_id, 200 + chunk_id % 700 AS tokens FROM b WHERE rank <= 12),
    k AS (SELECT query_id, rank, [chunk_id] AS chunks, CAST(tokens AS BIGINT) AS tokens FROM h WHERE rank = 1 UNION ALL
        SELECT h.query_id, h.rank, CASE WHEN k.tokens + h.tokens <= 3000 THEN list_append(k.chunks, h.chunk_id) ELSE k.chunks END, CASE WHEN k.tokens + h.tokens <= 3000 THEN CAST(k.tokens + h.tokens AS BIGINT) ELSE k.tokens END FROM k JOIN h ON h.query_id = k.query_id AND h.rank = k.rank + 1)
    SELECT query_id, array_to_string(chunks, ',') AS chunks, tokens FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1""", name="pack_budget")
def _pack(b):
    hits = vectors.search(b.vectors, _queries(b), 12, 2).withColumn("tokens", 200 + F.col("chunk_id") % 700)
    return vectors.pack(hits, 3000).select("query_id", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",").alias("chunks"), "tokens")


@query(name="embed_sync")
def _embed(b):
    """Vectors of whole texts, chunk by chunk, under their documents' titles."""
    chunks = b.chunks().join(b.docs.select(F.col("id").alias("doc_id"), "title"), "doc_id").select("id", "title", "heading", "text")
    none = b.spark.createDataFrame([], "chunk_id bigint, model string, vec array<float>")
    return vectors.embed_sync(chunks, none, vectors.LetterEmbedder()).select("chunk_id", "model", F.size("vec").alias("dims"))


# -- training data and scores ------------------------------------------------------------------------


@plain("""SELECT bucket, count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS r_at_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS r_at_3, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr
    FROM (SELECT CASE WHEN rank <= 10 THEN rank END AS r, unnest(CASE WHEN l_linenumber % 3 = 0 THEN ['all'] WHEN l_linenumber % 3 = 1 THEN ['all', 'cross'] ELSE ['all', 'same'] END) AS bucket
    FROM (SELECT CAST(l_quantity AS INTEGER) % 14 + 1 AS rank, l_linenumber FROM lineitem)) GROUP BY bucket""")
def eval_metrics(spark, d):
    r = table(spark, d, "lineitem").select((F.col("l_quantity").cast("int") % 14 + 1).alias("rank"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber") % 3 == 1).alias("cross"))
    got = sample.retrieval_scores(r)
    return got.select("bucket", "n", *[F.round(c, 6).alias(c) for c in ("r_at_1", "r_at_3", "mrr")])


@plain("SELECT l_returnflag AS category, count(*) AS total, count(*) FILTER (l_tax > 0.02) AS passed, count(*) FILTER (NOT l_tax > 0.02 AND l_discount > 0.05) AS regressions, count(*) FILTER (l_tax > 0.02 AND NOT l_discount > 0.05) AS improvements FROM lineitem GROUP BY 1")
def eval_by_category(spark, d):
    return sample.category_results(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("category"), (F.col("l_tax") > 0.02).alias("passed"), (F.col("l_discount") > 0.05).alias("baseline_passed")))


@plain("SELECT lang, kind, count(*) AS rows FROM (SELECT lang, CASE WHEN doc_id % 7 = 0 THEN 'heldout' ELSE 'train' END AS kind FROM documents) GROUP BY lang, kind")
def tune_status(spark, d):
    return sample.status(table(spark, d, "documents").select("lang", (F.col("doc_id") % 7 == 0).alias("heldout")))


@plain()
def ngram_copy(spark, d):
    """Every row whose id is divisible by 20 against all rows but itself.  Folding is beyond SQL; a test compares with
    brute force."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return sample.copied_from_others(rows, F.col("id") % 20 == 0).select(F.col("id").alias("doc_id"))


@plain()
def check_batch(spark, folder):
    """The description of every document as a question on it."""
    whole, d = (Q.matching(from_testdata(spark, folder, bodies), Q.Filter()).filter("body is not null") for bodies in (True, False))
    p = whole.select(F.col("id").alias("key"), F.coalesce("lang", F.lit("other")).alias("lang"), "title", F.col("body").alias("text"))
    kinds = F.element_at(F.array(*map(F.lit, ("natural", "keyword", "vague", "cross"))), (F.pmod(F.crc32(F.col("id")), F.lit(4)) + 1).cast("int"))
    q = d.select(F.col("id").alias("q_id"), F.col("id").alias("passage"), kinds.alias("kind"), F.coalesce("lang", F.lit("en")).alias("lang"), F.coalesce("description", "title", F.lit("")).alias("q"))
    return sample.check_questions(q, p, ["en", "vi", "ja"])


# -- SQL through the gate ----------------------------------------------------------------------------

SQL = {
    "sql_join": ("SELECT r_name, n_name, count(*) AS customers FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name", None),
    "sql_left": ("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", None),
    "sql_full": ("SELECT p.sku AS a, i.sku AS b FROM price_list p FULL JOIN (SELECT DISTINCT sku FROM inventory) i ON p.sku = i.sku", None),
    "sql_using": ("SELECT sku, product_name, qty FROM price_list JOIN (SELECT sku, qty FROM inventory) i USING (sku)", None),
    "sql_semi": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", None),
    "sql_anti": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", None),
    "sql_scalar_subquery": ("SELECT p_partkey FROM part p WHERE p_size = (SELECT max(p_size) FROM part x WHERE x.p_brand = p.p_brand)", None),
    "sql_theta": ("SELECT a.sku AS cheap, count(*) AS dearer FROM price_list a JOIN price_list b ON a.category = b.category AND a.price_vnd < b.price_vnd GROUP BY a.sku", None),
    "sql_group": ("SELECT region, month, sum(units) AS units, sum(revenue) AS revenue FROM sales GROUP BY region, month HAVING count(*) > 2", None),
    "sql_filter": ("SELECT sku, count(*) FILTER (WHERE units < 0) AS returned, sum(units) FILTER (WHERE units > 0) AS sold FROM sales GROUP BY sku", None),
    "sql_rollup": ("SELECT category, region, sum(units) AS units FROM sales GROUP BY ROLLUP (category, region)", None),
    "sql_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "sql_window": ("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders", None),
    "sql_frame": ("SELECT row_no, sum(units) OVER (PARTITION BY sku ORDER BY row_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM (SELECT DISTINCT row_no, sku, units FROM sales)", None),
    "sql_setops": ("SELECT sku FROM price_list EXCEPT SELECT sku FROM sales UNION SELECT sku FROM inventory INTERSECT SELECT sku FROM price_list", None),
    "sql_cte": ("WITH top AS (SELECT sku, sum(revenue) AS r FROM sales GROUP BY sku), m AS (SELECT max(r) AS r FROM top) SELECT sku FROM top JOIN m ON top.r = m.r", None),
    "sql_recursive": ("WITH RECURSIVE t AS (SELECT 1 AS k UNION ALL SELECT k + 1 FROM t WHERE k < 60) SELECT k, k * k AS square FROM t", None),
    "sql_case": ("SELECT sku, CASE WHEN qty IS NULL THEN 'unknown' WHEN qty < reorder_level THEN 'low' ELSE 'ok' END AS state FROM inventory", None),
    "sql_strings": ("SELECT sku, upper(sku) AS up, substr(sku, 1, 3) AS head, instr(sku, '-') AS at, replace(sku, '-', '') AS bare, length(product_name) AS n FROM price_list", None),
    "sql_json": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, props->>'$.k' AS k FROM events"),
    "sql_limit": ("SELECT row_no FROM (SELECT DISTINCT row_no FROM sales) ORDER BY row_no LIMIT 10 OFFSET 5", None),
    "sql_like": ("SELECT sku, product_name FROM inventory WHERE product_name LIKE '%A%E%'", "SELECT sku, product_name FROM inventory WHERE product_name ILIKE '%A%E%'"),
    "sql_glob": ("SELECT sku FROM inventory WHERE sku GLOB '*[A-F]*[0-4]' AND sku NOT GLOB '?X*'", "SELECT sku FROM inventory WHERE regexp_matches(sku, '[A-F].*[0-4]$') AND NOT regexp_matches(sku, '^.X')"),
    "sql_minmax": ("SELECT sku, max(qty, reorder_level) AS more, min(qty, reorder_level, 50) AS less FROM inventory", "SELECT sku, CASE WHEN qty IS NOT NULL AND reorder_level IS NOT NULL THEN greatest(qty, reorder_level) END AS more, CASE WHEN qty IS NOT NULL AND reorder_level IS NOT NULL THEN least(qty, reorder_level, 50) END AS less FROM inventory"),
    "sql_div_columns": ("SELECT region, sum(revenue) / count(*) AS mean, sum(units / 2) AS halves, sum(units) / 2e0 AS half FROM sales GROUP BY region", "SELECT region, CAST(sum(revenue) // count(*) AS BIGINT) AS mean, sum(CAST(trunc(units / 2) AS BIGINT)) AS halves, sum(units) / 2e0 AS half FROM sales GROUP BY region"),
    "sql_dates": ("SELECT o_orderkey, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS last, strftime('%Y-%j', o_orderdate) AS day, date(o_orderdate, 'weekday 1') AS monday, julianday(o_orderdate) AS jd FROM orders", "SELECT o_orderkey, strftime(last_day(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS last, strftime(o_orderdate, '%Y-%j') AS day, strftime(CAST(o_orderdate AS DATE) + CAST((8 - isodow(CAST(o_orderdate AS DATE))) % 7 AS INTEGER), '%Y-%m-%d') AS monday, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440587.5 AS jd FROM orders"),
    "sql_json_arrow": ("SELECT event_id, props ->> '$.k' AS k, props -> 'k' AS j FROM events", "SELECT event_id, props->>'$.k' AS k, CAST(props->'$.k' AS VARCHAR) AS j FROM events"),
    "sql_cast": ("SELECT sku, cast(substr(sku, instr(sku, '-') + 2) || 'x' AS integer) AS n, cast(sku AS integer) AS none, cast(qty AS text) AS t FROM inventory", "SELECT sku, coalesce(try_cast(regexp_extract(substr(sku, instr(sku, '-') + 2), '^[0-9]+') AS BIGINT), 0) AS n, CAST(0 AS BIGINT) AS none, CAST(qty AS VARCHAR) AS t FROM inventory"),
    "sql_printf": ("SELECT sku, printf('%s:%05d', sku, qty) AS x FROM inventory WHERE qty >= 0", "SELECT sku, sku || ':' || lpad(CAST(qty AS VARCHAR), 5, '0') AS x FROM inventory WHERE qty >= 0"),
    "sql_concat": ("SELECT category, group_concat(DISTINCT warehouse) IS NOT NULL AS some, count(*) AS n FROM inventory GROUP BY category", "SELECT category, string_agg(DISTINCT warehouse, ',') IS NOT NULL AS some, count(*) AS n FROM inventory GROUP BY category"),
    "sql_total": ("SELECT region, total(revenue) AS revenue FROM sales GROUP BY region", "SELECT region, coalesce(sum(CAST(revenue AS DOUBLE)), 0) AS revenue FROM sales GROUP BY region"),
    "sql_bool_sum": ("SELECT category, sum(qty < reorder_level) AS low FROM inventory GROUP BY category", "SELECT category, sum(CAST(qty < reorder_level AS INTEGER)) AS low FROM inventory GROUP BY category"),
    "sql_iif": ("SELECT sku, iif(qty IS NOT 0, 'some', 'none') AS stock, ifnull(qty, -1) AS qty FROM inventory", "SELECT sku, CASE WHEN qty IS DISTINCT FROM 0 THEN 'some' ELSE 'none' END AS stock, coalesce(qty, -1) AS qty FROM inventory"),
    "sql_int_div": ("SELECT 7 / 2 AS a, -7 / 2 AS b, 8 / 3 AS c", "SELECT 3 AS a, -3 AS b, 2 AS c"),
    "sql_quoted": ('SELECT "sku", [qty] FROM inventory WHERE "qty" > 10', 'SELECT "sku", "qty" FROM inventory WHERE "qty" > 10'),
}


def _gate(b) -> Gate:
    names = {n: f"data/{n}.csv" for n in b.datasets}
    return Gate(b.datasets, names)


def _register() -> None:
    for name, (text, oracle) in SQL.items():
        query(None, name)(lambda b, text=text: _gate(b).plan(text))
        ORACLE[name] = oracle or text


_register()


@query("SELECT unnest(['inventory', 'inventory', 'inventory', 'inventory', 'inventory', 'inventory']) AS table_name, unnest([0, 1, 2, 3, 4, 5])::INTEGER AS position, unnest(['sku', 'product_name', 'category', 'warehouse', 'qty', 'reorder_level']) AS column_name")
def sql_schema_table(b):
    return _gate(b).plan("SELECT table_name, position, column_name FROM _schema WHERE table_name = 'inventory'")


@query("SELECT unnest(['inventory', 'price_list']) AS name")
def table_acl(b):
    seen = _gate(b).visible(Scope(allow=("data/inventory", "data/price*")))
    return b.spark.createDataFrame([(n,) for n in seen], "name string")


@query()
def data_tables(b):
    return _gate(b).schema_rows()


# -- extension ---------------------------------------------------------------------------------------


@plain("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_hourly(spark, d):
    got = windowed(table(spark, d, "events"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@plain("SELECT sku, month, CAST(sum(units) AS BIGINT) AS units FROM (SELECT DISTINCT * FROM sales) GROUP BY sku, month")
def sales_by_sku(spark, d):
    """One sku holds a tenth of the rows: partial sums are made before the shuffle."""
    return run_sql("SELECT sku, month, sum(units) AS units FROM (SELECT DISTINCT * FROM <<s>>) GROUP BY sku, month", s=table(spark, d, "sales"))
