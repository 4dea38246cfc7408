"""Operators on small tables: nulls, ties, empty inputs, hidden documents."""

import hashlib
from functools import reduce

import pytest
import regex
from pyspark.sql import functions as F

from marginalia.bundle import Bundle, canonical_tags
from marginalia.engine import Engine
from marginalia.functions import columns as C
from marginalia.functions import markdown as M
from marginalia.operators import access, adopt, grep, lint, sample, sync, vectors
from marginalia.operators import query as Q
from marginalia.operators.scope import Scope, glob_predicate
from marginalia.operators.dialect import DialectError
from marginalia.operators.sqlgate import Gate, SqlError, SqlTimeout, rewrite, to_text
from marginalia.plans import relations
from marginalia.plans.catalogue import QUERIES

DOCS = "id string, path string, type string, title string, description string, lang string, status string, updated string, department string, region string, customer string, effective_from string, effective_to string, contract_value bigint, currency string, reserved boolean, fm_state string, tokens bigint, body string"
BODY = "# Rules\n\nSee [b](b.md) and [gone](gone.md) and [[only]].\nPhí vận chuyển\n## Scope\ntext\n"


@pytest.fixture(scope="module")
def bundle(spark):
    n = None
    rows = [
        ("p/a", "p/a.md", "Policy", "Alpha", "An alpha policy about things", "en", "stable", "2025-01-01", "Ops", "north", n, "2025-01-01", n, 10, "USD", False, "valid", 50, BODY),
        ("p/b", "p/b.md", "policy", "Béta", "alpha", "vi", "Deprecated", "2025-02-01", "ops", n, n, "2026-01-01", "2025-01-01", 30, "EUR", False, "valid", 9000, "x\ny\n"),
        ("f/only", "f/only.md", n, n, n, n, n, n, n, n, n, n, n, n, n, None, "absent", n, n),
        ("q", "q.md", "FAQ", "alpha", "ALPHA", "en-US", "draft", "soon", n, "south", "acme", n, "2024-01-01", 20, n, False, "invalid", -3, ""),
        ("p/index", "p/index.md", n, "Index", n, n, n, n, n, n, n, n, n, n, n, True, "absent", 5, "[a](a.md)"),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    tags = spark.createDataFrame([("p/a", 1, "Safety_Rule"), ("p/a", 2, "safety-rule"), ("p/b", 1, "an toàn"), ("q", 1, "odd")], "doc_id string, ord int, tag string")
    tags = tags.withColumn("norm", C.normalize_tag(F.col("tag"))).withColumn("folded", C.fold(F.col("norm")))
    vocab = spark.createDataFrame([("safety-rule", ["an toàn"], "topic", "x"), ("idle", None, None, None)], "tag string, synonyms array<string>, facet string, description string")
    sales = spark.createDataFrame([(1, "a", 2), (2, "A", None)], "k bigint, sku string, n bigint")
    return Bundle(docs, canonical_tags(tags, vocab), vocab, {"sales": sales, "secret": sales})


@pytest.fixture(scope="module")
def empty(bundle):
    return Bundle(bundle.docs.limit(0), bundle.tags.limit(0), bundle.vocabulary.limit(0), bundle.datasets)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (Q.Filter(), ["f/only", "p/a", "p/b", "q"]),
        (Q.Filter(type=("POLICY",)), ["p/a", "p/b"]),
        (Q.Filter(status_not=("deprecated",)), ["f/only", "p/a", "q"]),
        (Q.Filter(lang=("en",)), ["p/a"]),
        (Q.Filter(tags_all=("safety rule",)), ["p/a", "p/b"]),
        (Q.Filter(tags_any=("An Toàn", "odd")), ["p/b", "q"]),
        (Q.Filter(fields={"department": ["OPS "]}), ["p/a", "p/b"]),
        (Q.Filter(fields={"nothing": ["x"]}), []),
        (Q.Filter(text="beta"), ["p/b"]),
        (Q.Filter(text="P/A alpha"), ["p/a"]),
        (Q.Filter(active_on="2025-06-01"), ["f/only", "p/a"]),
        (Q.Filter(ranges={"contract_value": {"from": "15"}}), ["p/b", "q"]),
        (Q.Filter(updated_from="2025-01-15"), ["p/b", "q"]),
        (Q.Filter(path="p"), ["p/a", "p/b"]),
        (Q.Filter(path="**/only"), ["f/only"]),
    ],
)
def test_filters(bundle, empty, f, want):
    assert ids(Q.matching(bundle, f)) == want
    assert ids(Q.matching(empty, f)) == []


@pytest.mark.parametrize(
    ("pattern", "hits"),
    [("a", ["a", "a/b", "a/b/c"]), ("a/*", ["a/b"]), ("a/**", ["a/b", "a/b/c"]), ("**/c", ["a/b/c", "c"]), ("./a/b.md", ["a/b", "a/b/c"]), ("**", ["a", "a/b", "a/b/c", "c", "a?"]), ("a?", ["a?"]), ("", ["a", "a/b", "a/b/c", "c", "a?"])],
)
def test_globs(spark, pattern, hits):
    df = spark.createDataFrame([(x,) for x in ("a", "a/b", "a/b/c", "c", "a?")], "id string")
    assert [r["id"] for r in df.filter(glob_predicate(pattern, F.col("id"))).collect()] == hits


def test_hidden_documents_do_not_exist(bundle):
    s = Scope(deny=("p/a",), within={"status": ["stable", "deprecated", "draft"]})
    assert ids(Q.visible(bundle, s)) == ["p/b", "p/index", "q"]
    r = Q.run(bundle, Q.Request(facets=("type", "tags"), sum_field="contract_value"), s)
    assert r["total"] == 2 and r["sum"]["value"] == 50 and r["facets"]["tags"] == [("an toàn", 1), ("odd", 1)]
    with pytest.raises(access.NotFound):
        access.get(bundle, "p/a", scope=s)
    assert "Alpha" not in str(access.catalog(bundle, scope=s)["content"])
    assert all(n["id"] != "p/a" for n in access.graph(bundle, scope=s)["nodes"])


def test_requests(bundle):
    r = Q.run(bundle, Q.request_of({"lang": "en", "department": "ops", "contract_value_from": 5, "facets": ["region"]}))
    assert [d["id"] for d in r["docs"]] == ["p/a"] and r["facets"] == {"region": [("north", 1)]}
    assert r["docs"][0]["tags"] == ["Safety_Rule", "safety-rule"] and r["docs"][0]["extra"]["currency"] == "USD"
    r = Q.run(bundle, Q.Request(sort="-contract_value", limit=2, sum_field="contract_value"))
    assert [d["id"] for d in r["docs"]] == ["f/only", "p/b"] and r["more"] == 2
    assert r["sum"] == {"field": "contract_value", "value": 60.0, "count": 3, "units": {"USD": 1, "EUR": 1, None: 1}}
    assert Q.run(bundle, Q.Request(sort="contract_value"))["docs"][0]["id"] == "p/a"
    r = Q.run(bundle, Q.Request(count_only=True))
    assert (r["total"], r["docs"], r["more"]) == (4, [], 0)


def test_grep(bundle, empty):
    assert grep.compile_pattern(r"Á\S+(").literal and not grep.compile_pattern(r"\S+").literal
    assert grep.compile_pattern(r"\S", compat=True).text == r"\s" and grep.compile_pattern("(?=a)").literal
    with pytest.raises(ValueError, match="empty"):
        grep.compile_pattern("  ")
    r = grep.run(bundle, "PHI VAN")
    assert (r["total_docs"], r["total_lines"]) == (1, 1)
    assert r["docs"][0]["lines"] == [(3, "See [b](b.md) and [gone](gone.md) and [[only]].", False), (4, "Phí vận chuyển", True), (5, "## Scope", False)]
    assert grep.run(bundle, "x", files_only=True)["docs"] == [{"id": "p/a", "matches": 1, "lines": []}, {"id": "p/b", "matches": 1, "lines": []}]
    assert grep.run(bundle, ".", limit=3)["truncated"]
    assert grep.run(empty, "x")["total_docs"] == 0 and grep.run(empty, "x")["hint"]
    spanning = grep.line_hits(grep.corpus(bundle), grep.compile_pattern(r"x\ny"))
    assert [(r["id"], r["hits"]) for r in spanning.collect()] == [("p/b", [1])]
    headed = Bundle(bundle.docs.withColumn("fm_raw", F.lit("---\ntitle: Zebra\n---\n")), bundle.tags, bundle.vocabulary)
    assert grep.run(headed, "zebra")["total_docs"] == 4
    assert [x[0] for x in next(d for d in grep.run(headed, "phi van", context=0)["docs"])["lines"]] == [7]


def test_get(bundle):
    assert access.get(bundle, "./p/a.md", section="scope")["content"].startswith("## Scope")
    assert access.get(bundle, "p/a", lines="1-1")["content"] == "# Rules"
    assert access.get(bundle, "p/a", section="nope")["headings"] == [(1, "Rules"), (2, "Scope")]
    for bad in ("0-1", "x", "9-3", "99"):
        with pytest.raises(access.InvalidArgument):
            access.get(bundle, "p/a", lines=bad)
    assert access.get(bundle, "f/only")["content"] == ""
    whole = access.get(bundle, "p/a", section="SCO")
    assert whole["section"] == "Scope" and whole["tokens"] == M.tokens(BODY) and whole["frontmatter"] == {}


META = [
    ("a", '{"type": "x", "owner": "Kim", "level": 3, "areas": ["North", "South"], "open": true, "nested": {"k": 1}, "unit": "EUR", "odd \'key\'.x": "v"}'),
    ("b", '{"owner": "kim ", "level": 10, "areas": "north", "open": false, "level_text": "12"}'), ("c", '{"level": "7", "areas": [], "owner": null}'), ("d", None), ("e", "{broken"),
]


def test_any_metadata_field(spark, bundle):
    docs = bundle.docs.limit(0).drop("id").join(spark.createDataFrame(META, "id string, frontmatter string"), on=F.lit(True), how="right")
    b = Bundle(docs, bundle.tags.limit(0), bundle.vocabulary)
    find = lambda **x: ids(Q.matching(b, Q.request_of(x)))
    assert find(owner="KIM") == ["a", "b"] and find(areas="south") == ["a"] and find(open="TRUE") == ["a"] and find(nested="1") == [] and find(missing="x") == []
    assert find(fields={"odd 'key'.x": ["V"]}) == ["a"] and find(level_from="5") == ["b", "c"] and find(areas_from="a") == ["b"]
    assert ids(Q.visible(b, Scope(without={"areas": ["north"]}))) == ["c", "d", "e"] and ids(Q.visible(b, Scope(within={"level": ["3"]}))) == ["a"]
    facets = {(r["field"], r["value"]): r["count"] for r in Q.facet_values(b, docs, ["areas", "level"]).collect()}
    assert facets == {("areas", "North"): 1, ("areas", "South"): 1, ("areas", "north"): 1, ("level", "3"): 1, ("level", "10"): 1, ("level", "7"): 1}
    assert Q.sum_of(docs, "level").first().asDict() == {"total": 13.0, "contributing": 2}
    assert {r["unit"]: r["count"] for r in Q.sum_units(docs, "level").collect()} == {"EUR": 1, None: 1}
    assert [r["id"] for r in docs.orderBy(*Q.order_by(docs, "level")).collect()] == ["a", "b", "c", "d", "e"]
    assert [r["id"] for r in docs.orderBy(*Q.order_by(docs, "-level")).collect()][-2:] == ["b", "a"]
    got = Q.run(b, Q.request_of({"sort": "id", "facets": ["owner"], "sum_field": "level"}))
    assert got["docs"][0]["extra"] == {"level": "3", "odd 'key'.x": "v", "open": "true", "owner": "Kim", "unit": "EUR"} and list(got["docs"][0]["extra"]) == sorted(got["docs"][0]["extra"])
    rows = {(r["doc_id"], r["key"], r["idx"]): (r["value_type"], r["value_text"], r["value_num"]) for r in b.fields().collect()}
    assert rows["a", "areas", 1] == ("string", "South", None) and rows["a", "level", 0] == ("number", "3", 3.0) and rows["b", "open", 0] == ("bool", "false", None) and rows["a", "nested", 0][0] == "json"
    assert ("c", "owner", 0) not in rows
    assert {r["key"]: r["documents"] for r in access.frequent_fields(b, docs).collect()}["level"] == 3


def test_links_and_graph(bundle, empty):
    links = access.resolve_wiki(bundle.links(), bundle.docs.select("id"))
    got = {(r["src"], r["raw"]): (r["target"], r["exists"]) for r in access.outgoing(links, bundle.docs).collect()}
    assert got == {("p/a", "b.md"): ("p/b", True), ("p/a", "gone.md"): ("p/gone", False), ("p/a", "only"): ("f/only", True), ("p/index", "a.md"): ("p/a", True)}
    assert [r["src"] for r in access.backlinks(links, bundle.docs, "p/a").collect()] == ["p/index"]
    g = access.graph(bundle)
    assert {n["id"]: (n["out_degree"], n["in_degree"], n["broken"]) for n in g["nodes"]} == {"p/a": (2, 0, 1), "p/b": (0, 1, 0), "f/only": (0, 1, 0), "q": (0, 0, 0)}
    cut = access.graph(bundle, limit=2)
    assert cut["truncated"] and len(cut["nodes"]) == 2
    assert access.graph(empty) == {"nodes": [], "edges": [], "truncated": False}
    s = access.stats(bundle)
    assert (s["docs"], s["reserved"], s["tokens"], s["broken_links"], s["mode"]) == (4, 1, 9050, 1, "full")


def test_catalog_and_listing(bundle):
    c = access.catalog(bundle)
    assert c["mode"] == "flat" and c["docs"] == 4 and c["vocabulary"][0] == ("safety-rule", "topic", 2) and ("idle", None, 0) in c["vocabulary"]
    assert access.catalog(bundle, max_tokens=1)["content"] == "- f/ (1)\n- p/ (2)\n- q (1)"
    rows = {(r["kind"], r["name"]): r["documents"] for r in access.list_dir(bundle).collect()}
    assert rows == {("dir", "f"): 1, ("dir", "p"): 2, ("doc", "q"): 1}
    assert Engine(bundle).list("p")["source"] == "index.md" and Engine(bundle).list("p", scope=Scope(deny=("x",)))["source"] == "generated"


def test_lint(bundle, empty):
    own = bundle.docs.withColumn("fm_state", F.when(F.col("id") == "q", "valid").otherwise(F.col("fm_state")))
    deep = own.filter("id = 'p/b'")
    more_docs = [("w/bad", "invalid"), ("_meta/vocabulary", "valid"), ("p/sub/x", "valid"), ("p/_meta/y", "valid")]
    whole = reduce(lambda a, b: a.unionByName(b), [own, *(deep.withColumns({"id": F.lit(k), "path": F.lit(f"{k}.md"), "fm_state": F.lit(v), "title": F.lit(None).cast("string"), "tokens": F.lit(1).cast("bigint"), "effective_to": F.lit(None).cast("string"), "status": F.lit("stable")}) for k, v in more_docs)])
    bundle = Bundle(whole, bundle.tags, bundle.vocabulary, bundle.datasets)
    got, message = {}, {}
    for r in lint.lint(lint.Context(bundle)).collect():
        got.setdefault(r["rule"], set()).add(r["path"])
        message[r["rule"], r["path"]] = r["message"]
    assert got["missing-frontmatter"] == {"f/only.md"} and got["invalid-frontmatter"] == {"w/bad.md"} and "missing-type" not in got
    assert got["missing-title"] == {"p/sub/x.md", "p/_meta/y.md"}  # not those without a usable block, nor those in _meta
    assert got["description-repeats-title"] == {"q.md"} and got["doc-too-long"] == {"p/b.md"} and got["invalid-status"] == {"p/b.md"}
    assert got["invalid-effective-range"] == {"p/b.md"} and got["invalid-updated"] == {"q.md"} and got["unknown-tag"] == {"q.md"}
    assert got["non-canonical-tag"] == {"p/b.md"} and got["missing-index"] == {"index.md", "p/sub/index.md", "p/_meta/index.md"} and got["stale-index"] == {"p/index.md"}
    assert message["stale-index", "p/index.md"] == "does not list: p/_meta/ and 2 more"  # p/_meta isn't the collection's own _meta
    assert got["broken-link"] == {"p/a.md"} and got["missing-tags"] == {"p/sub/x.md", "p/_meta/y.md"}
    assert [r["rule"] for r in lint.lint(lint.Context(empty)).collect()] == ["empty-bundle"]
    s = lint.summary(lint.lint(lint.Context(bundle))).first()
    assert s["level"] == -1 and s["errors"] > 5
    assert lint.summary(lint.lint(lint.Context(bundle)).limit(0)).first()["level"] == 2
    sarif = lint.to_sarif([r.asDict() for r in lint.lint(lint.Context(bundle)).collect()])
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) > 10
    spark = bundle.spark
    parsed = spark.createDataFrame([("a.md", "a", '{"type": 3}', "valid", None), ("b.md", "b", '{"type": "x"}', "valid", None), ("index.md", "index", '{"format_version": 1}', "valid", None), ("s/index.md", "s/index", '{"x": 1}', "valid", None), ("z.md", "z", None, None, "not UTF-8")], "path string, id string, frontmatter string, fm_state string, error string")
    more = {(r["rule"], r["path"]) for r in lint.lint(lint.Context(empty, parsed=parsed, vocabulary_state="absent", broken_schemas=("_meta/types/x.md",))).collect()}
    assert more == {("empty-bundle", "."), ("no-vocabulary", "_meta/vocabulary.md"), ("invalid-schema", "_meta/types/x.md"), ("invalid-type", "a.md"), ("index-frontmatter", "s/index.md"), ("unreadable", "z.md")}
    assert "missing-type" not in {r["rule"] for r in lint.lint(lint.Context(bundle, disabled=frozenset({"missing-type"}))).collect()}


def test_type_schemas(spark):
    blocks = [
        ("a", "Guide", '{"area": ["N", "S"], "size": 2, "day": "2025-01-01", "more": {"x": 1}}'), ("b", "Guide", '{"area": "N", "name": ["Kim"], "size": 2.5, "more": [1]}'),
        ("c", "Guide", '{"name": null, "area": ["N", null, 3], "size": 3, "day": 20250101}'), ("d", "Guide", '{"name": "Kim", "area": []}'), ("e", "Other", "{}"), ("f", "Guide", None),
    ]
    docs = spark.createDataFrame([(k, f"{k}.md", t, j, "valid" if j else "invalid", False) for k, t, j in blocks], "id string, path string, type string, frontmatter string, fm_state string, reserved boolean")
    declared = [("Guide", "name", "string", True, []), ("Guide", "area", "list", True, ["N", "S"]), ("Guide", "size", "integer", False, ["1", "2"]), ("Guide", "day", "date", False, []), ("Guide", "more", "map", False, None)]
    schemas = spark.createDataFrame(declared, "type string, field string, kind string, required boolean, allowed array<string>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    parts = lint._schemas(lint.Context(Bundle(docs, None, None), schemas=schemas))
    got = sorted((r["path"], r["rule"], r["message"]) for r in reduce(lambda a, b: a.unionByName(b), parts).collect())
    assert got == [
        ("a.md", "schema-missing-field", "name"),
        ("b.md", "schema-wrong-type", "area"), ("b.md", "schema-wrong-type", "more"), ("b.md", "schema-wrong-type", "name"), ("b.md", "schema-wrong-type", "size"),
        ("c.md", "schema-missing-field", "name"), ("c.md", "schema-not-allowed", "area"), ("c.md", "schema-not-allowed", "size"), ("c.md", "schema-wrong-type", "day"),
    ]
    try:  # the schemas are the only side that is sent to every task, whatever the documents' size
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = reduce(lambda a, b: a.unionByName(b), lint._schemas(lint.Context(Bundle(docs, None, None), schemas=schemas)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
    plain = docs.drop("frontmatter").filter("id in ('a', 'e')").withColumns({"region": F.lit("east"), "contract_value": F.lit(3)})
    declared = [("Guide", "region", "string", False, ["north"]), ("Guide", "contract_value", "string", False, []), ("Guide", "customer", "string", True, [])]
    (found,) = lint._schemas(lint.Context(Bundle(plain, None, None), schemas=spark.createDataFrame(declared, schemas.schema)))
    assert sorted((r["rule"], r["message"]) for r in found.collect()) == [("schema-missing-field", "customer"), ("schema-not-allowed", "region"), ("schema-wrong-type", "contract_value")]


def test_adopt(bundle):
    got = {r["id"]: r for r in adopt.plan(bundle, 2).collect()}
    assert got["f/only"]["title"] == "Only" and got["f/only"]["type"] == "Document" and set(got["f/only"]["generated"]) == {"type", "title", "status", "updated"}
    r = adopt.report(bundle, 1)
    assert r["changes"]["title"] == 1 and r["level_before"] == -1 and r["listings"] >= 2 and "missing-frontmatter" not in r["remaining"] and "invalid-frontmatter" in r["remaining"]
    done = {x["id"]: x for x in adopt.adopted(bundle, 2).docs.collect()}
    assert (done["f/only"]["title"], done["f/only"]["fm_state"], done["q"]["fm_state"], done["p/a"]["title"]) == ("Only", "valid", "invalid", "Alpha")
    g = {r["tag"]: r for r in adopt.tag_groups(bundle.tags).collect()}
    assert g["Safety_Rule"]["documents"] == 1 and g["Safety_Rule"]["variants"] == []
    text = "---\r\na: 1\r\nb:\r\n  - x\r\nc: 2\r\n---\r\nBody"
    assert adopt.set_key(text, "b", "[y]") == "---\r\na: 1\r\nb: [y]\r\nc: 2\r\n---\r\nBody"
    assert adopt.set_key("Body", "a", "1") == "---\na: 1\n---\nBody" and adopt.remove_key(adopt.set_key(text, "d", "4"), "d") == text
    assert "synonyms" in adopt.suggest([{"tag": "a", "variants": ["b"]}])


# -- SQL -------------------------------------------------------------------------------------------


def test_sql(bundle):
    g = Gate(bundle.datasets, {"sales": "data/sales.csv", "secret": "data/secret.csv"})
    r = g.query("SELECT k, total(n) AS t FROM sales WHERE sku LIKE 'a' GROUP BY k ORDER BY k;", max_rows=1)
    assert r["columns"] == ["k", "t"] and r["rows"] == [[1, 2.0]] and r["truncated"]
    assert to_text(r).splitlines()[0].startswith("k | t")
    hidden = Scope(deny=("data/secret",))
    assert g.visible(hidden) == ["sales"]
    assert g.query("SELECT count(*) AS n FROM _schema")["rows"] == [[6]]
    for sql in (
        "SELECT * FROM secret", "SELECT * FROM _schema", "WITH x AS (SELECT * FROM secret) SELECT * FROM x",
    ):
        with pytest.raises(SqlError):
            g.query(sql, scope=hidden)
    for sql in (
        "", "DROP TABLE sales", "INSERT INTO sales VALUES (1)", "SELECT 1; SELECT 2", "SET a=b", "CREATE TABLE x AS SELECT 1", "SELECT * FROM parquet.`/etc`", "SELECT * FROM csv.`/etc/passwd`", "SHOW TABLES",
        "SELECT java_method('java.lang.System', 'getenv')", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT TRANSFORM(k) USING 'cat' AS (x string) FROM sales", "EXPLAIN SELECT 1", "SELECT * FROM default.sales",
        "DESCRIBE sales", "CACHE TABLE sales", "nonsense",
    ):
        with pytest.raises(SqlError):
            g.query(sql)
    with pytest.raises(SqlTimeout):
        g.query("SELECT count(*) FROM range(100000000000) a JOIN range(1000) b ON a.id % 7 = b.id % 5", timeout=1)
    assert g.query("WITH RECURSIVE t AS (SELECT 1 AS k UNION ALL SELECT k + 1 FROM t WHERE k < 9) SELECT sum(k) AS s FROM t")["rows"] == [[45]]


def test_rewrite():
    assert rewrite("SELECT iif(a IS NOT 1, \"b\", 'LIKE [c] iif(') FROM [t] WHERE a IS NOT NULL") == "SELECT if(a IS DISTINCT FROM 1, `b`, 'LIKE [c] iif(') FROM `t` WHERE a IS NOT NULL"
    assert rewrite("SELECT sum(a < b), 7 / 2, group_concat(x)") == "SELECT sum(cast((a < b) AS int)), 7 / 2, listagg(cast(x AS string), ',')"
    assert rewrite("SELECT max(a, max(b)), 'it''s' FROM t -- max(1, 2)\n") == "SELECT CASE WHEN (a) IS NOT NULL AND (max(b)) IS NOT NULL THEN greatest(a, max(b)) END, 'it\\'s' FROM t -- max(1, 2)\n"
    for bad in ("SELECT a GLOB b", "SELECT date(d, x)", "SELECT date(d, 'next year')", "SELECT strftime(f, d)", "SELECT strftime('%Q', d)", "SELECT (1"):
        with pytest.raises(DialectError):
            rewrite(bad)


#: What the other dialect's own engine returns.
DIALECT = [
    ("SELECT a/b, a/2, a/2.0, sum(a) over ()/2, (a+1)/b/2 FROM t ORDER BY a", [[3, 3, 3.5, 8, 2], [2, 4, 4.5, 8, 1]]),
    ("SELECT sum(a)/count(*), 7/2, -7/2, 'x / 7/2' FROM t", [[8, 3, -3, "x / 7/2"]]),
    ("SELECT max(a,b), min(a,b,3), max(a,NULL) FROM t ORDER BY a", [[7, 2, None], [9, 3, None]]),
    ("SELECT cast(s as integer), cast(s as real), cast('3.9x' as integer), cast(a as text), cast('x' as real) FROM t ORDER BY a", [[12, 12.0, 3, "7", 0.0], [None, None, 3, "9", 0.0]]),
    ("SELECT date(d,'+1 month'), date(d,'start of month','+1 month','-1 day'), strftime('%Y-%m %d/%j %w',d), datetime(d,'+90 minutes') FROM t ORDER BY a", [["2024-03-02", "2024-01-31", "2024-01 31/031 3", "2024-01-31 01:30:00"], ["2024-03-29", "2024-02-29", "2024-02 29/060 4", "2024-02-29 11:50:30"]]),
    ("SELECT julianday(d), date(d,'weekday 0'), unixepoch(d) FROM t WHERE a = 7", [[2460340.5, "2024-02-04", 1706659200]]),
    ("SELECT j ->> '$.a.b', j -> '$.a', json_extract(j,'$.l[1]'), j->>'l' FROM t WHERE a = 7", [["5", '{"b":5}', "x", '[1,"x"]']]),
    ("SELECT key, value FROM t, json_each(j) WHERE a = 9", [["0", "1"]]),
    ("SELECT s FROM t WHERE s GLOB '1[0-9]*c' OR d GLOB '?x'", [["12abc"]]),
    ("SELECT group_concat(a), total(a+b), sum(a > b), sum(s IS NULL), avg(a=7) FROM t", [["7,9", 22.0, 2, 1, 0.5]]),
    ("SELECT printf('%05d|%.2f|%s|%d%%', a, b, s, a), char(65,66), unicode('A') FROM t WHERE a = 7", [["00007|2.00|12abc|7%", "AB", 65]]),
]


def test_dialect(spark):
    t = spark.createDataFrame([(7, 2, "12abc", "2024-01-31", '{"a":{"b":5},"l":[1,"x"]}'), (9, 4, None, "2024-02-29 10:20:30", "[1]")], "a bigint, b int, s string, d string, j string").coalesce(1)
    g = Gate({"t": t})
    for sql, want in DIALECT:
        assert g.query(sql, timeout=60)["rows"] == want, sql
    for sql in ("SELECT input_file_name() FROM t", "SELECT uuid()", "SELECT version()", "SELECT spark_partition_id() FROM t", "SELECT no_such_function(1)", "SELECT a FROM t WHERE a IN (SELECT 1 FROM hidden)", "SELECT (SELECT max(x) FROM hidden)", "SELECT * FROM (WITH t2 AS (SELECT * FROM hidden) SELECT * FROM t2)", "SELECT * FROM read_files('/etc')"):
        with pytest.raises(SqlError):
            g.query(sql)
    assert g.query("SELECT count(*) FROM t WHERE EXISTS (SELECT 1 FROM t x WHERE x.a = t.a + 2)")["rows"] == [[1]]
    assert [x["rows"] for x in g.tables()] == [2] and Gate({"t": t}, {"t": "b.xlsx#S"}).schema_rows().first()["sheet"] == "S"


# -- vectors, samples, sync --------------------------------------------------------------------------


def test_vectors(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "a", [0.9, 0.1]), (4, "b", [0.0, 1.0]), (5, "c", None), (6, "c", [1.0]), (7, "c", [0.0, 0.0])], "chunk_id bigint, doc_id string, vec array<float>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id bigint, qvec array<float>")
    got = [(r["rank"], r["chunk_id"], round(r["score"], 3)) for r in vectors.search(v, q, 4, 2).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 4, 0.0), (4, 7, 0.0)]
    assert vectors.search(v.limit(0), q).count() == 0 and vectors.search(v, q.limit(0)).count() == 0
    many = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(vectors.QUERY_BLOCK + 5)], "query_id bigint, qvec array<float>")
    assert vectors.search(v, many, 1, 1).count() == vectors.QUERY_BLOCK + 5
    with pytest.raises(ValueError, match="blocks"):
        vectors.scores(v, many)
    hits = spark.createDataFrame([(0, 1, 11, 900), (0, 2, 12, 300), (0, 3, 13, 80), (1, 1, 14, 5000)], "query_id bigint, rank int, chunk_id bigint, tokens int")
    packed = {r["query_id"]: (r["chunks"], r["tokens"]) for r in vectors.pack(hits, 1000).collect()}
    assert packed == {0: ([11, 13], 980), 1: ([14], 5000)}
    chunks = spark.createDataFrame([(1, "t", "", "hello"), (2, "t", "h", "world")], "id bigint, title string, heading string, text string")
    e = vectors.LetterEmbedder(8)
    first = vectors.embed_sync(chunks, spark.createDataFrame([], "chunk_id bigint, model string, vec array<float>"), e)
    old = spark.createDataFrame([(1, e.model, [9.0] * 8), (2, "other", [1.0] * 8), (9, e.model, [1.0] * 8)], "chunk_id bigint, model string, vec array<float>")
    again = {r["chunk_id"]: r["vec"] for r in vectors.embed_sync(chunks, old, e).collect()}
    assert first.count() == 2 and set(again) == {1, 2} and again[1][0] == 9.0


def test_samples(spark):
    rows = [(f"{'ab'[i % 2]}/d{i % 7}", i, 50, f"text {i}", "en" if i % 3 else None) for i in range(60)] + [("a/x", 99, 10, "short", "en"), ("a/x", 98, 90, " ", "en")]
    c = spark.createDataFrame(rows, "doc_id string, ord int, tokens int, text string, lang string")
    p = sample.stratified(c, sample.Settings(max_passages=20, per_document=4)).collect()
    assert len(p) == 20 and max(r["turn"] for r in p) - min(r["turn"] for r in p) < 20
    per = {}
    for r in p:
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + 1
    assert max(per.values()) <= 4
    held = sample.heldout(c.select("doc_id"))
    n = held.count()
    assert held.filter("heldout").count() == max(-(-n * 15 // 100), min(20, n // 4))
    assert sample.heldout(c.limit(1).select("doc_id")).filter("heldout").count() == 0
    items = spark.createDataFrame([(i, f"k{i}", t) for i, t in enumerate([3000, 2500, 600, 7000, 10] + [1] * 12)], "turn int, key string, tokens int")
    got = [r["batch"] for r in sample.batches(items).orderBy(F.regexp_replace("key", "k", "").cast("int")).collect()]
    assert got == [1, 1, 2, 3, 4] + [4] * 9 + [5] * 3
    assert sample.batches(items.limit(0)).count() == 0


def test_questions(spark):
    p = spark.createDataFrame([("k1", "en", "Delivery of heavy boxes", "The crew checks every box at the north gate before noon.")], "key string, lang string, title string, text string")
    rows = [
        (1, "k1", "natural", "en", "When are parcels looked at?"), (2, "k9", "natural", "en", "Where is it now?"), (3, "k1", "natural", "vi", "Khi nào kiểm tra hàng?"), (4, "k1", "vague", "en", "crew checks every box at the gate"),
        (5, "k1", "keyword", "en", "box"), (6, "k1", "natural", "en", "when are parcels looked at"), (7, "k1", "cross", "ja", "いつ箱を調べますか"), (8, "k1", "natural", "en", "what about delivery of heavy boxes"), (9, "k1", "vague", "en", "see the file rules.md now"),
    ]
    got = {r["q_id"]: r["problems"] for r in sample.check_questions(spark.createDataFrame(rows, "q_id int, passage string, kind string, lang string, q string"), p, ["en", "vi", "ja"]).collect()}
    assert got[1] == [] and got[2] == ["unknown passage"] and got[3] == ["natural questions use the passage's language"] and got[4] == ["copies the passage"]
    assert got[5] == ["length"] and got[6] == ["duplicate of another question"] and got[7] == [] and got[8] == ["repeats the title"] and got[9] == ["mentions a file name"]
    q = spark.createDataFrame([(1, "A b!"), (2, "a B"), (3, "c")], "q_id int, q string")
    assert [r["q_id"] for r in sample.fresh_questions(q, spark.createDataFrame([("C?",)], "q string")).collect()] == [1]


def test_copied_questions(spark):
    import random
    import time

    def overlap(q, t, n, chars):  # all pairs of runs
        runs = lambda x, k, sep: [sep.join(x[i : i + k]) for i in range(len(x) - k + 1)]
        a, b = runs(q.split(" "), n, " "), runs(t.split(" "), n, " ")
        c, d = runs(q.replace(" ", ""), sample.COPY_CHARS, ""), runs(t.replace(" ", ""), sample.COPY_CHARS, "")
        return any(x == y for x in a for y in b) or chars and any(x == y for x in c for y in d)

    r = random.Random(3)
    for _ in range(3000):
        q, t = (" ".join(r.choice(["a", "b", "ab", "箱", "ba箱"]) for _ in range(r.choice([0, 3, 6, 12, 20]))) for _ in "qt")
        n, chars = r.choice([5, 8]), r.random() < 0.5
        assert sample.shares_run(q, t, n, chars) == overlap(q, t, n, chars), (q, t, n, chars)
    assert not sample.shares_run(None, "a b c d e", 5, True) and not sample.shares_run("a b c d e", None, 5, True)
    # a long passage takes time in proportion to its length
    words = [f"word{i}" for i in range(40_000)]
    p = spark.createDataFrame([("k1", "en", "T", " ".join(words)), ("k2", "ja", "T", "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(40_000)))], "key string, lang string, title string, text string")
    asked = [(1, "k1", "vague", "en", " ".join(words[-6:])), (2, "k1", "vague", "en", " ".join(words[-4:] + ["x", "y"])), (3, "k2", "vague", "ja", p.collect()[1]["text"][-13:]), (4, "k2", "vague", "ja", "箱をいつ調べますか"), (5, "k9", "vague", "en", " ".join(words[-6:]))]
    began = time.monotonic()
    got = {r["q_id"]: r["problems"] for r in sample.check_questions(spark.createDataFrame(asked, "q_id int, passage string, kind string, lang string, q string"), p, ["en", "ja"]).collect()}
    assert got == {1: ["copies the passage"], 2: [], 3: ["copies the passage"], 4: [], 5: ["unknown passage"]}
    assert time.monotonic() - began < 60


def test_scores():
    base, tuned = {"r_at_1": 0.8, "cross": 0.7}, {"r_at_1": 0.82, "cross": 0.7}
    assert sample.gate(base, tuned, {"r_at_1": 0.9}, {"r_at_1": 0.89})["passed"]
    assert not sample.gate(base, tuned | {"cross": 0.69}, {"r_at_1": 0.9}, {"r_at_1": 0.9})["passed"]
    assert not sample.gate(base, tuned, {"r_at_1": 0.9}, {"r_at_1": 0.88})["passed"]
    assert sample.judge_case({"ids": ["a"], "values": [1234, "x"], "rank": {"id": "a", "k": 1}}, ["a", "b"], "1,234 and X")
    assert not sample.judge_case({"rank": {"id": "b", "k": 1}}, ["a", "b"], "")


def test_sync(spark, tmp_path):
    a = spark.createDataFrame([("n", "h", 1, 1), ("c", "h2", 1, 2), ("t", "h", 2, 2), ("u", "h", 1, 1), ("u", "h", 1, 1)], "path string, hash string, size bigint, mtime_ns bigint")
    b = spark.createDataFrame([("c", "h", 1, 1), ("t", "h", 1, 1), ("u", "h", 1, 1), ("r", "h", 1, 1)], a.schema)
    assert {r["path"]: r["action"] for r in sync.changes(a, b).collect()} == {"n": "new", "c": "changed", "t": "touched", "u": "unchanged", "r": "removed"}
    s = sync.State(spark, str(tmp_path / "state"))
    assert s.read("docs") is None
    s.commit({"docs": a})
    s.commit({"docs": b})
    assert s.read("docs").count() == 4 and sync.State(spark, s.folder, "2").read("docs") is None
    c = sync.Claims(10)
    assert [c.next([1, 2], set(), 0), c.next([1, 2], set(), 1), c.next([1, 2], set(), 2), c.next([1, 2], {1}, 12)] == [1, 2, None, 2]


def test_embed_sync_takes_whole_texts(bundle):
    long = "# Top\n\n" + "".join(f"## Part {k}\n\n" + f"word{k} " * 900 + "\n" for k in range(3)) + "## End\n\n" + "last " * 900
    docs = bundle.docs.withColumn("body", F.when(F.col("id") == "p/a", long).otherwise(F.col("body")))
    b = Bundle(docs, bundle.tags, bundle.vocabulary)
    chunks = {r["id"]: r["text"] for r in b.chunks().collect()}
    assert len(chunks) > 4 and sum(t.count("last") for t in chunks.values()) == 900
    got = [(r["chunk_id"], r["dims"]) for r in relations._embed(b).collect()]
    assert sorted(got) == sorted((k, 64) for k in chunks)


def test_numbers_of_every_text(spark, tmp_path):
    texts = ["1.234,5 and 7.", "1,234.50", "2.5.2025", "from 1,2 to 3.4, at 12", "no number", "", "8 and 08", "...", None, "3,,4"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["numbers"] for r in QUERIES["numbers_in"](spark, str(tmp_path)).collect()}
    assert got == {k: sorted(sample.numbers(t)) for k, t in rows if t is not None}


def drawn(rows, most):
    """(key, turn, tokens) of the plan by brute force."""
    c = [(f"d{k // 3}#{k}", f"d{k // 3}", n, (lang or "").strip().split("-")[0].lower() or ("ja" if "\u3042" in t else "en")) for k, t, lang, n in rows if t and t.strip() and n >= 40]
    c.sort(key=lambda x: hashlib.sha256(x[0].encode()).hexdigest())
    in_doc, strata, seen = {}, {}, {}
    ranked = [(in_doc.setdefault(x[1], []).append(0) or len(in_doc[x[1]]), x) for x in c]
    for r, x in sorted((x for x in ranked if x[0] <= 4), key=lambda x: x[0]):
        strata.setdefault(x[3], []).append(x)
    for lang, xs in strata.items():
        for turn, x in enumerate(xs, 1):
            seen[turn, lang] = (x[0], turn, x[2])
    return [seen[k] for k in sorted(seen)][:most]


def passages(spark, tmp_path):
    langs = ("en", "en-GB", "de", None)
    rows = [(k, "some text here", langs[k % 4], 30 + k * 37 % 900) for k in range(440)]
    rows += [(k, "\u3042\u3044\u3046 \u3048\u304a", ("ja", None, " ")[k % 3], 50 + k) for k in range(440, 480)] + [(480, None, "en", None), (481, " ", "fr", 50), (482, "texte", "fr", 50)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_batches_hold_the_plan_of_all_documents(spark, tmp_path):
    want, batch, n, t = [], 1, 0, 0
    for key, _, tokens in drawn(passages(spark, tmp_path), 400):
        if n and (n >= 10 or t + tokens > 6000):
            batch, n, t = batch + 1, 0, 0
        n, t = n + 1, t + tokens
        want.append((key, batch))
    got = [(r["key"], r["batch"]) for r in QUERIES["batch_pack"](spark, str(tmp_path)).collect()]
    assert len(want) == 400 and sorted(got) == sorted(want) and any(k.endswith("#482") for k, _ in got)


def test_copies_among_all_rows(spark, tmp_path):
    texts = {0: "one two three four five", 1: "No. One, TWO three four FIVE!", 20: "alpha beta gamma delta eps", 40: "x alpha beta gamma delta eps", 60: "a b c d e a b c d e", 80: "phí vận chuyển cho đơn hàng", 81: "Phi van chuyen cho don", 100: "単 語 が 五 つ ある", 101: "単 語 が 五 つ", 120: None, 121: None, 140: "", 160: "one two three four", 180: "le prix est à payer", 183: "nur der andere text hier"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def runs(t):
        w = regex.sub(r"[^\p{L}\p{N}]+", " ", C.fold_text(t or "")).strip().split(" ")
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = [a for a in texts if a % 20 == 0 and any(runs(texts[a]) & runs(t) for b, t in texts.items() if b != a)]
    assert want == [0, 20, 40, 80, 100]
    assert sorted(r["doc_id"] for r in QUERIES["ngram_copy"](spark, str(tmp_path)).collect()) == want


def test_strata_of_all_documents(spark, tmp_path):
    want = [x[:2] for x in drawn(passages(spark, tmp_path), 60)]
    got = [(r["key"], r["turn"]) for r in QUERIES["stratified_rr"](spark, str(tmp_path)).collect()]
    assert len(want) == 60 and got == want and any(k.endswith("#482") for k, _ in got)
