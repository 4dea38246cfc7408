"""Data-quality rules over documents, tags, links and vocabulary; each yields rows, all are united."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.bundle import Bundle
from marginalia.functions import columns as C
from marginalia.functions import fields as metadata
from marginalia.functions import markdown as M
from marginalia.operators import access
from marginalia.tables import cut_lineage

#: Rules on single documents that look at every document.
ALWAYS = ("missing-frontmatter", "invalid-frontmatter", "doc-too-long")
SCHEMA = "rule string, level int, severity string, path string, line int, field string, message string"
STATUSES = ("stable", "deprecated", "draft")

#: code -> (level, severity): fixed values.
RULES = {
    **dict.fromkeys("empty-bundle missing-frontmatter invalid-frontmatter missing-type invalid-type index-frontmatter unreadable".split(), (0, "error")),
    **dict.fromkeys("log-date-heading doc-too-long".split(), (0, "warning")),
    **dict.fromkeys("missing-title missing-description description-repeats-title missing-index".split(), (1, "error")),
    **dict.fromkeys("description-too-short description-too-long stale-index unreviewed-generated".split(), (1, "warning")),
    **dict.fromkeys(
        "missing-tags missing-lang missing-status missing-updated no-vocabulary invalid-vocabulary unknown-tag non-canonical-tag invalid-status invalid-updated invalid-supersedes "
        "unknown-supersedes superseded-still-stable invalid-effective-range invalid-schema schema-missing-field schema-wrong-type schema-not-allowed".split(),
        (2, "error"),
    ),
    "broken-link": (3, "warning"),
}


@dataclass
class Context:
    """What rules see: the bundle, and what only some collections have."""

    bundle: Bundle
    max_doc_tokens: int = 8000
    supersedes: DataFrame | None = None  # id, old (null or blank: wrong shape)
    generated: DataFrame | None = None  # id, fields array<string>, verified boolean
    schemas: DataFrame | None = None  # type, field, kind, required, allowed array<string>
    links: DataFrame | None = None
    parsed: DataFrame | None = None  # path, id, frontmatter (JSON), fm_state, error: of files read from a folder
    vocabulary_state: str = "valid"  # or absent, invalid
    broken_schemas: tuple[str, ...] = ()  # paths of type schemas that can't be read
    whole: Bundle | None = None  # the bundle with bodies, where `bundle` has none
    disabled: frozenset[str] = frozenset()
    extra: list[Callable[[Context], DataFrame]] = field(default_factory=list)

    @property
    def docs(self) -> DataFrame:
        return self.bundle.docs.filter(~F.coalesce("reserved", F.lit(False)))

    @property
    def usable(self) -> DataFrame:
        """Documents with a metadata block that can be read, outside of _meta/: only they have findings on their
        metadata, on others those would only repeat what is wrong with the block."""
        return self.docs.filter(_usable())


def _usable() -> Column:
    return F.coalesce(F.col("fm_state") == "valid", F.lit(False)) & ~_is_meta(F.col("id"))


def _is_meta(c: Column) -> Column:
    return (c == "_meta") | c.startswith("_meta/")


def diagnostic(df: DataFrame, code: str, path: Column, message: Column | str = "", line: Column | int | None = None, fld: str | None = None) -> DataFrame:
    level, severity = RULES.get(code, (0, "warning"))
    text = F.lit(message) if isinstance(message, str) else message
    at = line if isinstance(line, Column) else F.lit(line)
    return df.select(F.lit(code).alias("rule"), F.lit(level).alias("level"), F.lit(severity).alias("severity"), path.alias("path"), at.cast("int").alias("line"), F.lit(fld).cast("string").alias("field"), text.alias("message"))


def _filters(c: Context) -> DataFrame:
    """All rules that look at one document only: one scan, the codes of each row exploded."""
    empty = lambda x: C.blank_to_null(F.col(x)).isNull()
    weight = F.length("description") + 2 * F.length(F.regexp_replace("description", f"[^{C.CJK}]", ""))
    from_, to = F.col("effective_from"), F.col("effective_to")
    bad_range = (from_.isNotNull() & ~C.is_iso_date(from_)) | (to.isNotNull() & ~C.is_iso_date(to)) | F.coalesce(C.is_iso_date(from_) & C.is_iso_date(to) & (from_ > to), F.lit(False))
    checks = {
        "missing-frontmatter": F.coalesce(F.col("fm_state") == "absent", F.lit(False)),
        "invalid-frontmatter": F.coalesce(F.col("fm_state").isin("unterminated", "invalid"), F.lit(False)),
        "missing-type": empty("type"),
        "doc-too-long": F.coalesce(F.col("tokens") > c.max_doc_tokens, F.lit(False)),
        "missing-title": empty("title") | (F.col("title_from") != "metadata" if "title_from" in c.bundle.docs.columns else F.lit(False)),
        "missing-description": empty("description"),
        "description-repeats-title": F.coalesce(C.ascii_lower(F.trim("description")) == C.ascii_lower(F.trim("title")), F.lit(False)),
        "description-too-short": F.coalesce(~empty("description") & (weight < 20), F.lit(False)),
        "description-too-long": F.coalesce(F.length("description") > 300, F.lit(False)),
        "missing-lang": empty("lang"),
        "missing-status": empty("status"),
        "missing-updated": empty("updated"),
        "invalid-status": F.coalesce(~empty("status") & ~F.col("status").isin(*STATUSES), F.lit(False)),
        "invalid-updated": F.coalesce(~empty("updated") & ~C.is_iso_date(F.col("updated")), F.lit(False)),
        "invalid-effective-range": bad_range,
    }
    each = F.array_compact(F.array(*[F.when(p, F.struct(F.lit(code).alias("rule"), F.lit(RULES[code][0]).alias("level"), F.lit(RULES[code][1]).alias("severity"))) for code, p in ((code, p if code in ALWAYS else p & _usable()) for code, p in checks.items()) if code not in c.disabled]))
    rows = c.docs.select("path", F.explode(each).alias("x"))
    return rows.select("x.rule", "x.level", "x.severity", "path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("field"), F.lit("").alias("message"))


def _tags(c: Context) -> list[DataFrame]:
    tags, docs, out = c.bundle.tags, c.usable.select(F.col("id").alias("doc_id"), "path"), []
    bare = docs.join(tags.select("doc_id").distinct(), "doc_id", "left_anti")
    out.append(diagnostic(bare, "missing-tags", F.col("path"), fld="tags"))
    t = tags.join(docs, "doc_id")
    out.append(diagnostic(t.filter("canonical is null"), "unknown-tag", F.col("path"), F.col("tag"), fld="tags"))
    out.append(diagnostic(t.filter("canonical is not null and canonical <> norm"), "non-canonical-tag", F.col("path"), F.concat("tag", F.lit(" -> "), "canonical"), fld="tags"))
    return out


def _structure(c: Context) -> list[DataFrame]:
    out = []
    none = c.docs.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    out.append(diagnostic(none, "empty-bundle", F.lit(".")))
    # every folder with usable documents, and all above it, has an index
    parts = F.split("id", "/")
    folders = c.usable.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("folder")).distinct()
    index = c.bundle.docs.filter((F.col("id") == "index") | F.col("id").endswith("/index")).select(C.id_dir(F.col("id")).alias("folder"))
    out.append(diagnostic(folders.join(index, "folder", "left_anti"), "missing-index", F.concat(F.when(F.col("folder") != "", F.concat("folder", F.lit("/"))).otherwise(""), F.lit("index.md"))))
    return out


def _index_contents(c: Context) -> list[DataFrame]:
    """stale-index: an index that doesn't link every document of its folder and the index of every folder below it
    (_meta aside); log-date-heading."""
    links = c.links if c.links is not None else c.bundle.links()
    index = c.bundle.docs.filter((F.col("id") == "index") | F.col("id").endswith("/index")).select("path", C.id_dir(F.col("id")).alias("folder")).filter(~_is_meta(F.col("folder")))
    # what each folder above a document has to list: the document itself, or the index of the folder between
    parts = F.split("id", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda k: F.struct(
            F.array_join(F.slice(parts, 1, k), "/").alias("folder"),
            F.when(k == F.size(parts) - 1, F.col("id")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k + 1), "/"), F.lit("/index"))).alias("child"),
            F.when(k < F.size(parts) - 1, F.array_join(F.slice(parts, 1, k + 1), "/")).otherwise("").alias("sub"),
        ),
    )
    expected = c.docs.select(F.explode(above).alias("x")).select("x.*").filter(~_is_meta(F.col("sub"))).select("folder", "child").distinct()
    listed = links.filter((F.col("kind") == "markdown") & C.id_name(F.col("src")).isin("index")).select(C.id_dir(F.col("src")).alias("folder"), F.col("target").alias("child"))
    # both sides meet by folder and child, so that a large folder is no hot key; only counts meet the index documents
    lost = expected.join(listed, ["folder", "child"], "left_anti").groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("first"))
    stale = lost.join(index, "folder").select("path", F.concat(F.lit("does not list: "), F.regexp_replace("first", "/index$", "/"), F.when(F.col("n") > 1, F.concat(F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" more"))).otherwise("")).alias("m"))
    logs = access.headings_of((c.whole or c.bundle).docs.filter((F.col("id") == "log") | F.col("id").endswith("/log"))).filter((F.col("level") == 2) & ~C.is_iso_date(F.col("text")))
    return [diagnostic(stale, "stale-index", F.col("path"), F.col("m")), diagnostic(logs, "log-date-heading", F.concat("id", F.lit(".md")), F.col("text"), F.col("line"))]


def _supersedes(c: Context) -> list[DataFrame]:
    if c.supersedes is None:
        return []
    s = c.supersedes.join(c.docs.select("id", "path"), "id")
    ok = s.filter(C.blank_to_null(F.col("old")).isNotNull())
    old = c.docs.select(F.col("id").alias("old"), F.col("status").alias("old_status"))
    return [
        diagnostic(s.filter(C.blank_to_null(F.col("old")).isNull()), "invalid-supersedes", F.col("path"), fld="supersedes"),
        diagnostic(ok.join(old, "old", "left_anti"), "unknown-supersedes", F.col("path"), F.col("old"), fld="supersedes"),
        diagnostic(ok.join(old, "old").filter("old_status = 'stable'"), "superseded-still-stable", F.col("path"), F.col("old"), fld="supersedes"),
    ]


def _generated(c: Context) -> list[DataFrame]:
    if c.generated is None:
        return []
    g = c.generated.filter(~F.coalesce("verified", F.lit(False)) & F.arrays_overlap("fields", F.array(F.lit("title"), F.lit("description"), F.lit("type"))))
    return [diagnostic(g.join(c.docs.select("id", "path"), "id"), "unreviewed-generated", F.col("path"))]


def _schemas(c: Context) -> list[DataFrame]:
    """Declared fields per type, all findings in one pass over the documents of these types.

    The schemas are few rows, which the driver has read, and are sent to every task: documents are neither moved nor
    joined with their own fields.
    """
    if c.schemas is None:
        return []
    per_type = c.schemas.groupBy("type").agg(F.collect_list(F.struct("field", "kind", "required", "allowed")).alias("declared"))
    d = c.usable.join(F.broadcast(per_type), "type")
    each = d.select("path", F.explode("declared").alias("s"), metadata.pairs(d).alias("pairs")).select("path", "s.*", F.try_element_at("pairs", F.col("s.field")).alias("v"))
    # the field itself is held against its kind, each item of a list against the allowed values
    x = each.select("path", "field", F.lower("kind").alias("kind"), "required", "allowed", metadata.kind_of(F.col("v")).alias("t"), metadata.item_texts(F.col("v")).alias("texts"))
    kind, t, v = F.col("kind"), F.col("t"), F.get("texts", F.lit(0))
    fits = (
        F.when(kind.isin("any", ""), True).when(kind.isin("number", "float"), t == "number").when(kind.isin("integer", "int"), (t == "number") & v.rlike(r"^-?\d+(\.0+)?$"))
        .when(kind.isin("bool", "boolean"), t == "bool").when(kind.isin("date", "datetime"), (t == "string") & C.is_iso_date(v)).when(kind.isin("list", "array"), t == "list").when(kind.isin("map", "object"), t == "map").otherwise(t == "string")
    )
    other = F.exists("texts", lambda i: ~F.array_contains("allowed", i))
    mark = lambda code: F.struct(F.lit(code).alias("rule"), F.lit(RULES[code][0]).alias("level"), F.lit(RULES[code][1]).alias("severity"))
    found = F.when(t.isNull(), F.when(F.col("required"), mark("schema-missing-field"))).when(~fits, mark("schema-wrong-type")).when((F.size("allowed") > 0) & other, mark("schema-not-allowed"))
    rows = x.select("path", F.col("field").alias("message"), F.explode(F.array_compact(F.array(found))).alias("f"))
    return [rows.select("f.rule", "f.level", "f.severity", "path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("field"), "message")]


def _files(c: Context) -> list[DataFrame]:
    """Rules on the files themselves, and on the bundle's own documents of terms and types."""
    spark, out = c.bundle.spark, []
    one = lambda code, paths: diagnostic(spark.createDataFrame([(p,) for p in paths], "path string"), code, F.col("path"))
    if c.vocabulary_state != "valid":
        out.append(one("no-vocabulary" if c.vocabulary_state == "absent" else "invalid-vocabulary", ["_meta/vocabulary.md"]))
    if c.broken_schemas:
        out.append(one("invalid-schema", list(c.broken_schemas)))
    if c.parsed is None:
        return out
    p = c.parsed
    type_ = F.try_variant_get(F.try_parse_json("frontmatter"), "$.type", "variant")
    keys = F.json_object_keys("frontmatter")
    index = (F.col("id") == "index") | F.col("id").endswith("/index")
    extra = F.when(F.col("id") == "index", F.size(F.filter(keys, lambda k: ~k.endswith("_version"))) > 0).otherwise(F.size(keys) > 0)
    out.append(diagnostic(p.filter("error is not null"), "unreadable", F.col("path"), F.col("error")))
    out.append(diagnostic(p.filter(F.schema_of_variant(type_) != "STRING").filter(F.schema_of_variant(type_) != "VOID"), "invalid-type", F.col("path"), fld="type"))
    out.append(diagnostic(p.filter(index & (F.col("fm_state") == "valid") & F.coalesce(extra, F.lit(False))), "index-frontmatter", F.col("path")))
    return out


def _links(c: Context) -> list[DataFrame]:
    links = access.resolve_wiki(c.links if c.links is not None else c.bundle.links(), c.bundle.docs.select("id"))
    lost = access.broken(links, c.bundle.docs.select("id")).join(c.docs.select(F.col("id").alias("src"), "path"), "src")
    return [diagnostic(lost, "broken-link", F.col("path"), F.col("raw"), F.col("line"))]


def distinct(diagnostics: DataFrame) -> DataFrame:
    """Equal diagnostics once."""
    return diagnostics.dropDuplicates()


def lint(c: Context) -> DataFrame:
    """All diagnostics, equal ones once.

    The documents' metadata and the tags are read by many rules: they are worked out once and kept (without
    the bodies); only links and dated headings come from the bodies.
    """
    b = c.bundle
    slim = replace(b, docs=cut_lineage(b.docs.drop("body")), tags=cut_lineage(b.tags.drop("folded")))
    c = replace(c, bundle=slim, whole=b, links=c.links if c.links is not None else b.links())
    parts = [_filters(c), *_tags(c), *_structure(c), *_index_contents(c), *_supersedes(c), *_generated(c), *_schemas(c), *_files(c), *_links(c), *(r(c) for r in c.extra)]
    out = distinct(reduce(DataFrame.unionByName, parts))
    return out.filter(~F.col("rule").isin(*c.disabled) if c.disabled else F.lit(True))


def summary(diagnostics: DataFrame, target: int = 2) -> DataFrame:
    """errors, warnings, and the level reached: below the lowest level with an error (-1: none)."""
    e = F.col("severity") == "error"
    d = diagnostics.filter(F.col("level") <= target)
    return d.agg(F.count_if(e).alias("errors"), F.count_if(~e).alias("warnings"), F.coalesce(F.min(F.when(e, F.col("level"))) - 1, F.lit(target)).alias("level"))


def counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("rule", "level", "severity").agg(F.count(F.lit(1)).alias("findings"))


# -- safe repairs ------------------------------------------------------------------------------------


def canonical_plan(b: Bundle) -> DataFrame:
    """doc_id, tags as they are and canonical, of documents that a rewrite would change; the first of equal
    tags stays."""
    per = b.tags.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "tag", F.coalesce("canonical", "tag").alias("new")))).alias("x"))
    p = per.select("doc_id", F.transform("x", lambda t: t["tag"]).alias("before"), F.array_distinct(F.transform("x", lambda t: t["new"])).alias("after"))
    return p.filter(F.to_json(F.struct("before")) != F.to_json(F.struct(F.col("after").alias("before"))))


def index_plan(c: Context) -> DataFrame:
    """folder and line: the lines of the index documents to create, one row each (null where a folder only
    has folders), so that a folder of any size is never gathered in one task."""
    lost = _structure(c)[1].select(F.regexp_replace("path", "/?index[.]md$", "").alias("folder"))
    own = c.docs.select(C.id_dir(F.col("id")).alias("folder"), C.id_name(F.col("id")).alias("name"), F.coalesce("title", C.id_name(F.col("id"))).alias("title"))
    return lost.join(own.select("folder", F.concat(F.lit("- ["), "title", F.lit("](./"), "name", F.lit(".md)")).alias("line")), "folder", "left")


# -- output ------------------------------------------------------------------------------------------


def to_sarif(rows: list) -> dict:
    """SARIF 2.1.0 of collected diagnostics."""
    rules = sorted({r["rule"] for r in rows})
    return {
        "version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json",
        "runs": [{
            "tool": {"driver": {"name": "marginalia", "rules": [{"id": r, "properties": {"level": f"L{RULES.get(r, (0,))[0]}"}} for r in rules]}},
            "results": [{
                "ruleId": r["rule"], "ruleIndex": rules.index(r["rule"]), "level": r["severity"], "message": {"text": r["message"] or r["rule"]},
                "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}, **({"region": {"startLine": r["line"]}} if r["line"] else {})}}],
            } for r in rows],
        }],
    }


def first_h1_of(docs: DataFrame) -> DataFrame:
    """id and first # heading of every document."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(k, M.first_h1(t), M.first_sentence(t)) for k, t in zip(pdf["id"], pdf["body"])], columns=["id", "h1", "sentence"])

    return docs.select("id", "body").mapInPandas(run, "id string, h1 string, sentence string")
