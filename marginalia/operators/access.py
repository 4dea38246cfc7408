"""Document access, listings, links, the graph and statistics."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.bundle import Bundle
from marginalia.functions import columns as C
from marginalia.functions import fields as metadata
from marginalia.functions import markdown as M
from marginalia.operators.query import Filter, facet_values, matching, visible
from marginalia.operators.scope import EVERYTHING, Scope

FULL_MODE_TOKENS, CATALOG_TOKENS = 30_000, 12_000


class NotFound(LookupError):
    """No such document in the visible ones."""


class InvalidArgument(ValueError):
    """A malformed request."""


# -- one document ------------------------------------------------------------------------------------


def line_range(spec: str, count: int) -> tuple[int, int]:
    """(first, last) of a-b, a- or a; 1-based and inclusive."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:(-)\s*(\d*)\s*)?", spec)
    if not m:
        raise InvalidArgument(f"no line range: {spec}")
    a = int(m[1])
    b = a if not m[2] else int(m[3]) if m[3] else count
    if a < 1 or b < a or a > count:
        raise InvalidArgument(f"lines {spec} of {count}")
    return a, min(b, count)


def get(b: Bundle, id_: str, section: str | None = None, lines: str | None = None, max_tokens: int = 4000, scope: Scope = EVERYTHING) -> dict:
    """One document, one of its sections or a range of its lines, cut to a token budget (at least 100); `section` is the
    heading found, `tokens` counts the whole document."""
    key = re.sub(r"^(\./|/)+", "", id_.strip()).removesuffix(".md")
    row = visible(b, scope).filter(F.col("id") == key).first()
    if row is None:
        raise NotFound(key)
    body, heads = row["body"] or "", M.headings(row["body"])
    missing = False
    if lines:
        all_ = body.split("\n")
        a, z = line_range(lines, len(all_))
        content = "\n".join(all_[a - 1 : z])
    elif section:
        content = M.section(body, section, C.fold_text)
        missing = content is None
        content = content or ""
    else:
        content = body
    content, cut = M.cut_to_tokens(content, max(100, max_tokens))
    at = M.section_heading(body, section, C.fold_text) if section and not missing else None
    fields = json.loads(row["frontmatter"]) if "frontmatter" in b.docs.columns and row["frontmatter"] else {}
    shown = [(level, text) for level, text, _ in heads if level <= 2] if cut or missing else []
    return {"id": key, "path": row["path"], "title": row["title"], "frontmatter": fields, "content": content, "section": at, "truncated": cut, "headings": shown, "tokens": M.tokens(body)}


def sections_of(docs: DataFrame, wanted: str) -> DataFrame:
    """id and content of the section of every document that has it."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, s) for k, t in zip(pdf["id"], pdf["body"]) if (s := M.section(t, wanted, C.fold_text)) is not None]
            yield pd.DataFrame(rows, columns=["id", "content"])

    return docs.select("id", "body").filter("body is not null").mapInPandas(run, "id string, content string")


def headings_of(docs: DataFrame) -> DataFrame:
    """id, level, text and line of every heading."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(k, *h) for k, t in zip(pdf["id"], pdf["body"]) for h in M.headings(t)], columns=["id", "level", "text", "line"])

    return docs.select("id", "body").filter(F.col("body").contains("#")).mapInPandas(run, "id string, level int, text string, line int")


def lines_of(docs: DataFrame, first: int, last: int) -> DataFrame:
    """id and lines first to last of every body, without Python."""
    return docs.select("id", F.array_join(F.slice(F.split("body", "\n"), first, last - first + 1), "\n").alias("content"))


def cut_bodies(docs: DataFrame, budget: int) -> DataFrame:
    """id, content, truncated: every body cut to a token budget."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(k, *M.cut_to_tokens(t, budget)) for k, t in zip(pdf["id"], pdf["body"])], columns=["id", "content", "truncated"])

    return docs.select("id", "body").mapInPandas(run, "id string, content string, truncated boolean")


# -- listings ----------------------------------------------------------------------------------------


def list_dir(b: Bundle, folder: str = ".", scope: Scope = EVERYTHING) -> DataFrame:
    """kind (dir or doc), name, documents and title of what lies directly in a folder; a folder's index
    document isn't listed."""
    base = re.sub(r"^(\./|/)+", "", folder.strip()).strip("/")
    d = visible(b, scope)
    rest = F.col("id")
    if base not in ("", "."):
        d = d.filter(F.col("id").startswith(base + "/"))
        rest = F.substring(F.col("id"), len(base) + 2, 1_000_000)
    d = d.filter(~F.coalesce("reserved", F.lit(False))).select("id", "title", rest.alias("rest"))
    sub = d.filter(F.col("rest").contains("/")).groupBy(F.substring_index("rest", "/", 1).alias("name")).agg(F.count(F.lit(1)).alias("documents")).select(F.lit("dir").alias("kind"), "name", "documents", F.lit(None).cast("string").alias("title"))
    own = d.filter(~F.col("rest").contains("/")).select(F.lit("doc").alias("kind"), F.col("rest").alias("name"), F.lit(1).cast("bigint").alias("documents"), "title")
    return sub.unionByName(own)


def catalog_rows(b: Bundle, scope: Scope = EVERYTHING) -> DataFrame:
    """id, title, type and description of the visible documents: the lines of the catalogue."""
    return matching(b, Filter(), scope).select("id", "title", "type", "description")


def vocabulary_usage(b: Bundle, docs: DataFrame) -> DataFrame:
    """tag, facet and documents of every term of the vocabulary; terms without documents count 0."""
    used = b.tags.filter("canonical is not null").join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").groupBy(F.col("canonical").alias("tag")).agg(F.countDistinct("doc_id").alias("documents"))
    return b.vocabulary.select("tag", "facet").join(used, "tag", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def catalog_facets(b: Bundle, docs: DataFrame) -> DataFrame:
    """field, value, count of type, lang and status, and of the vocabulary's facets (count: documents with
    any of a facet's terms)."""
    plain = facet_values(b, docs, ["type", "lang", "status"])
    terms = b.vocabulary.filter("facet is not null").select(F.col("tag").alias("canonical"), "facet")
    seen = b.tags.join(terms, "canonical").join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    facets = seen.groupBy("facet").agg(F.countDistinct("doc_id").alias("count")).select(F.lit("facet").alias("field"), F.col("facet").alias("value"), "count")
    return plain.unionByName(facets)


def catalog(b: Bundle, max_tokens: int = CATALOG_TOKENS, scope: Scope = EVERYTHING) -> dict:
    """All documents as a list if it fits a token budget, else counts by top folder; with the vocabulary
    and the facets.  Lines are added up before any is collected."""
    d = matching(b, Filter(), scope)
    line = F.concat(F.lit("- "), "id", F.lit(": "), F.coalesce("title", F.lit("")), F.when(F.col("description").isNotNull(), F.concat(F.lit(" — "), "description")).otherwise(""))
    rows = d.select("id", line.alias("line"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(C.estimate_tokens(F.concat("line", F.lit("\n")))), F.lit(0)).alias("t")).first()
    flat = size["t"] <= max_tokens
    if flat:
        content = "\n".join(r["line"] for r in rows.orderBy("id").collect())
    else:
        tops = d.groupBy(F.when(F.col("id").contains("/"), F.concat(F.substring_index("id", "/", 1), F.lit("/"))).otherwise(F.col("id")).alias("top")).count().orderBy("top").collect()
        content = "\n".join(f"- {r['top']} ({r['count']})" for r in tops)
    return {
        "mode": "flat" if flat else "index", "docs": size["n"], "content": content, "tokens": M.tokens(content),
        "vocabulary": [tuple(r) for r in vocabulary_usage(b, d).orderBy(F.desc("documents"), "tag").collect()],
        "facets": [tuple(r) for r in catalog_facets(b, d).orderBy("field", F.desc("count"), "value").collect()],
    }


# -- links and graph ---------------------------------------------------------------------------------


def resolve_wiki(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links with the targets of wiki links: an exact id first, else the only document of that name."""
    name = F.regexp_replace(F.regexp_replace(F.trim(F.substring_index("raw", "#", 1)), "^/+", ""), r"\.md$", "")
    wiki = links.filter("kind = 'wiki'").withColumn("wanted", name).drop("target")
    exact = ids.select(F.col("id").alias("wanted"), F.col("id").alias("by_id"))
    by_name = ids.select(C.id_name(F.col("id")).alias("wanted"), "id").groupBy("wanted").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("by_name")).filter("n = 1").drop("n")
    got = wiki.join(exact, "wanted", "left").join(by_name, "wanted", "left").withColumn("target", F.coalesce("by_id", "by_name"))
    return links.filter("kind <> 'wiki'").unionByName(got.select(links.columns))


def outgoing(links: DataFrame, ids: DataFrame, id_: str | None = None) -> DataFrame:
    """src, target, raw, text, kind, line and whether the target exists, of one document or all; links to
    other places are left out."""
    own = links.filter(F.col("src") == id_) if id_ else links
    known = ids.select(F.col("id").alias("target"), F.lit(True).alias("exists"))
    return own.filter("target is not null or kind = 'wiki'").join(known, "target", "left").select("src", "target", "raw", "text", "kind", "line", F.coalesce("exists", F.lit(False)).alias("exists"))


def backlinks(links: DataFrame, visible_ids: DataFrame, id_: str | None = None) -> DataFrame:
    """target, src, text, line of links from visible documents to one document or to any."""
    to = links.filter(F.col("target") == id_) if id_ else links.filter("target is not null")
    return to.join(visible_ids.select(F.col("id").alias("src")), "src", "left_semi").select("target", "src", "text", "line")


def broken(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links to nowhere: unresolved wiki links, and document paths that no document has."""
    lost = links.filter("target is not null").join(ids.select(F.col("id").alias("target")), "target", "left_anti").select(links.columns)
    return lost.unionByName(links.filter("target is null and kind = 'wiki'").select(links.columns))


def merged_edges(links: DataFrame) -> DataFrame:
    """src, target and the number of parallel links; links of a document to itself are dropped."""
    return links.filter("target is not null and src <> target").groupBy("src", "target").agg(F.count(F.lit(1)).alias("count"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree over merged edges; both ends in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def top_nodes(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The most linked nodes (both directions, ties by id): id and degree."""
    d = degrees(edges).select("id", (F.col("out_degree") + F.col("in_degree")).alias("degree"))
    return nodes.select("id").join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "id").limit(limit)


def kept_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between kept nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")


def graph(b: Bundle, f: Filter | None = None, limit: int = 2000, scope: Scope = EVERYTHING) -> dict:
    """nodes (id, title, type, status, out_degree, in_degree, broken), edges and whether some were left
    out; degrees are those among the kept nodes, broken counts targets missing from all ids."""
    docs = matching(b, f or Filter(), scope)
    links = resolve_wiki(b.links(), b.docs.select("id")).persist()
    try:
        edges = kept_edges(merged_edges(links), docs)
        n = docs.count()
        nodes = top_nodes(docs, edges, limit) if n > limit else docs.select("id")
        edges = kept_edges(edges, nodes)
        lost = broken(links, b.docs).filter(scope.path(F.coalesce("target", F.col("src")))).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("broken"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        full = docs.select("id", "title", "type", "status").join(nodes.select("id"), "id", "left_semi").join(degrees(edges), "id", "left").join(lost, "id", "left")
        out = full.select("id", "title", "type", "status", zero("out_degree"), zero("in_degree"), zero("broken"))
        return {"nodes": [r.asDict() for r in out.orderBy("id").collect()], "edges": [tuple(r) for r in edges.select("src", "target", "count").orderBy("src", "target").collect()], "truncated": n > limit}
    finally:
        links.unpersist()


# -- statistics --------------------------------------------------------------------------------------


def mode_for(tokens: Column, all_embedded: Column) -> Column:
    return F.when(tokens <= FULL_MODE_TOKENS, "full").when(all_embedded, "retrieval").otherwise("lexical")


def totals(docs: DataFrame) -> DataFrame:
    """docs, reserved, tokens in one pass; stored token counts below 0 or missing count 0."""
    own = ~F.coalesce("reserved", F.lit(False))
    return docs.agg(F.count_if(own).alias("docs"), F.count_if(~own).alias("reserved"), F.coalesce(F.sum(F.when(own, F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)))), F.lit(0)).alias("tokens"))


def counts_by(docs: DataFrame, field: str) -> DataFrame:
    return docs.filter(~F.coalesce("reserved", F.lit(False))).groupBy(F.coalesce(field, F.lit("(none)")).alias(field)).agg(F.count(F.lit(1)).alias("documents"))


def content_langs(docs: DataFrame) -> DataFrame:
    """lang and weight: tokens (at least 1 a document) by language prefix; a missing language is detected
    on the first 2000 characters; _meta/ is left out."""
    code = F.lower(F.regexp_extract(C.blank_to_null(F.col("lang")), "^([^-_]*)", 1))
    lang = F.coalesce(F.when(code != "", code), C.detect_lang(F.substring("body", 1, 2000)))
    d = docs.filter(~F.coalesce("reserved", F.lit(False)) & ~F.col("id").startswith("_meta/"))
    return d.select(lang.alias("lang"), F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(1)).alias("w")).filter("lang is not null").groupBy("lang").agg(F.sum("w").alias("weight"))


def frequent_fields(b: Bundle, docs: DataFrame, top: int = 12) -> DataFrame:
    """key and documents of custom fields in at least a tenth of the documents, the most frequent first."""
    own = metadata.long_table(docs).filter(~F.col("key").isin(*metadata.STANDARD_KEYS))
    per = own.select("doc_id", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("documents"))
    n = docs.agg(F.greatest(F.floor(F.count(F.lit(1)) / 10), F.lit(1)).alias("least"))
    return per.join(F.broadcast(n), F.col("documents") >= F.col("least")).select("key", "documents").orderBy(F.desc("documents"), "key").limit(top)  # n is one row


def detected_langs(docs: DataFrame, sample: int = 200, share: float = 0.1) -> DataFrame:
    """Languages of at least a share of the titles and descriptions of the first documents (by id; a
    sample is the feature)."""
    head = docs.orderBy("id").limit(sample).select(C.detect_lang(F.concat_ws(" ", "title", "description")).alias("lang")).filter("lang is not null")
    n = head.agg(F.count(F.lit(1)).alias("n"))
    return head.groupBy("lang").agg(F.count(F.lit(1)).alias("documents")).join(F.broadcast(n), F.col("documents") >= F.lit(share) * F.col("n")).select("lang", "documents")  # n is one row


def stats(b: Bundle, scope: Scope = EVERYTHING) -> dict:
    d = visible(b, scope)
    row = totals(d).first().asDict()
    chunks = b.chunks().join(d.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").count()
    links = resolve_wiki(b.links(), b.docs.select("id"))
    lost = broken(links.join(d.select(F.col("id").alias("src")), "src", "left_semi").select(links.columns), b.docs).count()
    by = {f"{k}s": {r[0]: r[1] for r in counts_by(d, k).collect()} for k in ("type", "lang")}
    return {**row, "chunks": chunks, **by, "broken_links": lost, "mode": "full" if row["tokens"] <= FULL_MODE_TOKENS else "lexical"}
