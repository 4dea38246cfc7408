"""Metadata queries: filters, facets, sums, sorting and limits over documents."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.bundle import Bundle
from marginalia.functions import columns as C
from marginalia.functions import fields as M
from marginalia.operators.scope import EVERYTHING, Scope, glob_predicate, value_matches


@dataclass(frozen=True)
class Filter:
    """All conditions must hold; within a list any value will do."""

    type: tuple[str, ...] = ()
    tags_all: tuple[str, ...] = ()
    tags_any: tuple[str, ...] = ()
    status: tuple[str, ...] = ()
    status_not: tuple[str, ...] = ()
    lang: tuple[str, ...] = ()
    fields: dict[str, list[str]] = field(default_factory=dict)
    path: str | None = None
    text: str | None = None
    updated_from: str | None = None
    updated_to: str | None = None
    active_on: str | None = None
    ranges: dict[str, dict[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Request(Filter):
    sort: str = "id"
    limit: int = 50
    count_only: bool = False
    facets: tuple[str, ...] = ()
    sum_field: str | None = None


def request_of(args: dict) -> Request:
    """A request from loose arguments: unknown ones become field filters, and <f>_from and <f>_to ranges."""
    known, out, fields, ranges = Request.__dataclass_fields__, {}, dict(args.get("fields", {})), {k: dict(v) for k, v in args.get("ranges", {}).items()}
    for k, v in args.items():
        if k in ("fields", "ranges"):
            continue
        if k in known:
            out[k] = tuple([v] if isinstance(v, str) else v) if known[k].type.startswith("tuple") else v
        elif k.endswith(("_from", "_to")) and not isinstance(v, list):
            ranges.setdefault(k.rpartition("_")[0], {})[k.rpartition("_")[2]] = str(v)
        else:
            fields[k] = [str(x) for x in v] if isinstance(v, list) else [str(v)]
    return Request(**out, fields=fields, ranges=ranges)


def compare(value: Column, bound: str, op: str) -> Column:
    """value >= bound or value <= bound: as numbers if both are, else as text."""
    text = value >= bound if op == ">=" else value <= bound
    import re

    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", bound):
        return text
    n = C.number_of_text(value)
    return F.when(n.isNotNull(), n >= float(bound) if op == ">=" else n <= float(bound)).otherwise(text)


def in_range(value: Column, low: str | None, high: str | None) -> Column:
    """Inclusive; no bounds: true; a null value with a bound: false."""
    out = F.lit(True)
    if low is not None:
        out &= compare(value, low, ">=")
    if high is not None:
        out &= compare(value, high, "<=")
    return F.coalesce(out, F.lit(False))


def active_on(day: str) -> Column:
    """In force on a day: status missing or stable, and the day within effective_from and effective_to,
    where a missing end is open.  Days are compared as text."""
    status = F.coalesce(F.col("status") == "stable", F.lit(True))
    return status & F.coalesce(F.col("effective_from") <= day, F.lit(True)) & F.coalesce(F.col("effective_to") >= day, F.lit(True))


def search_text() -> Column:
    return C.fold(F.concat_ws(" ", "id", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))


def tag_keys(tags: DataFrame) -> DataFrame:
    """doc_id and all keys of its tags: folded as written and folded canonical."""
    both = tags.select("doc_id", F.explode(F.array("folded", C.fold(C.normalize_tag(F.col("canonical"))))).alias("key")).filter("key is not null")
    return both.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def predicate(docs: DataFrame, f: Filter) -> Column:
    """The conditions on documents themselves (all but tags).  Any metadata field can be asked for."""
    p = F.lit(True)
    if f.type:
        p &= F.coalesce(value_matches(F.col("type"), list(f.type)), F.lit(False))
    if f.status:
        p &= F.coalesce(value_matches(F.col("status"), list(f.status)), F.lit(False))
    if f.status_not:
        p &= ~F.coalesce(value_matches(F.col("status"), list(f.status_not)), F.lit(False))
    if f.lang:
        p &= F.coalesce(F.col("lang").isin(*f.lang), F.lit(False))
    if f.path:
        p &= glob_predicate(f.path, F.col("id"))
    if f.text:
        p &= search_text().contains(C.fold_text(f.text))
    if f.updated_from is not None or f.updated_to is not None:
        p &= in_range(F.col("updated"), f.updated_from, f.updated_to)
    if f.active_on:
        p &= active_on(f.active_on)
    for name, wanted in f.fields.items():
        p &= F.coalesce(value_matches(M.items(docs, name), wanted, many=True), F.lit(False))
    for name, r in f.ranges.items():
        p &= in_range(M.scalar(docs, name), r.get("from"), r.get("to"))
    return p


def visible(b: Bundle, scope: Scope = EVERYTHING) -> DataFrame:
    if not scope.restricted:
        return b.docs
    return b.docs.filter(scope.visible(F.col("id"), F.col("reserved"), {n: M.items(b.docs, n) for n in (*scope.within, *scope.without)}))


def matching(b: Bundle, f: Filter, scope: Scope = EVERYTHING) -> DataFrame:
    """The documents a filter keeps; reserved ones are never among them.  Tags are joined only when asked
    for."""
    d = visible(b, scope).filter(~F.coalesce("reserved", F.lit(False))).filter(predicate(b.docs, f))
    want = lambda ts: [C.fold_text(_norm(t)) for t in ts]
    if f.tags_all or f.tags_any:
        d = d.join(tag_keys(b.tags).withColumnRenamed("doc_id", "id"), "id", "left")
        keys = F.coalesce("keys", F.array().cast("array<string>"))
        for k in want(f.tags_all):
            d = d.filter(F.array_contains(keys, k))
        if f.tags_any:
            d = d.filter(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in want(f.tags_any)])))
        d = d.drop("keys")
    return d


def _norm(t: str) -> str:
    import re

    return re.sub(r"[\s_-]+", "-", t.strip().lower()).strip("-")


def facet_values(b: Bundle, docs: DataFrame, fields: list[str] | tuple[str, ...]) -> DataFrame:
    """field, value, count of every value; all fields in one pass (each item of a list counts), tags as written."""
    plain = [f for f in fields if f != "tags"]
    parts = []
    if plain:
        named = lambda f: lambda v: F.struct(F.lit(f).alias("field"), v.alias("value"))
        own = F.array(*[named(f)(docs[f].cast("string")) for f in plain if M.is_column(docs, f)]) if any(M.is_column(docs, f) for f in plain) else None
        lists = [F.transform(M.items(docs, f), named(f)) for f in plain if not M.is_column(docs, f)]
        each = F.concat(*([own] if own is not None else []), *lists) if lists else own
        parts.append(docs.select(F.explode(each).alias("x")).select("x.field", "x.value").filter("value is not null").groupBy("field", "value").count())
    if "tags" in fields:
        parts.append(docs.select(F.col("id").alias("doc_id")).join(b.tags.select("doc_id", "tag"), "doc_id").groupBy(F.col("tag").alias("value")).count().select(F.lit("tags").alias("field"), "value", "count"))
    empty = docs.sparkSession.createDataFrame([], "field string, value string, count bigint")
    return reduce(DataFrame.unionByName, parts) if parts else empty


def sum_of(docs: DataFrame, name: str) -> DataFrame:
    """total and contributing count of a numeric field; texts are no numbers."""
    v = M.number(docs, name)
    return docs.select(F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.count(v).alias("contributing"))


def sum_units(docs: DataFrame, name: str) -> DataFrame:
    """unit (the currency, else the unit) and count over the documents that a sum of the field counts."""
    unit = F.coalesce(M.scalar(docs, "currency"), M.scalar(docs, "unit"))
    return docs.filter(M.number(docs, name).isNotNull()).groupBy(unit.alias("unit")).count()


def order_by(docs: DataFrame, sort: str) -> list[Column]:
    """Sort key with ties by id; numbers as numbers and before texts; missing last.  A leading - turns everything round,
    so missing come first and ids run down."""
    down, name = sort.startswith("-"), sort.removeprefix("-")
    if name == "id":
        cols = [F.col("id")]
    elif M.is_column(docs, name):
        cols = [docs[name], F.col("id")]
    else:
        cols = [M.number(docs, name), M.scalar(docs, name), F.col("id")]
    return [c.desc_nulls_first() if down else c.asc_nulls_last() for c in cols]


def project(b: Bundle, docs: DataFrame) -> DataFrame:
    """id, title, type, status, lang, updated, tags as written, extra (key-sorted map of other scalars).
    Tags are joined to the shown rows only."""
    shown = docs.select("id", "title", "type", "status", "lang", "updated", M.extra(docs).alias("extra"))
    tags = b.tags.join(shown.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tag"))), lambda x: x["tag"]).alias("tags"))
    return shown.join(tags.withColumnRenamed("doc_id", "id"), "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


#: Values of a facet that a call shows.
FACET_VALUES = 1000


def shown_facets(b: Bundle, docs: DataFrame, fields: tuple[str, ...]) -> dict[str, list[tuple[str, int]]]:
    """The most frequent values of each field (at most FACET_VALUES), all fields in one pass."""
    per = Window.partitionBy("field").orderBy(F.desc("count"), "value")
    rows = facet_values(b, docs, fields).withColumn("rank", F.row_number().over(per)).filter(F.col("rank") <= FACET_VALUES).collect()
    out: dict[str, list[tuple[str, int]]] = {f: [] for f in fields}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r["field"]].append((r["value"], r["count"]))
    return out


def page(docs: DataFrame, limit: int | None = 50) -> DataFrame:
    """total, shown and more of a result with a limit."""
    shown = F.least("total", F.lit(limit)) if limit is not None else F.col("total")
    return docs.agg(F.count(F.lit(1)).alias("total")).withColumn("shown", shown).withColumn("more", F.col("total") - F.col("shown"))


def run(b: Bundle, r: Request, scope: Scope = EVERYTHING) -> dict:
    """total, docs, more, facets and sum of a request.  The matching documents are kept once for all."""
    d = matching(b, r, scope)
    rows, total_sum = [], None
    slim = d.drop("body").persist()
    try:
        total = slim.count()
        facets = shown_facets(b, slim, r.facets) if r.facets else {}
        if r.sum_field:
            s = sum_of(slim, r.sum_field).first()
            units = {x["unit"]: x["count"] for x in sum_units(slim, r.sum_field).collect()}
            total_sum = {"field": r.sum_field, "value": s["total"], "count": s["contributing"], "units": units}
        if not r.count_only:
            order = [x["id"] for x in slim.orderBy(*order_by(slim, r.sort)).limit(r.limit).select("id").collect()]
            found = {x["id"]: x.asDict() for x in project(b, slim.filter(F.col("id").isin(order))).collect()} if order else {}
            rows = [found[k] | {"extra": dict(sorted(found[k]["extra"].items()))} for k in order]
    finally:
        slim.unpersist()
    return {"total": total, "docs": rows, "more": 0 if r.count_only else max(0, total - len(rows)), "facets": facets, "sum": total_sum}
