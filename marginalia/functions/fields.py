"""Metadata fields by name: a column of its own where the documents have one, else a key of their metadata JSON.

The column `frontmatter` holds the whole metadata block as JSON.  A field can be a scalar, a list (each item counts) or
an object or null (which count as nothing).  A missing field and an unreadable block are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import columns as C

#: Metadata fields kept as columns, beside those of every document.
EXTRA = ("department", "region", "customer", "effective_from", "effective_to", "contract_value", "currency")
COLUMNS = ("type", "status", "lang", "title", "description", "updated", *EXTRA)
#: Fields that are no "extra" of a result row (fixed values).
STANDARD_KEYS = tuple("type title description tags status lang updated aliases supersedes sources generated verified resource summary excerpt categories".split())
_NUMBERS = ("bigint", "int", "smallint", "tinyint", "double", "float")


def has_json(docs: DataFrame) -> bool:
    return "frontmatter" in docs.columns


def is_column(docs: DataFrame, name: str) -> bool:
    return name in COLUMNS and name in docs.columns


def value(name: str) -> Column:
    """The field of the metadata JSON as a variant."""
    if "'" in name or "\\" in name:  # such keys can't be written in a path
        return F.try_element_at(F.from_json("frontmatter", "map<string,variant>"), F.lit(name))
    return F.try_variant_get(F.try_parse_json("frontmatter"), f"$['{name}']", "variant")


def _list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def scalar(docs: DataFrame, name: str) -> Column:
    """The text of a scalar field; null for lists, objects and missing fields."""
    if is_column(docs, name):
        return docs[name].cast("string")
    return C.scalar_text(value(name)) if has_json(docs) else F.lit(None).cast("string")


def items(docs: DataFrame, name: str) -> Column:
    """The texts of a field: of a list all its scalar items, of a scalar itself alone; never null."""
    if is_column(docs, name) or not has_json(docs):
        return F.array_compact(F.array(scalar(docs, name)))
    v = value(name)
    each = F.when(_list(v), F.transform(F.try_variant_get(v, "$", "array<variant>"), C.scalar_text)).otherwise(F.array(C.scalar_text(v)))
    return F.coalesce(F.array_compact(each), F.array().cast("array<string>"))


def number(docs: DataFrame, name: str) -> Column:
    """The value of a numeric field; null for texts that look like numbers, too."""
    if is_column(docs, name):
        return docs[name].cast("double") if dict(docs.dtypes)[name] in _NUMBERS else F.lit(None).cast("double")
    return C.as_number(value(name)) if has_json(docs) else F.lit(None).cast("double")


def long_table(docs: DataFrame) -> DataFrame:
    """doc_id, key, idx, value_type (string, number, bool or json), value_text, value_num of every field that isn't null;
    the items of a list are numbered."""
    if has_json(docs):
        pairs = F.from_json("frontmatter", "map<string,variant>")
        x = docs.select(F.col("id").alias("doc_id"), F.explode(pairs).alias("key", "v"))
        x = x.select("doc_id", "key", F.posexplode(F.when(_list(F.col("v")), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))).alias("idx", "v"))
        kind = F.schema_of_variant("v")
        name = F.when(kind.rlike("^(ARRAY|OBJECT)"), "json").when(kind == "STRING", "string").when(kind == "BOOLEAN", "bool").otherwise("number")
        text = F.coalesce(C.scalar_text(F.col("v")), F.when(kind != "VOID", F.to_json("v")))
        return x.select("doc_id", "key", "idx", name.alias("value_type"), text.alias("value_text"), C.as_number(F.col("v")).alias("value_num")).filter("value_text is not null")
    kinds = dict(docs.dtypes)
    each = [
        F.struct(F.lit(c).alias("key"), F.lit("number" if kinds[c] in _NUMBERS else "string").alias("value_type"), docs[c].cast("string").alias("value_text"), number(docs, c).alias("value_num"))
        for c in COLUMNS if c in kinds
    ]
    x = docs.select(F.col("id").alias("doc_id"), F.explode(F.array(*each)).alias("f")).select("doc_id", "f.key", F.lit(0).alias("idx"), "f.value_type", "f.value_text", "f.value_num")
    return x.filter("value_text is not null")


def pairs(docs: DataFrame) -> Column:
    """All fields as a map of variants by key; null for an unreadable block."""
    if has_json(docs):
        return F.from_json("frontmatter", "map<string,variant>")
    return F.from_json(F.to_json(F.struct(*[docs[c] for c in COLUMNS if c in docs.columns])), "map<string,variant>")


def kind_of(v: Column) -> Column:
    """string, number, bool, list or map; null for null and a missing field."""
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "map").when(kind == "STRING", "string").when(kind == "BOOLEAN", "bool").when(kind != "VOID", "number")


def item_texts(v: Column) -> Column:
    """The texts of a value: of a list those of all its items, of anything else its own; lists and objects within, and
    nulls, as JSON."""
    text = lambda x: F.coalesce(C.scalar_text(x), F.to_json(x), F.lit("null"))
    return F.when(_list(v), F.transform(F.try_variant_get(v, "$", "array<variant>"), text)).otherwise(F.array(text(v)))


def extra(docs: DataFrame) -> Column:
    """The other scalar fields as a map, sorted by key."""
    if has_json(docs):
        pairs = F.map_entries(F.from_json("frontmatter", "map<string,variant>"))
        texts = F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), C.scalar_text(p["value"]).alias("value")))
        texts = F.filter(texts, lambda p: p["value"].isNotNull() & ~p["key"].isin(*STANDARD_KEYS))
    else:
        texts = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), docs[c].cast("string").alias("value")) for c in sorted(EXTRA) if c in docs.columns]), lambda p: p["value"].isNotNull())
    return F.coalesce(F.map_from_entries(F.array_sort(texts)), F.create_map().cast("map<string,string>"))
