"""What a collection says about itself: its vocabulary and type schemas (documents below _meta/), and the metadata of
documents that only some rules look at.  The documents of _meta/ are few; they are read on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.bundle import Bundle
from marginalia.functions import fields
from marginalia.functions.columns import scalar_text
from marginalia.operators.lint import Context

VOCABULARY = "_meta/vocabulary"
TYPES = "_meta/types/"
VOCABULARY_SCHEMA = "tag string, synonyms array<string>, facet string, description string"
#: Names of the kinds of a declared field (fixed values).
KINDS = frozenset("string text number float integer int bool boolean date datetime list array map object any".split())
#: The most documents of _meta/ that are read.
MOST = 10_000


@dataclass
class Meta:
    terms: list[tuple] = field(default_factory=list)  # VOCABULARY_SCHEMA
    vocabulary_state: str = "absent"  # or valid, invalid
    schemas: list[tuple] = field(default_factory=list)  # type, field, kind, required, allowed
    broken_schemas: list[str] = field(default_factory=list)


def _term(t) -> tuple | None:
    if isinstance(t, str):
        t = {"tag": t}
    if not isinstance(t, dict) or not isinstance(t.get("tag"), str) or not t["tag"].strip():
        return None
    synonyms = t.get("synonyms") or []
    if not isinstance(synonyms, list) or not all(isinstance(x, str) for x in synonyms):
        return None
    text = lambda k: t[k] if isinstance(t.get(k), str) else None
    return (t["tag"], synonyms, text("facet"), text("description"))


def _fields(name: str, block: dict) -> list[tuple] | None:
    """The declared fields of a schema document; None if it is wrong."""
    applies = block.get("applies_to") if isinstance(block.get("applies_to"), str) else name
    declared, out = block.get("fields") or {}, []
    if not isinstance(declared, dict):
        return None
    for key, spec in declared.items():
        spec = {"type": spec} if isinstance(spec, str) else spec
        if not isinstance(spec, dict) or str(spec.get("type", "any")).lower() not in KINDS or not isinstance(spec.get("enum", []), list):
            return None
        allowed = [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in spec.get("enum", [])]
        out.append((applies, key, str(spec.get("type", "any")).lower(), bool(spec.get("required", False)), allowed))
    return out


def read(docs: DataFrame) -> Meta:
    """Vocabulary and type schemas of documents with a metadata block; nothing where they have none."""
    out = Meta()
    if not fields.has_json(docs):
        return out
    rows = docs.filter((F.col("id") == VOCABULARY) | F.col("id").startswith(TYPES)).select("id", "path", "fm_state", "frontmatter").limit(MOST).collect()
    for r in sorted(rows, key=lambda r: r["id"]):
        block = json.loads(r["frontmatter"]) if r["fm_state"] == "valid" and r["frontmatter"] else None
        name = r["id"].rpartition("/")[2]
        if r["id"] == VOCABULARY:
            terms = (block or {}).get("terms", {} if block is not None else None)
            if isinstance(terms, dict):  # by name
                terms = [{"tag": k, **v} if isinstance(v, dict) else {"tag": k} if v is None else 0 for k, v in terms.items()]
            got = [_term(t) for t in terms] if isinstance(terms, list) else [None]
            out.vocabulary_state = "invalid" if None in got else "valid"
            out.terms = [t for t in got if t]
        elif name not in ("index", "log"):
            got = _fields(name, block) if block is not None else None
            if got is None:
                out.broken_schemas.append(r["path"])
            else:
                out.schemas += got
    return out


def vocabulary(spark: SparkSession, m: Meta) -> DataFrame:
    return spark.createDataFrame(m.terms, VOCABULARY_SCHEMA)


def supersedes(docs: DataFrame) -> DataFrame:
    """id, old: the documents that a document says it replaces; null where the field has another shape."""
    v = fields.value("supersedes")
    kind = F.schema_of_variant(v)
    each = F.when(kind == "STRING", F.array(scalar_text(v))).when(kind.startswith("ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", scalar_text(x))))
    each = F.when(kind.isNull() | (kind == "VOID"), F.array().cast("array<string>")).otherwise(F.coalesce(each, F.array(F.lit(None).cast("string"))))
    return docs.select("id", F.explode(each).alias("old")).withColumn("old", F.regexp_replace("old", r"\.md$", ""))


def generated(docs: DataFrame) -> DataFrame:
    """id, fields, verified: what a tool filled in, and whether somebody has looked at it."""
    v = fields.value("generated")
    seen = fields.value("verified")
    return docs.select("id", F.try_variant_get(v, "$.fields", "array<string>").alias("fields"), (seen.isNotNull() & ~F.coalesce(F.schema_of_variant(seen) == "VOID", F.lit(False))).alias("verified")).filter("fields is not null")


def context(b: Bundle, m: Meta | None = None, **options) -> Context:
    """All that the rules can see of a collection.  Without metadata blocks only its tables."""
    if not fields.has_json(b.docs) or "error" not in b.docs.columns:
        return Context(b, **options)
    m = m or read(b.docs)
    own = b.docs.filter(~F.coalesce("reserved", F.lit(False)))
    return Context(
        b, supersedes=supersedes(own), generated=generated(own), schemas=b.spark.createDataFrame(m.schemas, "type string, field string, kind string, required boolean, allowed array<string>") if m.schemas else None,
        parsed=b.docs.select("path", "id", "frontmatter", "fm_state", "error"), vocabulary_state=m.vocabulary_state, broken_schemas=tuple(m.broken_schemas), **options,
    )
