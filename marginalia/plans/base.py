"""What queries and their SQL share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.bundle import Bundle, from_testdata
from marginalia.functions.columns import CJK

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Unicode white space for DuckDB's patterns.
SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}".replace(r"\x{1C}-\x{1F}", "")


def norm_sql(x: str) -> str:
    """A tag's normal form."""
    t = f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
    return f"regexp_replace(regexp_replace(lower({t}), '[{SPACE}_-]+', '-', 'g'), '^-+|-+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR regexp_replace({x}, '[{SPACE}]', '', 'g') = '')"


#: The current documents (d), those that aren't reserved (n), their tags (t), the vocabulary's names (v).
BASE = f"""WITH d AS (SELECT *, text AS body FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mtime_ns DESC NULLS LAST) AS rank_ FROM docs WHERE id IS NOT NULL) WHERE rank_ = 1),
n AS (SELECT * FROM d WHERE NOT coalesce(reserved, false)),
t AS (SELECT DISTINCT doc_id, ord, tag, norm, folded FROM doc_tags WHERE NOT {blank("tag")}),
v AS (SELECT norm, min(term) AS canonical FROM (
    SELECT tag AS term, {norm_sql("name")} AS norm FROM (SELECT tag, tag AS name FROM terms UNION ALL SELECT tag, unnest(synonyms) FROM terms)) WHERE norm <> '' GROUP BY norm),
c AS (SELECT t.*, v.canonical FROM t LEFT JOIN v ON t.norm = v.norm)
"""


def query(sql: str | None = None, name: str | None = None):
    """Registers f(bundle) -> DataFrame under its name, with its SQL behind BASE if it has one."""

    def add(f: Callable[[Bundle], DataFrame]):
        key = name or f.__name__.rstrip("_")
        QUERIES[key] = lambda spark, d: f(from_testdata(spark, d))
        if sql is not None:
            ORACLE[key] = BASE.replace("WITH", "WITH RECURSIVE", 1) + sql.removeprefix("RECURSIVE ") if sql.startswith("RECURSIVE ") else BASE + sql
        return f

    return add


def plain(sql: str | None = None, name: str | None = None):
    """The same for f(spark, folder)."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__.rstrip("_")
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return add


__all__ = ["BASE", "CJK", "ORACLE", "QUERIES", "SPACE", "blank", "norm_sql", "plain", "query"]
