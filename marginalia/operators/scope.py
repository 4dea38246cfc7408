"""Row-level access: path patterns and metadata rules as predicates applied before every read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.columns import ascii_lower


def glob_predicate(pattern: str, c: Column) -> Column:
    """* within a segment, ** across; without * the id or anything below it; '', '.' and ** are all.

    Patterns without * become an equality and a prefix, which reach the scan.  ? and [] are literals.
    """
    p = re.sub(r"^(\./|/)+", "", pattern.strip()).removesuffix(".md").rstrip("/")
    if p in ("", ".", "**"):
        return F.lit(True)
    if "*" not in p:
        return (c == p) | c.startswith(p + "/")
    rx = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}.get(x, re.escape(x)) for x in re.split(r"(\*\*/|\*\*|\*)", p))
    return c.rlike(f"(?s)^{rx}$")


def value_matches(value: Column, wanted: list[str], many: bool = False) -> Column:
    """Whether a text (or any item of a list of texts) equals a wanted one: trimmed, A-Z in any case."""
    keys = [re.sub("[A-Z]", lambda m: m.group().lower(), w.strip()) for w in wanted]
    if many:
        return F.exists(F.filter(value, lambda x: x.isNotNull()), lambda x: ascii_lower(F.trim(x)).isin(keys)) if keys else F.lit(False)
    return ascii_lower(F.trim(value)).isin(keys) if keys else F.lit(False)


@dataclass(frozen=True)
class Scope:
    """allow and deny path patterns; `within` and `without` rules on metadata: field -> values.

    A document is visible if any allow pattern (or none is given) and no deny pattern matches, every
    `within` field has one of its values (a missing field hides it), and no `without` field has one
    (a missing field keeps it).  Reserved documents obey the path rules only.
    """

    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    within: dict[str, list[str]] = field(default_factory=dict)
    without: dict[str, list[str]] = field(default_factory=dict)

    def path(self, c: Column) -> Column:
        some = reduce(lambda a, b: a | b, [glob_predicate(p, c) for p in self.allow], F.lit(False)) if self.allow else F.lit(True)
        none = reduce(lambda a, b: a | b, [glob_predicate(p, c) for p in self.deny], F.lit(False))
        return some & ~none

    def meta(self, columns: dict[str, Column]) -> Column:
        """`columns` maps field names to the lists of their values; unknown fields are missing."""
        out = F.lit(True)
        for name, wanted in self.within.items():
            out &= F.coalesce(value_matches(columns[name], wanted, many=True), F.lit(False)) if name in columns else F.lit(False)
        for name, wanted in self.without.items():
            if name in columns:
                out &= ~F.coalesce(value_matches(columns[name], wanted, many=True), F.lit(False))
        return out

    def visible(self, id_: Column, reserved: Column, columns: dict[str, Column]) -> Column:
        return self.path(id_) & (F.coalesce(reserved, F.lit(False)) | self.meta(columns))

    @property
    def restricted(self) -> bool:
        return bool(self.allow or self.deny or self.within or self.without)


EVERYTHING = Scope()
