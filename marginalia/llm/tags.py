"""Mapping freely written values to a canonical list, in SQL only.

Values and reference names are folded to keys (case, width, marks, look-alike letters, decorations and
separators don't count).  Every reference key is cut into k+1 segments; a value within k edits of it holds
one of them unchanged, at most k places off.  So values and references meet in one equality join on
(reference length, segment number, segment), candidates are verified with the built-in levenshtein, and
values without a verified candidate come from an anti join.

Rank of candidates: same key; abbreviated first word; then fewer edits.  A value whose best candidates
belong to several terms is too general and means none.  Defined results: null and blank values are not
mapped; null, empty and repeated synonyms are ignored; terms whose tag is null or blank don't exist.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame

from marginalia.tables import cut_lineage, run_sql, spread

NONE = "(none)"
#: Keys shorter than this allow no edits, one edit, or else two; keys of spaceless scripts allow none.
ONE_EDIT, TWO_EDITS = 6, 10

# ---- fixed values ---------------------------------------------------------------------------------
#: Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһӏкмтнвгαορνικτυ", "aeopcyxijsdhlkmthbraopviktu"))
#: Digits written for letters.
LEET_FROM, LEET_TO = "013457$@", "oieastsa"
PREFIXES = "re|fw|fwd|tag|tags|topic|label|category|keyword|type|chủ đề|chu de|nhãn|nhan|タグ|分類"
SUFFIXES = "関連|関係|社内|相关|관련"
STOP = "of|for|the|and|de|des|du"
# ---------------------------------------------------------------------------------------------------


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Characters and what they fold to, by the Unicode decompositions: full and half width forms, Latin
    letters with marks, kana with voicing marks, and look-alikes."""
    table = dict(LOOK_ALIKES)
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x3041, 0x30FF), *range(0xFF01, 0xFFEF), 0x3000):
        c = chr(cp)
        d = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
        if len(d) == 1 and d != c and d not in "\\'":
            table[c] = d
    table.update({"đ": "d", "Đ": "d", "ı": "i", "ø": "o", "ł": "l"})
    return "".join(table), "".join(table.values())


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold_sql(col: str, duck: bool = False) -> str:
    """SQL of the folded form of a value: lower case, plain width, no marks, no decorations."""
    a, b = fold_table()
    g = ", 'g'" if duck else ""
    r = "" if duck else "r"  # raw literals, so that Spark leaves the backslashes to the patterns

    def sub(x: str, pattern: str, to: str = "") -> str:
        quoted = _lit(pattern) if duck or "'" not in pattern else f'"{pattern}"'  # raw literals know no doubled quotes
        return f"regexp_replace({x}, {r}{quoted}, {_lit(to)}{g})"

    x = f"lower({col})"
    x = sub(x, "[​-‏﻿­⁠̀-゙゚ͯﾞﾟ]")
    x = f"translate({x}, {_lit(a)}, {_lit(b)})"
    x = sub(x, rf"^[\s#@*>]*(({PREFIXES})\s*[:=]\s*)+")
    x = sub(x, r"([^\s])\s*[(\[【][^)\]】]*[)\]】][\s.!?]*$", r"\1" if duck else "$1")
    x = sub(x, r"[\s/_.-]+(19|20)[0-9][0-9]\s*$")
    x = sub(x, rf"({SUFFIXES})\s*$")
    x = sub(x, r"['’`]s(\s|[-_/]|$)", " ")
    return f"trim({x})"


def words_sql(folded: str, duck: bool = False, stop: str = STOP) -> str:
    """SQL of the words of a folded value, parted by single blanks, stop words left out."""
    g = ", 'g'" if duck else ""
    r = "" if duck else "r"
    x = f"regexp_replace({folded}, {r}{_lit(r'[\s\p{P}\p{S}]+')}, '  '{g})"
    x = f"regexp_replace(concat(' ', {x}, ' '), {r}{_lit(rf' ({stop}) ')}, ' '{g})"
    return f"trim(regexp_replace({x}, {r}{_lit(r'\s+')}, ' '{g}))"


def key_sql(words: str) -> str:
    return f"replace(replace({words}, ' ', ''), 'の', '')"


_CJK = "[぀-ヿ㐀-鿿가-힣]"


def edits_sql(key: str, duck: bool = False) -> str:
    has = f"regexp_matches({key}, '{_CJK}')" if duck else f"{key} rlike '{_CJK}'"
    return f"CASE WHEN {has} OR length({key}) < {ONE_EDIT} THEN 0 WHEN length({key}) < {TWO_EDITS} THEN 1 ELSE 2 END"


REFERENCES = f"""
WITH names AS (
    SELECT tag AS term, tag AS name FROM <<terms>> WHERE trim(tag) <> ''
    UNION ALL
    SELECT tag AS term, synonym AS name FROM <<terms>> LATERAL VIEW explode(synonyms) s AS synonym WHERE trim(tag) <> '' AND trim(synonym) <> ''
), told AS (  -- without and with the stop words
    SELECT term, {words_sql(fold_sql("name"))} AS words FROM names
    UNION ALL
    SELECT term, {words_sql(fold_sql("name"), stop="-")} AS words FROM names
), turned AS (  -- the words in order, and turned by one to either side
    SELECT DISTINCT term, way, CASE way
        WHEN 0 THEN words
        WHEN 1 THEN concat(substring_index(words, ' ', -1), ' ', substr(words, 1, length(words) - length(substring_index(words, ' ', -1))))
        ELSE concat(substr(words, length(substring_index(words, ' ', 1)) + 2), ' ', substring_index(words, ' ', 1)) END AS words
    FROM told LATERAL VIEW explode(sequence(0, CASE WHEN words LIKE '% %' THEN 2 ELSE 0 END)) w AS way
)
SELECT DISTINCT term, {key_sql("words")} AS key, substring_index(trim(words), ' ', 1) AS first_word,
    {key_sql("substr(trim(words), length(substring_index(trim(words), ' ', 1)) + 2)")} AS other_words
FROM turned WHERE {key_sql("words")} <> ''
"""

SEGMENTS_OF_REFERENCES = f"""
WITH r AS (SELECT *, {edits_sql("key")} AS k FROM <<refs>>)
SELECT term, key AS ref_key, '' AS first_word, 'same' AS kind, 0 AS len, 0 AS seg, key AS part FROM r
UNION ALL
SELECT term, key, first_word, 'short', 0, 0, other_words FROM r WHERE other_words <> ''
UNION ALL
SELECT term, key, '', 'near', length(key), seg, substr(key, 1 + (seg * length(key)) div (k + 1), ((seg + 1) * length(key)) div (k + 1) - (seg * length(key)) div (k + 1))
FROM r LATERAL VIEW explode(sequence(0, k)) s AS seg WHERE k > 0
"""

#: What follows an abbreviated first word.
ABBREVIATED = "regexp_extract(f, r'^[a-z]{3,}[.] *([^.]+)$', 1)"

DISTINCT_VALUES = r"SELECT tag, count(*) AS uses FROM <<tags>> WHERE tag IS NOT NULL AND tag rlike r'[^\p{IsWhite_Space}]' GROUP BY tag"

VALUES = rf"""
WITH folded AS (SELECT tag, {fold_sql("tag")} AS f FROM <<distinct_values>>)
SELECT tag, {key_sql(words_sql("f"))} AS key,
    regexp_extract(f, r'^([a-z]{{3,}})[.] *[^.]+$', 1) AS prefix,
    {key_sql(words_sql(ABBREVIATED))} AS other_words
FROM folded
"""

# one row per way to find a value's reference, in one pass over the values; for every reference length
# within k of the value's, every segment at up to k places from where it is in the reference
_K = f"CASE WHEN len < {ONE_EDIT} THEN 0 WHEN len < {TWO_EDITS} THEN 1 ELSE 2 END"
_SIZE = f"((seg + 1) * len) div ({_K} + 1) - (seg * len) div ({_K} + 1)"
_NEAR = f"""
flatten(transform(filter(sequence(greatest(length(key) - 2, 1), length(key) + 2), len -> ({_K}) > 0 AND abs(length(key) - len) <= ({_K})), len ->
    flatten(transform(sequence(0, {_K}), seg -> transform(
        filter(sequence(-({_K}), {_K}), move -> 1 + (seg * len) div ({_K} + 1) + move >= 1 AND (seg * len) div ({_K} + 1) + move + {_SIZE} <= length(key)),
        move -> struct(key AS wanted, 'near' AS kind, len AS len, seg AS seg, substr(key, 1 + (seg * len) div ({_K} + 1) + move, {_SIZE}) AS part))))))"""
_NOTHING = "array()"
PARTS_OF_VALUES = f"""
SELECT tag, prefix, p.wanted AS key, p.kind, p.len, p.seg, p.part FROM (SELECT tag, prefix, explode(array_distinct(concat(
    array(struct(key AS wanted, 'same' AS kind, 0 AS len, 0 AS seg, key AS part)),
    CASE WHEN key rlike '[a-z]' AND key rlike '[0-9$@]' THEN array(struct(translate(key, '{LEET_FROM}', '{LEET_TO}') AS wanted, 'same' AS kind, 0 AS len, 0 AS seg, translate(key, '{LEET_FROM}', '{LEET_TO}') AS part)) ELSE {_NOTHING} END,
    CASE WHEN prefix <> '' AND other_words <> '' THEN array(struct(key AS wanted, 'short' AS kind, 0 AS len, 0 AS seg, other_words AS part)) ELSE {_NOTHING} END,
    CASE WHEN key rlike '{_CJK}' THEN {_NOTHING} ELSE {_NEAR} END))) AS p
FROM <<vals>> WHERE key <> '')
"""

MATCHES = f"""
WITH found AS (
    SELECT p.tag, r.term, CASE p.kind WHEN 'same' THEN 0 WHEN 'short' THEN 1 ELSE 1 + levenshtein(p.key, r.ref_key) END AS score,
        p.kind <> 'near' OR levenshtein(p.key, r.ref_key) <= CASE WHEN p.len < {ONE_EDIT} THEN 0 WHEN p.len < {TWO_EDITS} THEN 1 ELSE 2 END AS near
    FROM <<parts>> p JOIN <<segments>> r ON p.kind = r.kind AND p.len = r.len AND p.seg = r.seg AND p.part = r.part
    WHERE p.kind <> 'short' OR startswith(r.first_word, p.prefix)
), best AS (SELECT tag, term, min(score) AS score FROM found WHERE near GROUP BY tag, term
), least AS (SELECT tag, min(struct(score, term)) AS b, collect_set(struct(score, term)) AS all_of FROM best GROUP BY tag)
SELECT tag, b.term AS canonical, b.score AS score FROM least WHERE size(filter(all_of, x -> x.score = b.score)) = 1
"""

RESOLVED = f"""
SELECT tag, canonical, score FROM <<matches>>
UNION ALL
SELECT v.tag, '{NONE}' AS canonical, CAST(NULL AS INT) AS score FROM <<distinct_values>> v LEFT ANTI JOIN <<matches>> m ON v.tag = m.tag
"""

#: A value is frequent if it holds more than one of so many rows; so there are fewer frequent values than this.
FREQUENT = 256

# frequent values are few and are broadcast; the other rows meet the map by value, where no key has many rows; rows that
# have their meaning already are kept apart by a key of their own that no value has
APPLIED = f"""
WITH frequent AS (SELECT r.tag, r.canonical AS meant, r.score FROM <<resolved>> r JOIN <<distinct_values>> v ON r.tag = v.tag WHERE v.uses > (SELECT sum(uses) FROM <<distinct_values>>) / {FREQUENT}),
     marked AS (SELECT /*+ BROADCAST(f) */ t.*, f.meant AS known, f.score AS known_score, CASE WHEN f.tag IS NULL THEN t.tag ELSE concat(t.tag, chr(0), pmod(xxhash64(t.doc_id, t.ord), {FREQUENT})) END AS wanted
        FROM <<rows>> t LEFT JOIN frequent f ON t.tag = f.tag)
SELECT doc_id, ord, tag, stored, canonical, score FROM (
    SELECT /*+ MERGE(m) */ s.doc_id, s.ord, s.tag, s.canonical AS stored, CASE WHEN s.known IS NOT NULL THEN s.known ELSE m.canonical END AS canonical, CASE WHEN s.known IS NOT NULL THEN s.known_score ELSE m.score END AS score
    FROM marked s LEFT JOIN <<resolved>> m ON s.wanted = m.tag) WHERE canonical IS NOT NULL
"""


def _resolved(tags: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tag, canonical, score; tag, uses) of every distinct value.  Both are small beside the rows and read twice."""
    sql = run_sql
    refs = sql(REFERENCES, terms=terms.select("tag", "synonyms"))
    segments = sql(SEGMENTS_OF_REFERENCES, refs=refs)
    distinct_values = cut_lineage(sql(DISTINCT_VALUES, tags=tags.select("tag")))
    parts = sql(PARTS_OF_VALUES, vals=sql(VALUES, distinct_values=spread(distinct_values)))  # small rows, much work for each
    matches = cut_lineage(sql(MATCHES, parts=parts, segments=segments))
    return sql(RESOLVED, matches=matches, distinct_values=distinct_values), distinct_values


def resolve(tags: DataFrame, terms: DataFrame) -> DataFrame:
    """tag, canonical ('(none)' where it means no term), score (0 same key, 1 abbreviated, 1 + edits) of
    every distinct value."""
    return _resolved(tags, terms)[0]


def applied(doc_tags: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, ord, tag, stored, canonical and score of each (doc_id, ord) with a value.  Repeated rows
    count once; of different rows with one key the greatest (tag, canonical) is taken."""
    resolved, values = _resolved(doc_tags, terms)
    rows = run_sql("SELECT doc_id, ord, x.tag, x.canonical FROM (SELECT doc_id, ord, max(struct(tag, canonical)) AS x FROM <<t>> GROUP BY doc_id, ord)", t=doc_tags.select("doc_id", "ord", "tag", "canonical"))
    return run_sql(APPLIED, rows=rows, resolved=resolved, distinct_values=values)


def misplaced(doc_tags: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, ord and canonical where the stored canonical isn't what the value means."""
    return run_sql("SELECT doc_id, ord, canonical FROM <<a>> WHERE NOT (stored <=> canonical)", a=applied(doc_tags, terms))
