"""Scalar functions as native Column expressions, and exact Arrow versions where none exists."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values ---------------------------------------------------------------------------------
CJK = "぀-ヿ㐀-䶿一-鿿\uF900-\uFAFFｦ-ﾟ"
#: Hundredths of a token.
TOKEN_NEWLINE, TOKEN_DIGIT, TOKEN_CJK, TOKEN_OTHER, TOKEN_WORD, TOKEN_MARKED = 164, 140, 51, 63, 109, 101
VIETNAMESE = "ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
TITLE_KEYS = ("title", "sidebar_label")
DESCRIPTION_KEYS = ("description", "summary", "excerpt")
TAG_KEYS = ("tags", "categories")
#: Directory names and the type they mean.
DIRECTORY_TYPES = {
    "FAQ": "faq faqs help",
    "Decision": "adr adrs decisions",
    "Tutorial": "tutorial tutorials start getting-started quickstart",
    "Guide": "guide guides howto how-to how-tos",
    "Reference": "reference references api cli",
    "Concept": "concept concepts architecture",
    "Policy": "policy policies",
    "Playbook": "sop sops runbook runbooks playbook playbooks",
    "Post": "blog posts news announcements",
    "Release Notes": "changelog releases release-notes",
    "Meeting Note": "meeting meetings minutes",
    "Spec": "spec specs rfc rfcs",
    "Install Guide": "install installation setup",
    "Troubleshooting": "troubleshooting",
}
# ---------------------------------------------------------------------------------------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"\p{IsWhite_Space}"


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, UPPER, LOWER)


def trimmed(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    t = trimmed(c)
    return F.when(t != "", t)


# -- folding -----------------------------------------------------------------------------------------


_MARKS = re.compile("[\u0300-\u036f]+")


def fold_text(s: str | None) -> str | None:
    """ASCII: lower case. Else compatibility forms, no marks U+0300-036F, đ as d, lower case, composed."""
    if s is None:
        return None
    if s.isascii():
        return s.lower()
    d = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", s))
    d = _MARKS.sub("", d).replace("đ", "d").replace("Đ", "d")
    return unicodedata.normalize("NFC", d.lower())


@lru_cache(1)
def _fold_udf():
    @F.pandas_udf(T.StringType())
    def fold_(s: pd.Series) -> pd.Series:
        return s.map(fold_text, na_action="ignore")

    return fold_


def fold(c: Column) -> Column:
    """Exact folding, in Arrow batches; null stays null."""
    return _fold_udf()(c)


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Single characters of the Latin blocks and of the full width forms, with what they fold to."""
    out = {}
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), 0x3000):
        c, f = chr(cp), fold_text(chr(cp))
        if f and len(f) == 1 and f != c and f not in "\\'":
            out[c] = f
    return "".join(out), "".join(out.values())


def fold_native(c: Column) -> Column:
    """Folding without Python: equal to `fold` on Latin text and full width forms."""
    a, b = fold_table()
    return F.translate(F.regexp_replace(F.lower(c), "[̀-ͯ]", ""), a, b)


def normalize_tag(c: Column) -> Column:
    """Trimmed, lower case, runs of white space, _ and - as one -, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(c)), rf"[{SPACE}_-]+", "-"), "^-+|-+$", "")


def question_normalize(c: Column) -> Column:
    """Folded, everything but letters and numbers as one blank."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


# -- tokens, languages -------------------------------------------------------------------------------


def token_hundredths(c: Column) -> Column:
    """The linear token estimate in exact hundredths; 0 for null."""
    open_ = F.regexp_replace(c, f"[{CJK}]", " ")
    word, marked = F.lit(r"[\p{L}\p{N}&&[^0-9]][\p{L}\p{N}]*+"), F.lit(r"[\p{L}\p{N}&&[À-ỹ]][\p{L}\p{N}]*+")
    other = F.lit(rf"[^\p{{L}}\p{{N}}{SPACE}{CJK}]")
    n = lambda p, of=c: F.regexp_count(of, p)
    total = (
        n(F.lit("\n")) * TOKEN_NEWLINE + n(F.lit("[0-9]")) * TOKEN_DIGIT + n(F.lit(f"[{CJK}]")) * TOKEN_CJK + n(other) * TOKEN_OTHER
        + n(word, open_) * TOKEN_WORD - n(marked, open_) * (TOKEN_WORD - TOKEN_MARKED)
    )
    return F.coalesce(total, F.lit(0)).cast("bigint")


def estimate_tokens(c: Column) -> Column:
    return F.floor((token_hundredths(c) + 99) / 100).cast("bigint")


def is_cjk(c: Column) -> Column:
    """Whether a text has a CJK character."""
    return F.coalesce(c.rlike(f"[{CJK}]"), F.lit(False))


def detect_lang(c: Column) -> Column:
    """CJK: ja; Vietnamese letters: vi; any other letter: en; none: null."""
    return F.when(is_cjk(c), "ja").when(F.lower(c).rlike(f"[{VIETNAMESE}]"), "vi").when(c.rlike(r"\p{L}"), "en")


# -- values ------------------------------------------------------------------------------------------


def scalar_text(variant: Column) -> Column:
    """Text of a JSON scalar; null for null, lists and objects."""
    kind = F.schema_of_variant(variant)
    return F.when(~kind.rlike("^(ARRAY|OBJECT|VOID)"), F.variant_get(variant, "$", "string"))


def as_number(variant: Column) -> Column:
    """A JSON number as a double; null for everything else, strings too."""
    return F.when(F.schema_of_variant(variant).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(variant, "$", "double"))


def number_of_text(c: Column) -> Column:
    """The number a text is, by a strict pattern (no blanks); null if none."""
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))


def is_iso_date(c: Column) -> Column:
    """YYYY-MM-DD, with anything after T, t or a blank; the digits aren't range checked."""
    return F.coalesce(c.rlike(r"(?s)^[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt ].*)?$"), F.lit(False))


def excel_date(serial: Column) -> Column:
    """ISO text of a spreadsheet's serial date, with the time if there is one; null outside 0 to 9999."""
    days = F.floor(serial).cast("int")
    seconds = F.round((serial - F.floor(serial)) * 86400).cast("bigint")
    stamp = F.timestamp_seconds(F.unix_timestamp(F.date_add(F.lit("1899-12-30").cast("date"), days).cast("timestamp")) + seconds)
    text = F.when(seconds == 0, F.date_format(stamp, "yyyy-MM-dd")).otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
    return F.when((serial >= 0) & (serial < 2958466), text)


def fmt_num(c: Column) -> Column:
    """Integral numbers without a fraction."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def numbers_in(c: Column) -> Column:
    """Distinct numbers of a text in two readings: without any separator, and as written if that is a number."""
    found = F.transform(F.regexp_extract_all(c, F.lit("([0-9][0-9.,]*)"), F.lit(1)), lambda x: F.regexp_replace(x, "[.,]+$", ""))
    whole = F.transform(found, lambda x: F.regexp_replace(x, "[.,]", "").try_cast("double"))
    written = F.transform(found, lambda x: x.try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(whole, written), lambda x: x.isNotNull())))


# -- ids ---------------------------------------------------------------------------------------------


def normalize_id(c: Column) -> Column:
    """Without leading ./ and / and without .md."""
    return F.regexp_replace(F.regexp_replace(trimmed(c), r"^(\./|/)+", ""), r"\.md$", "")


def concept_id(path: Column) -> Column:
    """The id of a path; null for paths that leave the bundle or aren't markdown."""
    p = F.regexp_replace(path, r"^(\./)+", "")
    bad = p.rlike(r"(^|/)(\.{1,2})?(/|$)|\\|^/") | ~p.endswith(".md")
    return F.when(~bad, F.regexp_replace(p, r"\.md$", ""))


def id_dir(c: Column) -> Column:
    """Everything before the last /, '' if there is none."""
    return F.when(c.contains("/"), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.when(c.isNotNull(), F.lit("")))


def id_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def is_reserved(c: Column, content_index: bool = False) -> Column:
    """index and log; with `content_index` (sites, vaults) index is content."""
    return id_name(c).isin(["log"] if content_index else ["index", "log"])


def guess_type(c: Column) -> Column:
    """Type by file name, else by the deepest directory with a known name, else Document."""
    name, parts = F.lower(id_name(c)), F.split(F.lower(c), "/")
    known = F.create_map(*[F.lit(x) for kind, names in DIRECTORY_TYPES.items() for n in names.split() for x in (n, kind)])
    kinds = F.filter(F.transform(F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))), lambda x: known[x]), lambda x: x.isNotNull())
    return (
        F.when(name.rlike("^adr[-_]"), "Decision").when((name == "faq") | name.endswith("-faq"), "FAQ").when(name.contains("changelog"), "Release Notes")
        .otherwise(F.coalesce(F.get(kinds, F.lit(0)), F.lit("Document")))
    )


def title_from_name(c: Column) -> Column:
    words = F.trim(F.translate(c, "-_", "  "))
    return F.when(words == "", c).otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000)))


def slug(c: Column) -> Column:
    """Folded, everything but letters and numbers as one -."""
    return F.regexp_replace(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def type_dir(c: Column) -> Column:
    """The plural of a type's slug."""
    s = slug(c)
    return F.when(s.rlike("(s|x|ch|sh)$"), F.concat(s, F.lit("es"))).when(s.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(s, "y$", ""), F.lit("ies"))).otherwise(F.concat(s, F.lit("s")))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


#: Inline markup with text to keep, one group for each kind: wiki links with and without another text, links and
#: images, reference links; footnotes and tags keep nothing.
INLINE = "|".join((
    r"\[\[[^\[\]|]*\|([^\[\]]+)\]\]", r"\[\[([^\[\]|#]+)(?:#[^\[\]|]*)?\]\]", r"!?\[([^\[\]^][^\[\]]*|)\]\([^()]*\)", r"\[([^\[\]^][^\[\]]*)\]\[[^\[\]]*\]", r"\[\^[^\[\]]*\]", r"<[^<>]+>",
))
EMPHASIS = r"(?:\*{1,3}|_{1,3}|~~)([^*_~]+)(?:\*{1,3}|_{1,3}|~~)"


def clean_inline(c: Column) -> Column:
    """Markdown inline syntax as plain text."""
    s = F.regexp_replace(F.regexp_replace(c, INLINE, "$1$2$3$4"), EMPHASIS, "$1")
    return F.trim(F.regexp_replace(s, rf"{SPACE}+", " "))


def first_filled(*cols: Column) -> Column:
    """The first that isn't null or blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def embed_input(title: Column, heading: Column, text: Column) -> Column:
    head = F.concat_ws(" > ", title, blank_to_null(heading))
    return F.concat(head, F.lit("\n"), text)


def prompt(template: str, c: Column) -> Column:
    """A model's prompt; {} in the template is the text."""
    a, _, b = template.partition("{}")
    return F.concat(F.lit(a), c, F.lit(b))


# -- vectors -----------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if either is null or the lengths differ."""
    sum_ = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), sum_)


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))
