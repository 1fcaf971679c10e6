"""Scalar expressions: coercion, periods, formats, predicates and text pieces, all built-in and code-generated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# ---- numbers ----------------------------------------------------------------------------------------------------


def number(c: Column) -> Column:
    """A finite double from text or a number: white space and thousands commas are dropped; blanks, malformed text,
    NaN and infinities are null."""
    t = F.regexp_replace(F.trim(c.cast("string")), ",", "")
    x = t.try_cast("double")
    return F.when(~t.rlike("[dDfF]$|^$") & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def whole(c: Column) -> Column:
    """An integer by truncation, as for year columns."""
    return number(c).cast("int")


def label(c: Column) -> Column:
    """The text of a group key: trimmed, blank as null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def number_of(df: DataFrame, name: str) -> Column:
    """``number`` of a column; one that is numeric already isn't turned into text first."""
    if isinstance(df.schema[name].dataType, NumericType):
        x = F.col(f"`{name}`").cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
    return number(F.col(f"`{name}`"))


def exact_sum(c: Column) -> Column:
    """A sum whose result doesn't depend on the order of rows: through decimals of four places."""
    return F.sum(c.cast("decimal(28,4)")).cast("double")


def share(part: Column, whole_: Column, digits: int = 2) -> Column:
    """Per cent of a whole; null if that is 0."""
    return F.round(100 * part / F.nullif(whole_, F.lit(0.0)), digits)


def money(c: Column) -> Column:
    """$1.23M, $4.56K, $7.89."""
    size = F.abs(c)
    return (
        F.when(size >= 1e6, F.format_string("$%.2fM", c / 1e6)).when(size >= 1e3, F.format_string("$%.1fK", c / 1e3)).otherwise(F.format_string("$%.2f", c))
    )


def plain(c: Column) -> Column:
    """Commas and no decimals from 1000 on, else at most two decimals without trailing zeros."""
    return F.when(F.abs(c) >= 1000, F.format_number(c, 0)).otherwise(F.regexp_replace(F.format_number(c, 2), r"\.?0+$", ""))


def gloss(c: Column) -> Column:
    """$1.2B, $3.4M, $5.6K; null below a thousand."""
    size = F.abs(c)
    return F.when(size >= 1e9, F.format_string("$%.1fB", c / 1e9)).when(size >= 1e6, F.format_string("$%.1fM", c / 1e6)).when(size >= 1e3, F.format_string("$%.1fK", c / 1e3))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c)


# ---- periods ----------------------------------------------------------------------------------------------------


def quarter_of(c: Column) -> Column:
    """1 to 4 from the first q1 to q4 in a label, whatever its case; else null."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"(?i)q([1-4])", 1), F.lit("")).cast("int")


def year_of(c: Column) -> Column:
    """The first four digits of a label, or the whole part of a number."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\d{4})", 1), F.lit("")).cast("int")


def period_key(c: Column) -> Column:
    """An order for period labels: years, 'Qn yyyy' or 'yyyy Qn', 'Hn yyyy', other numbers, then other text. A year
    comes before its quarters."""
    t = F.trim(c.cast("string"))
    year = F.nullif(F.regexp_extract(t, r"((?:19|20)\d\d)", 1), F.lit("")).cast("double")
    half = F.nullif(F.regexp_extract(t, r"(?i)h([12])", 1), F.lit("")).cast("double")
    part = F.coalesce(quarter_of(t).cast("double"), half * 2 - 1, F.lit(0.0))
    return F.struct(
        F.when(year.isNotNull(), 0).when(number(t).isNotNull(), 1).otherwise(2).alias("group"),
        F.coalesce(year, number(t), F.lit(0.0)).alias("year"),
        part.alias("part"),
        t.alias("text"),
    )


def age_days(at: Column, now: Column) -> Column:
    return F.floor((now.cast("double") - at.cast("double")) / 86400).cast("int")


def iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def decay(at: Column, cutoff: Column, window: Column) -> Column:
    """Linear: 0 at the cutoff, 1 a window later."""
    return (at - cutoff) / window


def sentiment(rating: Column) -> Column:
    return (rating - 3) / 2.0


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


# ---- predicates -------------------------------------------------------------------------------------------------

# Patterns that decide which path a question or a document takes.
COMPLEX = (
    r"(?i)\b(compare|contrast|difference between|differences between|walk me through|step[- ]by[- ]step|deep dive|in[- ]depth|comprehensive|explain in detail|"
    r"elaborate on|how does .{3,40} work|pros and cons|trade[- ]off|architecture of|internals of|full breakdown|everything about)\b"
)
DATA = (
    r"(?i)\b(revenue|total revenue|arr|mrr|acv|tcv|quota|attainment|how much|how many|"
    r"what is the (number|count|total|sum|amount|value|figure|balance|price|cost|rate|percentage|percent|ratio|score|metric)|"
    r"what (are|were) the (number|count|total|sum|figures|numbers|metrics|results|revenue|sales|deals|renewals|bookings|customers|accounts)|"
    r"list (all|every|the|each)|show me (all|the|every)|give me (all|the)|breakdown|"
    r"by (quarter|region|country|geography|market|segment|product|customer|account|industry|channel)|"
    r"q[1-4]\s*20\d\d|20\d\d\s*q[1-4]|fy\s*20\d\d|ytd|yoy|qoq|mom|r4q|trailing|rolling)\b"
)
OVERVIEW = r"(?i)\b(what|which) (files|documents|docs)\b|\blist (of )?(the |all )?(files|documents|docs)\b"
CONFIDENTIAL = (
    r"(?i)\b(confidential|internal use only|not for distribution|not for sharing|do not share|do not distribute|proprietary|restricted|privileged|"
    r"for internal use|sensitive|top secret)\b|\bclassification:"
)
PERSONAL_NAME = r"(?i)e-?mail|employee|phone|contact|\bowner(ship)?\b"
RATIO_NAME = r"(?i)\brrr\b|rate|ratio|percent|%|\bpct\b|margin"
MILLIONS_NAME = r"(?i)\(\s*\$\s*m\s*\)"
FORMATS = {
    "table": r"(?i)\b(as a table|in (a )?table|give me a table)\b",
    "bullets": r"(?i)\b(as bullet[- ]?points?|in bullet[- ]?points?|bullet[- ]?point|as a (bullet )?list)\b",
    "oneline": r"(?i)\b(in one sentence|as one sentence|one[- ]liner|one[- ]line|in a single sentence)\b",
    "numbered": r"(?i)\b(as a numbered list|in a numbered list|number (the |each )?(items?|points?|steps?))\b",
    "json": r"(?i)\b(as (valid )?json|in json|return (as )?json)\b",
    "paragraph": r"(?i)\b(as (prose )?paragraphs?|in paragraph)\b",
}


def is_complex(question: Column) -> Column:
    return question.rlike(COMPLEX)


def is_data(question: Column) -> Column:
    return question.rlike(DATA)


def is_overview(question: Column) -> Column:
    return question.rlike(OVERVIEW)


def format_key(question: Column) -> Column:
    """The first format whose phrase is in the question, else null."""
    return F.coalesce(*(F.when(question.rlike(p), F.lit(k)) for k, p in FORMATS.items()))


def confidential_reason(path: Column, body: Column, head: int | None = None) -> Column:
    """``path: word`` or ``body: word`` for the first sign of confidentiality, else null; ``head`` reads only so many
    characters of the body."""
    found = lambda c: F.nullif(F.lower(F.regexp_extract(c, CONFIDENTIAL, 0)), F.lit(""))
    words = F.translate(path, "_-", "  ")
    return F.coalesce(F.concat(F.lit("path: "), found(words)), F.concat(F.lit("body: "), found(F.substring(body, 1, head) if head else body)))


def effective_length(text: Column) -> Column:
    """Code points, those beyond ASCII counting three times."""
    return F.length(text) + 2 * F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))


def extraction_status(text: Column, supported: Column, thin: int = 40) -> Column:
    size = effective_length(F.trim(text))
    return F.when(~supported, "unsupported").when(text.isNull(), "failed").when(size < thin, "thin").otherwise("ok")


def confidence(sources: Column, best: Column) -> Column:
    return F.when(sources < 1, "Low").when(best >= 0.8, "High").when(best >= 0.6, "Medium").otherwise("Low")


def mentions(text: Column, keyword: Column) -> Column:
    """The keyword as a whole word, also in the plural; both sides are compared in lower case."""
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.lower(keyword), F.lit(r"\E(?:e?s)?(?![a-z0-9])"))
    return F.regexp_like(F.lower(text), quoted)


# ---- text pieces ------------------------------------------------------------------------------------------------


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_-]+", "_"), "^_+|_+$", "")


def collection_name(c: Column) -> Column:
    """3 to 63 characters of [a-zA-Z0-9_-], padded with 'x'."""
    return F.rpad(F.substring(F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_"), 1, 63), F.greatest(F.lit(3), F.least(F.length(c), F.lit(63))), F.lit("x"))


def answer_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 8)


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1F\x7F]", " "), r" {2,}", " "))


def first_sentence(c: Column, most: int = 160) -> Column:
    """Up to the first full stop, else cut at a word boundary with an ellipsis."""
    s = F.regexp_extract(c, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    t = F.when(s != "", s).otherwise(c)
    cut = F.regexp_replace(F.substring(t, 1, most), r"\s+\S*$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(cut, F.lit("…")))


def strip_footer(c: Column) -> Column:
    """Text before a rule that begins a confidence or sources footer."""
    return F.trim(F.regexp_replace(c, "(?s)\n\n---\n[\\x{1F3AF}\\x{1F4C4}].*", ""))


def trimmed_to(c: Column, budget: int) -> Column:
    """Cut at the last line end if that keeps 80 % of the budget, else hard, with an ellipsis."""
    head = F.substring(c, 1, budget)
    at = F.length(head) - F.locate("\n", F.reverse(head))
    cut = F.when((F.locate("\n", F.reverse(head)) > 0) & (at >= int(0.8 * budget)), head.substr(F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= budget, c).otherwise(F.concat(cut, F.lit("…")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if one is zero or they differ in length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(norm, F.lit(0.0)))


def ancestors(path: Column) -> Column:
    """All folders above a relative path, none of a path without folders."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))


def glob_like(path: Column, pattern: str) -> Column:
    """Shell patterns with *, ? and [sets]; * also crosses folders."""
    out = "".join({"*": ".*", "?": "."}.get(ch, ch if ch in "[]!-" or ch.isalnum() else "\\" + ch) for ch in pattern).replace("[!", "[^")
    return path.rlike(f"(?is)^{out}$")
