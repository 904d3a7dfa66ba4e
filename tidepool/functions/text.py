"""String, path and token expressions (JVM-side columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query.
STOPWORDS = [
    "a", "about", "all", "an", "and", "any", "around", "at", "been", "by", "did", "do", "does", "find", "for", "from", "had", "has", "have", "i", "in", "is", "it", "its", "last", "me", "my",
    "of", "on", "or", "remember", "show", "so", "some", "that", "the", "this", "to", "was", "were", "what", "where", "which", "with", "work",
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def index_tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits in order; null and empty texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def query_text(text: Column | str) -> Column:
    """A query for the index: characters that are neither words nor blanks become blanks, the edges are trimmed."""
    return F.trim(F.regexp_replace(_col(text), r"(?U)[^\w\s]", " "))


def query_tokens(text: Column | str) -> Column:
    """A query's tokens in order: runs of ASCII letters, digits, dots, underscores and hyphens between word boundaries."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"\b[a-zA-Z0-9._-]+\b"), 0)


def meaning_tokens(text: Column | str) -> Column:
    """Distinct [a-z0-9]+ tokens of the lower-cased text without stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    tokens = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(tokens, lambda t: ~F.array_contains(stop, t)))


def segments(path: Column | str) -> Column:
    """Non-empty parts of a path between slashes; null for a null path."""
    return F.filter(F.split(_col(path), "/"), lambda s: s != "")


def basename(path: Column | str) -> Column:
    """The last part of a path; null for a null or empty path."""
    parts = segments(path)
    return F.when(F.size(parts) > 0, F.element_at(parts, -1))


def extension(path: Column | str) -> Column:
    """.ext in lower case, or an empty text."""
    return F.lower(F.regexp_extract(_col(path), r"(\.[^./]+)$", 1))


def shared_depth(a: Column, b: Column) -> Column:
    """How many leading elements two arrays have in common."""
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.transform(F.arrays_zip(F.slice(a, 1, n).alias("x"), F.slice(b, 1, n).alias("y")), lambda z: z["x"] == z["y"]), False)
    return F.when(n <= 0, F.lit(0).cast("bigint")).when(first == 0, n.cast("bigint")).otherwise(first - 1)


def contains_any(text: Column | str, terms: list[str]) -> Column:
    """1.0 if any term stands in the text, whatever the case, else 0.0."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    hit = F.lit(False)
    for t in terms:
        hit = hit | low.contains(t.lower())
    return F.when(hit, 1.0).otherwise(0.0)


def overlap_share(current: Column, stored: Column) -> Column:
    """Part of current's tokens that stored has as well; 0 if current has none."""
    both = F.size(F.array_intersect(current, stored))
    return F.when(F.size(current) > 0, both / F.size(current)).otherwise(0.0)


def json_text(payload: Column | str, name: str) -> Column:
    """A text field of a JSON object; null where the payload is null, empty, cut off or without the field."""
    return F.nullif(F.try_variant_get(F.try_parse_json(_col(payload)), f"$.{name}", "string"), F.lit(""))


def file_slug(name: Column | str) -> Column:
    """A name that is safe in paths."""
    return F.regexp_replace(_col(name), "[^A-Za-z0-9_.-]", "_")


def glob_matches(text: Column, pattern: str) -> Column:
    """Whether a text matches a glob (* and ?), or has the pattern in it if it is none; cases don't matter."""
    low = F.lower(text)
    if not any(ch in pattern for ch in "*?"):
        return low.contains(pattern.lower())
    escaped = "".join(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not ch.isalnum() and ch != " " else ch for ch in pattern.lower())
    return low.rlike(f"(?s)^{escaped}$")
