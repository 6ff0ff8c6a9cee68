"""Text, path and scoring expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """SHA-1 of the parts joined by '::'; a null part counts as empty."""
    return F.sha1(F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def content_hash(text: Column) -> Column:
    return F.sha1(text)


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def tokenize(text: Column, least: int = 2) -> Column:
    """Lower-case runs of Latin or Cyrillic letters, digits, '_', '/' and '-' of at least ``least`` characters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9а-яё_/-]{%d,}" % least), F.lit(0))


def score_text(text: Column, terms: list[str]) -> Column:
    """How many of the terms the lower-cased text holds."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(t.lower())).cast("long") for t in terms), F.lit(0).cast("long"))


def score_groups(text: Column, groups: list[list[str]]) -> Column:
    """How many groups have all their terms in the lower-cased text."""
    low = F.lower(text)
    out = F.lit(0).cast("long")
    for group in groups:
        hit = F.lit(True)
        for t in group:
            hit = hit & F.contains(low, F.lit(t.lower()))
        out = out + hit.cast("long")
    return out


def split_identifier(name: Column) -> Column:
    """Words of a camelCase, snake_case or path identifier, lower-cased."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda x: x != "")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, 20 at least."""
    return F.greatest(F.lit(20).cast("long"), F.ceil(F.length(text) / 4).cast("long"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def line_number(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based character offset."""
    return F.regexp_count(F.substring(text, F.lit(1), offset.cast("int")), F.lit("\n")) + 1


def mask_key(key: Column) -> Column:
    """First and last four characters; short keys are masked whole."""
    return F.when(F.length(key) <= 8, F.lit("****")).otherwise(F.concat(F.substring(key, 1, 4), F.lit("..."), F.substring(key, -4, 4)))


def excerpt(text: Column, terms: list[str], width: int = 280) -> Column:
    """The first trimmed line that holds a term, else the first line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    hit = F.filter(lines, lambda x: score_text(x, terms) > 0)
    return F.substring(F.coalesce(F.try_element_at(hit, F.lit(1)), F.try_element_at(lines, F.lit(1)), F.lit("")), 1, width)


def near_duplicate(a: Column, b: Column, share: float = 0.7) -> Column:
    """Whether two word sets (ASCII words of four letters or more) share at least ``share`` of the smaller one."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{4,}"), F.lit(0))) for c in (a, b))
    small = F.least(F.size(x), F.size(y))
    return (small > 0) & (F.size(F.array_intersect(x, y)) >= share * small)


def route_key(path: Column) -> Column:
    """A path without query or fragment, parameters as ':param', single slashes and no slash at the end."""
    p = F.regexp_replace(path, r"[?#].*$", "")
    p = F.regexp_replace(p, r"\$\{[^}]*\}|\{[^}]*\}|:[A-Za-z_][A-Za-z0-9_]*|(?<=/)[0-9]+(?=/|\.|$)", ":param")
    p = F.regexp_replace(p, r"/+", "/")
    return F.when(p.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(p, r"/$", ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; 0 where a norm is 0."""
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    x, y = double(a), double(b)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda p: p * p)))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)
