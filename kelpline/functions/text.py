"""Column functions on text: cleaning, prices, tokens, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import BRAND_ALIASES, GENERIC_MODEL, MEASURE, MISSING, NUMBER, TITLE_STOP


def is_missing(c: Column) -> Column:
    """Null, blank, or one of the texts that mean a missing value."""
    return c.isNull() | F.lower(F.trim(c)).isin(MISSING)


def clean_str(c: Column) -> Column:
    """Single blanks, trimmed; missing texts become null."""
    return F.when(~is_missing(c), F.trim(F.regexp_replace(F.translate(c, " ", " "), r"\s+", " ")))


def parse_price(c: Column) -> Column:
    """A price as double; a range counts as its middle, rounded to cents."""
    s = F.regexp_replace(c, r"[^\d.,\-]", "")
    parts = F.split(s, "-")
    number = lambda x: F.regexp_replace(x, ",", "").try_cast("double")
    middle = F.round((number(parts[0]) + number(F.try_element_at(parts, F.lit(2)))) / 2, 2)
    return F.when(is_missing(c), None).when(s.rlike(r"^[\d.,]+-[\d.,]+$"), middle).otherwise(number(s))


def norm_text(c: Column) -> Column:
    """Lower case without ASCII punctuation, single blanks; missing texts become empty."""
    bare = F.translate(F.lower(c), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    return F.when(is_missing(c), "").otherwise(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def norm_brand(c: Column) -> Column:
    """Lower case letters, digits and single blanks, aliases resolved; missing or empty becomes null."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+", " "))
    out = s
    for alias, brand in BRAND_ALIASES.items():
        out = F.when(s == alias, brand).otherwise(out)
    return F.when(~is_missing(c), F.nullif(out, F.lit("")))


def norm_modelno(c: Column) -> Column:
    """Lower case without blanks and joining signs; missing or empty becomes null."""
    return F.when(~is_missing(c), F.nullif(F.regexp_replace(F.lower(c), r"[\s\-_/.]+", ""), F.lit("")))


def generic_model_tokens(c: Column) -> Column:
    """Distinct title tokens with letters and digits that aren't measures, without joining signs."""
    found = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9][A-Za-z0-9\-/]*)"), 1)
    found = F.filter(found, lambda t: t.rlike(GENERIC_MODEL) & ~t.rlike(MEASURE))
    bare = F.transform(found, lambda t: F.regexp_replace(F.lower(t), r"[\s\-_/]+", ""))
    return F.when(is_missing(c), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(bare, lambda t: F.length(t) >= 4)))


def title_tokens(c: Column) -> Column:
    """Distinct words of a normalised title, without stop words and single letters."""
    stop = F.array(*map(F.lit, TITLE_STOP))
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def title_numbers(c: Column) -> Column:
    """Distinct numbers of a normalised title with their unit, without blanks."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({NUMBER})"), 1), lambda t: F.regexp_replace(t, r"\s", "")))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without a match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def excerpt(c: Column, pattern: str, width: int = 260) -> Column:
    """``width`` characters around the first match, with an ellipsis where text is cut off."""
    at = F.greatest(F.regexp_instr(c, F.lit(pattern)) - F.lit(width // 2), F.lit(1))
    body = F.trim(c.substr(at, F.lit(width)))
    return F.concat(F.when(at > 1, "…").otherwise(""), body, F.when(at + width - 1 < F.length(c), "…").otherwise(""))


def house_style(c: Column, banned: str) -> Column:
    """Sentences that match ``banned`` go, em dashes become commas."""
    sentences = F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: ~s.rlike(banned))
    return F.regexp_replace(F.array_join(sentences, " "), r"\s*—\s*", ", ")


def short_hash(c: Column) -> Column:
    """The first 16 hex digits of sha256, to tell visitors apart without keeping their address."""
    return F.left(F.sha2(c, 256), F.lit(16))


def escaped(c: Column, width: int = 90) -> Column:
    """Text for a report: null as empty, line feeds as blanks, cut at ``width`` characters, markup escaped."""
    flat = F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
    out = F.concat(F.substring(flat, 1, width), F.when(F.length(flat) > width, "…").otherwise(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out
