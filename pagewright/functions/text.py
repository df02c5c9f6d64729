"""Text, number and date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of characters that are drawn twice as wide.
WIDE = r"[\u1100-\u115F\u2E80-\u2EFF\u3000-\u9FFF\uF900-\uFAFF\uFF00-\uFFEF]"


def half_even(c: Column, digits: int) -> Column:
    """Half-even rounding at so many digits, on decimals so that ties are exact."""
    return F.bround(c.cast("decimal(30,10)"), digits).cast("double")


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def pixel_width(c: Column) -> Column:
    return 7.5 * F.length(c) + 6.5 * F.length(F.regexp_replace(c, WIDE.replace("[", "[^"), ""))


def long_tokens(c: Column) -> Column:
    """Number of white-space separated tokens of more than one character."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 1))


def white_space_words(c: Column) -> Column:
    """Number of tokens between white space."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def letter_words(c: Column) -> Column:
    """Lower-cased runs of at least three letters a to z, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})"), F.lit(1))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\b[\w'-]+\b"))


def syllables(c: Column) -> Column:
    """Groups of vowels: the stated approximation of syllables."""
    return F.greatest(F.regexp_count(F.lower(c), F.lit("[aeiouy]+")), F.lit(1))


def readability_grade(c: Column) -> Column:
    words = F.greatest(F.regexp_count(c, F.lit(r"[A-Za-z']+")), F.lit(1))
    sentences = F.greatest(F.regexp_count(c, F.lit("[.!?]+")), F.lit(1))
    return half_even(0.39 * words / sentences + 11.8 * syllables(c) / words - 15.59, 1)


def reading_ease(c: Column) -> Column:
    words = F.greatest(F.regexp_count(c, F.lit(r"[A-Za-z']+")), F.lit(1))
    sentences = F.greatest(F.regexp_count(c, F.lit("[.!?]+")), F.lit(1))
    return half_even(206.835 - 1.015 * words / sentences - 84.6 * syllables(c) / words, 1)


def reading_minutes(words: Column) -> Column:
    return F.when(words <= 0, 0).otherwise(F.greatest(F.bround(words / 220, 0).cast("int"), F.lit(1)))


def escape_xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def score_band(c: Column) -> Column:
    return F.when(c >= 80, "excellent").when(c >= 50, "good").otherwise("poor")


def coerce_int(c: Column) -> Column:
    return F.bround(c.cast("string").try_cast("double"), 0).cast("long")


def coerce_float(c: Column) -> Column:
    return F.bround(c.cast("string").try_cast("double"), 4)


def parse_date_signal(c: Column) -> Column:
    """ISO-8601, a bare date, or RFC-822 with its offset; null if neither."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s*(GMT|UTC|Z)$", " +0000")
    zoned = F.when(zoned.rlike(r"[+-]\d{4}$"), zoned).otherwise(F.concat(zoned, F.lit(" +0000")))
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")))


def age_days(c: Column, as_of: str) -> Column:
    """Whole days from a timestamp to as_of."""
    return F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(c)) / 86400).cast("int")


def metric_value(c: Column) -> Column:
    """Number of a displayed metric; milliseconds become seconds. Nothing gives 0."""
    n = F.coalesce(F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))
    return F.when(F.contains(F.lower(c), F.lit("ms")), n / 1000).otherwise(n)


# Stems of the search intents, in order.
INTENTS = (("inform", "informational"), ("commerc", "commercial"), ("transact", "transactional"), ("navig", "navigational"))


def intent(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*(F.when(F.contains(low, F.lit(stem)), name) for stem, name in INTENTS), F.lit("unknown"))


# Words of tool names that are written in capitals.
ACRONYMS = tuple("ssl http og dns url gsc lcp cls fid fcp tti ttfb ctr js css cdn api id h1 h2 h3 spf dmarc mx ai ui ux".split())


def pretty_tool_name(c: Column) -> Column:
    """A tool's id as a title: words in title case, acronyms in capitals."""
    return F.array_join(F.transform(F.split(c, "_"), lambda w: F.when(w.isin(*ACRONYMS), F.upper(w)).otherwise(F.initcap(w))), " ")


def batch_key(urls: Column) -> Column:
    """16 hex digits that name a batch by its first three urls in order."""
    return F.substring(F.sha1(F.array_join(F.slice(F.sort_array(urls), 1, 3), "|")), 1, 16)


# States that are errors, and beginnings of such states.
ERROR_STATES = ("Error", "Timeout", "Other")
ERROR_PREFIXES = ("GSC Error", "Error:", "Error ", "Browser Error", "Playwright Error")


def is_error_status(c: Column) -> Column:
    hit = c.isin(*ERROR_STATES)
    for prefix in ERROR_PREFIXES:
        hit = hit | F.startswith(c, F.lit(prefix))
    return F.coalesce(hit, F.lit(False))


def csv_safe(c: Column) -> Column:
    """A quote before cells that a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^\s*[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
