"""Checks of response headers: crawl log rows (url, status, final_url, headers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.text import half_even

# Security headers with their labels, headers with a meaning for search, headers to recommend.
SECURITY = (("strict-transport-security", "HSTS"), ("x-frame-options", "X-Frame-Options"), ("x-content-type-options", "X-Content-Type-Options"), ("content-security-policy", "CSP"), ("referrer-policy", "Referrer-Policy"))
RELEVANT = (
    "content-type", "x-robots-tag", "cache-control", "expires", "last-modified", "etag", "content-encoding", "vary", "link", "location", "strict-transport-security", "x-content-type-options", "server", "cf-cache-status", "age",
)
RECOMMENDED = ("cache-control", "content-encoding", "strict-transport-security", "x-content-type-options", "content-security-policy", "x-frame-options", "referrer-policy")


def lowered(headers: Column) -> Column:
    """Headers by lower-case names; of names that differ in case only, the first counts; null is none."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def value(headers: Column, name: str) -> Column:
    """A header's value by its name in any case; empty if there is none."""
    return F.coalesce(F.try_element_at(lowered(headers), F.lit(name.lower())), F.lit(""))


def link_header(headers: Column, rel: str = "canonical") -> Column:
    """Address of the first entry of the Link header with this rel; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(value(headers, "link"), rf"""<([^>]+)>;\s*rel=["']{rel}["']""", 1)), F.lit(""))


def security_headers(log: DataFrame) -> DataFrame:
    """Labels of the five security headers that are missing; two may be for a warning."""
    names = F.map_keys(lowered(F.col("headers")))
    missing = F.array_compact(F.array(*(F.when(~F.array_contains(names, h), label) for h, label in SECURITY)))
    n = F.size(missing)
    return log.select("url", F.array_join(missing, ",").alias("missing"), F.when(n == 0, "pass").when(n <= 2, "warning").otherwise("fail").alias("status"))


def compression_headers(log: DataFrame) -> DataFrame:
    """Five yes/no checks of each response and the share that passes, in percent."""
    h = F.col("headers")
    tests = {
        "compressed": ~F.lower(value(h, "content-encoding")).isin("", "none", "identity"), "cached": value(h, "cache-control") != "", "hsts": value(h, "strict-transport-security") != "",
        "conditional": (value(h, "etag") != "") | (value(h, "last-modified") != ""), "vary": value(h, "vary") != "",
    }
    passed = sum(t.cast("int") for t in tests.values())
    return log.select("url", *(t.alias(n) for n, t in tests.items()), half_even(100 * passed / len(tests), 0).cast("int").alias("score"))


def header_highlights(log: DataFrame) -> DataFrame:
    """What stands out in each response, and recommended headers that it lacks."""
    h = F.col("headers")
    robots, cache = F.lower(value(h, "x-robots-tag")), F.lower(value(h, "cache-control"))
    notes = F.array_compact(F.array(
        F.when(F.contains(robots, F.lit("noindex")), "error: noindex"), F.when(F.contains(robots, F.lit("nofollow")), "warn: nofollow"), F.when(cache == "", "warn: no cache-control"),
        F.when(F.contains(cache, F.lit("no-store")), "warn: no-store"), F.when(value(h, "content-encoding") == "", "info: no content-encoding"),
    ))
    names = F.map_keys(lowered(h))
    missing = F.array_except(F.array(*map(F.lit, RECOMMENDED)), names)
    return log.select("url", F.array_join(notes, "; ").alias("highlights"), F.array_join(missing, ",").alias("missing"))


def header_rows(log: DataFrame) -> DataFrame:
    """A row for each header: those with a meaning for search first, then by name."""
    rows = log.select("url", F.explode(F.map_entries("headers")).alias("h")).select("url", F.col("h.key").alias("name"), F.col("h.value").alias("value"), F.lower("h.key").isin(*RELEVANT).alias("relevant"))
    return rows.orderBy("url", F.col("relevant").desc(), F.lower("name"), "name")


def https_enforcement(pages: DataFrame, log: DataFrame) -> DataFrame:
    """Whether the http form of each page ends on https; error if the log lacks it."""
    plain = F.concat(F.lit("http://"), urls.netloc(F.col("url")), F.when(urls.path(F.col("url")) == "", "/").otherwise(urls.path(F.col("url"))))
    seen = log.select(F.col("url").alias("http_url"), F.coalesce("final_url", "url").alias("final_url")).dropDuplicates(["http_url"])
    j = pages.select("url", plain.alias("http_url")).join(seen, "http_url", "left")
    return j.select("url", "http_url", "final_url", F.when(F.col("final_url").isNull(), "error").when(F.startswith("final_url", F.lit("https://")), "pass").otherwise("fail").alias("status"))


def www_redirect(pages: DataFrame, log: DataFrame) -> DataFrame:
    """Whether the www twin of each page's host leads to that host (pass), or answers by itself
    (warning). A twin that was not reached, or leads elsewhere, passes."""
    host = urls.netloc(F.col("url"))
    twin = F.when(F.startswith(host, F.lit("www.")), F.substring(host, 5, 1000)).otherwise(F.concat(F.lit("www."), host))
    seen = log.select(F.col("url").alias("twin_url"), F.coalesce("final_url", "url").alias("final_url")).dropDuplicates(["twin_url"])
    rows = pages.select("url", twin.alias("twin"), F.concat(urls.scheme(F.col("url")), F.lit("://"), twin, F.lit("/")).alias("twin_url"))
    j = rows.join(seen, "twin_url", "left")
    own = F.coalesce(urls.netloc(F.col("final_url")) == F.col("twin"), F.lit(False))
    return j.select("url", "twin_url", "final_url", F.when(own, "warning").otherwise("pass").alias("status"))
