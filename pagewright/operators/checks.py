"""Page checks: a registry of tool id to (status, message), fused into one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.text import age_days, half_even, long_tokens, parse_date_signal, pixel_width, readability_grade, white_space_words

Check = tuple[Column, Column]
REGISTRY: dict[str, Callable[[], Check]] = {}


def check(tool: str):
    def add(f: Callable[[], Check]) -> Callable[[], Check]:
        REGISTRY[tool] = f
        return f

    return add


def graded(fail: Column, warning: Column) -> Column:
    return F.when(fail, "fail").when(warning, "warning").otherwise("pass")


def number(c: Column) -> Column:
    return c.cast("string")


def metas(name: str, field: str = "name") -> Column:
    return F.filter("metas", lambda m: F.lower(m[field]) == name)


def meta(name: str, field: str = "name") -> Column:
    """Content of the first meta element of that name; null if there is none."""
    return F.get(metas(name, field), 0)["content"]


def header(name: str) -> Column:
    """A response header by its name in any case; null without one."""
    return F.try_element_at(F.transform_keys("headers", lambda k, v: F.lower(k)), F.lit(name))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(half_even(100.0 * part / F.nullif(whole, F.lit(0)), 1), F.lit(0.0))


def count(array: str, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(array, lambda x: F.coalesce(test(x), F.lit(False))))


@check("title")
def title() -> Check:
    n = F.length(F.coalesce("title", F.lit("")))
    return graded(n == 0, (n < 30) | (n > 60)), number(n)


@check("meta_description")
def meta_description() -> Check:
    px = F.bround(pixel_width(F.trim(F.coalesce(meta("description"), F.lit("")))), 0)
    return graded(px == 0, (px < 430) | (px > 920)), number(px.cast("int"))


@check("headings")
def headings() -> Check:
    h1, h2 = count("headings", lambda h: h["level"] == 1), count("headings", lambda h: h["level"] == 2)
    issues = F.array_compact(F.array(F.when(h1 == 0, "no H1"), F.when(h1 > 1, "several H1"), F.when(h2 == 0, "no H2")))
    return graded(h1 == 0, (h1 > 1) | (h2 == 0)), F.array_join(issues, " | ")


@check("image_alt")
def image_alt() -> Check:
    p = share(count("imgs", lambda i: i["alt"].isNull()), F.size("imgs"))
    return graded(p > 30, p > 0), number(p)


@check("word_count")
def words() -> Check:
    n = long_tokens(F.col("body_text"))
    return graded(n < 300, (n < 600) | (n > 2500)), number(n)


@check("readability")
def readability() -> Check:
    n, grade = white_space_words(F.col("body_text")), readability_grade(F.col("body_text"))
    return F.when(n < 50, "warning").otherwise(graded(grade > 14, grade > 10)), F.when(n < 50, "too little text").otherwise(number(grade))


@check("internal_links")
def internal_links() -> Check:
    """Links to the page's own host, to others, and own ones marked nofollow."""
    link = lambda a: (a["href"] != "") & ~F.startswith(a["href"], F.lit("#"))
    n = count("anchors", lambda a: link(a) & a["internal"])
    external = count("anchors", lambda a: link(a) & ~a["internal"] & F.startswith(a["href"], F.lit("http")))
    nofollow = count("anchors", lambda a: link(a) & a["internal"] & F.array_contains(F.split(a["rel"], r"\s+"), "nofollow"))
    return graded(F.lit(False), n < 3), F.concat_ws("/", *map(number, (n, external, nofollow)))


@check("schema")
def schema() -> Check:
    bad = count("ld.blocks", lambda b: ~b["valid"])
    n = F.size("ld.blocks") - bad + F.size("itemtypes")
    return graded(n == 0, bad > 0), F.concat_ws("/", number(n), number(bad))


@check("hreflang")
def hreflang() -> Check:
    """Language codes count as they are written."""
    langs = F.transform(F.filter("links", lambda x: x["hreflang"].isNotNull() & F.array_contains(F.split(x["rel"], r"\s+"), "alternate")), lambda x: x["hreflang"])
    return F.when(F.size(langs) == 0, "warning").otherwise(graded(~F.array_contains(langs, "x-default") | (F.size(langs) > F.size(F.array_distinct(langs))), F.lit(False))), F.array_join(langs, ",")


def social(prefix: str, field: str) -> Column:
    """Keys behind a prefix with their contents; the last of equal keys counts."""
    found = F.filter("metas", lambda m: F.startswith(F.lower(m[field]), F.lit(prefix)))
    pairs = F.transform(found, lambda m: F.struct(F.lower(m[field]).alias("key"), F.coalesce(m["content"], F.lit("")).alias("value")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, v: k != p["key"]), F.map_from_arrays(F.array(p["key"]), F.array(p["value"]))))


@check("og_tags")
def og_tags() -> Check:
    og, twitter = social("og:", "property"), social("twitter:", "name")
    lacks = lambda m, key: F.when(F.coalesce(F.try_element_at(m, F.lit(key)), F.lit("")) == "", key)
    missing = F.array_compact(F.array(*(lacks(og, f"og:{k}") for k in ("title", "description", "image", "url", "type")), lacks(twitter, "twitter:card")))
    return F.when(F.size(missing) == 0, "pass").when(F.size(F.map_keys(og)) >= 3, "warning").otherwise("fail"), F.array_join(missing, ",")


@check("mixed_content")
def mixed_content() -> Check:
    n = count("resources", lambda r: F.startswith(F.lower(r), F.lit("http://")))
    return F.when(~F.startswith(F.lower("url"), F.lit("https://")), "warning").otherwise(graded(n > 3, n > 0)), number(n)


@check("meta_robots")
def meta_robots() -> Check:
    rules = F.trim(F.concat_ws(" ", F.lower(F.coalesce(F.get(F.filter("metas", lambda m: m["name"] == "robots"), 0)["content"], F.lit(""))), F.lower(F.coalesce(header("x-robots-tag"), F.lit("")))))
    return graded(F.contains(rules, F.lit("noindex")), rules.rlike("nofollow|noarchive|nosnippet|noimageindex")), rules


def _icons() -> tuple[Column, Column]:
    """Whether a page declares an icon, and a touch icon, with an address."""
    named = lambda test: F.exists("links", lambda x: (F.coalesce(x["href"], F.lit("")) != "") & test(x["rel"]))
    apple = named(lambda r: F.contains(r, F.lit("apple-touch-icon")))
    icon = named(lambda r: ~F.contains(r, F.lit("apple-touch-icon")) & ((F.contains(r, F.lit("icon")) & F.contains(r, F.lit("shortcut"))) | (F.trim(r) == "icon")))
    return icon, apple


@check("favicon")
def favicon() -> Check:
    """Declared icons. A root icon without a link is a matter of the crawl log: favicon_check."""
    icon, apple = _icons()
    return graded(~icon & ~apple, ~icon | ~apple), F.concat_ws(",", F.when(icon, "icon"), F.when(apple, "apple-touch-icon"))


def favicon_check(facts: DataFrame, fetches: DataFrame) -> DataFrame:
    """The icon check with the crawl log (url, status): a page that declares no icon has that of its
    host's root, if it was fetched with 200."""
    icon, apple = _icons()
    root = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    roots = fetches.where((F.col("status") == 200) & (urls.path(F.col("url")) == "/favicon.ico") & ~F.contains("url", F.lit("?"))).select(root.alias("root")).distinct().withColumn("at_root", F.lit(True))
    rows = facts.select("url", root.alias("root"), icon.alias("icon"), apple.alias("apple")).join(roots, "root", "left")
    fallback = ~F.col("icon") & F.coalesce("at_root", F.lit(False))
    some = F.col("icon") | fallback
    found = F.concat_ws(",", F.when(F.col("icon"), "icon").when(fallback, "root icon"), F.when(F.col("apple"), "apple-touch-icon"))
    return rows.select("url", F.lit("favicon").alias("tool"), graded(~some & ~F.col("apple"), ~some | ~F.col("apple")).alias("status"), found.alias("message"))


@check("viewport")
def viewport() -> Check:
    v = F.get(metas("viewport"), 0)["content"]
    return graded(v.isNull(), ~F.contains(v, F.lit("width=device-width"))), F.coalesce(v, F.lit(""))


@check("lang_attr")
def lang_attr() -> Check:
    v = F.trim(F.coalesce("lang", F.lit("")))
    return graded(v == "", F.lit(False)), v


# Parameters of paged lists and of sessions.
PAGE_PARAMETERS = ("page", "p", "pg", "paged", "offset", "start")
SESSION_PARAMETERS = ("sid", "sessionid", "session_id", "phpsessid", "jsessionid")


@check("url_structure")
def url_structure() -> Check:
    u = F.col("url")
    slug = F.regexp_extract(urls.path(u), "([^/]*)/*$", 1)
    # a parameter without a value is none
    names = F.array_distinct(F.transform(F.filter(F.split(urls.query(u), "&"), lambda p: p.rlike("^[^=]+=.")), lambda p: F.substring_index(p, "=", 1)))
    issues = (
        (F.length(u) > 115).cast("int") + urls.path(u).rlike(r"\p{Lu}").cast("int") + (F.size(F.filter(names, lambda p: ~F.lower(p).isin(*PAGE_PARAMETERS))) > 3).cast("int")
        + F.exists(names, lambda p: F.lower(p).isin(*SESSION_PARAMETERS)).cast("int") + slug.rlike("[0-9]{8,}").cast("int") + (F.contains(slug, F.lit("_")) & ~F.contains(slug, F.lit("-"))).cast("int")
    )
    return graded(issues > 2, issues >= 1), number(issues)


@check("render_blocking")
def render_blocking() -> Check:
    """In the head, or anywhere on a page without one."""
    place = lambda x: x["in_head"] | ~F.col("has_head")
    js = count("scripts", lambda s: place(s) & s["src"].isNotNull() & ~s["deferred"])
    css = count("links", lambda x: place(x) & F.array_contains(F.split(x["rel"], r"\s+"), "stylesheet") & F.coalesce(x["media"], F.lit("")).isin("", "all"))
    return graded((js > 2) | (css > 12), (js > 0) | (css > 6)), F.concat_ws("/", number(js), number(css))


@check("image_optimization")
def image_optimization() -> Check:
    """Content images are those not hidden; lazy and modern ones count among all images."""
    n, empty = count("imgs", lambda i: ~i["hidden"]), lambda c: F.coalesce(c, F.lit("")) == ""
    lazy, first = count("imgs", lambda i: i["loading"] == "lazy"), count("imgs", lambda i: i["fetchpriority"] == "high")
    dims = count("imgs", lambda i: ~i["hidden"] & (empty(i["width"]) | empty(i["height"])))
    modern = count("imgs", lambda i: F.lower(i["src"]).rlike(r"\.webp|\.avif")) + F.col("modern_sources")
    issues = ((n > 3) & (lazy < 0.5 * n)).cast("int") + (dims > 0.3 * n).cast("int") + ((n > 3) & (modern < 0.3 * n)).cast("int") + ((n > 0) & (first == 0)).cast("int")
    return F.when(F.size("imgs") == 0, "pass").otherwise(graded(issues > 2, issues >= 1)), number(issues)


@check("canonical")
def canonical() -> Check:
    """The page's canonical link, else the one of its Link header."""
    own = F.trim(F.get(F.filter("links", lambda x: F.array_contains(F.split(x["rel"], r"\s+"), "canonical")), 0)["href"])
    sent = F.trim(F.regexp_extract(F.coalesce(header("link"), F.lit("")), r"<([^>]+)>;\s*rel=[\"']canonical[\"']", 1))
    c = F.coalesce(F.nullif(own, F.lit("")), F.nullif(sent, F.lit("")))
    return F.when(c.isNull(), "warning").when(urls.strip_slash(c) == urls.strip_slash(F.col("url")), "pass").otherwise("warning"), F.coalesce(c, F.lit(""))


@check("code_to_text_ratio")
def code_to_text_ratio() -> Check:
    p = share(F.octet_length("visible_text"), F.col("html_bytes"))
    return graded(p < 10, p < 25), number(p)


def content_freshness(as_of: str) -> Check:
    """Age of the Last-Modified header, else of the first date in the page."""
    stamp = lambda m: F.nullif(F.get(m, 0)["content"], F.lit(""))
    inside = F.coalesce(stamp(metas("article:modified_time", "property")), stamp(metas("article:published_time", "property")), F.nullif(F.get("times", 0), F.lit("")), stamp(metas("date")), stamp(metas("revised")))
    raw = F.coalesce(F.nullif(header("last-modified"), F.lit("")), inside)
    age = age_days(parse_date_signal(raw), as_of)
    return F.when(raw.isNull(), "warning").when(age.isNull() | (age <= 365), "pass").when(age <= 730, "warning").otherwise("fail"), F.coalesce(number(age), raw, F.lit(""))


# Checks of each use case; technical_seo is made up of three others.
USE_CASES = {
    "crawlability": ("robots", "http_status", "redirect", "broken_links", "internal_links", "sitemap", "canonical", "meta_robots", "hreflang", "ttfb", "url_structure", "canonical_loop"),
    "on_page": ("title", "meta_description", "headings", "image_alt", "word_count", "readability", "schema", "og_tags", "viewport", "lang_attr", "content_freshness"),
    "site_health": ("ssl", "domain_age", "mixed_content", "https_enforcement", "security_headers", "spf", "dmarc", "mx_records", "favicon", "dns_health", "www_redirect", "http2"),
    "performance": ("render_blocking", "image_optimization", "pagespeed_mobile", "pagespeed_desktop", "mobile", "gsc_crawl_inspection", "lcp", "cls", "fcp", "inp"),
    "search_console": ("clicks_impressions", "top_queries", "position_tracker", "ctr_analyzer", "coverage_errors", "sitemaps_status", "manual_actions"),
    "authority": ("backlinks", "domain_authority", "page_authority", "referring_domains", "domain_rank", "broken_backlinks", "nofollow_ratio", "spam_score"),
    "rankings": ("rank_tracker", "serp_features", "competitor", "rank_change", "traffic_share"),
    "technical_seo": ("crawlability", "on_page", "site_health"),
}


def select_checks(use_cases: list[str] | None = None, tools: list[str] | None = None) -> list[str]:
    """Check ids of use cases (all if none is named), each once; tools keeps only those named."""
    names = [n for n in use_cases or USE_CASES if n != "technical_seo"] + (list(USE_CASES["technical_seo"]) if "technical_seo" in (use_cases or ()) else [])
    found = dict.fromkeys(t for n in names for t in USE_CASES.get(n, ()))
    return [t for t in found if tools is None or t in tools]


def check_rows(facts: DataFrame, chosen: dict[str, Check]) -> DataFrame:
    """Rows (url, tool, status, message) of checks, fused into one projection."""
    return facts.select("url", F.inline(F.array(*(F.struct(F.lit(t).alias("tool"), s.alias("status"), m.alias("message")) for t, (s, m) in chosen.items()))))


def run_checks(facts: DataFrame, tools: list[str] | None = None, as_of: str | None = None) -> DataFrame:
    """Check rows (url, tool, status, message) of the chosen tools, in one pass over the facts.
    content_freshness is among them only if as_of says when ages are taken."""
    known = REGISTRY | ({"content_freshness": lambda: content_freshness(as_of)} if as_of else {})
    return check_rows(facts, {t: known[t]() for t in (known if tools is None else tools) if t in known})


def serp_preview(facts: DataFrame) -> DataFrame:
    """Title, description (that of og if there is none), displayed url, icon and length warnings."""
    title = F.coalesce("title", F.lit(""))
    about = F.trim(F.coalesce(meta("description"), meta("og:description", "property"), F.lit("")))
    crumbs = F.array_join(F.filter(F.concat(F.array(urls.netloc(F.col("url"))), F.split(urls.path(F.col("url")), "/")), lambda x: x != ""), " › ")
    icon = F.get(F.filter("links", lambda x: F.contains(x["rel"], F.lit("icon"))), 0)["href"]
    root = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.netloc(F.col("url")))
    full = F.when(F.coalesce(icon, F.lit("")) == "", F.concat(root, F.lit("/favicon.ico"))).when(icon.rlike("^https?://"), icon).otherwise(F.concat(root, F.lit("/"), F.ltrim(icon, F.lit("/"))))
    n, m = F.length(title), F.length(about)
    warnings = F.concat_ws("; ", F.when(n == 0, "no title").when(n > 60, "long title").when(n < 30, "short title"), F.when(m == 0, "no description").when(m > 160, "long description").when(m < 70, "short description"))
    return facts.select("url", title.alias("title"), n.alias("title_chars"), about.alias("description"), m.alias("description_chars"), crumbs.alias("display_url"), full.alias("icon_url"), warnings.alias("warnings"))
