"""Queries on links, chains, sitemaps, robots.txt, ranks and lists of urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.operators import headers, links, redirects, robots, search
from pagewright.operators.facts import extract_facts
from pagewright.operators.places import with_place
from pagewright.plans.base import ORACLE_SQL, even, over, query
from pagewright.sources import lists
from pagewright.sources.derived import CTR_CURVE, derived, input_sql, read
from pagewright.sources.durable import durable


def made(table: str, columns: str):
    """An input of a table and expressions that both engines read: (Spark function, SQL)."""

    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, table).selectExpr(*columns.split(";"))

    return rows, f"SELECT {columns.replace(';', ', ')} FROM {table}"


# links of pages against a log of their targets

_HREFS = "a AS (SELECT url, regexp_extract_all(html, '<a (?:rel=\"nofollow\" )?href=\"([^\"]*)\"', 1) AS h FROM rich_pages), raw AS (SELECT url AS src_url, h[i] AS href, i AS nth, CASE WHEN h[i] LIKE '/%' THEN regexp_extract(url, '^(https?://[^/]*)', 1) || h[i] ELSE h[i] END AS dst_url FROM a, unnest(range(1, len(h) + 1)) AS t(i)), kept AS (SELECT *, row_number() OVER (PARTITION BY src_url ORDER BY nth) AS rn FROM raw WHERE NOT regexp_matches(href, '^(#|mailto:|tel:)'))"
_STATE = "CASE length(dst_url) % 4 WHEN 0 THEN 404 WHEN 1 THEN 301 ELSE 200 END"
_KEY = "regexp_replace(regexp_replace(dst_url, '#.*$', ''), '/+$', '')"


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of each page of any size, written once: pages are parsed once for links and targets."""
    return durable(extract_facts(derived(spark, sf_dir, "rich_pages"), None, closed_only=True, columns=("url", "anchors")).drop("headers"))


def _target_log(anchors: DataFrame) -> DataFrame:
    """A crawl log of the targets; those whose length five divides were never fetched."""
    rows = links.links_of(anchors).select("dst_url").distinct().where("length(dst_url) % 5 <> 0")
    return rows.selectExpr("dst_url AS url", f"{_STATE} AS status", f"CASE WHEN {_STATE} = 301 THEN concat(dst_url, '/moved') END AS location", "true AS is_html")


def _broken(anchors: DataFrame) -> DataFrame:
    return links.broken_links(links.links_of(anchors), _target_log(anchors))


query("broken_links_rich", over("rich_pages", sql=f", {_HREFS}, t AS (SELECT DISTINCT src_url, dst_url FROM kept) SELECT src_url, count(*) AS n_links, count(*) FILTER (length(dst_url) % 5 = 0 OR {_STATE} = 404) AS n_broken, CASE WHEN n_broken > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM t GROUP BY src_url"))(
    lambda s, d: _broken(_anchors(s, d))
)
def health_sql(name: str, pages: str, moved: str) -> str:
    """CTEs of the link report over pages; moved is the location that the log holds for a redirect."""
    return f"""WITH rich_pages AS ({pages}), {_HREFS}, k AS (SELECT src_url, {_KEY} AS href, min(dst_url) AS dst_url, min(nth) - 1 AS pos FROM raw WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)') GROUP BY src_url, {_KEY}),
f AS (SELECT *, row_number() OVER (PARTITION BY src_url ORDER BY pos) AS rn FROM k QUALIFY rn <= 60), health AS (SELECT src_url, pos::INT AS pos, href, CASE WHEN length(dst_url) % 5 <> 0 THEN {_STATE} END AS status, CASE WHEN length(dst_url) % 5 = 0 THEN 'error' WHEN {_STATE} = 404 THEN 'broken' WHEN {_STATE} = 301 AND {moved} IS NOT NULL THEN 'redirect' ELSE 'ok' END AS state FROM f)"""


_HEALTH = health_sql("rich_pages", input_sql("rich_pages"), "'x'")


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = _anchors(spark, sf_dir)
    return links.link_health(links.links_of(anchors), _target_log(anchors))


query("link_health_rich", f"{_HEALTH} SELECT * FROM health")(_health)
query("link_health_order", f"{_HEALTH} SELECT *, CASE state WHEN 'broken' THEN 1 WHEN 'redirect' THEN 2 WHEN 'error' THEN 3 ELSE 4 END::INT AS rank FROM health ORDER BY src_url, rank, pos")(lambda s, d: links.link_health_order(_health(s, d)))
query("link_health_summary", f"{_HEALTH} SELECT src_url, count(*) AS total, count(*) FILTER (state = 'broken') AS n_broken, count(*) FILTER (state = 'redirect') AS n_redirect, count(*) FILTER (state = 'error') AS n_error, count(*) FILTER (state = 'ok') AS n_ok, count(*) >= 60 AS capped FROM health GROUP BY src_url")(
    lambda s, d: links.link_health_summary(_health(s, d))
)
_KEYS = f"WITH RECURSIVE rich_pages AS (SELECT * FROM pages), {_HREFS}, e AS (SELECT DISTINCT regexp_replace(regexp_replace(src_url, '#.*$', ''), '/+$', '') AS a, {_KEY} AS b, length(dst_url) % 5 <> 0 AND {_STATE} = 200 AS good FROM kept), edges AS (SELECT a, b, good FROM e WHERE regexp_extract(a, '://([^/?#]*)', 1) = regexp_extract(b, '://([^/?#]*)', 1))"
_SEEDS = "SELECT DISTINCT regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS url, 0 AS depth FROM pages"
CRAWL = f"{_KEYS}, walk AS ({_SEEDS} UNION SELECT edges.b, walk.depth + 1 FROM walk JOIN edges ON edges.a = walk.url WHERE walk.depth < 2) SELECT url, min(depth)::INT AS depth FROM walk GROUP BY url"
query(
    "crawl_fetched",
    f"{_KEYS}, good AS (SELECT a, b FROM edges WHERE length(b) % 3 > 0), walk AS (SELECT * FROM ({_SEEDS}) WHERE length(url) % 3 > 0 UNION SELECT good.b, walk.depth + 1 FROM walk JOIN good ON good.a = walk.url WHERE walk.depth < 2), r AS (SELECT url, min(depth)::INT AS depth FROM walk GROUP BY url), p AS (SELECT *, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1) ORDER BY depth, url) AS rn FROM r) SELECT url, depth FROM p WHERE rn <= 5",
)(lambda s, d: _crawl_fetched(s, d))


def _crawl_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all pages over their links, where only what a length of no three answers with 200."""
    pages = read(spark, sf_dir, "pages")
    rows = durable(links.links_of(extract_facts(pages, closed_only=True, columns=("url", "anchors"))).select("src_url", "dst_url").distinct())
    seeds = pages.select("url")
    key = "regexp_replace(regexp_replace({}, '#.*$', ''), '/+$', '')"
    log = rows.select(F.expr(key.format("dst_url")).alias("url")).unionByName(seeds.select(F.expr(key.format("url")).alias("url"))).distinct()
    return links.crawl_from(rows, seeds, 2, log.selectExpr("url", "CASE WHEN length(url) % 3 > 0 THEN 200 ELSE 404 END AS status", "true AS is_html"), 5)


# chains

_canonicals, _CANONICALS = made("orders", "concat('https://c.example/', o_orderkey) AS url;CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN concat('https://c.example/', o_orderkey) WHEN 2 THEN concat('https://c.example/', o_orderkey - 1) WHEN 3 THEN concat('https://c.example/', o_orderkey + 1) WHEN 4 THEN concat('https://c.example/', o_orderkey - 1) WHEN 5 THEN 'https://gone.example/' ELSE concat('https://c.example/', o_orderkey - 2) END AS canonical")
query(
    "canonical_loop",
    f"""WITH RECURSIVE c AS ({_CANONICALS}), t AS (SELECT url, nullif(canonical, '') AS canonical FROM c),
w AS (SELECT url, url AS at, [url] AS seen, NULL::VARCHAR AS verdict, 0 AS k FROM t
UNION ALL SELECT w.url, CASE WHEN v IS NULL THEN t.canonical ELSE w.at END, CASE WHEN v IS NULL THEN list_append(w.seen, t.canonical) ELSE w.seen END, v, k + 1 FROM w LEFT JOIN t ON t.url = w.at, LATERAL (SELECT CASE WHEN t.url IS NULL THEN 'error' WHEN t.canonical IS NULL THEN CASE WHEN k = 0 THEN 'warning' ELSE 'pass' END WHEN t.canonical = w.at THEN CASE WHEN k = 0 THEN 'pass' ELSE 'warning' END WHEN list_contains(w.seen, t.canonical) THEN 'fail' END AS v) AS l WHERE w.verdict IS NULL AND k < 5)
SELECT url, coalesce(arg_max(verdict, k), 'warning') AS verdict, list_last(arg_max(seen, k)) AS chain_end, (len(arg_max(seen, k)) - 1)::INT AS hops FROM w GROUP BY url""",
)(lambda s, d: links.canonical_loop(_canonicals(s, d)))
_alternates, _ALTERNATES = made("orders", "concat('https://p.example/', cast(floor(o_orderkey / 4) AS bigint)) AS url;CASE o_orderkey % 4 WHEN 0 THEN 'x-default' WHEN 1 THEN 'en' WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN 'en' ELSE 'de' END ELSE 'fr' END AS lang;CASE WHEN o_custkey % 9 = 0 THEN '/fr' WHEN o_orderkey % 4 = 1 THEN concat('https://p.example/', cast(floor(o_orderkey / 4) AS bigint), '/') ELSE concat('https://t.example/', o_custkey % 50) END AS href")
_targets, _TARGETS = made("orders", "concat('https://t.example/', o_custkey % 50) AS url;cast(CASE o_custkey % 50 % 5 WHEN 0 THEN 404 WHEN 1 THEN 301 ELSE 200 END AS int) AS status;CASE WHEN o_custkey % 50 % 5 = 1 THEN 'https://t.example/new' END AS location")
query(
    "hreflang_validate",
    f"""WITH e AS ({_ALTERNATES}), f AS (SELECT DISTINCT * FROM ({_TARGETS})), j AS (SELECT e.*, f.status, coalesce(f.location, f.url) AS final, f.url IS NULL AS unknown FROM e LEFT JOIN f ON f.url = e.href),
s AS (SELECT url, count(*) AS n_entries, bool_or(lang = 'x-default') AS has_x_default, bool_or(regexp_replace(href, '/+$', '') = url) AS has_self, count(*) FILTER (NOT href LIKE 'http%') AS n_relative, count(*) FILTER (unknown OR status >= 400) AS n_unreachable, count(*) FILTER (status < 400 AND final <> href) AS n_redirecting FROM j GROUP BY url),
d AS (SELECT url, string_agg(lang, ',' ORDER BY lang) AS duplicate_langs FROM (SELECT url, lang FROM j GROUP BY url, lang HAVING count(*) > 1) GROUP BY url)
SELECT s.*, coalesce(duplicate_langs, '') AS duplicate_langs, CASE WHEN n_relative + n_unreachable > 0 OR duplicate_langs IS NOT NULL THEN 'fail' WHEN n_redirecting > 0 OR NOT has_x_default OR NOT has_self THEN 'warning' ELSE 'pass' END AS verdict FROM s LEFT JOIN d ON s.url = d.url""",
)(lambda s, d: links.hreflang_validate(_alternates(s, d), _targets(s, d)))

# crawl log

query(
    "http_status_attempts",
    over("fetch_attempts", sql=", s AS (SELECT url, coalesce(arg_min(status, attempt) FILTER (status < 500), arg_min_null(status, attempt)) AS status FROM fetch_attempts GROUP BY url) SELECT url, status, CASE WHEN status IS NULL THEN 'error' WHEN status = 200 THEN 'pass' WHEN status IN (301, 302, 307, 308) THEN 'warning' WHEN status IN (404, 410) OR status >= 500 THEN 'fail' ELSE 'warning' END AS verdict FROM s"),
)(lambda s, d: links.http_status(derived(s, d, "fetch_attempts")))

# chains over a log where a url in a hundred ends or loops back 49 hops

_long_log, _LONG_LOG = made(
    "customer",
    "concat(CASE WHEN c_custkey % 3 = 0 THEN 'http' ELSE 'https' END, '://l.example/', c_custkey) AS url;cast(CASE WHEN c_custkey % 100 = 99 AND c_custkey % 200 < 100 THEN 200 WHEN c_custkey % 7 = 0 THEN 302 ELSE 301 END AS int) AS status;"
    "CASE WHEN c_custkey % 100 < 99 THEN concat(CASE WHEN (c_custkey + 1) % 3 = 0 THEN 'http' ELSE 'https' END, '://l.example/', c_custkey + 1) WHEN c_custkey % 200 >= 100 THEN concat(CASE WHEN (c_custkey - 49) % 3 = 0 THEN 'http' ELSE 'https' END, '://l.example/', c_custkey - 49) END AS location",
)


def _report_sql(log: str) -> str:
    return f"""WITH RECURSIVE crawl_log AS ({log}), c AS (SELECT url, location AS cur, [cast(status AS VARCHAR)] AS codes, [url] AS seen, list_contains([url], location) AS loops FROM crawl_log WHERE location IS NOT NULL
UNION ALL SELECT c.url, l.location, list_append(c.codes, cast(l.status AS VARCHAR)), list_append(c.seen, c.cur), list_contains(list_append(c.seen, c.cur), l.location) FROM c JOIN crawl_log l ON l.url = c.cur WHERE l.location IS NOT NULL AND NOT c.loops),
e AS (SELECT url, arg_max(cur, len(codes)) AS final_url, max(len(codes)) AS hops, arg_max(codes, len(codes)) AS codes, arg_max(list_append(seen, cur), len(codes)) AS chain, bool_or(loops) AS is_loop FROM c GROUP BY url),
r AS (SELECT url, final_url, hops::INT AS hops, array_to_string(chain, ' > ') AS chain, array_to_string(codes, '>') AS codes, is_loop, regexp_matches(array_to_string(chain, ' > '), '(^|> )http://[^ ]* > https://') AS mixed_scheme FROM e
UNION ALL SELECT url, url, 0, url, '', false, false FROM crawl_log WHERE location IS NULL)
SELECT *, CASE WHEN is_loop OR hops >= 2 THEN 'fail' WHEN hops = 1 THEN 'warning' ELSE 'pass' END AS verdict FROM r"""


query("redirect_report", _report_sql(input_sql("crawl_log")))(lambda s, d: redirects.redirect_report(derived(s, d, "crawl_log")))
query("redirect_report_long", _report_sql(_LONG_LOG))(lambda s, d: redirects.redirect_report(_long_log(s, d)))

# headers

_LOG = (
    "concat('https://h.example/', o_orderkey) AS url;cast(200 AS int) AS status;"
    "concat_ws('|', CASE WHEN o_orderkey % 2 = 0 THEN 'Strict-Transport-Security=max-age=1' END, CASE WHEN o_orderkey % 3 = 0 THEN 'x-frame-options=DENY' END, CASE WHEN o_orderkey % 5 = 0 THEN 'X-Content-Type-Options=nosniff' END, CASE WHEN o_orderkey % 7 < 3 THEN 'Content-Security-Policy=x' END, CASE WHEN o_orderkey % 11 < 6 THEN 'Referrer-Policy=origin' END, "
    "CASE o_orderkey % 4 WHEN 0 THEN 'Cache-Control=no-store' WHEN 1 THEN 'cache-control=max-age=9' END, CASE o_orderkey % 6 WHEN 0 THEN 'Content-Encoding=gzip' WHEN 1 THEN 'content-encoding=identity' END, CASE WHEN o_orderkey % 13 = 0 THEN 'X-Robots-Tag=NoIndex, nofollow' END, CASE WHEN o_orderkey % 3 = 1 THEN 'ETag=x' END, CASE WHEN o_orderkey % 8 = 1 THEN 'Vary=Accept' END) AS raw"
)
_raw_log, _RAW_LOG = made("orders", _LOG)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first = of a header ends its name
    pairs = F.transform(F.split("raw", "[|]"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
    return _raw_log(spark, sf_dir).withColumn("headers", F.map_from_entries(F.filter(pairs, lambda p: p["key"] != ""))).drop("raw")


def _has(name: str) -> str:
    return f"contains('|' || lower(raw), '|{name}=')"


_LIST = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), '{}')"
_MISSING = _LIST.format(", ".join(f"CASE WHEN NOT {_has(h)} THEN '{label}' END" for h, label in (("strict-transport-security", "HSTS"), ("x-frame-options", "X-Frame-Options"), ("x-content-type-options", "X-Content-Type-Options"), ("content-security-policy", "CSP"), ("referrer-policy", "Referrer-Policy"))), ",")
query("security_headers", f"WITH l AS ({_RAW_LOG}), m AS (SELECT url, {_MISSING} AS missing FROM l) SELECT url, missing, CASE WHEN missing = '' THEN 'pass' WHEN len(string_split(missing, ',')) <= 2 THEN 'warning' ELSE 'fail' END AS status FROM m")(lambda s, d: headers.security_headers(_log(s, d)))
_COMPRESSED = "contains('|' || lower(raw), '|content-encoding=gzip')"
query(
    "compression_headers",
    f"WITH l AS ({_RAW_LOG}), c AS (SELECT url, {_COMPRESSED} AS compressed, {_has('cache-control')} AS cached, {_has('strict-transport-security')} AS hsts, {_has('etag')} AS conditional, {_has('vary')} AS vary FROM l) SELECT *, (20 * (compressed::INT + cached::INT + hsts::INT + conditional::INT + vary::INT))::INT AS score FROM c",
)(lambda s, d: headers.compression_headers(_log(s, d)))
_NOTES = _LIST.format("CASE WHEN contains(lower(raw), 'noindex') THEN 'error: noindex' END, CASE WHEN contains(lower(raw), 'nofollow') THEN 'warn: nofollow' END, CASE WHEN NOT " + _has("cache-control") + " THEN 'warn: no cache-control' END, CASE WHEN contains(raw, 'no-store') THEN 'warn: no-store' END, CASE WHEN NOT " + _has("content-encoding") + " THEN 'info: no content-encoding' END", "; ")
_RECOMMENDED = _LIST.format(", ".join(f"CASE WHEN NOT {_has(h)} THEN '{h}' END" for h in ("cache-control", "content-encoding", "strict-transport-security", "x-content-type-options", "content-security-policy", "x-frame-options", "referrer-policy")), ",")
query("header_highlights", f"WITH l AS ({_RAW_LOG}) SELECT url, {_NOTES} AS highlights, {_RECOMMENDED} AS missing FROM l")(lambda s, d: headers.header_highlights(_log(s, d)))
query("header_rows", f"WITH l AS ({_RAW_LOG}), r AS (SELECT url, unnest(string_split(raw, '|')) AS x FROM l WHERE raw <> '') SELECT url, string_split(x, '=')[1] AS name, regexp_replace(x, '^[^=]*=', '') AS value, lower(string_split(x, '=')[1]) IN ('strict-transport-security', 'x-content-type-options', 'cache-control', 'content-encoding', 'x-robots-tag', 'etag', 'vary') AS relevant FROM r")(
    lambda s, d: headers.header_rows(_log(s, d))
)
_http, _HTTP = made("pages", "concat('http://', regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END) AS url;CASE WHEN page_id % 3 = 0 THEN concat('https://', regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '/') END AS final_url;page_id")
query("https_enforcement", f"WITH l AS (SELECT url, coalesce(any_value(final_url), url) AS final_url FROM ({_HTTP}) WHERE page_id % 4 <> 1 GROUP BY url) SELECT p.url, h.url AS http_url, l.final_url, CASE WHEN l.url IS NULL THEN 'error' WHEN l.final_url LIKE 'https://%' THEN 'pass' ELSE 'fail' END AS status FROM pages p JOIN ({_HTTP}) h ON h.page_id = p.page_id LEFT JOIN l ON l.url = h.url")(
    lambda s, d: headers.https_enforcement(read(s, d, "pages"), _http(s, d).where("page_id % 4 <> 1").groupBy("url").agg(F.max("final_url").alias("final_url")))
)
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_TWIN = f"CASE WHEN {_HOST} LIKE 'www.%' THEN substring({_HOST}, 5) ELSE concat('www.', {_HOST}) END"
_twins, _TWINS = made("pages", f"concat(regexp_extract(url, '^([a-z]+)://', 1), '://', {_TWIN}, '/') AS url;CASE WHEN length({_HOST}) % 2 = 0 THEN url END AS final_url;length({_HOST}) AS n")
query("www_redirect", f"WITH l AS (SELECT url, coalesce(max(final_url), url) AS final_url FROM ({_TWINS}) WHERE n % 3 > 0 GROUP BY url), p AS (SELECT url, {_TWIN} AS twin, concat(regexp_extract(url, '^([a-z]+)://', 1), '://', {_TWIN}, '/') AS twin_url FROM pages) SELECT p.url, p.twin_url, l.final_url, CASE WHEN regexp_extract(l.final_url, '://([^/?#]*)', 1) = twin THEN 'warning' ELSE 'pass' END AS status FROM p LEFT JOIN l ON l.url = p.twin_url")(
    lambda s, d: headers.www_redirect(read(s, d, "pages"), _twins(s, d).where("n % 3 > 0").groupBy("url").agg(F.max("final_url").alias("final_url")))
)

# robots.txt

_robots, _ROBOTS = made(
    "customer",
    "concat('h', c_custkey, '.example') AS host;cast(CASE c_custkey % 10 WHEN 8 THEN 404 WHEN 9 THEN 500 ELSE 200 END AS int) AS status;"
    "concat('# c', chr(10), 'User-agent: *', chr(10), CASE c_custkey % 5 WHEN 0 THEN concat('Disallow: /', chr(10)) WHEN 1 THEN concat('Disallow: /a', chr(10), 'Allow: /a/b', chr(10)) WHEN 2 THEN concat('Allow: /a/b', chr(10), 'Disallow: /a', chr(10)) WHEN 3 THEN concat('Disallow:', chr(10)) ELSE '' END, "
    "CASE c_custkey % 3 WHEN 0 THEN concat('Crawl-delay: ', c_custkey % 20, chr(10)) WHEN 1 THEN concat('Crawl-delay: soon', chr(10)) ELSE '' END, CASE WHEN c_custkey % 4 = 0 THEN concat('User-agent: Googlebot', chr(10), 'Disallow: /', CASE WHEN c_custkey % 8 = 0 THEN 'a' ELSE '' END, chr(10)) ELSE '' END, CASE c_custkey % 6 WHEN 0 THEN 'Sitemap: https://x.example/s.xml' WHEN 1 THEN 'Sitemap: ftp://x.example/s.xml' ELSE '' END) AS body",
)
_visits, _VISITS = made("customer", "concat('https://h', c_custkey, '.example', CASE c_custkey % 4 WHEN 0 THEN '/a/b/c' WHEN 1 THEN '/a?x=1' WHEN 2 THEN '' ELSE '/z' END) AS url;c_custkey AS k")
_SETS = "k % 4 AS p, k % 5 AS r, k % 10 < 8 AS has"
_STAR = "NOT has OR CASE WHEN r = 4 AND k % 3 = 2 AND k % 4 = 0 THEN k % 8 <> 4 AND k % 8 <> 0 ELSE CASE r WHEN 0 THEN false WHEN 1 THEN p > 1 WHEN 2 THEN p <> 1 ELSE true END END"
_BOT = f"CASE WHEN has AND k % 4 = 0 THEN k % 8 <> 4 AND (k % 8 <> 0 OR p > 1) ELSE {_STAR} END"
query("robots_allowed", f"WITH v AS (SELECT *, {_SETS} FROM ({_VISITS})) SELECT url, {_STAR} AS allowed FROM v")(lambda s, d: robots.robots_allowed(_visits(s, d).select("url"), robots.robots_rules(robots.robots_lines(_robots(s, d).where("status = 200")))))
query(
    "robots_check",
    f"WITH v AS (SELECT *, {_SETS} FROM ({_VISITS})), w AS (SELECT url, k, {_STAR} AS allowed, {_BOT} AS googlebot, CASE WHEN has AND k % 3 = 0 THEN (k % 20)::VARCHAR WHEN has AND k % 3 = 1 THEN 'soon' END AS crawl_delay FROM v) SELECT url, allowed, googlebot, crawl_delay, CASE WHEN k % 10 = 9 THEN 'warning' WHEN allowed AND googlebot THEN 'pass' ELSE 'fail' END AS status FROM w",
)(lambda s, d: robots.robots_check(_visits(s, d).select("url"), _robots(s, d)))
# a delay line ends a block like a rule; without any rule, a following agent shares the block
_SHARED = "(r = 4 AND k % 3 = 2)"
_STAR_BLOCKED = f"(r = 0 OR ({_SHARED} AND k % 8 = 4))"
_ROBOT_ISSUES = f"""WITH c AS (SELECT c_custkey AS k, c_custkey % 5 AS r, concat('h', c_custkey, '.example') AS host FROM customer),
issues AS (SELECT host, 'error' AS level, 'all crawlers blocked' AS issue, '' AS detail FROM c WHERE {_STAR_BLOCKED} UNION ALL SELECT host, 'error', 'main crawler blocked', 'Googlebot' FROM c WHERE k % 8 = 4
UNION ALL SELECT host, 'warning', 'no sitemap', '' FROM c WHERE k % 6 > 1 UNION ALL SELECT host, 'warning', 'long crawl delay', (k % 20)::VARCHAR FROM c WHERE k % 3 = 0 AND k % 20 > 10 UNION ALL SELECT host, 'warning', 'invalid crawl delay', 'soon' FROM c WHERE k % 3 = 1
UNION ALL SELECT host, 'info', 'empty disallow', '*' FROM c WHERE r = 3 UNION ALL SELECT host, 'error', 'bad sitemap address', 'ftp://x.example/s.xml' FROM c WHERE k % 6 = 1)"""


def _robot_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.robots_issues(robots.robots_lines(_robots(spark, sf_dir)))


_VERDICTS = "count(*) FILTER (level = 'error') AS n_errors, count(*) FILTER (level = 'warning') AS n_warnings, CASE WHEN count(*) FILTER (level = 'error') > 0 THEN 'fail' WHEN count(*) FILTER (level = 'warning') > 0 THEN 'warning' ELSE 'pass' END AS verdict"
query("robots_issues", f"{_ROBOT_ISSUES} SELECT * FROM issues")(_robot_issues)
query("robots_audit", f"{_ROBOT_ISSUES} SELECT c.host, {_VERDICTS} FROM c LEFT JOIN issues ON c.host = issues.host GROUP BY c.host")(lambda s, d: robots.robots_audit(robots.robots_lines(_robots(s, d))))

# sitemaps

_SM_KEY = "regexp_replace(lower(regexp_replace(loc, '/+$', '')), '^https?://', '')"
_SM = f""", k AS (SELECT *, {_SM_KEY} AS key FROM sitemap_urls), s AS (SELECT sitemap_url, count(*) AS total, count(*) FILTER (sitemap_url LIKE 'https:%' AND starts_with(loc, 'http://')) AS http_urls, count(*) FILTER (loc LIKE '%?%' OR loc LIKE '%.pdf') AS non_indexable, count(*) - count(DISTINCT key) AS duplicates, count(*) FILTER (lastmod = 'not-a-date') AS invalid_lastmod FROM k GROUP BY sitemap_url)"""
query("sitemap_issues", over("sitemap_urls", sql=f"{_SM}, v AS (SELECT regexp_extract(sitemap_url, '://([^/]*)', 1) AS host, unnest([{{'i': 'http in https', 'n': http_urls}}, {{'i': 'not indexable', 'n': non_indexable}}, {{'i': 'duplicates', 'n': duplicates}}, {{'i': 'invalid lastmod', 'n': invalid_lastmod}}]) AS x FROM s) SELECT host, 'warning' AS level, x.i AS issue, x.n::VARCHAR AS detail FROM v WHERE x.n > 0"))(
    lambda s, d: links.sitemap_issues(links.sitemap_audit(derived(s, d, "sitemap_urls")), limits=False)  # the SQL asks for issues of entries
)
query("sitemap_validate", over("sitemap_urls", sql=" SELECT sitemap_url, count(*) AS total, count(*) - count(DISTINCT loc) AS duplicates, count(*) FILTER (starts_with(loc, 'http://')) AS http_urls, CASE WHEN count(*) > count(DISTINCT loc) OR count(*) FILTER (starts_with(loc, 'http://')) > 0 OR count(*) > 50000 THEN 'fail' ELSE 'pass' END AS verdict FROM sitemap_urls GROUP BY sitemap_url"))(
    lambda s, d: links.sitemap_validate(derived(s, d, "sitemap_urls"))
)
query("crawl_issues", f"{_ROBOT_ISSUES}, rows AS (SELECT host, level, issue, detail, 'robots' AS source FROM issues WHERE level <> 'info' UNION ALL SELECT host, 'error', 'not readable', '', 'sitemap' FROM c WHERE k % 7 = 0) SELECT host, {_VERDICTS} FROM rows GROUP BY host")(
    lambda s, d: robots.issue_verdicts(robots.crawl_issues(_robot_issues(s, d), _robot_issues(s, d).limit(0), _visits(s, d).where("k % 7 = 0").selectExpr("concat('h', k, '.example') AS host", "'sitemap' AS source")))
)

# ranks

_DOMAINS = "(SELECT DISTINCT 'site' || (p_size % 9) || '.example' AS domain FROM part)"
_RANKS = f", g AS (SELECT g.domain, k.keyword, min(s.rank) AS rank FROM {_DOMAINS} g CROSS JOIN (SELECT DISTINCT keyword FROM serp) k LEFT JOIN serp s ON s.keyword = k.keyword AND contains(s.link, g.domain) GROUP BY ALL), ranks AS (SELECT *, coalesce(rank <= 10, false) AS in_top_10, coalesce(rank <= 3, false) AS in_top_3 FROM g)"


def _ranked_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("concat('site', p_size % 9, '.example') AS domain").distinct()


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.rank_tracker(derived(spark, sf_dir, "serp"), _ranked_domains(spark, sf_dir))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change against an earlier run made of the same ranks, which are found once. Pairs without a rank have no change and are not made."""
    ranks = durable(links.best_ranks(derived(spark, sf_dir, "serp"), _ranked_domains(spark, sf_dir)))
    return links.rank_change(ranks, ranks.withColumn("rank", F.expr("CASE WHEN length(keyword) % 2 = 0 THEN 1 + (rank * 7) % 13 ELSE rank END")))


query("rank_tracker", over("serp", sql=f"{_RANKS} SELECT * FROM ranks"))(_ranks)
query("rank_summary", over("serp", sql=f"{_RANKS} SELECT domain, count(*) AS keywords, count(rank) AS ranked, count(*) FILTER (in_top_10) AS top_10, count(*) FILTER (in_top_3) AS top_3, CASE WHEN count(*) FILTER (in_top_10) > 0 THEN 'pass' WHEN count(rank) > 0 THEN 'warning' ELSE 'fail' END AS verdict FROM ranks GROUP BY domain"))(lambda s, d: links.rank_summary(_ranks(s, d)))
_CHANGE = f"{_RANKS}, change AS (SELECT domain, keyword, rank, CASE WHEN length(keyword) % 2 = 0 THEN 1 + (rank * 7) % 13 ELSE rank END AS was, was - rank AS delta FROM ranks WHERE rank IS NOT NULL)"
query("rank_change", over("serp", sql=f"{_CHANGE} SELECT domain, keyword, rank, was, delta FROM change"))(_changes)
query("rank_change_summary", over("serp", sql=f"{_CHANGE} SELECT domain, count(*) AS compared, count(*) FILTER (delta > 0) AS improved, count(*) FILTER (delta < 0) AS declined, CASE WHEN count(*) FILTER (delta > 0) >= count(*) FILTER (delta < 0) THEN 'pass' ELSE 'warning' END AS verdict FROM change GROUP BY domain"))(
    lambda s, d: links.rank_change_summary(_changes(s, d))
)
_CURVE = "CASE rank " + " ".join(f"WHEN {k} THEN {v}" for k, v in CTR_CURVE.items()) + " END"
query("traffic_share", over("serp", sql=f"{_RANKS}, t AS (SELECT domain, count(*) AS keywords, {even(f'avg({_CURVE})', 1)} AS avg_ctr FROM ranks WHERE rank <= 10 GROUP BY domain) SELECT *, CASE WHEN avg_ctr >= 10 THEN 'pass' WHEN avg_ctr >= 5 THEN 'warning' ELSE 'fail' END AS verdict FROM t"))(lambda s, d: links.traffic_share(_ranks(s, d)))
query("competitor_rows", over("serp", sql=" SELECT keyword, rank, regexp_extract(link, '://([^/]*)', 1) AS host, link, regexp_extract(link, '://([^/]*)', 1) = 'www.site3.example' AS is_you FROM serp WHERE rank <= 10"))(lambda s, d: links.competitor_rows(derived(s, d, "serp"), "www.site3.example"))
_checked, _CHECKED = made("supplier", "concat('http://SITE', s_suppkey % 12, '.example/', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '/?x=1' ELSE '' END) AS url")
query("serp_index_match", over("serp", sql=f", p AS ({_CHECKED}) SELECT url, CASE WHEN regexp_replace(regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '^(https?://)?(www\\.)?', ''), '/+$', '') IN (SELECT regexp_replace(lower(link), '^https?://(www\\.)?', '') FROM serp) THEN 'Indexed' ELSE 'Not Indexed' END AS status FROM p"))(lambda s, d: links.serp_index_match(derived(s, d, "serp"), _checked(s, d)))

# backlinks

_back, _BACK = made("orders", "concat('https://www.ref', o_orderkey % (3 + o_custkey % 60), '.example/', o_orderkey) AS src_url;concat('https://www.target', o_custkey % 40, '.example/', o_custkey) AS dst_url;CASE WHEN o_orderkey % (2 + o_custkey % 5) = 0 THEN 'nofollow' ELSE '' END AS rel")
_back_log, _BACK_LOG = made("customer", "concat('https://www.target', c_custkey % 40, '.example/', c_custkey) AS url;cast(CASE WHEN c_custkey % 40 > 2 AND c_custkey % 7 = 0 THEN 404 ELSE 200 END AS int) AS status")
_DOMAIN = "regexp_replace(regexp_extract({}, '://([^/]*)', 1), '^www\\.', '')"
query(
    "backlink_domains",
    f"WITH b AS (SELECT {_DOMAIN.format('dst_url')} AS domain, {_DOMAIN.format('src_url')} AS ref, rel FROM ({_BACK})), s AS (SELECT domain, count(*) AS backlinks, count(DISTINCT ref) AS referring_domains, {even('100.0 * count(*) FILTER (rel = ' + chr(39) * 2 + ') / count(*)', 1)} AS dofollow FROM b GROUP BY domain) "
    "SELECT *, CASE WHEN backlinks > 100 THEN 'pass' WHEN backlinks > 10 THEN 'warning' ELSE 'fail' END AS backlinks_verdict, CASE WHEN referring_domains >= 50 THEN 'pass' WHEN referring_domains >= 10 THEN 'warning' ELSE 'fail' END AS domains_verdict, CASE WHEN dofollow >= 70 THEN 'pass' WHEN dofollow >= 50 THEN 'warning' ELSE 'fail' END AS dofollow_verdict FROM s",
)(lambda s, d: links.backlink_summary(_back(s, d)))
query("broken_backlinks", f"WITH b AS (SELECT {_DOMAIN.format('dst_url')} AS domain, dst_url FROM ({_BACK})), s AS (SELECT domain, count(*) AS backlinks, count(*) FILTER (status IS NULL OR status IN (400, 403, 404, 410)) AS broken FROM b LEFT JOIN ({_BACK_LOG}) l ON l.url = b.dst_url GROUP BY domain) SELECT *, CASE WHEN broken = 0 THEN 'pass' WHEN broken <= 10 THEN 'warning' ELSE 'fail' END AS verdict FROM s")(
    lambda s, d: links.broken_backlinks(_back(s, d), _back_log(s, d))
)

_back_days, _BACK_DAYS = made("orders", "concat('https://www.ref', o_orderkey % (3 + o_custkey % 60), '.example/', o_orderkey) AS src_url;concat('https://www.target', o_custkey % 40, '.example/', o_custkey) AS dst_url;CASE WHEN o_orderkey % (2 + o_custkey % 5) = 0 THEN 'nofollow' ELSE '' END AS rel;cast(o_orderdate AS date) AS day")
query("backlink_rollup", ORACLE_SQL["backlink_domains"])(lambda s, d: links.backlink_rollup(links.backlink_days(_back_days(s, d))))

# sitemaps of the supplied keys: indexes of indexes, loops among them, broken and plain bodies

_maps, _MAPS = made(
    "customer",
    "concat('https://s.example/', c_custkey) AS sitemap_url;CASE WHEN c_custkey % 4 = 0 THEN concat('<sitemapindex><sitemap><loc>https://s.example/', c_custkey + 4, '</loc></sitemap><sitemap><loc> https://s.example/', c_custkey * 2, ' </loc></sitemap><sitemap><loc>https://s.example/', c_custkey - 12, '</loc></sitemap></sitemapindex>') "
    "WHEN c_custkey % 4 = 1 THEN concat('<urlset><url><loc>https://a.example/', c_custkey, '</loc><lastmod>2026-01-01</lastmod></url><url><loc><![CDATA[https://a.example/?x=', c_custkey, ']]></loc><priority>0.5</priority></url></urlset>') "
    "WHEN c_custkey % 4 = 2 THEN concat('<urlset><url><loc>https://b.example/', c_custkey, '</loc><url><loc>ftp://b.example/</loc></url><url><loc>https://b.example/2</loc><changefreq>daily</changefreq>') END AS body",
)
_roots, _ROOTS = made("customer", "concat('https://s.example/', c_custkey * 16) AS url")
query(
    "parse_sitemaps",
    f"""WITH m AS ({_MAPS}), i AS (SELECT sitemap_url, string_split_regex(body, '<(url|sitemap)>') AS parts FROM m WHERE body IS NOT NULL), e AS (SELECT sitemap_url, k - 2 AS pos, replace(replace(parts[k], '<![CDATA[', ''), ']]>', '') AS item FROM i, unnest(range(2, len(parts) + 1)) AS t(k))
SELECT sitemap_url, pos::INT AS pos, {", ".join(f"nullif(trim(regexp_extract(item, '<{n}>([^<]*)</{n}>', 1)), '') AS {n}" for n in ("loc", "lastmod", "changefreq", "priority"))} FROM e WHERE regexp_matches(trim(regexp_extract(item, '<loc>([^<]*)</loc>', 1)), '^https?://')""",
)(lambda s, d: links.parse_sitemaps(_maps(s, d)))
query(
    "expand_sitemap_index",
    f"""WITH RECURSIVE e AS (SELECT c_custkey AS k, unnest([c_custkey + 4, c_custkey * 2, c_custkey - 12]) AS child FROM customer WHERE c_custkey % 4 = 0),
w AS (SELECT DISTINCT c_custkey * 16 AS k, 0 AS depth FROM customer UNION SELECT e.child, w.depth + 1 FROM w JOIN e ON e.k = w.k WHERE w.depth < 5) SELECT 'https://s.example/' || k AS url, min(depth)::INT AS depth FROM w GROUP BY k""",
)(lambda s, d: links.expand_sitemap_index(_maps(s, d), _roots(s, d)))

# search rows that straddle the real thresholds, and denser logs

_SUMS = "s AS (SELECT page, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, 100.0 * sum(clicks) / sum(impressions) AS c, sum(position * impressions) / sum(impressions) AS p FROM mixed_search_rows GROUP BY page)"
_ROUNDED = f"clicks, impressions, {even('c', 2)} AS ctr, {even('p', 1)} AS position"
_LOW = f", {_SUMS} SELECT page, {_ROUNDED} FROM s WHERE impressions >= 100 AND c < 2 AND p <= 20"
_PLACE = f"least(greatest({even('p', 0)}::INT, 1), 10)"
_BENCHMARK = f"CASE {_PLACE} " + " ".join(f"WHEN {k} THEN {v}" for k, v in CTR_CURVE.items()) + " END"
_CHANCES = f", {_SUMS}, o AS (SELECT *, ({_BENCHMARK})::DOUBLE AS benchmark_ctr FROM s WHERE impressions >= 200 AND c < 3 AND p <= 20) SELECT page, {_ROUNDED}, benchmark_ctr, greatest({even('(benchmark_ctr - c) / 100 * impressions', 0)}, 0)::BIGINT AS extra_clicks, CASE WHEN p <= 3 THEN 'rewrite title' WHEN p <= 10 THEN 'improve snippet' ELSE 'strengthen content' END AS action FROM o"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "mixed_search_rows")


query("low_ctr_pages", over("mixed_search_rows", sql=_LOW))(lambda s, d: search.low_ctr(_mixed(s, d)))
query("top_low_ctr_pages", over("mixed_search_rows", sql=_LOW + " ORDER BY impressions DESC, page LIMIT 50"))(lambda s, d: search.top(search.low_ctr(_mixed(s, d)), 50, F.col("impressions").desc(), F.col("page")))
query("opportunities", over("mixed_search_rows", sql=_CHANCES))(lambda s, d: search.opportunity_pages(_mixed(s, d)))
query("top_opportunity_pages", over("mixed_search_rows", sql=_CHANCES + " ORDER BY impressions DESC, page LIMIT 100"))(lambda s, d: search.top(search.opportunity_pages(_mixed(s, d)), 100, F.col("impressions").desc(), F.col("page")))
query("site_performance", over("search_rows", sql=f", s AS (SELECT site, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, 100.0 * sum(clicks) / sum(impressions) AS c, sum(position * impressions) / sum(impressions) AS p FROM search_rows WHERE date > DATE '1995-03-01' - 30 AND date <= DATE '1995-03-01' GROUP BY site) SELECT site, {_ROUNDED}, CASE WHEN clicks > 0 THEN 'pass' ELSE 'warning' END AS status FROM s"))(
    lambda s, d: search.site_performance(derived(s, d, "search_rows"), "1995-03-01")
)
# lists of urls

_list, _LIST_ROWS = made("orders", "cast(o_orderkey AS bigint) AS pos;CASE o_orderkey % 6 WHEN 0 THEN concat(' https://u.example/', o_custkey, ' ') WHEN 1 THEN 'http://localhost/x' WHEN 2 THEN 'http://10.1.2.3/' WHEN 3 THEN 'not a url' ELSE concat('https://u.example/', o_custkey) END AS url")
_other, _OTHER = made("customer", "cast(c_custkey AS bigint) AS pos;concat('https://u.example/', c_custkey * 2) AS url")
_UNION = f"WITH u AS (SELECT 0 AS source, * FROM ({_LIST_ROWS}) UNION ALL SELECT 1, * FROM ({_OTHER}))"
_CLEAN = f"{_UNION}, c AS (SELECT trim(url) AS url, source, pos, row_number() OVER (PARTITION BY trim(url) ORDER BY source, pos) AS rn FROM u WHERE trim(url) LIKE 'https://u.example/%'), clean AS (SELECT url, source, pos FROM c WHERE rn = 1)"


def _united(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.union_url_sources(_list(spark, sf_dir), _other(spark, sf_dir))


query("union_url_sources", f"{_UNION} SELECT * FROM u")(_united)
query("dedupe_urls", f"{_CLEAN} SELECT * FROM clean")(lambda s, d: lists.dedupe_urls(_united(s, d), "source", "pos"))
query("invalid_urls", f"{_UNION} SELECT * FROM u WHERE trim(url) NOT LIKE 'https://u.example/%'")(lambda s, d: lists.invalid_urls(_united(s, d)))
query("limit_urls", f"{_CLEAN} SELECT * FROM clean ORDER BY source, pos LIMIT 40")(lambda s, d: lists.limit_urls(lists.dedupe_urls(_united(s, d), "source", "pos"), 40, "source", "pos"))
query("url_cells", f"WITH l AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, concat(o_orderkey, ';', 'https://u.example/', o_custkey, ';x') AS line FROM orders) SELECT pos, 1 AS cell, string_split(line, ';')[2] AS url FROM l")(
    lambda s, d: lists.url_cells(with_place(read(s, d, "orders").selectExpr("0 AS list", "o_orderkey", "concat(o_orderkey, ';', 'https://u.example/', o_custkey, ';x') AS line"), "list", "o_orderkey", name="pos", large=100_000), "1;https://u.example/1;x").withColumn("pos", F.col("pos").cast("long"))
)
_export, _EXPORT = made("lineitem", "concat('site', l_suppkey % 5) AS site;concat('/p/', l_partkey) AS page;concat('q', l_orderkey % 9) AS query;CASE WHEN l_linenumber = 3 THEN 'never' ELSE cast(cast(l_shipdate AS date) AS varchar(10)) END AS day;CASE WHEN l_linenumber = 2 THEN 'n/a' ELSE cast(l_partkey AS varchar(20)) END AS clicks;cast(l_suppkey AS varchar(20)) AS impressions;CASE WHEN l_linenumber = 1 THEN '' ELSE '1.5' END AS position")
query("typed_search_rows", f"SELECT site, page, query, cast(try_cast(day AS DATE) AS VARCHAR) AS date, coalesce(try_cast(clicks AS BIGINT), 0) AS clicks, impressions::BIGINT AS impressions, try_cast(position AS DOUBLE) AS position FROM ({_EXPORT})")(lambda s, d: lists.typed_search_rows(_export(s, d).withColumn("keys", F.array("page", "query", "day"))).withColumn("date", F.col("date").cast("string")))

# references of pages

_refs, _REFS = made("customer", "cast(c_custkey AS bigint) AS k;concat('https://h.example/a/b/c', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '?q#f' ELSE '' END) AS base;CASE c_custkey % 9 WHEN 0 THEN concat('../x/', c_custkey) WHEN 1 THEN './y' WHEN 2 THEN '/z/../w/.' WHEN 3 THEN '?n=1' WHEN 4 THEN '#top' WHEN 5 THEN '//o.example' WHEN 6 THEN 'mailto:a@b.example' WHEN 7 THEN '../../../up' ELSE '' END AS href")
query(
    "resolve_urls",
    f"WITH r AS (SELECT *, regexp_replace(base, '#.*$', '') AS page, regexp_replace(base, '[?#].*$', '') AS bare FROM ({_REFS})) SELECT k, CASE k % 9 WHEN 0 THEN 'https://h.example/a/x/' || k WHEN 1 THEN 'https://h.example/a/b/y' WHEN 2 THEN 'https://h.example/w/' WHEN 3 THEN bare || '?n=1' WHEN 4 THEN page || '#top' WHEN 5 THEN 'https://o.example' WHEN 6 THEN 'mailto:a@b.example' WHEN 7 THEN 'https://h.example/up' ELSE page END AS url FROM r",
)(lambda s, d: _refs(s, d).select("k", urls.resolve(F.col("base"), F.col("href")).alias("url")))
