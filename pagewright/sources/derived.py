"""Inputs that the supplied tables stand for: search rows, index states, audits, logs, links.

Each input is a table, expressions that Spark and DuckDB both read, and a filter. So a query and
its SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def rich_html() -> str:
    """The html of pages with what they lack, by page_id: head elements, and images, headings and
    links before the footer."""

    def by(n: int, *parts: str) -> str:
        return f"CASE page_id % {n} " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(parts, 1)) + " ELSE '' END"

    def og(*names: str) -> str:
        return "'" + "".join(f'<meta property="og:{n}" content="v">' for n in names) + "'"

    ld = '<script type="application/ld+json">{}</script>'
    article = ld.format('{"@context": "https://schema.org", "@type": "Article", "headline": "h"}')
    head = (
        by(4, "'<meta name=\"Description\" content=\"Short text\">'", "concat('<meta name=\"description\" content=\"', repeat('word ', 15), '\">')", "concat('<meta name=\"description\" content=\"', repeat('word ', 40), '\">')"),
        by(5, "concat('<link rel=\"canonical\" href=\"', replace(url, '&', '&amp;'), '\">')", "'<link rel=\"canonical\" href=\"https://canon.example/x\">'"),
        by(3, "'<meta name=\"viewport\" content=\"width=device-width, initial-scale=1\">'", "'<meta name=\"viewport\" content=\"width=600\">'"),
        by(6, "'<meta name=\"robots\" content=\"NOINDEX\">'", "'<meta name=\"robots\" content=\"nofollow, noarchive\">'", "'<meta name=\"robots\" content=\"index,follow\">'"),
        by(4, og("title", "description", "image"), f"concat({og('title', 'description', 'image', 'url', 'type')}, '<meta name=\"twitter:card\" content=\"v\">')", "'<meta property=\"og:title\" content=\"t\"><meta property=\"og:type\" content=\"\">'"),
        by(5, "'<link rel=\"alternate\" hreflang=\"en\" href=\"/en\"><link rel=\"alternate\" hreflang=\"x-default\" href=\"/\">'", "'<link rel=\"alternate\" hreflang=\"en\" href=\"/en\">'", "'<link rel=\"alternate\" hreflang=\"en\" href=\"/en\"><link rel=\"alternate\" hreflang=\"en\" href=\"/us\"><link rel=\"alternate\" hreflang=\"x-default\" href=\"/\">'"),
        by(6, f"'{article}'", f"'{ld.format('{broken')}'", f"'{article}{ld.format('{broken')}'", f"'{ld.format('[1]')}'", "'" + ld.format('{"@context": "http://other.example", "@type": "Course", "name": "n", "description": "d"}') + "'"),
        by(4, "'<link rel=\"icon\" href=\"/i.ico\">'", "'<link rel=\"shortcut icon\" href=\"/i.ico\"><link rel=\"apple-touch-icon\" href=\"/a.png\">'", "'<link rel=\"apple-touch-icon\" href=\"/a.png\">'"),
        "repeat('<script src=\"/a.js\"></script>', cast(page_id % 4 AS int))", "repeat('<link rel=\"stylesheet\" href=\"/s.css\">', cast(page_id % 14 AS int))",
        by(5, "'<meta property=\"article:modified_time\" content=\"2026-01-01T00:00:00Z\">'", "'<meta property=\"article:modified_time\" content=\"2024-12-01\">'", "'<meta property=\"article:modified_time\" content=\"2020-01-01\">'", "'<meta property=\"article:modified_time\" content=\"not a date\">'"),
    )
    body = (
        "repeat('<img src=\"/a.webp\" alt=\"x\" width=\"1\" height=\"1\" loading=\"lazy\">', cast(page_id % 6 AS int))", "repeat('<img src=\"http://h.example/b.png\">', cast(page_id % 5 AS int))",
        "repeat('<h2>Part</h2>', cast(page_id % 3 AS int))", by(2, "'<a href=\"#top\">t</a><a href=\"mailto:a@b.example\">m</a><a href=\"tel:1\">n</a><a rel=\"nofollow\" href=\"/nf\">n</a><a href=\"https://other.example/x\">e</a>'"),
    )
    return f"replace(replace(html, '</head>', concat({', '.join(head)}, '</head>')), '<footer>', concat({', '.join(body)}, '<footer>')) AS html"


INPUTS: dict[str, tuple[str, str]] = {
    "search_rows": (
        "lineitem",
        "concat('site', l_suppkey % 5) AS site, concat('https://www.shop.example/p/', l_partkey) AS page, concat('q', l_orderkey % 400) AS query, "
        "cast(l_shipdate AS date) AS date, cast(floor(l_quantity * l_discount * 10) AS bigint) AS clicks, cast(l_quantity * 20 AS bigint) AS impressions, "
        "cast(1 + (l_partkey + l_linenumber * 7 + extract(year FROM l_shipdate)) % 23 AS double) AS position",
    ),
    "index_status": (
        "orders",
        "concat('run', extract(year FROM o_orderdate)) AS run_id, concat('https://www.shop.example/', CASE o_custkey % 4 WHEN 0 THEN 'blog/post-' WHEN 1 THEN 'course/' WHEN 2 THEN 'tag/x/' ELSE 'a/b/c/d/' END, o_custkey) AS url, "
        "CASE o_orderstatus WHEN 'F' THEN 'Indexed' WHEN 'O' THEN 'Not Indexed' ELSE 'Error' END AS status, o_orderkey AS num, o_orderdate AS checked_at",
    ),
    "login_attempts": (
        "events",
        "event_id AS id, concat('user', user_id % 300) AS username, ts, concat('10.0.0.', user_id % 7) AS ip, concat('agent', event_id % 3) AS user_agent, event_type <> 'error' AS success",
    ),
    "http_requests": (
        "events",
        "event_id AS id, ts, CASE WHEN user_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, event_type AS endpoint, cast(CASE event_id % 5 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END AS int) AS status, value / 1000 AS duration_s",
    ),
    "serp": (
        "part",
        "concat('kw', p_partkey % 50) AS keyword, cast(1 + floor(p_partkey / 50) % 20 AS int) AS rank, concat('https://www.site', p_size % 9, '.example/', p_partkey) AS link, p_name AS title",
    ),
    "sitemap_urls": (
        "orders",
        "concat('https://www.shop', o_custkey % 20, '.example/sitemap.xml') AS sitemap_url, o_orderkey AS pos, concat(CASE WHEN o_orderkey % 11 = 0 THEN 'http' ELSE 'https' END, '://www.shop', o_custkey % 20, '.example/p/', o_custkey, "
        "CASE o_orderkey % 7 WHEN 0 THEN '/' WHEN 1 THEN '?a=1' WHEN 2 THEN '.pdf' ELSE '' END) AS loc, CASE o_orderkey % 5 WHEN 0 THEN '2026-01-01' WHEN 1 THEN 'not-a-date' ELSE NULL END AS lastmod",
    ),
    "crawl_log": (
        "orders",
        "concat('https://www.shop.example/r/', o_orderkey) AS url, 1 AS attempt, cast(CASE o_orderkey % 6 WHEN 0 THEN 301 WHEN 1 THEN 302 WHEN 2 THEN 404 WHEN 3 THEN 500 ELSE 200 END AS int) AS status, "
        "CASE WHEN o_orderkey % 6 < 2 THEN concat('https://www.shop.example/r/', o_orderkey + 6 * (o_orderkey % 3) + CASE WHEN o_orderkey % 12 = 0 THEN 1 ELSE 4 END) END AS location, cast(floor(o_totalprice) AS int) % 1200 AS ttfb_ms",
    ),
    "mixed_search_rows": (
        "lineitem",
        "concat('site', l_suppkey % 5) AS site, concat('https://www.shop.example/p/', l_partkey) AS page, concat('q', l_orderkey % 400) AS query, cast(l_shipdate AS date) AS date, "
        "cast(floor(l_quantity * l_discount * (2 + l_partkey % 13)) AS bigint) AS clicks, cast(l_quantity * 20 AS bigint) AS impressions, cast(1 + l_partkey % 27 + l_linenumber % 3 AS double) AS position",
    ),
    "fetch_attempts": (
        "lineitem",
        "concat('https://www.shop.example/r/', l_orderkey) AS url, cast(l_linenumber AS int) AS attempt, "
        "cast(CASE (l_orderkey + l_linenumber * l_linenumber) % 7 WHEN 0 THEN 301 WHEN 1 THEN 404 WHEN 2 THEN 200 WHEN 3 THEN NULL ELSE 503 END AS int) AS status",
    ),
    "dense_attempts": (
        "events",
        "event_id AS id, concat('user', event_id % 3) AS username, make_timestamp(2024, cast(1 AS int), cast(1 + floor(event_id / 4320) % 28 AS int), cast(floor(event_id / 180) % 24 AS int), cast(floor(event_id / 3) % 60 AS int), (event_id % 3) * 20) AS ts, "
        "concat('10.0.0.', user_id % 7) AS ip, concat('agent', event_id % 3) AS user_agent, event_type <> 'error' AS success",
    ),
    "rich_pages": ("pages", "page_id, url, " + rich_html()),
}

# Tools, each with weight in the score, impact and effort of a fix.
TOOLS = (
    ("http_status", 15, None, None), ("robots", 10, 10, "low"), ("meta_robots", 10, 9, "low"), ("title", 10, 9, "low"), ("meta_description", 8, 7, "low"), ("headings", 8, 6, "low"), ("canonical", 7, 8, "low"),
    ("word_count", 7, 5, "high"), ("image_alt", 6, 6, "medium"), ("ssl", 6, 10, "medium"), ("schema", 5, 7, "medium"), ("ttfb", 5, None, None), ("redirect", 5, 8, "medium"), ("broken_links", 5, 9, "medium"),
    ("mixed_content", 5, 8, "medium"), ("internal_links", 4, 6, "medium"), ("og_tags", 4, 5, "low"), ("readability", 4, 4, "high"), ("dns_health", 3, 9, "low"), ("viewport", 6, 8, "low"), ("lang_attr", 3, 5, "low"),
    ("content_freshness", 4, 6, "high"), ("url_structure", 4, 7, "medium"), ("canonical_loop", 6, 9, "medium"), ("www_redirect", 4, 6, "low"), ("http2", 3, 5, "medium"), ("render_blocking", 5, 8, "medium"),
    ("image_optimization", 5, 7, "medium"), ("favicon", 2, None, None), ("domain_age", 2, None, None), ("hreflang", 2, 5, "high"), ("sitemap", 3, 7, "low"), ("https_enforcement", 5, 9, "medium"),
    ("security_headers", 3, 6, "low"), ("spf", 2, None, None), ("dmarc", 2, None, None), ("mx_records", 1, None, None), ("gsc_crawl_inspection", 4, None, None), ("pagespeed_mobile", 12, None, None),
    ("pagespeed_desktop", 6, None, None), ("lcp", 8, 9, "high"), ("cls", 6, 8, "high"), ("inp", 6, 7, "high"), ("fcp", 4, 7, "high"), ("mobile", 4, None, None), ("backlinks", 8, None, None),
    ("domain_authority", 6, None, None), ("referring_domains", 4, None, None), ("page_authority", 3, None, None), ("spam_score", 3, None, None), ("rank_tracker", 8, None, None), ("serp_features", 3, None, None),
    ("course_schema", None, 8, "medium"), ("course_cta", None, 8, "low"), ("course_pricing", None, 7, "low"), ("blog_article_schema", None, 7, "medium"), ("blog_og_image", None, 6, "low"),
)
UNSCORED = ("clicks_impressions", "top_queries", "position_tracker", "ctr_analyzer", "coverage_errors", "sitemaps_status", "manual_actions", "competitor", "rank_change", "traffic_share", "domain_rank", "broken_backlinks", "nofollow_ratio")
CTR_CURVE = {1: 28.5, 2: 15.7, 3: 11.0, 4: 8.0, 5: 7.2, 6: 5.1, 7: 4.0, 8: 3.2, 9: 2.8, 10: 2.5}

_AUDITED = ("title", "meta_description", "ssl", "word_count", "og_tags", "robots", "traffic_share", "unknown_tool")


def check_results_sql(run: int) -> str:
    """Check rows of a run over pages: the tools' states cycle with page, tool and run."""
    tools = ", ".join(f"('{t}', {i})" for i, t in enumerate(_AUDITED))
    return f"SELECT url, tool, CASE (page_id * 3 + i * 5 + page_id % 7 * {run}) % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'pass' END AS status, concat(tool, ' of ', page_id) AS message FROM pages CROSS JOIN (VALUES {tools}) AS t(tool, i) WHERE page_id % 10 <> {run}"


def input_sql(name: str) -> str:
    table, columns = INPUTS[name]
    return f"SELECT {columns} FROM {table}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = INPUTS[name]
    columns = columns.replace("{", "{{").replace("}", "}}")
    return spark.sql(f"SELECT {columns} FROM {{rows}}", rows=read(spark, sf_dir, table))


def check_results(spark: SparkSession, sf_dir: str, run: int) -> DataFrame:
    """As check_results_sql, with the tools unfolded inside each row."""
    tools = ", ".join(f"struct('{t}' AS tool, {i} AS i)" for i, t in enumerate(_AUDITED))
    rows = read(spark, sf_dir, "pages").where(f"page_id % 10 <> {run}").selectExpr("page_id", "url", f"inline(array({tools}))")
    return rows.selectExpr("url", "tool", f"CASE (page_id * 3 + i * 5 + page_id % 7 * {run}) % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'pass' END AS status", "concat(tool, ' of ', page_id) AS message")
