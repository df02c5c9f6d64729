"""Cases of page types, blog and course audits, structured data, headers, robots.txt and metrics."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators import audits, checks, facts, headers, keywords, links, metrics, robots, scoring, structured


def facts_of(spark, source, url="https://h.example/a-b", sent=None):
    df = spark.createDataFrame([(url, source, sent)], "url string, html string, headers map<string,string>")
    return facts.extract_facts(df)


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_text_rules(spark):
    assert one(spark, text.pixel_width, "가나다", "日本", "Ａ") == [22.5, 28.0, 14.0]
    assert one(spark, text.is_error_status, "GSC Error: 403", "Browser Error: blocked", "Playwright Error: launch failed", "Error", "Error: x", "Error x", "Timeout", "Other") == [True] * 8
    assert one(spark, text.is_error_status, "Errorless", "Blocked", "Indexed", "Not Indexed", "", None) == [False] * 6
    assert one(spark, text.intent, "Inform", "commerce", "Transactional", "navigate", "x", None) == ["informational", "commercial", "transactional", "navigational", "unknown", "unknown"]
    assert one(spark, text.metric_value, "540 ms", "2.4 s", "", "n/a") == [0.54, 2.4, 0.0, 0.0]
    assert one(spark, text.pretty_tool_name, "og_tags", "broken_links", "ttfb") == ["OG Tags", "Broken Links", "TTFB"]
    assert [str(x) for x in one(spark, text.parse_date_signal, "Tue, 06 Jan 2026 10:00:00 +0200", "6 Jan 2026 23:30:00 -0700", "2026-01-01T00:00:00+01:00")] == ["2026-01-06 08:00:00", "2026-01-07 06:30:00", "2025-12-31 23:00:00"]
    assert one(spark, text.coerce_int, "2.5", "3.5", "x", None) == [2, 4, None, None] and one(spark, text.coerce_float, "0.12345", "x") == [0.1234, None]


LINKS = '<a href="#x">a</a><a href="mailto:a@b">m</a><a href="tel:1">t</a><a href="/ok">o</a><a href="javascript:void(0)">j</a>'


def test_links_to_no_page_are_skipped_before_the_cap(spark):
    f = facts_of(spark, LINKS)
    log = spark.createDataFrame([("https://h.example/ok", 200, None)], "url string, status int, location string")
    rows = links.links_of(f.select("url", F.expr("filter(anchors, a -> a.href not like 'java%')").alias("anchors")), 1)
    assert [(r.n_links, r.n_broken, r.verdict) for r in links.broken_links(rows, log).collect()] == [(1, 0, "pass")]
    assert [(r.href, r.state) for r in links.link_health(links.links_of(f), log).collect()] == [("https://h.example/ok", "ok")]


def test_header_fallbacks(spark):
    sent = {"X-Robots-Tag": "NoIndex", "link": '<https://h.example/a-b>; rel="canonical"', "Last-Modified": "Tue, 06 Jan 2026 10:00:00 GMT"}
    got = {r.tool: r.status for r in checks.run_checks(facts_of(spark, "<p>x", sent=sent), as_of="2026-02-01").collect()}
    assert (got["meta_robots"], got["canonical"], got["content_freshness"]) == ("fail", "pass", "pass")


@pytest.mark.parametrize("stamp, want", [("2025-06-01", "pass"), ("2025-05-31", "warning"), ("2024-06-01", "warning"), ("2024-05-31", "fail"), ("soon", "pass"), ("", "warning")])
def test_freshness_bounds(spark, stamp, want):
    f = facts_of(spark, f'<meta property="article:modified_time" content="{stamp}">')
    assert [r.status for r in checks.run_checks(f, ["content_freshness"], as_of="2026-06-01").collect()] == [want]


@pytest.mark.parametrize("url, want", [("https://h.example/a?session_id=1", "warning"), ("https://h.example/a?pg=1&paged=2&a=1&b=2&c=3", "pass"), ("https://h.example/a?a=1&b=2&c=3&d=4", "warning"), ("https://h.example/A_b?sid=1", "fail"), ("https://h.example/12345678", "warning"), ("https://h.example/" + "a" * 98, "warning"), ("https://h.example/" + "a" * 97, "pass")])
def test_url_structure(spark, url, want):
    assert [r.status for r in checks.run_checks(facts_of(spark, "", url), ["url_structure"]).collect()] == [want]


def test_images_and_og(spark):
    imgs = '<img src="data:x"><img src="/a.jpg" width="" height="1">' + '<img src="/b.webp" width=1 height=1 loading=lazy>' * 4 + '<picture><source type="image/avif"></picture>'
    got = {r.tool: (r.status, r.message) for r in checks.run_checks(facts_of(spark, imgs + '<meta property="og:title" content="a"><meta property="og:title" content="">'), ["image_optimization", "og_tags"]).collect()}
    assert got["image_optimization"] == ("warning", "1") and got["og_tags"][0] == "fail" and got["og_tags"][1].startswith("og:title")


def test_select_checks():
    assert checks.select_checks(["on_page"], ["title", "ssl"]) == ["title"]
    assert checks.select_checks(["technical_seo", "on_page"])[0] == "title" and len(checks.select_checks(["technical_seo"])) == 35


# structured data


def test_jsonld_issues():
    good = {"@context": "https://schema.org", "@type": "Article", "headline": "h", "author": "a", "datePublished": "2026-01-01"}
    assert structured.issues_of(good) == []
    bad = {"@type": ["Product", "Gadget"], "offers": {"@type": "Event", "name": "n", "startDate": ""}}
    assert [(i["level"], i["path"], i["message"]) for i in structured.issues_of(bad)] == [("error", "$", "Missing @context"), ("error", "$", "Product: missing name"), ("info", "$", "Unknown type Gadget"), ("error", "$.offers", "Event: missing startDate"), ("error", "$.offers", "Event: missing location")]
    assert structured.issues_of([good]) == [] and structured.issues_of(1) == []
    f = structured.jsonld_facts(['{"@graph": [{"@type": "Course", "name": "n"}]}', "{", "[1]"])
    assert [b["valid"] for b in f["blocks"]] == [True, False, True] and f["course_missing"] == ["description", "provider"] and f["article_missing"] is None


def test_jsonld_reports(spark):
    f = facts_of(spark, f'<script type="application/ld+json">{json.dumps({"@context": "https://schema.org", "@type": "WebSite", "name": "n"})}</script>')
    r = structured.jsonld_validate(f).first()
    assert (r.n_blocks, r.n_errors, r.types, r.recommended) == (1, 1, "WebSite", "Article,BreadcrumbList,FAQPage,Organization,Product,VideoObject")
    assert [i.message for i in structured.jsonld_issues(f).collect()] == ["WebSite: missing url"]


# page types, blogs, courses


@pytest.mark.parametrize("url, source, want", [("https://h.example/blog/x", "", "generic"), ("https://h.example/blog/x", '<meta property="og:type" content="article">', "blog"), ("https://h.example/", '<script type="application/ld+json">{"@type": "Course"}</script>', "course"),
    ("https://h.example/", '<script type="application/ld+json">{"@graph": [{"@type": "Product"}]}</script>', "product"), ("https://h.example/", '<script type="application/ld+json">[{"@type": "BlogPosting"}]</script>', "blog"), ("https://h.example/shop/x", '<meta property="og:type" content="product.item"><p itemprop="price">1</p>', "product")])
def test_page_types(spark, url, source, want):
    r = audits.page_type(facts_of(spark, source, url)).first()
    assert r.page_type == want and (want == "generic") == (r.confidence < 0.4)


BLOG = '<html><head><meta property="article:section" content="News"><meta property="og:image" content="https://h.example/i.png"><meta property="og:image:width" content="1200"><meta property="og:image:height" content="630">%s</head><body><article><h2>a</h2><h2>b</h2>%s<p>%s</p></article></body></html>'


def test_blog_audit(spark):
    ld = json.dumps({"@type": "BlogPosting", "headline": "h", "author": [{"name": "Ann"}], "datePublished": "2026-01-01", "dateModified": "2026-01-02", "image": "i"})
    source = BLOG % (f'<script type="application/ld+json">{ld}</script>', '<a href="/x">x</a><a href="/y">y</a><a href="/z">z</a>', "word " * 600)
    rows = audits.blog_audit(facts_of(spark, source))
    assert {r.tool: r.status for r in rows.collect() if r.status != "pass"} == {} and audits.blog_score(rows).first().score == 100
    empty = {r.tool: r.status for r in audits.blog_audit(facts_of(spark, "")).collect()}
    assert {t for t, s in empty.items() if s == "warning"} == {"blog_updated_date", "blog_category", "blog_internal_links"} and "pass" not in empty.values()
    for source, want in (('<a rel="author" href="/a">Ann</a>', "pass"), ('<address class="author">Ann</address>', "pass"), ("<address>Ann</address>", "fail")):
        assert {r.tool: r.status for r in audits.blog_audit(facts_of(spark, source)).collect()}["blog_author"] == want
    for stamp, want in (("2026-01-01", "pass"), ("yesterday", "warning")):
        assert {r.tool: r.status for r in audits.blog_audit(facts_of(spark, f'<time datetime="{stamp}">x</time>')).collect()}["blog_published_date"] == want


@pytest.mark.parametrize("n, want", [(299, "fail"), (300, "warning"), (599, "warning"), (600, "pass")])
def test_reading_time_bounds(spark, n, want):
    assert {r.tool: r.status for r in audits.blog_audit(facts_of(spark, f"<article><nav>no</nav>{'word ' * n}</article>")).collect()}["blog_reading_time"] == want


COURSE = """<html><head><meta name="viewport" content="width=device-width"><script type="application/ld+json">{"@type": "Course", "name": "n", "description": "d", "provider": "p"}</script></head><body><h1>Python</h1>
<p>A course for people who want to learn the language well.</p><h2>What you'll learn</h2><h2>Syllabus</h2><h2>Your instructor</h2><p>6 weeks, starts in May</p><p>Price: $ 99</p><h2>FAQ</h2><a href="/e">Enroll now</a></body></html>"""


def test_course_audit(spark):
    rows = audits.course_audit(facts_of(spark, COURSE))
    assert {r.tool: r.status for r in rows.collect() if r.status != "pass"} == {} and audits.course_score(rows).first().score == 100
    body = {r.tool: r.status for r in audits.course_audit(facts_of(spark, "<p>benefits, modules and trainers</p><div class=pricing>x</div>")).collect()}
    assert (body["course_outcomes"], body["course_syllabus"], body["course_instructor"], body["course_pricing"], body["course_faq"], body["mobile_friendly"]) == ("warning", "warning", "warning", "warning", "fail", "fail")
    errors = spark.createDataFrame([("u", "a", "pass"), ("u", "b", "error")], "url string, tool string, status string")
    assert audits.course_score(errors).first().score == 50 and audits.blog_score(errors).first().score == 100


def test_fix_hints(spark):
    rows = spark.createDataFrame([("u", "title", "fail", "Missing title"), ("u", "title", "pass", "Missing"), ("u", "x", "fail", "m")], "url string, tool string, status string, message string")
    assert [r.hint for r in audits.fix_hints(rows).collect()] == ["write a title of 30 to 60 characters", ""]


# chains, alternates, robots


def test_canonical_loops(spark):
    rows = [("a", "a"), ("b", None), ("c", "d"), ("d", "d"), ("e", "f"), ("f", "e"), ("g", "gone"), ("h", "b")] + [(f"l{i}", f"l{i + 1}") for i in range(7)] + [("l7", "l7")]
    got = {r.url: r.verdict for r in links.canonical_loop(spark.createDataFrame(rows, "url string, canonical string")).collect()}
    assert {k: got[k] for k in "abcdefgh"} == {"a": "pass", "b": "warning", "c": "warning", "d": "pass", "e": "fail", "f": "fail", "g": "error", "h": "pass"} and got["l0"] == "warning"
    hot = {r.url: r.verdict for r in links.canonical_loop(spark.createDataFrame(rows, "url string, canonical string"), hot=2).collect()}
    assert hot == got


def test_canonical_rows_that_need_no_lookup_are_dealt_evenly(spark):
    rows = spark.range(4000).selectExpr("concat('u', id) AS url", "CASE WHEN id % 2 = 0 THEN '' ELSE 'gone' END AS canonical")
    out = links.canonical_loop(rows, hot=1000).withColumn("part", F.spark_partition_id())
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sizes = sorted(r["count"] for r in out.groupBy("part").count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[1])
    assert sum(sizes) == 4000 and len(sizes) == 4 and sizes[-1] < 1300  # 2,000 and 4,000 before


def test_long_redirects_are_followed_to_their_end(spark):
    rows = [(f"u{i}", 301, f"u{i + 1}") for i in range(24)] + [("u24", 200, None), ("http://p", 301, "https://p")]
    got = {r.url: r for r in links.redirect_chains(spark.createDataFrame(rows, "url string, status int, location string")).collect()}
    assert (got["u0"].hops, got["u0"].final_url, got["u0"].is_loop) == (24, "u24", False) and got["u0"].issues == "long chain; several permanent redirects"
    assert got["http://p"].to_https and got["http://p"].issues == ""


def test_hreflang_report(spark):
    f = facts_of(spark, '<link rel="alternate" hreflang="en" href="/a"><link rel="alternate" hreflang="en" href="https://h.example/a-b/">', sent={"Link": '<https://h.example/de>; rel="alternate"; hreflang="de"'})
    entries = links.hreflang_entries(f)
    assert {(r.lang, r.href) for r in entries.collect()} == {("en", "/a"), ("en", "https://h.example/a-b/"), ("de", "https://h.example/de")}
    log = spark.createDataFrame([("https://h.example/a-b/", 200, None), ("https://h.example/de", 301, "https://h.example/de/")], "url string, status int, location string")
    r = links.hreflang_validate(entries, log).first()
    assert (r.n_entries, r.has_x_default, r.duplicate_langs, r.has_self, r.n_relative, r.n_unreachable, r.n_redirecting, r.verdict) == (3, False, "en", True, 1, 1, 1, "fail")


ROBOTS = "# x\nUser-agent: *\nDisallow: /a\nAllow: /a/b\nCrawl-delay: soon\n\nUser-agent: Googlebot\nUser-agent: Bing\nDisallow: /\nSitemap: ftp://x\n"


def test_robots_files(spark):
    docs = spark.createDataFrame([("h", 200, ROBOTS), ("n", 404, None), ("e", 500, None)], "host string, status int, body string")
    lines = robots.robots_lines(docs.where("status = 200"))
    rules = {(r.block, r.user_agent, r.rule_idx): (r.allow, r.path) for r in robots.robots_rules(lines).collect()}
    assert rules == {(1, "*", 0): (False, "/a"), (1, "*", 1): (True, "/a/b"), (2, "Googlebot", 0): (False, "/"), (2, "Bing", 0): (False, "/")}
    pages = spark.createDataFrame([("https://h/a/b",), ("https://h/c",), ("https://n/x",), ("https://e/x",)], "url string")
    assert {r.url: (r.allowed, r.googlebot, r.status) for r in robots.robots_check(pages, docs).collect()} == {"https://h/a/b": (False, False, "fail"), "https://h/c": (True, False, "fail"), "https://n/x": (True, True, "pass"), "https://e/x": (True, True, "warning")}
    issues = {r.issue for r in robots.robots_issues(lines).collect()}
    assert issues == {"main crawler blocked", "invalid crawl delay", "bad sitemap address"}
    assert robots.robots_audit(lines).first().verdict == "fail"
    all_ = robots.crawl_issues(robots.robots_issues(lines), robots.robots_issues(lines).limit(0), spark.createDataFrame([("z", "sitemap")], "host string, source string"))
    assert {r.host: r.n_errors for r in robots.issue_verdicts(all_).collect()} == {"h": 2, "z": 1}


def test_sitemap_rules(spark):
    e = spark.createDataFrame([("https://h/s.xml", i, u, m) for i, (u, m) in enumerate([("https://h/1", "2026-01-01"), ("https://H/1/", "not-a-date"), ("http://h/2", None), ("https://h/x.pdf", None)])] + [("http://p/s.xml", 0, "http://p/1", None)], "sitemap_url string, pos int, loc string, lastmod string")
    got = {r.sitemap_url: (r.http_urls, r.non_indexable, r.duplicates, r.invalid_lastmod, r.n_errors, r.score) for r in links.sitemap_audit(e, spark.createDataFrame([("http://p/s.xml", "x" * 10)], "sitemap_url string, body string")).collect()}
    assert got == {"https://h/s.xml": (1, 1, 1, 1, 0, 60), "http://p/s.xml": (0, 0, 0, 0, 0, 100)}
    assert {r.sitemap_url: r.verdict for r in links.sitemap_validate(e).collect()} == {"https://h/s.xml": "fail", "http://p/s.xml": "fail"}


# headers, hosts, metrics


def test_headers(spark):
    log = spark.createDataFrame([("u", {"strict-Transport-security": "x", "X-Frame-Options": "y", "x-content-type-options": "z", "Cache-Control": "no-store", "X-Robots-Tag": "noindex"})], "url string, headers map<string,string>")
    assert headers.security_headers(log).first().missing == "CSP,Referrer-Policy"
    r = headers.compression_headers(log).first()
    assert (r.compressed, r.cached, r.hsts, r.score) == (False, True, True, 40)
    assert headers.header_highlights(log).first().highlights == "error: noindex; warn: no-store; info: no content-encoding"
    none = spark.createDataFrame([("u", None)], log.schema)
    assert headers.security_headers(none).first().status == "fail" and headers.compression_headers(none).first().score == 0


@pytest.mark.parametrize("metric, value, want", [("spam_score", 3, "pass"), ("spam_score", 7, "warning"), ("spam_score", 8, "fail"), ("backlinks", 100, "warning"), ("backlinks", 101, "pass"), ("backlinks", 10, "fail"), ("broken_backlinks", 0, "pass"), ("broken_backlinks", 10, "warning"), ("broken_backlinks", 11, "fail"), ("pagespeed", 90, "pass"), ("pagespeed", 49.9, "fail"), ("x", 1, "error"), ("mobile", None, "error")])
def test_metric_bounds(spark, metric, value, want):
    df = spark.createDataFrame([("u", metric, None if value is None else float(value))], "url string, metric string, value double")
    assert metrics.metric_status(df).first().status == want


def test_lab_grades(spark):
    rows = [("u", s, m, v, None) for s, m, v in (("mobile", "largest-contentful-paint", "4.1 s"), ("desktop", "largest-contentful-paint", "2.5 s"), ("mobile", "interaction-to-next-paint", "200 ms"), ("desktop", "interaction-to-next-paint", "501 ms"), ("mobile", "speed-index", "3.5 s"))] + [("u", "mobile", "performance_score", None, 40.0), ("u", "desktop", "performance_score", None, 95.0)]
    r = metrics.performance_opportunities(spark.createDataFrame(rows, "url string, strategy string, metric string, display_value string, score double")).first()
    assert (r.critical, r.quick_wins, r.nice_to_have, r.gap, r.overall) == ("largest-contentful-paint", "interaction-to-next-paint", "speed-index", 55.0, "critical")


def test_host_bounds(spark):
    rows = [("a", "2026-01-15", "2024-01-02", "s", "v=DMARC1; p=reject", ["m"]), ("b", "2026-01-31", "2025-01-01", None, "v=DMARC1; p=none", ["m"]), ("c", "2026-01-14", "2025-06-01", None, None, []), ("d", None, None, "s", "d", None)]
    df = spark.createDataFrame(rows, "host string, cert_not_after string, domain_created string, spf string, dmarc string, mx array<string>")
    got = {(r.host, r.tool): r.status for r in metrics.host_facts_checks(df, "2026-01-01").collect()}
    assert [got[h, "ssl"] for h in "abcd"] == ["warning", "pass", "fail", "error"] and [got[h, "domain_age"] for h in "abcd"] == ["pass", "warning", "fail", "error"]
    assert [got[h, "dns_health"] for h in "abcd"] == ["pass", "warning", "fail", "warning"] and [got[h, "dmarc"] for h in "abcd"] == ["pass", "warning", "fail", "warning"]


# keywords


def test_keyword_density_and_targets(spark):
    f = facts_of(spark, "<html><head><title>Rust guide</title></head><body><h1>Learn Rust</h1><nav>rust</nav><p>Rust is the rust of go and the go. Memory safe memory.</p></body></html>")
    got = {r.keyword: r for r in keywords.keyword_density(f).collect()}
    assert {k: r["count"] for k, r in got.items()} == {"rust": 4, "guide": 1, "learn": 1, "memory": 2, "safe": 1} and got["rust"].total_words == 9 and got["rust"].density == 44.44 and got["rust"].in_title and got["rust"].in_h1 and not got["memory"].in_title
    assert [r.keyword for r in keywords.top_keywords_per_page(keywords.keyword_density(f), 3).orderBy("place").collect()] == ["rust", "memory", "guide"]
    t = spark.createDataFrame([("https://h.example/a-b", "Rust"), ("https://h.example/a-b", "zig")], "url string, keyword string")
    got = {r.keyword: (r.errors, r.score) for r in keywords.keyword_targeting(f, t).collect()}
    assert got == {"Rust": ("", 60), "zig": ("not in title; not in text", 20)}


def test_keyword_research(spark):
    item = {"keyword": " SEO  Tools ", "keyword_info": {"search_volume": 1200, "cpc": 1.25, "competition": 0.42, "monthly_searches": [{"year": 2026, "month": 4, "search_volume": 1000}]}, "keyword_properties": {"keyword_difficulty": 37}, "search_intent_info": {"main_intent": "informational"}}
    wrap = lambda items: json.dumps({"tasks": [{"result": [{"items": items}]}]})
    raw = spark.createDataFrame([("related", "s", wrap([{"keyword_data": item}, {"keyword_data": item}, {}])), ("ideas", "s", wrap([item | {"keyword_info_normalized_with_clickstream": {"search_volume": 7}}])), ("ideas", "t", "{")], "source string, seed string, payload string")
    got = {r.source: r for r in keywords.map_keyword_json(raw).collect()}
    assert len(got) == 2 and (got["related"].keyword, got["related"].search_volume, got["related"].cpc, got["related"].difficulty, got["related"].intent, got["related"].trend[0].month) == ("seo tools", 1200, 1.25, 37, "informational", 4)
    assert got["ideas"].search_volume == 7
    rows = [("s", "related", i, k) for i, k in enumerate(["s", "a", "b"])] + [("s", "suggestions", i, k) for i, k in enumerate(["b", "c", "d", "e"])] + [("s", "ideas", 0, "z")]
    merged = keywords.keyword_fallback_merge(spark.createDataFrame(rows, "seed string, source string, pos int, keyword string"))
    assert [r.keyword for r in merged.orderBy("place").collect()] == ["s", "a", "b", "c", "d", "e"]


def test_issue_samples_and_digest(spark):
    rows = spark.createDataFrame([(f"u{i}", "title", "fail" if i else "warning", f"m{i:02}") for i in range(30)], "url string, tool string, status string, message string")
    assert scoring.issue_samples(rows, 2).first().sample_urls == "u1,u10"
    got = scoring.issue_digest(rows).collect()
    assert len(got) == 16 and [r.line for r in got if r.status == "fail"] == list(range(1, 16))
