"""Cases of lists, reports, generators, event logs and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.operators import checks, facts, keywords, links, logs, scoring, search
from pagewright.sources import lists, markup, reports
from pagewright.streaming import jobs


@pytest.mark.parametrize("body, want", [("URL\nhttps://a.example/1\nhttps://a.example/2\nnot-a-date\n", 2), ("Name,URL,Notes\nx,https://a.example/1,n\ny,https://a.example/2,http\n", 2), ("a;https://a.example/1;http://b.example/\n", 2), ("x\thttps://a.example/1\n", 1), ('"Link"|"b"\n"https://a.example/1"|https://b.example\n', 1)])
def test_url_lists(spark, tmp_path, body, want):
    (tmp_path / "list.csv").write_text(body)
    assert lists.read_url_list(spark, str(tmp_path / "list.csv")).count() == want


def test_url_list_without_urls(spark, tmp_path):
    (tmp_path / "list.csv").write_text("keyword,volume\na,1\nb,2\n")
    with pytest.raises(ValueError, match="keyword, volume"):
        lists.read_url_list(spark, str(tmp_path / "list.csv"))


def test_urls_united_cleaned_and_limited(spark):
    a = spark.createDataFrame([(0, " https://a.example/1 "), (1, "http://localhost/"), (2, "https://a.example/2")], "pos int, url string")
    b = spark.createDataFrame([(0, "https://a.example/2"), (1, "https://a.example/3")], "pos int, url string")
    u = lists.union_url_sources(a, b)
    clean = lists.dedupe_urls(u, "source", "pos")
    assert [r.url for r in lists.limit_urls(clean, 2, "source", "pos").collect()] == ["https://a.example/1", "https://a.example/2"]
    assert clean.count() == 3 and [r.url for r in lists.invalid_urls(u).collect()] == ["http://localhost/"]


def test_search_exports(spark, tmp_path):
    rows = spark.createDataFrame([("s", ["/p", "q", "2026-01-01"], "3", "x", "1.5"), ("s", ["/p"], None, "7", "")], "site string, keys array<string>, clicks string, impressions string, position string")
    typed = lists.typed_search_rows(rows)
    assert [(r.clicks, r.impressions, r.position, str(r.date)) for r in typed.orderBy("clicks").collect()] == [(0, 7, None, "None"), (3, 0, 1.5, "2026-01-01")]
    typed.write.partitionBy("date").parquet(str(tmp_path / "x"))
    back = lists.read_search_rows(spark, str(tmp_path / "x")).where("date = '2026-01-01'")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(date" in back._jdf.queryExecution().toString()


def test_limits_hold_before_rounding(spark):
    rows = spark.createDataFrame([("a", 1999, 100_000, 20.04), ("b", 2000, 100_000, 3.0), ("c", 1, 100, 20.0)], "page string, clicks long, impressions long, position double")
    assert {r.page for r in search.low_ctr(rows).collect()} == {"c"} and {r.page for r in search.opportunity_pages(rows).collect()} == {"b"}
    many = spark.createDataFrame([("q", f"https://h/{i}", 0, 50, float(i)) for i in range(6)], "query string, page string, clicks long, impressions long, position double")
    got = search.consolidation_map(many).collect()
    assert len(got) == 5 and {r.winner for r in got} == {"https://h/0"} and "Redirect 301 /5 /0" in {r.rule for r in got}


def test_index_trend_by_time(spark):
    rows = [("z", "u1", "Indexed", "2026-01-01"), ("z", "u2", "Error", "2026-01-01"), ("a", "u1", "Indexed", "2026-02-01"), ("a", "u2", "Indexed", "2026-02-01")]
    got = scoring.index_trend(spark.createDataFrame(rows, "run_id string, url string, status string, checked_at string")).collect()
    assert [(r.run_id, r.rate, r.change, r.best) for r in got] == [("a", 100.0, 50.0, True), ("z", 50.0, None, False)]


def test_ranks(spark):
    serp = spark.createDataFrame([("k1", 4, "https://www.a.example/x"), ("k1", 2, "https://b.example/"), ("k2", 11, "https://www.a.example/y")], "keyword string, rank int, link string")
    targets = spark.createDataFrame([("a.example",), ("c.example",)], "domain string")
    for most in (10_000, 1):
        ranks = links.rank_tracker(serp, targets, most)
        assert {(r.domain, r.keyword): r.rank for r in ranks.collect()} == {("a.example", "k1"): 4, ("a.example", "k2"): 11, ("c.example", "k1"): None, ("c.example", "k2"): None}
    assert {r.domain: r.verdict for r in links.rank_summary(ranks).collect()} == {"a.example": "pass", "c.example": "fail"}
    assert links.traffic_share(ranks).first().avg_ctr == 8.0
    was = ranks.withColumn("rank", F.col("rank") + 3)
    assert links.rank_change_summary(links.rank_change(ranks, was)).first().verdict == "pass"
    assert [r.is_you for r in links.competitor_rows(serp, "a.example").collect()] == [False, False]


# reports and generators


def test_reports(spark, tmp_path):
    index = spark.createDataFrame([(1, "https://h.example/blog/x", "=cmd", dt.datetime(2026, 1, 1))], "num int, url string, status string, checked_at timestamp")
    reports.write_index_report(index, str(tmp_path / "i"))
    row = spark.read.option("header", True).csv(str(tmp_path / "i")).first()
    assert row.asDict() == {"#": "1", "URL": "https://h.example/blog/x", "Google Indexed": "'=cmd", "Priority": "Medium", "Depth": "2", "URL Type": "Blog", "Checked At": "2026-01-01 00:00:00"}
    checks = spark.createDataFrame([("u", "title", "pass", "m" * 300)], "url string, tool string, status string, message string")
    reports.write_audit_report(scoring.audits(checks), checks, str(tmp_path / "a"), "r1")
    assert spark.read.option("header", True).csv(str(tmp_path / "a/report")).first()["SEO Score"] == "100" and len(spark.read.parquet(str(tmp_path / "a/details")).first().message) == 200


def test_sitemaps(spark, tmp_path):
    rows = [("https://h.example/?a=1&b=2", "2026-01-01", "Daily", "0.5"), ("ftp://h.example/", None, None, None), ("https://h.example/b", "01/02/2026", "often", "1.5"), ("https://h.example/c", None, None, "x"), ("", None, None, None)]
    df = spark.createDataFrame(rows, "url string, lastmod string, changefreq string, priority string")
    got = {r.url: r.warnings for r in reports.sitemap_entries(df).collect()}
    assert got == {"https://h.example/?a=1&b=2": "", "ftp://h.example/": "bad scheme", "https://h.example/b": "bad lastmod; bad changefreq; bad priority", "https://h.example/c": "bad priority"}
    body = reports.sitemap_shards(df).first().body
    assert "<loc>https://h.example/?a=1&amp;b=2</loc>" in body and body.count("<url>") == 3 and body.endswith("</urlset>")
    many = spark.range(25).selectExpr("concat('https://h.example/', id) AS url", "'' AS lastmod", "'' AS changefreq", "'' AS priority")
    shards = reports.sitemap_shards(many, 4).collect()
    assert sum(r.n for r in shards) == 25 and max(r.n for r in shards) <= 4
    reports.write_sitemaps(many, str(tmp_path / "s"), 10)
    docs = spark.read.text(str(tmp_path / "s"), wholetext=True).selectExpr("shard AS sitemap_url", "value AS body")
    assert links.parse_sitemaps(docs).select("loc").distinct().count() == 25


def test_hreflang_and_robots_texts(spark):
    pairs = spark.createDataFrame([("c", 1, "en", "https://h.example/?a&b"), ("c", 2, "english!", "https://h.example/"), ("c", 3, "x-default", "https://h.example/"), ("c", 4, "de", "/x"), ("d", 1, "zz zz", "/")], "cluster string, pos int, locale string, url string")
    got = {r.cluster: r for r in reports.hreflang_tags(pairs).collect()}
    assert got["c"].html_tags.splitlines()[0] == '<link rel="alternate" hreflang="en" href="https://h.example/?a&amp;b">' and (got["c"].n, got["c"].dropped) == (2, 2) and got["c"].http_header.count("rel=") == 2 and got["d"].http_header == ""
    rules = spark.createDataFrame([("h", 1, "*", ["/b"], ["/a\nAllow: /"], "5", "https://h.example/s.xml"), ("h", 2, "", None, None, "soon", "/s.xml")], "host string, pos int, user_agent string, allow array<string>, disallow array<string>, crawl_delay string, sitemap string")
    r = reports.robots_txt(rules).first()
    assert r.body == "User-agent: *\nDisallow: /a Allow: /\nAllow: /b\nCrawl-delay: 5\n\nUser-agent: *\n\nSitemap: https://h.example/s.xml" and r.warnings == "bad crawl-delay; bad sitemap"


def test_meta_tags(spark):
    r = reports.meta_tag_block(spark.createDataFrame([(1, "<T>", "", "")], "key int, title string, description string, canonical string")).first()
    assert "<title>&lt;T&gt;</title>" in r.block and '<meta property="og:title" content="&lt;T&gt;">' in r.block and r.warnings == "no description; no canonical; no image"


def test_markup_of_all_kinds(spark):
    columns = "name description steps supplies ingredients instructions headline author publisher date_published url thumbnail_url upload_date start_date location_name image title date_posted hiring_org city country provider_name item_name rating_value operating_system application_category salary_min same_as price".split()
    df = spark.createDataFrame([(1, *("a\nb" if c in ("steps", "supplies", "ingredients", "instructions", "same_as") else c for c in columns), [("Q", "A"), ("", "x")], [("Home", "/"), ("B", None)])], "key int, " + ", ".join(f"{c} string" for c in columns) + ", faq_items array<struct<question:string,answer:string>>, items array<struct<name:string,url:string>>")
    for kind in markup.FORMS:
        r = markup.jsonld_markup(df, kind).first()
        value = json.loads(r.json)
        assert value["@context"] == "https://schema.org" and value["@type"] and r.warnings == "", kind
    assert json.loads(markup.jsonld_markup(df, "faq").first().json)["mainEntity"] == [{"@type": "Question", "name": "Q", "acceptedAnswer": {"@type": "Answer", "text": "A"}}]
    assert [x["position"] for x in json.loads(markup.jsonld_markup(df, "breadcrumb").first().json)["itemListElement"]] == [1, 2]
    blank = spark.createDataFrame([(1, " ")], "key int, name string")
    r = markup.jsonld_markup(blank, "organization").first()
    assert json.loads(r.json) == {"@context": "https://schema.org", "@type": "Organization", "name": "", "url": ""} and r.warnings == "missing name; missing url"


def test_submission_batches(spark):
    rows = spark.range(25).selectExpr("concat('https://h.example/', id) AS url").unionByName(spark.createDataFrame([("http://localhost/",), ("https://o.example/",)], "url string"))
    got = reports.submission_batches(rows, "k", 10).collect()
    assert sum(r.n for r in got) == 26 and max(r.n for r in got) <= 10
    payload = json.loads(next(r.payload for r in got if r.host == "o.example"))
    assert payload == {"host": "o.example", "key": "k", "keyLocation": "https://o.example/k.txt", "urlList": ["https://o.example/"]}


# logs and streams


def test_login_pages_and_bounds(spark):
    rows = spark.createDataFrame([(i, "u" if i % 2 else "v", dt.datetime(2026, 1, 1) + dt.timedelta(seconds=i), i % 3 == 0) for i in range(600)], "id int, username string, ts timestamp, success boolean")
    assert logs.login_history(rows, limit=9999).count() == 500 and [r.id for r in logs.login_history(rows, False, 2, 1, "u").collect()] == [595, 593]
    assert logs.login_count(rows, True).first().total == 200
    log = spark.createDataFrame([("GET", "/", 200, x) for x in (0.005, 30.0, 30.1)], "method string, endpoint string, status int, duration_s double")
    r = logs.http_metrics(log).first()
    assert (r.n, r.le_0, r.le_10, r.le_11) == (3, 1, 1, 2)


def _stream(spark, rows, ddl, path):
    spark.createDataFrame(rows, ddl).write.mode("append").parquet(path)
    return spark.readStream.schema(ddl).parquet(path)


def test_stream_of_page_audits(spark, tmp_path):
    pages = _stream(spark, [(1, "https://h.example/", "<title>x</title>"), (2, "https://h.example/b", None)], "page_id long, url string, html string", str(tmp_path / "in"))
    jobs.write_page_audits(pages, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/audits")).count() == 2 and spark.read.parquet(str(tmp_path / "out/checks")).select("tool").distinct().count() == 20


def test_exact_lockouts_reset_on_success(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [("u", at(i), False) for i in range(5)] + [("u", at(10), False), ("v", at(0), False), ("v", at(1), False), ("v", at(2), False), ("v", at(3), False), ("v", at(4), True), ("v", at(5), False), ("v", at(6), False), ("w", at(0), False)] + [("u", at(2000), False)]
    stream = _stream(spark, rows, "username string, ts timestamp, success boolean", str(tmp_path / "in"))
    q = jobs.login_lockout_exact(stream).writeStream.format("memory").queryName("exact").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.username, r.ts, r.failures) for r in spark.table("exact").collect()] == [("u", at(10), 5)]


def test_progress_and_sessions(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", "u1", t0, "fail", 10, 2), ("r", "u1", t0 + dt.timedelta(seconds=5), "pass", 90, 2), ("r", "u2", t0, "pass", 50, 2)]
    df = spark.createDataFrame(rows, "run_id string, url string, ts timestamp, status string, score int, total int")
    assert {r.url: r.status for r in jobs.dedupe_progress(df).collect()} == {"u1": "pass", "u2": "pass"}
    stream = _stream(spark, rows, df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), str(tmp_path / "in"))
    q = jobs.run_progress(stream).writeStream.format("memory").queryName("progress").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.done, r.total, r.failed, r.mean_score) for r in spark.table("progress").collect()] == [(3, 2, 1, 50.0)]
    visits = spark.createDataFrame([("u", t0), ("u", t0 + dt.timedelta(minutes=29)), ("u", t0 + dt.timedelta(minutes=70))], "username string, ts timestamp")
    assert sorted(r.n for r in jobs.session_activity(visits).collect()) == [1, 2]


def test_retention(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1), "2026-01-01"), (dt.datetime(2026, 6, 1), "2026-06-01")], "ts timestamp, day string")
    assert jobs.retention(df, "2026-06-02").count() == 1
    df.write.partitionBy("day").parquet(str(tmp_path / "x"))
    assert jobs.drop_expired(spark, str(tmp_path / "x"), "2026-06-02") == ["day=2026-01-01"]
    assert spark.read.parquet(str(tmp_path / "x")).count() == 1


@pytest.mark.parametrize(
    "reference, want",
    [  # examples of the generic syntax, section 5.4
        ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"),
        ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"), (";x", "http://a/b/c/;x"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"),
        ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), ("..g", "http://a/b/c/..g"), ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"),
        ("g?y/../x", "http://a/b/c/g?y/../x"), ("g#s/../x", "http://a/b/c/g#s/../x"), (None, None),
    ],
)
def test_references_are_resolved(spark, reference, want):
    df = spark.createDataFrame([("http://a/b/c/d;p?q", reference)], "base string, reference string")
    assert df.select(urls.resolve(F.col("base"), F.col("reference"))).first()[0] == want


def test_odd_keyword_payloads(spark):
    wrap = lambda items: json.dumps({"tasks": [{"result": [{"items": items}]}]})
    good = {"keyword": "a", "keyword_info": {"search_volume": 5, "monthly_searches": [{"year": 2026, "month": 0, "search_volume": 1}, {"year": 2026, "month": 3}, {"month": 2}]}}
    rows = [("ideas", "x", wrap([3, "keyword", None, good, {"keyword": 7}, {"keyword": " "}, {"keyword": "b", "keyword_info": "none"}])), ("related", "x", wrap([good, {"keyword_data": good}, {"keyword_data": 5}]))]
    rows += [("ideas", s, p) for s, p in (("1", "{}"), ("2", None), ("3", '{"tasks": []}'), ("4", '{"tasks": [{"result": null}]}'), ("5", wrap({})))]
    got = {(r.source, r.keyword): r for r in keywords.map_keyword_json(spark.createDataFrame(rows, "source string, seed string, payload string")).collect()}
    assert set(got) == {("ideas", "a"), ("ideas", "b"), ("related", "a")} and got["ideas", "b"].search_volume is None
    assert [(t.year, t.month, t.search_volume) for t in got["ideas", "a"].trend] == [(2026, 3, 0)]


def test_page_cap_and_root_icons(spark, tmp_path):
    pages = [(1, "https://a.example/x", "<title>t</title>"), (2, "https://b.example/x", '<link rel="apple-touch-icon" href="/a.png">'), (3, "https://a.example/y", None), (4, "https://c.example", '<link rel="icon" href="/i.ico">' + "x" * 90)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    read = facts.read_pages(spark, str(tmp_path / "p"), 100)
    assert sorted(r.page_id for r in read.collect()) == [1, 2, 3] and [r.html_bytes for r in facts.over_cap(spark.read.parquet(str(tmp_path / "p")), 100).collect()] == [121]
    log = spark.createDataFrame([("https://a.example/favicon.ico", 200), ("https://a.example/favicon.ico", 200), ("https://b.example/favicon.ico", 404), ("https://c.example/favicon.ico", 200)], "url string, status int")
    got = {r.url: (r.status, r.message) for r in checks.favicon_check(facts.extract_facts(spark.read.parquet(str(tmp_path / "p"))), log).collect()}
    assert got == {"https://a.example/x": ("warning", "root icon"), "https://b.example/x": ("warning", "apple-touch-icon"), "https://a.example/y": ("warning", "root icon"), "https://c.example": ("warning", "icon")}
