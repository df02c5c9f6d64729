"""Cases of the audit rules, thresholds, iterative joins and streams."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text, urls
from pagewright.operators import checks, facts, links, logs, scoring, search
from pagewright.plans import base, registry
from pagewright.streaming import jobs

SF = "/root/testdata/sf0.001"


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_url_functions(spark):
    u = ["https://example.com/", "https://example.com", "https://example.com/blog/my-post", "https://example.com/category/python", "https://example.com/tag/python", "https://example.com/a/b/c/d/e", "https://example.com/853.html"]
    assert one(spark, urls.crawl_depth, *u) == [0, 0, 2, 2, 2, 5, 1]
    assert one(spark, urls.url_type, *u) == ["Homepage", "Homepage", "Blog", "Category", "Tag", "A", "853.Html"]
    assert one(spark, urls.priority, *u) == ["High", "High", "Medium", "High", "Low", "Low", "High"]
    assert set(one(spark, urls.match_key, "https://www.example.com/path/", "http://example.com/path#section", "https://EXAMPLE.COM/Path?x=1")) == {"example.com/path"}
    assert one(spark, urls.non_indexable_reason, "https://a.b/x.PDF?q#f", "https://a.b/x?q#f", "https://a.b/x#f", "https://a.b/x") == ["file extension .pdf", "query parameters", "fragment", None]
    ok = ["https://example.com/x", "http://8.8.8.8/"]
    bad = ["ftp://example.com", "http://localhost/", "http://10.0.0.1/", "http://172.16.0.1", "http://192.168.1.1", "http://127.0.0.1:8080/", "https://exa mple.com", "nothing", None, "http://[::1]/", "http://169.254.169.254/"]
    assert one(spark, urls.is_public_url, *ok, *bad) == [True] * 2 + [False] * 11


def test_text_functions(spark):
    assert one(spark, text.pixel_width, "ab", "漢a") == [15.0, 21.5]
    assert one(spark, text.normalize_text, "  A  b\n C", None) == ["a b c", ""]
    assert one(spark, text.escape_xml, "<a b=\"c\">&'") == ["&lt;a b=&quot;c&quot;&gt;&amp;&apos;"]
    assert [d and d.date() for d in one(spark, text.parse_date_signal, "2026-01-01", "2026-01-01T10:00:00Z", "Tue, 06 Jan 2026 10:00:00 GMT", "not-a-date")] == [dt.date(2026, 1, 1), dt.date(2026, 1, 1), dt.date(2026, 1, 6), None]
    assert one(spark, text.is_error_status, "Error", "Timeout", "Indexed", "", None) == [True, True, False, False, False]
    assert one(spark, text.csv_safe, "=1+1", " -x", "plain", "@a") == ["'=1+1", "' -x", "plain", "'@a"]
    assert one(spark, lambda c: text.reading_minutes(c.cast("int")), "0", "100", "550") == [0, 1, 2]


def statuses(spark, source, url="https://h.example/a-b"):
    df = spark.createDataFrame([(1, url, source)], "page_id long, url string, html string")
    return {r.tool: r.status for r in checks.run_checks(facts.extract_facts(df)).collect()}


@pytest.mark.parametrize("n, want", [(0, "fail"), (29, "warning"), (30, "pass"), (60, "pass"), (61, "warning")])
def test_title_bounds(spark, n, want):
    assert statuses(spark, f"<title>{'x' * n}</title>")["title"] == want


@pytest.mark.parametrize("n, want", [(299, "fail"), (300, "warning"), (599, "warning"), (600, "pass"), (2500, "pass"), (2501, "warning")])
def test_word_bounds(spark, n, want):
    assert statuses(spark, f"<body><nav>no no</nav><p>{'ab ' * n} a</p><script>xx yy</script></body>")["word_count"] == want


def test_page_checks(spark):
    good = """<html lang="en"><head><title>A title of a sensible length here</title><meta name="viewport" content="width=device-width">
    <meta name="Description" content="%s"><link rel="canonical" href="https://h.example/a-b/"><link rel="icon" href="/i"><link rel="apple-touch-icon" href="/j">
    <link rel="alternate" hreflang="en" href="/"><link rel="alternate" hreflang="x-default" href="/"><script type="application/ld+json">{"@type": "Article"}</script>
    <script src="/x.js" defer></script>%s</head><body><h1>One</h1><h2>Two</h2><a href="/a">a</a><a href="b">b</a><a href="/c">c</a><img src="/i.webp" alt="" width=1 height=1 fetchpriority="high"></body></html>"""
    og = "".join(f'<meta property="og:{k}" content="v">' for k in ("title", "description", "image", "url", "type")) + '<meta name="twitter:card" content="v">'
    s = statuses(spark, good % ("d" * 80, og))
    passed = {"title", "meta_description", "headings", "image_alt", "internal_links", "schema", "hreflang", "og_tags", "mixed_content", "meta_robots", "favicon", "viewport", "lang_attr", "url_structure", "render_blocking", "image_optimization", "canonical"}
    assert {t for t in passed if s[t] != "pass"} == set()
    bad = '<meta name="robots" content="noindex"><h1>a</h1><h1>b</h1><img src="http://x/y.png"><script src=http://x/a.js></script><script type="application/ld+json">{bad</script>'
    s = statuses(spark, bad, "https://h.example/A_b?sid=1")
    assert (s["meta_robots"], s["headings"], s["image_alt"], s["mixed_content"], s["schema"], s["url_structure"], s["viewport"], s["lang_attr"]) == ("fail", "warning", "fail", "warning", "fail", "fail", "fail", "fail")


def test_facts_of_odd_pages(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "https://h/", "<p>a<script>var t='</p>'</script><b>b")], "page_id long, url string, html string")
    assert [r.visible_text for r in facts.extract_facts(df).orderBy(F.length("visible_text")).collect()] == ["", "", "a b"]
    assert facts.jsonld_types('{"@graph": [{"@type": ["A", "B"]}, {"@type": "C"}]}') == ["A", "B", "C"] and facts.jsonld_types("{") is None


def test_score_and_priorities(spark):
    rows = [("u", "title", "pass", "m"), ("u", "setup", "error", "m"), ("u", "traffic_share", "fail", "m")]
    df = spark.createDataFrame(rows, "url string, tool string, status string, message string")
    assert scoring.seo_score(df).first().score == 100
    issues = spark.createDataFrame([("u", "og_tags", "warning", "m"), ("u", "ssl", "fail", "m"), ("u", "meta_description", "warning", "m"), ("u", "new_tool", "fail", "m"), ("u", "title", "pass", "m")], df.schema)
    got = {r.tool: r.priority for r in scoring.score_issues(issues).collect()}
    assert got == {"ssl": 5.0, "meta_description": 3.5, "og_tags": 2.5, "new_tool": 2.5}


def test_compare_audits(spark):
    s = "url string, tool string, status string, message string"
    cur = spark.createDataFrame([("p1", "title", "pass", ""), ("p2", "title", "pass", ""), ("p2", "ssl", "fail", ""), ("p3", "title", "pass", "")], s)
    prev = spark.createDataFrame([("p1", "title", "warning", ""), ("p2", "title", "pass", ""), ("p2", "ssl", "pass", "")], s)
    got = {r.url: (r.verdict, r.resolved, r.new_issues) for r in scoring.compare_audits(cur, prev).collect()}
    assert got == {"p1": ("improved", "title", ""), "p2": ("regressed", "", "ssl")}


def test_score_reports_hold_all_pages(spark):
    urls_ = {r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()}
    scores = {r.url: r.score for r in registry.QUERIES["seo_score_checked"](spark, SF).collect()}
    assert set(scores) == urls_ and registry.QUERIES["run_summary_checked"](spark, SF).first().urls == len(urls_)
    worst = {r.url: r.score for r in registry.QUERIES["worst_pages"](spark, SF).collect()}
    assert worst.items() <= scores.items()
    for name in ("status_counts", "issue_frequency", "score_issues", "fix_next", "top_issue_per_url", "issue_digest", "audit_crosstab"):
        assert registry.QUERIES[f"{name}_checked"](spark, SF).count() > 0


def test_every_run_meets_its_predecessor(spark):
    duck = pytest.importorskip("duckdb").connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    seen = {}
    for name in ("compare_index_runs", "resume_remaining", "merge_retry", "url_changes"):
        got = sorted(map(tuple, registry.QUERIES[f"{name}_all"](spark, SF).collect()))
        assert got == sorted(duck.execute(registry.ORACLE_SQL[f"{name}_all"]).fetchall())
        seen[name] = {r[0] for r in got}
        one = sorted(map(tuple, registry.QUERIES[name](spark, SF).collect()))
        assert [r[1:] for r in got if r[0] == "run1996"] == one
    assert seen["url_changes"] == seen["merge_retry"] == {r.run_id for r in registry.QUERIES["previous_run"](spark, SF).collect() if r.previous}


def test_redirects_and_loops(spark):
    rows = [("a", 301, "b"), ("b", 302, "c"), ("c", 200, None), ("x", 301, "y"), ("y", 301, "x"), ("z", 301, "gone")]
    df = spark.createDataFrame(rows, "url string, status int, location string")
    got = {r.url: (r.final_url, r.hops, r.codes, r.is_loop, r.verdict) for r in links.redirect_chains(df).collect()}
    assert got == {"a": ("c", 2, "301>302", False, "fail"), "b": ("c", 1, "302", False, "warning"), "x": ("x", 2, "301>301", True, "fail"), "y": ("y", 2, "301>301", True, "fail"), "z": ("gone", 1, "301", False, "warning")}


def test_robots_first_match_wins(spark):
    pages = spark.createDataFrame([("https://h/a/b",), ("https://h/c",), ("https://other/a",)], "url string")
    rules = spark.createDataFrame([("h", 0, "*", 0, False, "/a"), ("h", 0, "*", 1, True, "/a/b"), ("h", 1, "Googlebot", 0, False, "/c")], "host string, block int, user_agent string, rule_idx int, allow boolean, path string")
    assert {r.url: r.allowed for r in links.robots_allowed(pages, rules).collect()} == {"https://h/a/b": False, "https://h/c": True, "https://other/a": True}
    assert {r.url: r.allowed for r in links.robots_allowed(pages, rules, "Googlebot").collect()} == {"https://h/a/b": True, "https://h/c": False, "https://other/a": True}


def test_sitemaps(spark):
    docs = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc>http://h/a.xml</loc></sitemap><sitemap><loc>i</loc></sitemap></sitemapindex>"), ("http://h/a.xml", "<urlset><url><loc><![CDATA[https://h/1]]></loc><lastmod>2026-01-01</lastmod></url><url><loc>https://h/2</loc><url><loc>mailto:x</loc></url>")], "sitemap_url string, body string")
    got = [(r.loc, r.lastmod) for r in links.parse_sitemaps(docs.where("sitemap_url <> 'i'")).collect()]
    assert got == [("https://h/1", "2026-01-01"), ("https://h/2", None)]
    roots = spark.createDataFrame([("i",)], "url string")
    assert {r.url: r.depth for r in links.expand_sitemap_index(docs, roots).collect()} == {"i": 0, "http://h/a.xml": 1}


def test_streams_equal_batch_and_drop_late_rows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "u", t0 + dt.timedelta(seconds=30 * i), "GET", "/", 200, 0.2) for i in range(20)] + [(99, "u", t0 + dt.timedelta(hours=5), "GET", "/", 200, 3.0)]
    spark.createDataFrame(rows, "id long, username string, ts timestamp, method string, endpoint string, status int, duration_s double").write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema("id long, username string, ts timestamp, method string, endpoint string, status int, duration_s double").parquet(str(tmp_path / "a"))
    q = jobs.http_metrics_stream(stream).writeStream.format("memory").queryName("metrics").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("metrics").agg(F.sum("n"), F.count("*")).first() == (20, 10)
    late = [(7, "u", t0, "GET", "/", 200, 0.2), (100, "u", t0 + dt.timedelta(hours=6), "GET", "/", 200, 0.2)]
    spark.createDataFrame(late, stream.schema).write.mode("append").parquet(str(tmp_path / "a"))
    q = jobs.http_metrics_stream(stream).writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 1


def test_lockout_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("u", t0 + dt.timedelta(minutes=i), False) for i in range(5)] + [("v", t0, False), ("w", t0 + dt.timedelta(hours=9), False)]
    spark.createDataFrame(rows, "username string, ts timestamp, success boolean").write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema("username string, ts timestamp, success boolean").parquet(str(tmp_path / "a"))
    q = jobs.login_lockout_stream(stream).writeStream.format("memory").queryName("locked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.username for r in spark.table("locked").collect()} == {"u"}


def test_entry_works_where_the_optional_parts_cannot_be_imported():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'seo_score' in q and 'pipeline' not in q and 'op2_simhash' not in q"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_entry_works_without_the_optional_parts(spark):
    code = "import sys, importlib.util as u; real = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith(('pagewright.llm', 'corpus_')) else real(n, *a); import __spark_entry__ as e; q = e.queries(); assert 'seo_score' in q and not any(x.startswith('op') and x[2].isdigit() for x in q) and set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_references_without_a_semicolon():
    html = "<title>a &amp; b&amp</title><script type='application/ld+json'>{\"x\": \"a&b\"}</script><p>c &lt d"
    assert facts.page_facts("https://u/", html)["title"] == "a & b&" and facts.page_facts("https://u/", html, True)["title"] == "a & b&amp"
    assert facts.page_facts("https://u/", html, True)["jsonld"] == ['{"x": "a&b"}'] and facts.page_facts("https://u/", html, True)["body_text"].endswith("c &lt d")


def test_a_paragraph_ends_where_the_next_begins():
    short = "<p><b>Of haesly edhest relyre threst.<br><p>All rights reserved here.</p>"
    assert facts.page_facts("https://u/", short)["intro_chars"] == 0
    assert facts.page_facts("https://u/", "<p>a<table><tr><td><p>" + "b" * 45 + "</table>")["intro_chars"] == 47


def test_titles_decode_the_references_asked_for():
    html = "<title>&quot;a&quot; &amp; b</title><body><h1>&quot;a&quot; &amp;amp; b</h1><h2>&quot;c&quot;</h2>"
    as_html, as_sql = facts.page_facts("https://u/", html), facts.page_facts("https://u/", html, **base.AS_SQL)
    assert as_html["title"] == '"a" & b' and [h["text"] for h in as_html["headings"]] == ['"a" &amp; b', '"c"']
    assert as_sql["title"] == "&quot;a&quot; & b" and [h["text"] for h in as_sql["headings"]] == ["&quot;a&quot; &amp; b", '"c"']
    assert as_sql["all_text"] == as_html["all_text"]


def test_any_paragraph_may_be_the_introduction():
    html = "<p>short</p>" * 30 + "<p>" + "b" * 45 + "</p>"
    assert facts.page_facts("https://u/", html)["intro_chars"] == 0
    assert facts.page_facts("https://u/", html, **base.AS_SQL)["intro_chars"] == 45


@pytest.mark.parametrize("name", ["duplicate_titles", "audit_details_checked", "course_signs", "score_issues_checked", "select_checks", "seo_score_checked"])
def test_titles_and_introductions_as_in_the_sql(spark, tmp_path, name):
    titles = ["&quot;" + "a" * 28, '""' + "x" * 40, "&quot;&quot;" + "x" * 40, "&quot;&quot;" + "x" * 40, "&quot;" * 6 + "t" * 30]
    body = "<p>short</p>" * 30 + "<p>" + "b" * 45 + "</p><footer></footer>"
    rows = [(i, f"https://u.example/{i}", f'<html lang="en"><head><title>{t}</title></head><body><h1>{t}</h1>{body}</body></html>') for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_only_the_columns_asked_for(spark):
    pages = spark.createDataFrame([("https://u/", "<a href='/x'>t</a>")], "url string, html string")
    got = facts.extract_facts(pages, columns=("url", "anchors"))
    assert got.columns == ["url", "anchors", "headers"] and got.first().anchors[0].dst == "https://u/x"


@pytest.mark.parametrize("name", ["rank_change", "rank_change_summary"])
def test_ranks_are_found_once(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan  # results were read again for each of two runs


def test_pages_are_parsed_once(spark):
    for name, most in (("issue_digest_checked", 1), ("broken_links_rich", 0), ("link_health_order", 0), ("broken_links", 0), ("link_health", 0)):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") <= most, name  # 2 before


def test_optimizer_context_of_pages_with_one_url(spark, tmp_path):
    spark.createDataFrame([(1, "https://u/", "<title>a</title>"), (2, "https://u/", "<title>b</title>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    os.symlink(f"{SF}/lineitem.parquet", tmp_path / "lineitem.parquet")
    assert sorted(r.url for r in registry.QUERIES["optimizer_context"](spark, str(tmp_path)).collect()) == ["u1", "u2"]  # 4 rows before
