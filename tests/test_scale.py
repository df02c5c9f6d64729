"""Operators that must not give a hot key, a long chain or a long list to one task."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pagewright.operators import links, logs, places, redirects, robots, scoring
from pagewright.sources import lists
from pagewright.sources import durable as durable_module

FETCH = "url string, status int, location string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# redirects


def followed(rows):
    """Chains one hop at a time."""
    to = {u: (str(s), v) for u, s, v in rows if v is not None}
    out = {}
    for u in to:
        path, codes, at = [], [], u
        while at in to and at not in path:
            path.append(at)
            codes.append(to[at][0])
            at = to[at][1]
        out[u] = (path, codes, at, at in path)
    return out


def test_chains_of_any_shape(spark):
    rng = random.Random(3)
    for trial in range(3):
        rows = [(f"u{i}", rng.choice([301, 302]), f"u{rng.randrange(60)}" if rng.random() < (0.6, 0.9, 1.0)[trial] else None) for i in range(60)]
        got = {r.url: (r.path, r.codes, r.final_url, r.is_loop) for r in redirects.follow(spark.createDataFrame(rows, FETCH)).collect()}
        assert got == followed(rows)


def test_a_thousand_hops_and_a_loop_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(redirects, "durable", lambda df: rounds.append(1) or durable_module.durable(df))
    rows = [(f"u{i}", 301, f"u{i + 1}") for i in range(1000)] + [(f"l{i}", 302, f"l{(i + 1) % 100}") for i in range(100)] + [("in", 301, "l7"), ("self", 301, "self"), ("ok", 200, None), (None, 301, "ok")]
    got = {r.url: r for r in redirects.redirect_report(spark.createDataFrame(rows, FETCH)).collect()}
    assert len(rounds) <= 12
    assert (got["u0"].hops, got["u0"].final_url, got["u999"].verdict) == (1000, "u1000", "warning")
    assert (got["l5"].hops, got["l5"].final_url, got["l5"].is_loop) == (100, "l5", True)
    assert (got["in"].hops, got["in"].final_url, got["self"].hops, got["self"].is_loop) == (101, "l7", 1, True)
    assert (got["ok"].hops, got["ok"].verdict, got["ok"].chain) == (0, "pass", "ok") and None not in got


def test_the_last_attempt_counts_and_schemes_mix(spark):
    rows = [("http://a", 1, 301, "http://b"), ("http://a", 2, 302, "https://c"), ("https://c", 1, 301, "http://d"), ("x", 1, 301, "y"), ("x", 2, 200, None)]
    got = {r.url: r for r in redirects.redirect_report(spark.createDataFrame(rows, "url string, attempt int, status int, location string")).collect()}
    assert (got["http://a"].codes, got["http://a"].chain, got["http://a"].mixed_scheme) == ("302>301", "http://a > https://c > http://d", True)
    assert not got["https://c"].mixed_scheme and got["x"].verdict == "pass"
    none = spark.createDataFrame([], FETCH)
    assert redirects.redirect_report(none).count() == 0 and redirects.redirect_chains(none).count() == 0


# substrings


def test_needles_of_every_length(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc.") for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    needles = ["".join(rng.choice("abc.") for _ in range(rng.randrange(0, 7))) for _ in range(60)] + ["aXb", "ü"]
    t, n = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in needles], "needle string")
    want = {(x, y) for x in texts for y in needles if y and y in x}
    for gram in (1, 3, 8):
        assert {(r.text, r.needle) for r in links.containing(t, n, gram).collect()} == want
    assert links.containing(t, n.limit(0)).count() == 0
    dealt = links.containing(t, n, 3, share=7)
    assert {(r.text, r.needle) for r in dealt.collect()} == want


def test_needles_that_are_dealt_out(spark):
    rng = random.Random(6)
    texts, needles = (["".join(rng.choice("abc.") for _ in range(rng.randrange(0, n))) for _ in range(m)] for n, m in ((14, 300), (7, 60)))
    t, n = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in [*needles, "aXb"]], "needle string")
    want = sorted({(x, y) for x in texts for y in needles if y and y in x})
    for share in (7, 100_000):
        got = links.containing(t, n, 3, share=share, few=0)
        assert sorted(map(tuple, got.collect())) == want
        assert not [line for line in plan_of(got).split("\n") if "BroadcastHashJoin" in line and "LeftOuter" not in line]


def test_what_is_kept_of_texts_is_a_row_for_each_needle(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(links, "durable", lambda df: kept.append(out := durable_module.durable(df)) or out)
    texts = spark.range(2000).selectExpr("concat('https://www.site', id % 9, '.example/', id) AS text")
    pairs = links.containing(texts, spark.range(9).selectExpr("concat('site', id, '.example') AS needle"))
    assert pairs.count() == 2000 and max(df.count() for df in kept) == 54  # 12,000 before
    assert "SortMergeJoin" not in plan_of(pairs)  # texts were dealt out by their parts


def test_texts_of_the_rank_tracker_are_not_broadcast(spark):
    serp = spark.range(3000).selectExpr("concat('k', id % 3) AS keyword", "cast(1 + id % 20 AS int) AS rank", "concat('https://www.site', id % 9, '.example/', id) AS link")
    ranks = links.rank_tracker(serp, spark.range(9).selectExpr("concat('site', id, '.example') AS domain"))
    assert ranks.where("rank IS NOT NULL").count() == 9
    # domains all alike look small where they are dealt out: no side that grows with the texts is broadcast
    assert not [line for line in plan_of(ranks).split("\n") if "BroadcastHashJoin" in line and ("[link" in line or "[keyword" in line or "share" in line)]


def test_a_hundred_thousand_targets_without_a_nested_loop(spark):
    serp = spark.range(4000).selectExpr("concat('k', id % 3) AS keyword", "cast(1 + id % 20 AS int) AS rank", "concat('https://www.site', id, '.example/x') AS link")
    targets = spark.range(100_000).selectExpr("concat('site', id, '.example') AS domain")
    ranks = links.rank_tracker(serp, targets)
    plan = plan_of(ranks)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ranks.count() == 300_000
    some = {(r.domain, r.keyword): r.rank for r in ranks.where("rank IS NOT NULL").collect()}
    assert some == {(f"site{i}.example", f"k{i % 3}"): 1 + i % 20 for i in range(4000)}


# histories of a hot user


def attempts_of(spark, n=1500, seed=2):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.9 else f"u{i % 9}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(40_000)), f"10.0.0.{rng.randrange(9)}", f"a{rng.randrange(6)}", rng.random() < 0.5) for i in range(n)]
    rows.append((n, "hot", None, "10.0.0.1", "a1", True))
    return rows, spark.createDataFrame(rows, "id long, username string, ts timestamp, ip string, user_agent string, success boolean")


def test_lockouts_over_bucket_bounds(spark):
    rows, df = attempts_of(spark)
    want = {}
    for i, user, ts, _, _, _ in rows:
        if ts:
            want[i] = sum(u == user and not ok and t is not None and ts - dt.timedelta(seconds=300) <= t <= ts and j != i for j, u, t, _, _, ok in rows)
    for span in (1, 4, 1000):
        got = {r.id: r.failures_before for r in logs.lockout_history(df, 300, span=span).collect()}
        assert {k: v for k, v in got.items() if k in want} == want and len(got) == len(rows)


def test_novel_logins_over_bucket_bounds(spark):
    rows, df = attempts_of(spark)
    want, past = {}, {}
    for i, user, ts, ip, agent, ok in sorted(rows, key=lambda r: (r[2] or dt.datetime.min, r[0])):
        if ok:
            seen = past.setdefault(user, [])
            want[i] = (ip, agent) not in seen[-7:]
            seen.append((ip, agent))
    for bucket_s in (60, 3600, 10**7):
        assert {r.id: r.novel for r in logs.novel_login(df, 7, bucket_s).collect()} == want


# places in large groups


def test_places_of_a_group_with_half_of_all_rows(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 2 else f"k{i % 40}", rng.randrange(50), f"p{i:05}") for i in range(4000)] + [(None, 1, "a"), (None, 2, "b")]
    df = spark.createDataFrame(rows, "key string, position int, page string").repartition(6)
    groups = {}
    for key, position, page in sorted(rows, key=lambda r: r[1:]):
        groups.setdefault(key, []).append((position, page))
    want = {(k, *r): i for k, g in groups.items() for i, r in enumerate(g, 1)}
    for large in (100, 60, 10**6):
        got = {(r.key, r.position, r.page): r.place for r in places.with_place(df, "key", "position", "page", large=large).collect()}
        assert got == want


def test_large_groups_lie_in_many_partitions(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(places, "durable", lambda df: seen.append(durable_module.durable(df)) or seen[-1])
    df = spark.range(20_000).selectExpr("'hot' AS key", "id * 7 % 20011 AS position")
    conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        places.with_place(df, "key", "position", large=1000).count()
        sizes = [r["count"] for r in seen[-1].groupBy("part_at").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)
    assert len(sizes) == 4 and max(sizes) < 10_000


# long lists


def test_a_list_over_many_splits_keeps_its_order(spark, tmp_path):
    lines = ["url,volume"] + [f"https://u.example/{i},{'x' * (i % 90)}" if i % 10 else "" for i in range(3000)]
    (tmp_path / "a.csv").write_text("\r\n".join(lines))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        numbered = lists.numbered_lines(spark, str(tmp_path / "a.csv"))
        assert numbered.select(F.spark_partition_id()).distinct().count() > 3
        assert [r.line for r in numbered.orderBy("pos").collect()] == lines
        found = lists.read_url_list(spark, str(tmp_path / "a.csv")).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [(r.pos, r.url) for r in found] == [(i, x.split(",")[0]) for i, x in enumerate(lines) if x.startswith("https")]


def test_two_lists_are_numbered_by_themselves(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text(f"https://{name}.example/0\nhttps://{name}.example/1\n")
    rows = lists.numbered_lines(spark, str(tmp_path)).collect()
    assert sorted((r.pos, r.line) for r in rows) == sorted((i, f"https://{n}.example/{i}") for n in "ab" for i in (0, 1))


# many rules


def test_ten_thousand_rules_of_a_host(spark):
    rng = random.Random(6)
    paths = ["/" + "/".join(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 7))) for _ in range(10_000)]
    rules = [("h", 1 + i // 5000, "*", i % 5000, rng.random() < 0.5, p) for i, p in enumerate(paths)] + [("g", 1, "bot", 0, False, "/"), ("g", 2, "*", 0, True, "/"), ("e", 1, "bot", 0, True, "")]
    pages = ["https://h" + p + rng.choice(["", "x", "/a/b?q=1", "#f"]) for p in rng.sample(paths, 300)] + ["https://h", "https://h?x", "https://g/z", "https://e/z", "https://none/a", "https://h"]
    df = spark.createDataFrame(rules, "host string, block int, user_agent string, rule_idx int, allow boolean, path string")
    ordered = sorted(r for r in rules if r[0] == "h")

    def slow(url):
        path = url.removeprefix("https://h").split("#")[0]
        path = "/" + path if not path or path[0] == "?" else path
        return next((r[4] for r in ordered if path.startswith(r[5])), True)

    verdicts = robots.robots_allowed(spark.createDataFrame([(p,) for p in pages], "url string"), df)
    got = verdicts.collect()
    assert len(got) == len(pages)
    assert {r.url: r.allowed for r in got if "//h" in r.url} == {u: slow(u) for u in pages if "//h" in u}
    assert {r.url: r.allowed for r in got if "//h" not in r.url} == {"https://g/z": True, "https://e/z": True, "https://none/a": True}
    bot = {r.url: r.allowed for r in robots.robots_allowed(spark.createDataFrame([("https://g/z",), ("https://e/z",)], "url string"), df, "Bot").collect()}
    assert bot == {"https://g/z": False, "https://e/z": True}


# crawls over bucketed edges


def test_edges_are_dealt_out_once(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(500)] + [(None, "n1"), ("n1", None)]
    plans = []
    original = links._reached
    monkeypatch.setattr(links, "_reached", lambda *a: plans.append((plan_of(original(*a).coalesce(1)), len(a[2]))) or original(*a))
    walked = links.crawl_edges(spark.createDataFrame(edges, "url string, to string"), spark.createDataFrame([("n0",), ("n1",), ("n1",), (None,)], "url string"), 4)
    got = {r.url: r.depth for r in walked.collect()}
    # rounds of one bucket number are not one partition
    assert {r.host: r.n for r in walked.groupBy(F.substring("url", 1, 1).alias("host")).agg(F.count("*").alias("n")).collect()} == {"n": len(got)} and walked.unionByName(walked).groupBy("url").count().count() == len(got)
    want, front = {"n0": 0, "n1": 0}, {"n0", "n1"}
    for d in range(1, 5):
        front = {b for a, b in edges if a in front and a and b} - want.keys()
        want |= dict.fromkeys(front, d)
    assert got == want and len(plans) == 4
    for plan, rounds in plans:
        # one exchange, that of the targets; broadcasts of a small side deal out nothing
        assert plan.count("Exchange hashpartitioning") == 1, plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pagewright_")]


# sketches


def test_sketches_of_days_add_up(spark):
    rows = spark.range(60_000).selectExpr("concat('https://r', (id * 7) % if(id % 2 = 0, 5000, 12000), '.example/') AS src_url", "concat('https://t', id % 2, '.example/') AS dst_url", "if(id % 3 = 0, 'nofollow', '') AS rel", "cast(id % 9 AS int) AS day")
    exact = {r.domain: r for r in links.backlink_summary(rows).collect()}
    days = links.backlink_days(rows)
    assert days.count() == 18
    for r in links.backlink_rollup(days.where("day < 4").unionByName(days.where("day >= 4"))).collect():
        e = exact[r.domain]
        assert (r.backlinks, r.dofollow, r.domains_verdict) == (e.backlinks, e.dofollow, e.domains_verdict)
        assert abs(r.referring_domains - e.referring_domains) < 0.05 * e.referring_domains


def test_a_cube_takes_one_row_a_pair(spark):
    rows = spark.range(1000).selectExpr("concat('https://h', id % 3, '/', id) AS url", "concat('t', id % 2) AS tool", "if(id % 5 = 0, 'fail', 'pass') AS status")
    cube = scoring.audit_crosstab(rows)
    plan = plan_of(cube)
    got = {(r.host, r.tool, r.level): (r.n, r.n_fail) for r in cube.collect()}
    assert got[None, None, 3] == (1000, 200) and got["h0", None, 1] == (334, 67) and len(got) == 12
    assert plan.index("Expand") < plan.rindex("HashAggregate(keys=[") and plan.count("HashAggregate") == 4
