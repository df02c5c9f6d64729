"""Metrics of hosts, vendors and lab runs: thresholds, grades, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import half_even, metric_value

# Pass and warning thresholds of vendor metrics, and how they compare.
THRESHOLDS = {
    "pagespeed": (">=", 90, 50), "mobile": (">=", 70, 50), "cwv_score": (">=", 0.9, 0.5), "backlinks": (">", 100, 10), "referring_domains": (">=", 50, 10), "domain_authority": (">=", 40, 20),
    "page_authority": (">=", 30, 15), "domain_rank": (">=", 50, 20), "spam_score": ("<=", 3, 7), "broken_backlinks": ("<=", 0, 10), "dofollow_share": (">=", 70, 50),
}
# Limits of a good and a middling lab metric (milliseconds are given in seconds), and its impact.
LAB = {
    "largest-contentful-paint": (2.5, 4.0, "high"), "cumulative-layout-shift": (0.1, 0.25, "medium"), "interaction-to-next-paint": (0.2, 0.5, "medium"),
    "total-blocking-time": (0.2, 0.6, "medium"), "first-contentful-paint": (1.8, 3.0, "low"), "speed-index": (3.4, 5.8, "low"),
}


def _fixed(values: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def metric_status(metrics: DataFrame) -> DataFrame:
    """Rows (url, metric, value) with their status; null values and unknown metrics give error."""
    m, v = F.col("metric"), F.col("value").cast("double")
    high, low = (_fixed({k: float(t[i]) for k, t in THRESHOLDS.items()}, m) for i in (1, 2))
    compare = lambda limit: F.when(_fixed({k: t[0] for k, t in THRESHOLDS.items()}, m) == "<=", v <= limit).when(_fixed({k: t[0] for k, t in THRESHOLDS.items()}, m) == ">", v > limit).otherwise(v >= limit)
    return metrics.select("url", "metric", "value", F.when(v.isNull() | high.isNull(), "error").when(compare(high), "pass").when(compare(low), "warning").otherwise("fail").alias("status"))


def cwv_grade(metric: Column, display: Column) -> Column:
    """good, needs_improvement or poor by a lab metric's displayed value; unknown if it is 0."""
    v = metric_value(display)
    good, fair = (_fixed({k: float(t[i]) for k, t in LAB.items()}, metric) for i in (0, 1))
    return F.when(F.coalesce(v, F.lit(0.0)) == 0, "unknown").when(v <= good, "good").when(v <= fair, "needs_improvement").otherwise("poor")


def performance_metrics(perf: DataFrame) -> DataFrame:
    """Grades of each lab metric of each url on mobile and desktop, and the worse of both. perf has
    url, strategy, metric, display_value."""
    graded = perf.where(F.col("metric").isin(*LAB)).withColumn("grade", cwv_grade(F.col("metric"), F.col("display_value")))
    g = graded.groupBy("url", "metric").pivot("strategy", ["mobile", "desktop"]).agg(F.max("grade"))
    both = F.array("mobile", "desktop")
    worst = F.when(F.array_contains(both, "poor"), "poor").when(F.array_contains(both, "needs_improvement"), "needs_improvement").otherwise("good")
    return g.select("url", "metric", *(F.coalesce(c, F.lit("unknown")).alias(c) for c in ("mobile", "desktop")), worst.alias("worst"), _fixed({k: t[2] for k, t in LAB.items()}, F.col("metric")).alias("impact"))


def performance_opportunities(perf: DataFrame) -> DataFrame:
    """Metrics of each url by urgency, scores, their gap and the overall grade. Scores are the rows
    of perf with metric performance_score."""
    m = performance_metrics(perf)
    named = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("metric")))), ",")
    poor, fair = F.col("worst") == "poor", F.col("worst") == "needs_improvement"
    b = m.groupBy("url").agg(named(poor & (F.col("impact") == "high")).alias("critical"), named((poor | fair) & (F.col("impact") == "medium")).alias("quick_wins"), named(fair & (F.col("impact") == "low")).alias("nice_to_have"))
    score = lambda s: F.coalesce(F.max(F.when(F.col("strategy") == s, F.col("score"))), F.lit(0.0))
    scores = perf.where("metric = 'performance_score'").groupBy("url").agg(score("mobile").alias("mobile_score"), score("desktop").alias("desktop_score"))
    j = b.join(scores, "url", "left").na.fill(0.0, ["mobile_score", "desktop_score"])
    overall = F.when(F.col("critical") != "", "critical").when(F.col("quick_wins") != "", "needs_work").when(F.col("mobile_score") >= 90, "good").otherwise("fair")
    return j.withColumn("gap", F.col("desktop_score") - F.col("mobile_score")).withColumn("overall", overall)


def host_facts_checks(hosts: DataFrame, as_of: str) -> DataFrame:
    """Check rows (host, tool, status) over host facts (host, cert_not_after, domain_created, spf,
    dmarc, mx): days left of the certificate, age of the domain, mail records."""
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    days = lambda c: F.floor(c / 86400)
    left, age = days(F.unix_timestamp(F.col("cert_not_after").cast("timestamp")) - now), days(now - F.unix_timestamp(F.col("domain_created").cast("timestamp")))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    mx = F.coalesce(F.size("mx") > 0, F.lit(False))
    missing = (~has("spf")).cast("int") + (~has("dmarc")).cast("int") + (~mx).cast("int")
    policy = F.lower(F.regexp_extract(F.coalesce("dmarc", F.lit("")), r"(?i)\bp\s*=\s*(\w+)", 1))
    rows = {
        "ssl": F.when(left.isNull(), "error").when(left < 14, "fail").when(left < 30, "warning").otherwise("pass"),
        "domain_age": F.when(age.isNull(), "error").when(age >= 2 * 365, "pass").when(age >= 365, "warning").otherwise("fail"),
        "dns_health": F.when(missing >= 2, "fail").when(missing == 1, "warning").otherwise("pass"),
        "spf": F.when(has("spf"), "pass").otherwise("fail"), "dmarc": F.when(~has("dmarc"), "fail").when(policy == "reject", "pass").otherwise("warning"), "mx_records": F.when(mx, "pass").otherwise("fail"),
    }
    return hosts.select("host", F.inline(F.array(*(F.struct(F.lit(t).alias("tool"), s.alias("status")) for t, s in rows.items()))))


def crawl_inspection_status(inspections: DataFrame) -> DataFrame:
    """Status of inspection results (url, result as JSON): crawl verdict, index state, manual actions."""
    at = lambda p: F.get_json_object("result", p)
    verdict = F.coalesce(at("$.indexStatusResult.verdict"), F.lit(""))
    manual = F.coalesce(at("$.manualActionsResult.verdict"), F.lit(""))
    actions = F.coalesce(F.json_array_length(at("$.manualActionsResult.manualActionInfo")), F.lit(0))
    return inspections.select(
        "url", F.when(verdict == "PASS", "pass").when(verdict == "NEUTRAL", "warning").otherwise("fail").alias("crawl_status"), F.when(verdict == "PASS", "Indexed").otherwise("Not Indexed").alias("index_status"),
        F.when((manual == "NO_MANUAL_ACTIONS") | (actions == 0), "pass").otherwise("fail").alias("manual_status"),
    )


def coverage_gaps(sitemaps: DataFrame) -> DataFrame:
    """Web contents of submitted sitemaps that are indexed in part. sitemaps has site, path and
    contents array<struct<type, submitted, indexed>>."""
    c = sitemaps.select("site", "path", F.inline("contents"))
    return c.where("type = 'WEB' AND submitted > 0 AND indexed > 0 AND submitted > indexed").select("site", "path", "submitted", "indexed", (F.col("submitted") - F.col("indexed")).alias("gap"))


def sitemap_status(sitemaps: DataFrame) -> DataFrame:
    """Submitted, indexed and rate of each sitemap; an issue if it has errors or under half indexed."""
    total = lambda f: F.aggregate("contents", F.lit(0).cast("long"), lambda acc, c: acc + F.coalesce(c[f].cast("long"), F.lit(0)))
    s = sitemaps.select("site", "path", total("submitted").alias("submitted"), total("indexed").alias("indexed"), F.coalesce("errors", F.lit(0)).alias("errors"))
    rate = F.when(F.col("submitted") > 0, half_even(100 * F.col("indexed") / F.col("submitted"), 1)).otherwise(0.0)
    return s.withColumn("rate", rate).withColumn("issue", (F.col("errors") > 0) | ((F.col("submitted") > 0) & (F.col("indexed") < 0.5 * F.col("submitted"))))


def sitemaps_status(sitemaps: DataFrame) -> DataFrame:
    """Sums of each site's sitemaps, the overall rate and the verdict."""
    s = sitemap_status(sitemaps).groupBy("site").agg(F.count("*").alias("sitemaps"), F.sum("submitted").alias("submitted"), F.sum("indexed").alias("indexed"), F.count_if("issue").alias("issues"))
    return s.withColumn("rate", F.when(F.col("submitted") > 0, half_even(100 * F.col("indexed") / F.col("submitted"), 1)).otherwise(0.0)).withColumn("verdict", F.when(F.col("issues") > 0, "fail").otherwise("pass"))


def last_n_days(stats: DataFrame, n: int = 30) -> DataFrame:
    """The latest n rows of each site by date."""
    w = Window.partitionBy("site").orderBy(F.col("date").desc())
    return stats.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def crawl_stats_summary(stats: DataFrame, n: int = 30) -> DataFrame:
    """Sums of the latest n days of each site (site, date, crawled, errors, dns, robots, conn)."""
    s = last_n_days(stats, n).groupBy("site").agg(*(F.sum(c).alias(c) for c in ("crawled", "errors", "dns", "robots", "conn")))
    failed = F.col("errors") > 0.05 * F.col("crawled")
    return s.withColumn("verdict", F.when(failed, "fail").when((F.col("dns") > 5) | (F.col("robots") > 0) | (F.col("conn") > 5), "warning").otherwise("pass"))


def bulk_usecase_summary(rows: DataFrame) -> DataFrame:
    """Mean score and summed counts over the rows (ok, score, n_pass, n_warning, n_fail) that are ok."""
    ok = F.col("ok")
    sums = [F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in ("n_pass", "n_warning", "n_fail")]
    return rows.agg(F.count("*").alias("urls"), F.count_if(ok).alias("ok"), half_even(F.avg(F.when(ok, F.col("score"))), 0).alias("avg_score"), *sums)
