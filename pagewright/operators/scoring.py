"""Check rows to scores, frequencies and priorities; run against run."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import half_even, score_band
from pagewright.sources.derived import TOOLS, UNSCORED


def _lookup(values: dict, default) -> Column:
    """A small fixed table as a map expression: no join."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))
    return F.coalesce(m[F.col("tool")], F.lit(default))


def _score_parts() -> tuple[Column, Column]:
    """Weight of a check row, null if it does not count, and what it earned."""
    scored = (F.col("status") != "error") & ~F.col("tool").isin(*UNSCORED)
    w = F.when(scored, _lookup({t: w for t, w, _, _ in TOOLS if w}, 2))
    return w, w * F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warning", 0.5).otherwise(0.0)


def _score() -> Column:
    weight, earned = _score_parts()
    return F.coalesce(half_even(100 * F.sum(earned) / F.sum(weight), 0), F.lit(0.0)).cast("int").alias("score")


def _counts(errors_as_fail: bool = True) -> list[Column]:
    fail = F.col("status").isin("fail", "error") if errors_as_fail else F.col("status") == "fail"
    return [F.count_if(F.col("status") == "pass").alias("n_pass"), F.count_if(F.col("status") == "warning").alias("n_warning"), F.count_if(fail).alias("n_fail")]


def _top_issue() -> Column:
    """Message of the first failure or error by message, else of the first warning."""
    bad = F.col("status") != "pass"
    cls = F.when(F.col("status").isin("fail", "error"), 0).otherwise(1)
    return F.min_by("message", F.when(bad, F.struct(cls.alias("c"), F.col("message")))).alias("top_issue")


def seo_score(results: DataFrame, *keys: str) -> DataFrame:
    """Weighted share of passed checks, 0 to 100; a warning counts half, errors and reports do not."""
    return results.groupBy(*(keys or ("url",))).agg(_score())


def status_counts(results: DataFrame, errors_as_fail: bool = True) -> DataFrame:
    return results.groupBy("url").agg(*_counts(errors_as_fail))


def audits(results: DataFrame, top_issue: bool = False) -> DataFrame:
    """Score and counts of each url, and its issue to fix first, in one grouping."""
    return results.groupBy("url").agg(_score(), *_counts(), *([_top_issue()] if top_issue else []))


def run_summary(audit_rows: DataFrame, *keys: str) -> DataFrame:
    """Totals of audits, of each run if keys name it."""
    band = score_band(F.col("score"))
    totals = [F.count("*").alias("urls"), half_even(F.avg("score"), 0).alias("avg_score"), F.sum("n_fail").alias("issues"), F.sum("n_warning").alias("warnings"), *(F.count_if(band == b).alias(b) for b in ("excellent", "good", "poor"))]
    return audit_rows.groupBy(*keys).agg(*totals) if keys else audit_rows.agg(*totals)


def issue_frequency(results: DataFrame, k: int = 10) -> DataFrame:
    return results.where(F.col("status") != "pass").groupBy("tool").agg(F.count("*").alias("n"), F.array_size(F.collect_set(F.when(F.col("status") != "warning", F.col("status")))).alias("kinds")).orderBy(F.col("n").desc(), "tool").limit(k)


def issue_samples(results: DataFrame, k: int = 5) -> DataFrame:
    """The first k urls of each tool's failures and errors. Each task keeps k urls a tool."""
    rows = results.where(F.col("status").isin("fail", "error")).select("tool", "url").distinct()
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("tool").orderBy("url"))).where(F.col("rn") <= k)
    return first.groupBy("tool").agg(F.array_join(F.array_sort(F.collect_list("url")), ",").alias("sample_urls"))


def score_issues(results: DataFrame) -> DataFrame:
    """Rows that do not pass, with impact, effort and priority."""
    impact = _lookup({t: i for t, _, i, _ in TOOLS if i}, 5)
    effort = _lookup({t: e for t, _, _, e in TOOLS if e}, "medium")
    weight = F.when(F.col("status") == "fail", 1.0).when(F.col("status") == "warning", 0.5).otherwise(0.7)
    rows = results.where(F.col("status") != "pass").withColumn("impact", impact).withColumn("effort", effort)
    rank = F.when(F.col("effort") == "low", 1).when(F.col("effort") == "medium", 2).otherwise(3)
    rows = rows.withColumn("priority", half_even(F.col("impact") * weight / rank, 3))
    return rows.withColumn("high_impact", F.col("impact") >= 8).withColumn("quick_win", (F.col("impact") >= 7) & (F.col("effort") == "low"))


def top_issue_per_url(results: DataFrame) -> DataFrame:
    """First failure or error of each url by message, else its first warning."""
    return results.where(F.col("status") != "pass").groupBy("url").agg(_top_issue())


def issue_digest(results: DataFrame, fails: int = 15, warnings: int = 10) -> DataFrame:
    """First failures and warnings of a run, by message: a report of fixed length. Check rows are
    made once, and every task keeps the first of each kind of its own."""
    w = Window.partitionBy("status").orderBy("message", "url")
    rows = results.where(F.col("status").isin("fail", "warning")).select("status", "message", "url").withColumn("line", F.row_number().over(w))
    first = rows.where(F.col("line") <= max(fails, warnings))  # a fixed number, by which each task limits its groups
    return first.where(F.col("line") <= F.when(F.col("status") == "fail", fails).otherwise(warnings)).select("status", "line", "message")


def audit_crosstab(results: DataFrame) -> DataFrame:
    """Check rows and failures of each host and tool, with subtotals. Rows are counted by pair first,
    so the cube unfolds one row for each pair."""
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    pairs = results.groupBy(host.alias("host"), "tool").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "fail").alias("n_fail"))
    return pairs.cube("host", "tool").agg(F.grouping_id().alias("level"), F.sum("n").alias("n"), F.sum("n_fail").alias("n_fail"))


def compare_audits(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """urls of both runs with both scores, their difference, and tools resolved and new."""
    bad = lambda c: F.coalesce(F.col(c).isin("fail", "warning"), F.lit(False))
    good = lambda c: F.coalesce(F.col(c) == "pass", F.lit(True))
    both = cur.select("url", "tool", F.col("status").alias("now")).join(prev.select("url", "tool", F.col("status").alias("was")), ["url", "tool"], "full")
    tools = both.groupBy("url").agg(F.sort_array(F.collect_list(F.when(bad("was") & good("now"), F.col("tool")))).alias("resolved"), F.sort_array(F.collect_list(F.when(bad("now") & good("was"), F.col("tool")))).alias("new"))
    s = seo_score(cur).withColumnRenamed("score", "score_now").join(seo_score(prev).withColumnRenamed("score", "score_was"), "url").join(tools, "url")
    delta = F.col("score_now") - F.col("score_was")
    return s.select("url", "score_was", "score_now", delta.alias("delta"), F.array_join("resolved", ",").alias("resolved"), F.array_join("new", ",").alias("new_issues"), F.when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("unchanged").alias("verdict"))


def compare_reports(a: DataFrame, b: DataFrame) -> DataFrame:
    """All urls of either report (url, score) with both scores, the change and what happened."""
    j = a.select("url", F.col("score").alias("a_score")).join(b.select("url", F.col("score").alias("b_score")), "url", "full")
    change = F.when(F.col("a_score").isNull(), "added").when(F.col("b_score").isNull(), "removed").when(F.col("b_score") > F.col("a_score"), "improved").when(F.col("b_score") < F.col("a_score"), "regressed").otherwise("unchanged")
    return j.select("url", "a_score", "b_score", (F.col("b_score") - F.col("a_score")).alias("delta"), change.alias("change"))


# index states


def latest_result(df: DataFrame, *keys: str, order: tuple[str, ...]) -> DataFrame:
    """Last row of each key in the given order: a grouped maximum, which combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def index_summary(status: DataFrame) -> DataFrame:
    s = status.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "Indexed").alias("indexed"), F.count_if(F.col("status") == "Not Indexed").alias("not_indexed"))
    return s.withColumn("other", F.col("total") - F.col("indexed") - F.col("not_indexed")).withColumn("rate", half_even(100 * F.col("indexed") / F.col("total"), 1))


def index_by_type(typed: DataFrame) -> DataFrame:
    kind = F.when(F.col("status").isin("Indexed", "Not Indexed"), F.col("status")).otherwise("Other")
    return typed.withColumn("kind", kind).groupBy("url_type").pivot("kind", ["Indexed", "Not Indexed", "Other"]).count().na.fill(0).select("url_type", F.col("Indexed").alias("indexed"), F.col("Not Indexed").alias("not_indexed"), F.col("Other").alias("other"))


def run_pairs(index: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (run_id, url, status) of each run that has a predecessor, and those of the predecessor
    under the run_id of the run they come before. runs is as previous_run gives it."""
    pairs = F.broadcast(runs.where("previous IS NOT NULL"))  # a row a run
    cur = index.join(pairs, "run_id").select("run_id", "url", "status")
    return cur, index.withColumnRenamed("run_id", "previous").join(pairs, "previous").select("run_id", "url", "status")


def compare_index_runs(cur: DataFrame, prev: DataFrame, *runs: str) -> DataFrame:
    """Changes of index state; with run columns, of each run against the rows of prev under it."""
    keys = [*runs, "url"]
    j = cur.select(*keys, F.col("status").alias("now")).join(prev.select(*keys, F.col("status").alias("was")), keys)
    change = F.when((F.col("was") != "Indexed") & (F.col("now") == "Indexed"), "newly indexed").when((F.col("was") == "Indexed") & (F.col("now") == "Not Indexed"), "newly de-indexed")
    return j.select(*keys, "was", "now", change.alias("change")).where("change IS NOT NULL")


def index_trend(status: DataFrame, n: int = 30) -> DataFrame:
    """Last n runs by the time of their last check (checked_at), with rate, the change to the run
    before, and whether no run of these has a better rate."""
    times = status.groupBy("run_id").agg(F.max("checked_at").alias("ts"))
    runs = index_summary(status).join(times, "run_id").orderBy(F.col("ts").desc(), F.col("run_id").desc()).limit(n + 1)
    w = Window.orderBy("ts", "run_id")  # at most n + 1 rows
    last = runs.withColumn("change", half_even(F.col("rate") - F.lag("rate").over(w), 1)).orderBy(F.col("ts").desc(), F.col("run_id").desc()).limit(n)
    return last.withColumn("best", F.col("rate") == F.max("rate").over(Window.partitionBy())).drop("ts")


def previous_run(status: DataFrame) -> DataFrame:
    """Each run with the latest one strictly before it, by its last check."""
    runs = status.groupBy("run_id").agg(F.max("checked_at").alias("ts"))  # a row a run
    return runs.select("run_id", F.lag("run_id").over(Window.orderBy("ts", "run_id")).alias("previous"))


def resume_remaining(urls: DataFrame, saved: DataFrame, *runs: str) -> DataFrame:
    keys = [*runs, "url"]
    return urls.join(saved.where(F.col("status").isin("Indexed", "Not Indexed")).select(*keys), keys, "left_anti")


def merge_retry(last: DataFrame, retried: DataFrame, *runs: str) -> DataFrame:
    keys = [*runs, "url"]
    return last.join(retried.select(*keys), keys, "left_anti").unionByName(retried)


def url_changes(cur: DataFrame, prev: DataFrame, *runs: str) -> DataFrame:
    """urls added and removed between two runs."""
    keys = [*runs, "url"]
    a, b = cur.select(*keys).distinct(), prev.select(*keys).distinct()
    return a.subtract(b).withColumn("change", F.lit("added")).unionByName(b.subtract(a).withColumn("change", F.lit("removed")))
