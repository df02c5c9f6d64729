"""Search analytics: rows of page, query and date to opportunities, decay and cannibalization."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import half_even
from pagewright.operators.places import LARGE_GROUP, with_place
from pagewright.sources.derived import CTR_CURVE


def _raw_ctr() -> Column:
    return F.when(F.col("impressions") > 0, 100.0 * F.col("clicks") / F.col("impressions")).otherwise(0.0)


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Clicks, impressions, CTR % and impression-weighted mean position, not rounded."""
    sums = rows.groupBy(*(keys or ("page",))).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("w"))
    return sums.withColumn("raw_ctr", _raw_ctr()).withColumn("raw_position", F.col("w") / F.nullif("impressions", F.lit(0))).drop("w")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("ctr", half_even(F.col("raw_ctr"), 2)).withColumn("position", half_even(F.col("raw_position"), 1)).drop("raw_ctr", "raw_position")


def page_performance(rows: DataFrame, *keys: str) -> DataFrame:
    """Clicks, impressions, CTR % and impression-weighted mean position of each page."""
    return _rounded(_sums(rows, *keys)).withColumn("status", F.when(F.col("clicks") > 0, "pass").otherwise("warning"))


# Days of a reporting period.
PERIODS = {"week": 7, "month": 30, "6months": 180}


def site_performance(rows: DataFrame, as_of: str, period: str = "month") -> DataFrame:
    """page_performance of each site over the days of a period up to as_of."""
    since = F.date_sub(F.lit(as_of).cast("date"), PERIODS[period])
    return page_performance(rows.where((F.col("date") > since) & (F.col("date") <= F.lit(as_of).cast("date"))), "site")


def _low_ctr(rows: DataFrame, min_impressions: int, max_ctr: float, max_position: float) -> DataFrame:
    return _sums(rows).where((F.col("impressions") >= min_impressions) & (F.col("raw_ctr") < max_ctr) & (F.col("raw_position") <= max_position))


def low_ctr(rows: DataFrame, min_impressions: int = 100, max_ctr: float = 2.0, max_position: float = 20.0) -> DataFrame:
    """Pages with impressions, a low CTR and a good position; limits hold before rounding."""
    return _rounded(_low_ctr(rows, min_impressions, max_ctr, max_position))


def opportunity_pages(rows: DataFrame, min_impressions: int = 200, max_ctr: float = 3.0, max_position: float = 20.0) -> DataFrame:
    """Low CTR pages with the benchmark of their position, clicks to gain and an action; figures are
    rounded last."""
    curve = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CTR_CURVE.items()))
    place = F.least(F.greatest(half_even(F.col("raw_position"), 0).cast("int"), F.lit(1)), F.lit(10))
    gain = F.greatest(half_even((F.col("benchmark_ctr") - F.col("raw_ctr")) / 100 * F.col("impressions"), 0), F.lit(0.0)).cast("long")
    action = F.when(F.col("raw_position") <= 3, "rewrite title").when(F.col("raw_position") <= 10, "improve snippet").otherwise("strengthen content")
    pages = _low_ctr(rows, min_impressions, max_ctr, max_position).withColumn("benchmark_ctr", curve[place])
    return _rounded(pages.withColumn("extra_clicks", gain).withColumn("action", action))


def daily_positions(rows: DataFrame) -> DataFrame:
    """Impression-weighted position and clicks of each page and day."""
    return rows.groupBy("page", "date").agg((F.sum(F.col("position") * F.col("impressions")) / F.sum("impressions")).alias("position"), F.sum("clicks").alias("clicks"))


def position_decay(rows: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Pages whose mean daily position grew by the threshold from the first half of their days to
    the second; halves need five days. The window is over days, not rows: a page has one row a day."""
    w = Window.partitionBy("page")
    ranked = daily_positions(rows).withColumn("rn", F.row_number().over(w.orderBy("date"))).withColumn("half", F.floor(F.count("*").over(w) / 2))
    p = ranked.where("half >= 5").groupBy("page").agg(F.avg(F.when(F.col("rn") <= F.col("half"), F.col("position"))).alias("a"), F.avg(F.when(F.col("rn") > F.col("half"), F.col("position"))).alias("b"), F.sum("clicks").alias("total_clicks"))
    delta = F.col("b") - F.col("a")
    severity = F.when(delta >= 10, "high").when(delta >= 5, "medium").otherwise("low")
    return p.where(delta >= threshold).select("page", half_even(F.col("a"), 1).alias("pos_start"), half_even(F.col("b"), 1).alias("pos_end"), half_even(delta, 1).alias("delta"), "total_clicks", severity.alias("severity"))


def position_tracker(rows: DataFrame) -> DataFrame:
    """Mean, first and last of the daily positions of each site, which count rounded to one digit."""
    daily = rows.groupBy("site", "date").agg(half_even(F.sum(F.col("position") * F.col("impressions")) / F.sum("impressions"), 1).alias("p"))
    s = daily.groupBy("site").agg(F.avg("p").alias("a"), F.min_by("p", "date").alias("f"), F.max_by("p", "date").alias("l"), F.count("*").alias("days"))
    return s.select("site", "days", *(half_even(F.col(c), 1).alias(n) for c, n in (("a", "avg_position"), ("f", "first_position"), ("l", "last_position"))), (F.col("l") < F.col("f")).alias("improving"), F.when(F.col("a") <= 10, "pass").when(F.col("a") <= 30, "warning").otherwise("fail").alias("status"))


def _query_pages(rows: DataFrame, min_impressions: int) -> DataFrame:
    return page_performance(rows, "query", "page").where(F.col("impressions") >= min_impressions)


def keyword_cannibalization(rows: DataFrame, min_impressions: int = 50) -> DataFrame:
    """Queries with two pages or more: the winner has the best position."""
    q = _query_pages(rows, min_impressions).groupBy("query").agg(F.count("*").alias("n_pages"), F.min_by("page", F.struct("position", "page")).alias("winner"), F.sum("impressions").alias("total_impressions"))
    return q.where("n_pages >= 2").withColumn("action", F.when(F.col("n_pages") >= 3, "consolidate").otherwise("differentiate"))


def cannibal_rank(rows: DataFrame, min_impressions: int = 50, large: int = LARGE_GROUP) -> DataFrame:
    """Place of each page of a query by position, then page; a query of many pages is ranked over many tasks."""
    return with_place(_query_pages(rows, min_impressions).select("query", "page", "position"), "query", "position", "page", large=large)


def consolidation_map(rows: DataFrame, min_impressions: int = 50) -> DataFrame:
    """All weaker pages of cannibalized queries and the page each should redirect to. The winner is
    a minimum, which every task reduces first, so no query's pages are sorted in one place."""
    pages = _query_pages(rows, min_impressions).select("query", "page", "position")
    winners = pages.groupBy("query").agg(F.min_by("page", F.struct("position", "page")).alias("winner"), F.count("*").alias("n")).where("n > 1").drop("n")
    cut = lambda c: F.regexp_extract(c, r"^https?://[^/]*(/.*)$", 1)
    weaker = pages.join(winners, "query").where("page <> winner")
    return weaker.select("query", "page", "winner", F.concat(F.lit("Redirect 301 "), cut(F.col("page")), F.lit(" "), cut(F.col("winner"))).alias("rule"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)
