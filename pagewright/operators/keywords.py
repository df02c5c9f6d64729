"""Keywords of pages, targets, and of keyword research."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import coerce_float, coerce_int, half_even, intent, letter_words
from pagewright.operators.checks import serp_preview
from pagewright.operators.search import page_performance, top_per

# Words that are no keywords.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might shall can that this these those it its "
    "i you he she we they what which who how when where not no so if as up out about into than then also just more some any all very there their they're we're don't doesn't didn't it's i'm "
    "your our my his her"
).split()


def keyword_density(facts: DataFrame) -> DataFrame:
    """Count and density % of every keyword of each page (url, keyword, count, density, first_pos,
    total_words, unique_words, in_title, in_h1). Words are counted inside each page's row. Pages that
    share a url add up; what they differ in is taken of the first that has the keyword, by page_id if
    facts have it, else by its numbers of words, whichever order the rows come in."""
    words = F.filter(letter_words(F.col("density_text")), lambda w: ~w.isin(*STOP_WORDS))
    h1 = F.lower(F.array_join(F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"]), " "))
    place = F.col("page_id") if "page_id" in facts.columns else F.lit(0).cast("long")
    p = facts.select("url", place.alias("page"), words.alias("words"), F.lower(F.coalesce("title", F.lit(""))).alias("title"), h1.alias("h1"))
    # both numbers are taken before unfolding, once a page
    p = p.select("*", F.size("words").alias("total_words"), F.size(F.array_distinct("words")).alias("unique_words"))
    rows = p.select("url", "page", "title", "h1", "total_words", "unique_words", F.posexplode("words").alias("pos", "keyword"))
    # titles do not travel with the words
    rows = rows.select("url", "page", "total_words", "unique_words", "pos", "keyword", *(F.contains(x, F.col("keyword")).alias(f"in_{x}") for x in ("title", "h1")))
    c = rows.groupBy("url", "keyword").agg(F.count("*").alias("count"), F.min("pos").alias("first_pos"), F.min(F.struct("page", "total_words", "unique_words", "in_title", "in_h1")).alias("p"))
    return c.select("url", "keyword", "count", half_even(100 * F.col("count") / F.col("p.total_words"), 2).alias("density"), "first_pos", "p.total_words", "p.unique_words", "p.in_title", "p.in_h1")


def top_keywords_per_page(density: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent keywords of each page, those of equal count by first occurrence; where pages
    share a url two may have one, and go by the alphabet."""
    return top_per(density, "url", n, F.col("count").desc(), F.col("first_pos"), F.col("keyword"))


def optimizer_context(facts: DataFrame, search_rows: DataFrame, n: int = 10) -> DataFrame:
    """Title and description of each page with its top queries by clicks, as input of copy drafting."""
    top = top_per(page_performance(search_rows, "page", "query"), "page", n, F.col("clicks").desc(), F.col("query"))
    lists = top.groupBy(F.col("page").alias("url")).agg(F.array_sort(F.collect_list(F.struct("place", "query", "clicks", "ctr", "position"))).alias("queries"))
    return serp_preview(facts).select("url", "title", "description").join(lists, "url", "left").withColumn("n_queries", F.coalesce(F.size("queries"), F.lit(0)))


def keyword_targeting(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Issues and score of target keywords (url, keyword): in title and description, lengths, density
    among the page's twenty top keywords."""
    low = F.lower("keyword")
    found = top_keywords_per_page(keyword_density(facts)).select("url", F.col("keyword").alias("low"), "density")
    j = targets.select("url", "keyword", low.alias("low")).join(serp_preview(facts), "url").join(found, ["url", "low"], "left")
    d = F.coalesce("density", F.lit(0.0))
    errors = F.array_compact(F.array(F.when(~F.contains(F.lower("title"), F.col("low")), "not in title"), F.when(d == 0, "not in text")))
    warnings = F.array_compact(F.array(
        F.when(~F.contains(F.lower("description"), F.col("low")), "not in description"), F.when(F.col("title_chars") < 30, "short title").when(F.col("title_chars") > 65, "long title"),
        F.when(F.col("description_chars") < 70, "short description").when(F.col("description_chars") > 165, "long description"), F.when((d > 0) & (d < 0.5), "low density").when(d > 3.5, "high density"),
    ))
    score = F.greatest(F.lit(0), 100 - 25 * F.size(errors) - 10 * F.size(warnings)).cast("int")
    return j.select("url", "keyword", d.alias("density"), F.array_join(errors, "; ").alias("errors"), F.array_join(warnings, "; ").alias("warnings"), score.alias("score"))


_ITEM = (
    "struct<keyword:string,keyword_info:struct<search_volume:string,cpc:string,competition:string,monthly_searches:array<struct<year:int,month:int,search_volume:int>>>,"
    "keyword_info_normalized_with_clickstream:struct<search_volume:string,monthly_searches:array<struct<year:int,month:int,search_volume:int>>>,keyword_properties:struct<keyword_difficulty:string>,search_intent_info:struct<main_intent:string>>"
)
_ITEMS = "struct<keyword_data:" + _ITEM + "," + _ITEM.removeprefix("struct<")


def map_keyword_json(raw: DataFrame) -> DataFrame:
    """Keyword rows of vendor payloads (source, seed, payload as JSON). The related source holds an
    item's data in keyword_data, others in the item. A clickstream volume that is not 0 counts before
    the plain one; what is no number is null; months without year or number are left out; of equal
    keywords of a source and seed the first stays. A payload without items, an item that is no object
    and a keyword that is no text give no row, and leave the others alone."""
    texts = F.from_json(F.get_json_object("payload", "$.tasks[0].result[0].items"), "array<string>")
    items = raw.select("source", "seed", F.posexplode(texts).alias("pos", "text")).where("text LIKE '{%'").withColumn("i", F.from_json("text", _ITEMS))
    # a keyword is read as text whatever it is, so its quotes tell
    named = F.when(F.col("source") == "related", F.get_json_object("text", "$.keyword_data")).otherwise(F.col("text"))
    items = items.where(named.rlike(r'"keyword"\s*:\s*"'))
    own = F.struct(*(F.col(f"i.{c}").alias(c) for c in ("keyword", "keyword_info", "keyword_info_normalized_with_clickstream", "keyword_properties", "search_intent_info")))
    d = items.select("source", "seed", "pos", F.when(F.col("source") == "related", F.col("i.keyword_data")).otherwise(own).alias("d")).where("trim(d.keyword) <> ''")
    stream = F.col("d.keyword_info_normalized_with_clickstream")
    by_clicks = F.coalesce(~stream["search_volume"].isin("", "0", "0.0", "null"), F.lit(False))
    best = lambda f: F.when(by_clicks, stream[f]).otherwise(F.col("d.keyword_info")[f])
    rows = d.select(
        "source", "seed", "pos", F.regexp_replace(F.lower(F.trim("d.keyword")), r"\s+", " ").alias("keyword"), coerce_int(best("search_volume")).alias("search_volume"),
        F.transform(F.filter(best("monthly_searches"), lambda t: (t["year"] != 0) & (t["month"] != 0)), lambda t: F.struct(t["year"].alias("year"), t["month"].alias("month"), F.coalesce(t["search_volume"], F.lit(0)).alias("search_volume"))).alias("trend"),
        coerce_float(F.col("d.keyword_info.cpc")).alias("cpc"), coerce_float(F.col("d.keyword_info.competition")).alias("competition"), coerce_int(F.col("d.keyword_properties.keyword_difficulty")).alias("difficulty"), intent(F.col("d.search_intent_info.main_intent")).alias("intent"),
    )
    rest = [c for c in rows.columns if c not in ("source", "seed", "keyword")]
    # pos comes first in the struct; equal places of several payloads are told apart by their values
    return rows.groupBy("source", "seed", "keyword").agg(F.min(F.struct(*rest)).alias("r")).select("source", "seed", "keyword", "r.*")


# Sources in the order in which they are asked, and rows that are enough.
SOURCES, ENOUGH = ("related", "suggestions", "ideas"), 5


def keyword_fallback_merge(rows: DataFrame, limit: int = 100) -> DataFrame:
    """Merge of keyword rows (seed, source, pos, keyword, ...): sources are taken in order until a
    seed has five keywords besides itself; the first row of a keyword stays, up to limit."""
    order = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    first = Window.partitionBy("seed", "keyword").orderBy("rank", "pos")
    tagged = rows.withColumn("rank", order).where("rank > 0").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    new = tagged.groupBy("seed", "rank").agg(F.count_if(F.col("keyword") != F.col("seed")).alias("new"))
    before = F.coalesce(F.sum("new").over(Window.partitionBy("seed").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = new.withColumn("before", before).where(F.col("before") < ENOUGH).select("seed", "rank")
    w = Window.partitionBy("seed").orderBy("rank", "pos", "keyword")
    return tagged.join(asked, ["seed", "rank"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("rn", "rank")


def keyword_sources(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows that each source gave and that were kept, for each seed."""
    kept = merged.groupBy("seed", "source").agg(F.count("*").alias("kept"))
    return rows.groupBy("seed", "source").agg(F.count("*").alias("given")).join(kept, ["seed", "source"], "left").na.fill(0, ["kept"])
