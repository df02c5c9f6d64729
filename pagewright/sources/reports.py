"""Sinks: reports, sitemaps, robots.txt, link and meta tags, JSON-LD, submission batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.text import csv_safe, escape_xml
from pagewright.operators.links import MAX_URLS

# Header of an index report and of an audit report, change frequencies, form of a locale.
INDEX_COLUMNS = ("#", "URL", "Google Indexed", "Priority", "Depth", "URL Type", "Checked At")
AUDIT_COLUMNS = ("URL", "SEO Score", "Pass", "Warnings", "Issues")
CHANGE_FREQUENCIES = ("always", "hourly", "daily", "weekly", "monthly", "yearly", "never")
LOCALE = r"(?i)^([a-z]{2,3}(-[a-z0-9]{2,8})?|x-default)$"
SITEMAP_HEAD, SITEMAP_END = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n', "\n</urlset>"
W3C_DATE = r"^\d{4}-\d{2}-\d{2}(T[\d:+\-Z.]+)?$"


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def index_report(index: DataFrame) -> DataFrame:
    """Index rows (num, url, status, checked_at) as the seven columns of the report; cells that a
    spreadsheet would take for a formula are quoted."""
    u = F.col("url")
    values = (F.col("num").cast("string"), csv_safe(u), csv_safe(F.col("status")), urls.priority(u), urls.crawl_depth(u).cast("string"), csv_safe(urls.url_type(u)), F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss"))
    return index.select(*(v.alias(c) for v, c in zip(values, INDEX_COLUMNS)))


def write_index_report(index: DataFrame, path: str) -> None:
    index_report(index).write.mode("overwrite").option("header", True).csv(path)


def audit_report(audits: DataFrame) -> DataFrame:
    """Audits (url, score, n_pass, n_warning, n_fail) as the columns of the report."""
    return audits.select(*(csv_safe(F.col(c).cast("string")).alias(n) for c, n in zip(("url", "score", "n_pass", "n_warning", "n_fail"), AUDIT_COLUMNS)))


def audit_details(results: DataFrame, chars: int = 200) -> DataFrame:
    """Check rows with values of so many characters at most, as the details report shows them."""
    return results.select("url", "tool", "status", F.substring("message", 1, chars).alias("message"))


def write_audit_report(audits: DataFrame, results: DataFrame, path: str, run_id: str) -> None:
    """The report as CSV and its details as Parquet, in a folder of the run."""
    audit_report(audits).write.mode("overwrite").option("header", True).csv(f"{path}/report/run_id={run_id}")
    audit_details(results).write.mode("overwrite").parquet(f"{path}/details/run_id={run_id}")


def sitemap_entries(rows: DataFrame) -> DataFrame:
    """Entries (url, lastmod, changefreq, priority) as XML fragments with warnings. A url that is not
    http(s) has no fragment; a bad date, frequency or priority is left out."""
    url, date, often, rank = _text("url"), _text("lastmod"), F.lower(_text("changefreq")), _text("priority")
    number = rank.try_cast("double")
    good_url, good_date, good_often = url.rlike("^(?i:https?):"), date.rlike(W3C_DATE), often.isin(*CHANGE_FREQUENCIES)
    good_rank = F.coalesce(number.between(0, 1), F.lit(False))
    tag = lambda name, v: F.concat(F.lit(f"    <{name}>"), escape_xml(v), F.lit(f"</{name}>"))
    xml = F.concat_ws("\n", F.lit("  <url>"), tag("loc", url), F.when(good_date, tag("lastmod", date)), F.when(good_often, tag("changefreq", often)), F.when(good_rank, tag("priority", rank)), F.lit("  </url>"))
    warnings = F.concat_ws("; ", F.when(~good_url, "bad scheme"), F.when((date != "") & ~good_date, "bad lastmod"), F.when((often != "") & ~good_often, "bad changefreq"), F.when((rank != "") & ~good_rank, "bad priority"))
    return rows.where(url != "").select(url.alias("url"), F.when(good_url, xml).alias("xml"), warnings.alias("warnings"))


def sitemap_shards(rows: DataFrame, max_per_file: int = MAX_URLS) -> DataFrame:
    """Whole sitemaps (shard, n, body) of at most so many urls. Shards are dealt out by a hash of the
    url: no global order and no single task."""
    good = sitemap_entries(rows).where("xml IS NOT NULL")
    n = good.count()
    shards = max(1, -(-n * 11 // (10 * max_per_file))) if n > max_per_file else 1
    dealt = good.withColumn("deal", F.pmod(F.xxhash64("url"), F.lit(shards)).cast("int"))
    # a dealt share that is larger by chance, or by repeats of one url, is cut by place
    placed = dealt.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("deal").orderBy("url")) - 1) / max_per_file).cast("int"))
    files = placed.groupBy("deal", "part").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("url", "xml"))), lambda x: x["xml"]), "\n").alias("items"))
    return files.select(F.concat_ws("-", "deal", "part").alias("shard"), "n", F.concat(F.lit(SITEMAP_HEAD), F.col("items"), F.lit(SITEMAP_END)).alias("body"))


#: Entries that lie in one stretch of a sitemap's text.
STRETCH = 50


def sitemap_digest(rows: DataFrame) -> DataFrame:
    """Number of urls and SHA-256 of the one sitemap of all urls, by url, of any number: what
    sitemap_shards gives if they fit one file. Entries are sorted in ranges and joined to stretches
    of text there. A digest is taken byte after byte, so one task reads the stretches in order; it
    holds none but those of a batch."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            urls_, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            starts = range(0, b.num_rows, STRETCH)
            cut = [texts[i : i + STRETCH] for i in starts]
            yield pa.RecordBatch.from_pydict({"url": [urls_[i] for i in starts], "first": [c[0] for c in cut], "at": pa.array(range(at, at + len(cut)), pa.int64()), "n": pa.array([len(c) for c in cut], pa.int64()), "items": ["\n".join(c) for c in cut]})
            at += len(cut)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, n = hashlib.sha256(SITEMAP_HEAD.encode()), 0
        for b in batches:
            for k, items in zip(b.column(0), b.column(1)):
                body.update(("\n" if n else "").encode() + items.as_py().encode())
                n += k.as_py()
        body.update(SITEMAP_END.encode())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "body_sha256": pa.array([body.hexdigest() if n else None], pa.string())})

    good = sitemap_entries(rows).where("xml IS NOT NULL").select("url", "xml")
    stretches = good.repartitionByRange("url", "xml").sortWithinPartitions("url", "xml").mapInArrow(lay, "url string, first string, at long, n long, items string")
    # the ranges do not overlap, so stretches are in order by what they begin with
    whole = stretches.repartition(1).sortWithinPartitions("url", "first", "at").select("n", "items").mapInArrow(digest, "n long, body_sha256 string")
    return whole.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("body_sha256").alias("body_sha256"))


def write_sitemaps(rows: DataFrame, path: str, max_per_file: int = MAX_URLS) -> None:
    """One text file a sitemap, in a folder of its shard."""
    sitemap_shards(rows, max_per_file).select("shard", F.col("body").alias("value")).write.mode("overwrite").partitionBy("shard").text(path)


def hreflang_tags(pairs: DataFrame) -> DataFrame:
    """Alternate links of each cluster (cluster, pos, locale, url) as tags and as a Link header, with
    the number of pairs that were left out."""
    locale, url = _text("locale"), _text("url")
    good = locale.rlike(LOCALE) & url.rlike("^(?i:https?):")
    rows = pairs.where((locale != "") & (url != "")).select("cluster", "pos", good.alias("good"), escape_xml(locale).alias("l"), escape_xml(url).alias("u"))
    tag = F.concat(F.lit('<link rel="alternate" hreflang="'), F.col("l"), F.lit('" href="'), F.col("u"), F.lit('">'))
    link = F.concat(F.lit("<"), F.col("u"), F.lit('>; rel="alternate"; hreflang="'), F.col("l"), F.lit('"'))
    lists = rows.groupBy("cluster").agg(F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("pos", tag.alias("tag"), link.alias("link"))))).alias("x"), F.count_if(~F.col("good")).alias("dropped"))
    join = lambda f, by: F.array_join(F.transform("x", lambda v: v[f]), by)
    return lists.select("cluster", join("tag", "\n").alias("html_tags"), F.when(F.size("x") > 0, F.concat(F.lit("Link: "), join("link", ", "))).otherwise("").alias("http_header"), F.size("x").alias("n"), "dropped")


def robots_txt(rules: DataFrame) -> DataFrame:
    """robots.txt of each host from rows (host, pos, user_agent, allow and disallow arrays,
    crawl_delay, sitemap). Line breaks are taken out of values; a delay that is no number and a
    sitemap that is not absolute are left out with a warning."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"[\r\n]", " "))
    agent = F.coalesce(F.nullif(clean(F.col("user_agent")), F.lit("")), F.lit("*"))
    delay, site = _text("crawl_delay"), clean(F.coalesce("sitemap", F.lit("")))
    lines = lambda name, c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != ""), lambda p: F.concat(F.lit(f"{name}: "), clean(p)))
    number = delay.try_cast("double").isNotNull()
    block = F.concat(F.array(F.concat(F.lit("User-agent: "), agent)), lines("Disallow", F.col("disallow")), lines("Allow", F.col("allow")), F.when(number, F.array(F.concat(F.lit("Crawl-delay: "), clean(delay)))).otherwise(F.array().cast("array<string>")), F.array(F.lit("")))
    absolute = site.rlike("^https?://")
    warnings = F.array_compact(F.array(F.when((delay != "") & ~number, "bad crawl-delay"), F.when((site != "") & ~absolute, "bad sitemap")))
    rows = rules.select("host", "pos", F.array_join(block, "\n").alias("block"), F.when(absolute, site).alias("site"), warnings.alias("w"))
    files = rows.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n").alias("blocks"), F.min_by("site", F.when(F.col("site").isNotNull(), F.col("pos"))).alias("site"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))), "; ").alias("warnings"))
    return files.select("host", F.regexp_replace(F.concat_ws("\n", "blocks", F.concat(F.lit("Sitemap: "), F.col("site"))), r"\s+$", "").alias("body"), "warnings")


def _attribute(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def meta_tag_block(rows: DataFrame) -> DataFrame:
    """Head block of each row of texts (key, title, description, ...): primary, og and twitter tags,
    where og and twitter default to title, description and address, and warnings on lengths."""
    own = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit("")
    either = lambda name, *rest: F.coalesce(*(F.col(n).cast("string") for n in (name, *rest) if n in rows.columns), F.lit(""))
    tag = lambda kind, name, c: F.when(c != "", F.concat(F.lit(f'<meta {kind}="{name}" content="'), _attribute(c), F.lit('">')))
    t, d, link = own("title"), own("description"), own("canonical")
    og_type = F.coalesce(F.col("og_type"), F.lit("website")) if "og_type" in rows.columns else F.lit("website")
    card = F.coalesce(F.col("tw_card"), F.lit("summary_large_image")) if "tw_card" in rows.columns else F.lit("summary_large_image")
    head = [F.when(t != "", F.concat(F.lit("<title>"), _attribute(t), F.lit("</title>"))), *(tag("name", n, own(n)) for n in ("description", "keywords", "robots")), F.when(link != "", F.concat(F.lit('<link rel="canonical" href="'), _attribute(link), F.lit('">')))]
    og = [tag("property", f"og:{n}", c) for n, c in (("type", og_type), ("url", either("og_url", "canonical")), ("title", either("og_title", "title")), ("description", either("og_description", "description")), ("image", own("og_image")), ("site_name", own("og_site_name")))]
    tw = [tag("name", f"twitter:{n}", c) for n, c in (("card", card), ("url", either("og_url", "canonical")), ("title", either("tw_title", "title")), ("description", either("tw_description", "description")), ("image", either("tw_image", "og_image")), ("site", own("tw_site")))]
    block = F.concat_ws("\n", F.lit("<!-- Primary Meta Tags -->"), *head, F.lit("\n<!-- Open Graph / Facebook -->"), *og, F.lit("\n<!-- Twitter -->"), *tw)
    warnings = F.concat_ws("; ", F.when(t == "", "no title").when(F.length(t) > 60, "long title"), F.when(d == "", "no description").when(F.length(d) > 160, "long description"), F.when(link == "", "no canonical"), F.when(either("og_image", "tw_image") == "", "no image"))
    return rows.select("key", block.alias("block"), warnings.alias("warnings"))


def submission_batches(rows: DataFrame, key: str, size: int = 10_000) -> DataFrame:
    """Payloads of at most size urls of each host. urls are dealt into batches by a hash, so one
    large host is no single task's sort."""
    good = rows.select(F.trim("url").alias("url")).where(urls.is_public_url(F.col("url"))).distinct().withColumn("host", urls.netloc(F.col("url")))
    n = good.groupBy("host").agg(F.count("*").alias("n"))
    deals = F.when(F.col("n") > size, F.ceil(F.col("n") * 1.1 / size)).otherwise(1)
    dealt = good.join(n.select("host", deals.alias("deals")), "host").withColumn("deal", F.pmod(F.xxhash64("url"), F.col("deals")))
    w = Window.partitionBy("host", "deal").orderBy("url")
    placed = dealt.withColumn("part", F.floor((F.row_number().over(w) - 1) / size))
    lists = placed.groupBy("host", "deal", "part").agg(F.array_sort(F.collect_list("url")).alias("urlList"))
    payload = F.to_json(F.struct("host", F.lit(key).alias("key"), F.concat(F.lit("https://"), F.col("host"), F.lit(f"/{key}.txt")).alias("keyLocation"), "urlList"))
    return lists.select("host", F.concat_ws("-", "deal", "part").alias("batch"), F.size("urlList").alias("n"), payload.alias("payload"))
