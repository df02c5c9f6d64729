"""URL lists and search exports as inputs: reading, uniting, cleaning, limiting."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import urls

# Names of a url column; separators of a list file, tried in this order of frequency.
URL_COLUMNS = ("url", "urls", "link", "links")
SEPARATORS = (",", "\t", ";", "|")


def url_cells(lines: DataFrame, first_line: str) -> DataFrame:
    """urls (pos, url) of a list's lines (pos, line). If the first line names a url column, cells of
    that column; else every cell that begins with http. A list with neither is an error."""
    sep = max(SEPARATORS, key=lambda s: (first_line.count(s), -SEPARATORS.index(s)))
    cells = F.transform(F.split("line", re.escape(sep)), lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")))
    names = [c.strip().strip('"').strip().lower() for c in first_line.split(sep)]
    column = next((i for i, n in enumerate(names) if n in URL_COLUMNS), None)
    if column is not None:
        found = lines.where(F.col("pos") > 0).select("pos", F.lit(0).alias("cell"), F.get(cells, column).alias("url"))
    else:
        found = lines.select("pos", F.posexplode(cells).alias("cell", "url"))
    found = found.where(F.startswith("url", F.lit("http")))
    if column is None and first_line.strip() and found.isEmpty():
        raise ValueError(f"no url column and no http address; columns: {', '.join(n for n in names if n) or '<empty>'}")
    return found


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (file, pos, line) of text files, numbered from 0 in each file. A large file is read in
    splits: the lines of every split are counted, and a line's number is that of the lines in the
    splits before it and its place in its own. Splits are far fewer than lines."""
    at = spark.read.text(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row_at"))
    splits = at.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("row_at").alias("first_at"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "start", (before - F.col("first_at")).alias("offset_at"))
    return at.join(F.broadcast(offsets), ["file", "start"]).select("file", (F.col("row_at") + F.col("offset_at")).alias("pos"), F.col("value").alias("line"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """urls (pos, cell, url) of a list file in CSV, TSV, semicolon or pipe form; pos is the line's
    number in the file, whatever splits it is read in."""
    lines = numbered_lines(spark, path).select("pos", "line").where("trim(line) <> ''")
    first = lines.orderBy("pos").limit(1).first()
    return url_cells(lines, first["line"].strip() if first else "")


SEARCH_ROWS = "site string, page string, query string, date date, clicks long, impressions long, position double"


def read_search_rows(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Typed rows of a search export; a folder partitioned by date is pruned by filters on date."""
    return spark.read.format(file_format).schema(SEARCH_ROWS).options(**({"header": True} if file_format == "csv" else {})).load(path)


def typed_search_rows(export: DataFrame) -> DataFrame:
    """Rows of a raw export (site, keys array of page, query and date, clicks, impressions, position
    as strings) as typed search rows; numbers that are none become 0 (position: null)."""
    number = lambda c, t: F.coalesce(F.col(c).cast("string").try_cast(t), F.lit(0).cast(t))
    return export.select("site", F.get("keys", 0).alias("page"), F.get("keys", 1).alias("query"), F.get("keys", 2).try_cast("date").alias("date"), number("clicks", "long").alias("clicks"), number("impressions", "long").alias("impressions"), F.col("position").cast("string").try_cast("double").alias("position"))


def union_url_sources(*sources: DataFrame) -> DataFrame:
    """urls of several lists (pos, url) as one, in the order of the lists."""
    out = None
    for i, s in enumerate(sources):
        part = s.select(F.lit(i).alias("source"), F.col("pos").cast("long").alias("pos"), "url")
        out = part if out is None else out.unionByName(part)
    return out


def dedupe_urls(rows: DataFrame, *order: str) -> DataFrame:
    """First occurrence of each public url in the given order; others are dropped."""
    clean = rows.withColumn("url", F.trim("url")).where(urls.is_public_url(F.col("url")))
    rest = [c for c in clean.columns if c != "url"]
    return clean.groupBy("url").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("url", "r.*")


def limit_urls(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n urls in the given order."""
    return rows.orderBy(*order).limit(n)


def invalid_urls(rows: DataFrame) -> DataFrame:
    """Rows whose url is not public."""
    return rows.where(~urls.is_public_url(F.trim("url")))
