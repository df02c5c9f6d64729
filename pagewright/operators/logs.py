"""Event logs: request metrics, failed logins, novel logins, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the request duration histogram, in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)


def histogram():
    return [F.count_if(F.col("duration_s") <= b).alias(f"le_{i}") for i, b in enumerate(BOUNDS)]


def http_metrics(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "endpoint", "status").agg(F.count("*").alias("n"), *histogram())


def recent_failures(attempts: DataFrame, as_of: str, window_s: int = 900, limit: int = 5) -> DataFrame:
    since = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {window_s} SECONDS")
    return attempts.where(~F.col("success") & (F.col("ts") >= since) & (F.col("ts") <= F.to_timestamp(F.lit(as_of)))).groupBy("username").agg(F.count("*").alias("failures")).withColumn("locked", F.col("failures") >= limit)


def lockout_history(attempts: DataFrame, window_s: int = 900, limit: int = 5, span: int = 4) -> DataFrame:
    """Failures of the user in the seconds before each attempt, the attempt itself left out.

    A user's log is cut into buckets of span windows of time. Failures within a window of a bucket's
    end go to the next one too, where they are counted but give no row. So a user with most of all
    rows spreads over as many tasks as there are buckets.
    """
    window, bucket = window_s * 1_000_000, span * window_s * 1_000_000
    failed = ~F.col("success")
    rows = attempts.select("id", "username", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), failed.alias("failed")).withColumn("bucket", F.floor(F.col("us") / bucket))
    near = F.col("failed") & (F.col("us") >= (F.col("bucket") + 1) * bucket - window)
    dealt = rows.select("id", "username", "us", "failed", F.posexplode(F.when(near, F.array(F.col("bucket"), F.col("bucket") + 1)).otherwise(F.array("bucket"))).alias("again", "bucket"))
    w = Window.partitionBy("username", "bucket").orderBy("us").rangeBetween(-window, 0)
    before = F.count_if("failed").over(w) - F.col("failed").cast("int")
    return dealt.withColumn("failures_before", before).where("again = 0").select("id", "username", "failures_before", (F.col("failures_before") >= limit).alias("locked"))


def novel_login(attempts: DataFrame, memory: int = 30, bucket_s: int = 86_400) -> DataFrame:
    """Successful logins from an address and agent not among the user's last successes.

    A user's successes are cut into buckets of time. Each bucket keeps its last memory logins; from
    those of the buckets before, the last memory are carried in front of a bucket. The window over a
    whole user has one row a bucket.
    """
    ok = attempts.where("success").select("id", "username", "ts", F.concat_ws(" ", "ip", "user_agent").alias("pair"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / bucket_s).alias("bucket"))
    own = Window.partitionBy("username", "bucket")
    last = ok.withColumn("nth", F.row_number().over(own.orderBy(F.col("ts").desc(), F.col("id").desc()))).where(F.col("nth") <= memory)
    kept = last.groupBy("username", "bucket").agg(F.collect_list(F.struct("ts", "id", "pair")).alias("last"))
    buckets_before = Window.partitionBy("username").orderBy("bucket").rowsBetween(-memory, -1)  # each has a login
    carried = kept.withColumn("before", F.sort_array(F.flatten(F.collect_list("last").over(buckets_before))))
    carried = carried.select("username", "bucket", F.inline(F.slice("before", F.greatest(F.size("before") - memory + 1, F.lit(1)), F.lit(memory))))
    rows = ok.withColumn("own", F.lit(True)).unionByName(carried.withColumn("own", F.lit(False)))
    seen = F.collect_set("pair").over(own.orderBy("ts", "id").rowsBetween(-memory, -1))
    return rows.withColumn("novel", ~F.array_contains(seen, F.col("pair"))).where("own").select("id", "username", "novel")


def _history(attempts: DataFrame, success: bool | None, username: str | None) -> DataFrame:
    rows = attempts if success is None else attempts.where(F.col("success") == success)
    return rows if username is None else rows.where(F.col("username") == username)


def login_history(attempts: DataFrame, success: bool | None = None, limit: int = 500, offset: int = 0, username: str | None = None) -> DataFrame:
    """A page of attempts, newest first, of one outcome and user if named; 500 rows at most."""
    return _history(attempts, success, username).orderBy(F.col("ts").desc(), F.col("id").desc()).offset(offset).limit(min(limit, 500))


def login_count(attempts: DataFrame, success: bool | None = None, username: str | None = None) -> DataFrame:
    """How many attempts login_history pages through."""
    return _history(attempts, success, username).agg(F.count("*").alias("total"))
