"""Structured Streaming forms of the page checks and log operators. Late rows beyond the watermark are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.operators import checks, facts, scoring
from pagewright.operators.logs import histogram

LATE = "10 minutes"


def stream_page_checks(pages: DataFrame, **reading) -> DataFrame:
    """Check rows of newly crawled pages, for append mode: stateless, one parse a page. reading is as
    in extract_facts."""
    return checks.run_checks(facts.extract_facts(pages, **reading))


def write_page_audits(pages: DataFrame, path: str, checkpoint: str):
    """Query that appends check rows and, for each batch, scores of its pages under path. A batch
    writes under its number, so one that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = stream_page_checks(batch).persist()
        rows.write.mode("overwrite").parquet(f"{path}/checks/batch={number}")
        scoring.audits(rows).write.mode("overwrite").parquet(f"{path}/audits/batch={number}")
        rows.unpersist()

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def http_metrics_stream(requests: DataFrame, every: str = "1 minute", late: str = LATE) -> DataFrame:
    return requests.withWatermark("ts", late).groupBy(F.window("ts", every), "method", "endpoint", "status").agg(F.count("*").alias("n"), *histogram())


def login_lockout_stream(attempts: DataFrame, length: str = "15 minutes", slide: str = "1 minute", limit: int = 5, late: str = LATE) -> DataFrame:
    """Users with so many failures in a sliding window: the rule of the stored log, up to the slide."""
    f = attempts.withWatermark("ts", late).where(~F.col("success")).groupBy(F.window("ts", length, slide), "username").agg(F.count("*").alias("failures"))
    return f.where(F.col("failures") >= limit)


def login_lockout_exact(attempts: DataFrame, window_s: int = 900, limit: int = 5, late: str = LATE) -> DataFrame:
    """username, ts and failures at each attempt that finds its user locked: so many failures in the
    seconds before it and since the last success. State is the user's recent failures, at most those
    of one window, and expires with the watermark."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures: list[int] = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, ok in zip(rows["ts"], rows["success"]):
            ms = int(ts.timestamp() * 1000)
            failures = [f for f in failures if f >= ms - window_s * 1000]
            if len(failures) >= limit:
                out.append((key[0], ts, len(failures)))
            failures = [] if ok else [*failures, ms]
        state.update((failures,))
        latest = max([*failures, state.getCurrentWatermarkMs()])
        state.setTimeoutTimestamp(latest + window_s * 1000 + 1)
        yield pd.DataFrame(out, columns=["username", "ts", "failures"])

    rows = attempts.withWatermark("ts", late).select("username", "ts", "success")
    return rows.groupBy("username").applyInPandasWithState(step, "username string, ts timestamp, failures int", "failures array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def session_activity(rows: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    return rows.withWatermark("ts", late).groupBy("username", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def run_progress(progress: DataFrame) -> DataFrame:
    """Finished urls, states and mean score of each run, for update mode."""
    return progress.groupBy("run_id").agg(F.count("*").alias("done"), F.max("total").alias("total"), F.count_if(F.col("status") == "fail").alias("failed"), F.avg("score").alias("mean_score"))


def dedupe_progress(progress: DataFrame) -> DataFrame:
    """The last result of each url of a run, for update mode: later results replace earlier ones."""
    rest = [c for c in progress.columns if c not in ("run_id", "url")]
    return progress.groupBy("run_id", "url").agg(F.max_by(F.struct(*rest), "ts").alias("r")).select("run_id", "url", "r.*")


def retention(rows: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Rows of the last so many days."""
    return rows.where(F.col("ts") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS"))


def drop_expired(spark, path: str, as_of: str, days: int = 90) -> list[str]:
    """Remove day folders (day=YYYY-MM-DD) of a sink that are older than so many days; their names."""
    limit = str((pd.Timestamp(as_of) - pd.Timedelta(days=days)).date())
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    old = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("day=") and s.getPath().getName()[4:] < limit]
    for p in old:
        fs.delete(p, True)
    return sorted(p.getName() for p in old)
