"""The streaming jobs over stored logs: what a stream gives once its watermark has passed all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.plans.base import AS_SQL, over, query
from pagewright.plans.link_queries import made
from pagewright.plans.page_queries import PLAIN_CHECKS
from pagewright.sources.derived import derived, read
from pagewright.streaming import jobs

_MINUTE = "yyyy-MM-dd HH:mm:ss"
_BOUNDS = ", ".join(f"count(*) FILTER (duration_s <= {b}) AS le_{i}" for i, b in enumerate((0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30)))

query("stream_page_checks", f"{PLAIN_CHECKS} SELECT * FROM cur")(lambda s, d: jobs.stream_page_checks(read(s, d, "pages"), **AS_SQL))
query("stream_http_metrics", over("http_requests", sql=f" SELECT strftime(time_bucket(INTERVAL '1 minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, method, endpoint, status, count(*) AS n, {_BOUNDS} FROM http_requests GROUP BY ALL"))(
    lambda s, d: jobs.http_metrics_stream(derived(s, d, "http_requests")).withColumn("minute", F.date_format("window.start", _MINUTE)).drop("window")
)
query(
    "stream_login_lockouts",
    over("dense_attempts", sql=", w AS (SELECT username, time_bucket(INTERVAL '1 minute', ts) - k * INTERVAL '1 minute' AS start FROM dense_attempts, unnest(range(15)) AS t(k) WHERE NOT success) SELECT username, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS failures FROM w GROUP BY ALL HAVING count(*) >= 5"),
)(lambda s, d: jobs.login_lockout_stream(derived(s, d, "dense_attempts")).select("username", F.date_format("window.start", _MINUTE).alias("start"), "failures"))
query(
    "stream_sessions",
    over("login_attempts", sql=", b AS (SELECT username, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS begins FROM login_attempts WINDOW w AS (PARTITION BY username ORDER BY ts)), g AS (SELECT *, sum(begins) OVER (PARTITION BY username ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM b) SELECT username, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM g GROUP BY username, nth"),
)(lambda s, d: jobs.session_activity(derived(s, d, "login_attempts")).select("username", "n", *(F.date_format(c, _MINUTE).alias(c) for c in ("first_seen", "last_seen"))))
_progress, _PROGRESS = made("lineitem", "concat('run', l_suppkey % 7) AS run_id;concat('https://p.example/', l_partkey) AS url;cast((l_orderkey * 8 + l_linenumber) * 100 + l_quantity AS bigint) AS ts;CASE WHEN l_partkey % 3 = 0 THEN 'fail' ELSE 'pass' END AS status;cast(l_quantity AS int) AS score;cast(5000 AS int) AS total")
_LAST = f"WITH p AS ({_PROGRESS}), last AS (SELECT run_id, url, max(ts) AS ts, arg_max(status, ts) AS status, arg_max(score, ts) AS score, arg_max(total, ts) AS total FROM p GROUP BY run_id, url)"
query("stream_dedupe_progress", f"{_LAST} SELECT * FROM last")(lambda s, d: jobs.dedupe_progress(_progress(s, d)))
query("stream_run_progress", f"{_LAST} SELECT run_id, count(*) AS done, max(total) AS total, count(*) FILTER (status = 'fail') AS failed, avg(score) AS mean_score FROM last GROUP BY run_id")(lambda s, d: jobs.run_progress(jobs.dedupe_progress(_progress(s, d))))
query("retention", over("login_attempts", sql=" SELECT id, username FROM login_attempts WHERE ts >= TIMESTAMP '2024-04-15' - INTERVAL '90 days'"))(lambda s, d: jobs.retention(derived(s, d, "login_attempts"), "2024-04-15").select("id", "username"))
