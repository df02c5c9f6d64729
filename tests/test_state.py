"""Keyed state: lockouts by event time and upserts of progress, with late rows, restarts and replays."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import logs
from pagewright.sources.derived import derived
from pagewright.streaming import jobs, lockouts, upserts

SF = "/root/testdata/sf0.001"
ATTEMPT = "id long, username string, ts timestamp, success boolean"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def provider(spark):
    key = lockouts._PROVIDER[0]
    old = spark.conf.get(key)
    yield
    spark.conf.set(key, old)


def run(spark, folder, out, checkpoint, **how):
    stream = spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).parquet(folder)
    q = lockouts.lockouts(stream, **how).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return {r.id: (r.failures_before, r.locked) for r in spark.read.schema(lockouts._OUT).parquet(out).collect()}


def add(spark, folder, rows):
    spark.createDataFrame(rows, ATTEMPT).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_the_stored_log_over_a_restart(spark, tmp_path):
    """The events table in three files of mixed order, the stream stopped and started again between."""
    log = derived(spark, SF, "dense_attempts").select(*(f.split()[0] for f in ATTEMPT.split(", "))).where("ts IS NOT NULL")
    want = {r.id: (r.failures_before, r.locked) for r in logs.lockout_history(log).collect()}
    rows = sorted((tuple(r) for r in log.collect()), key=lambda r: r[2])
    rng, folder, out, checkpoint = random.Random(1), *(str(tmp_path / x) for x in ("in", "out", "c"))
    thirds = [rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3] for i in range(3)]
    for part in thirds[:2]:
        rng.shuffle(part)
        add(spark, folder, part)
    some = run(spark, folder, out, checkpoint)
    assert 0 < len(some) < len(want)
    rng.shuffle(thirds[2])
    add(spark, folder, thirds[2])
    for day in (30, 60):  # a batch sees the watermark of the one before
        add(spark, folder, [(-day, "flush", rows[-1][2] + dt.timedelta(days=day), True)])
    got = run(spark, folder, out, checkpoint)
    assert {k: v for k, v in got.items() if k >= 0} == want and any(v[1] for v in want.values())


def test_late_rows_are_dropped_and_a_success_resets(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    folder = str(tmp_path / "in")
    add(spark, folder, [(i, "u", at(i), False) for i in range(5)] + [(5, "u", at(10), False), (6, "v", at(1), False), (7, "v", at(1), True), (8, "v", at(2), False), (9, "v", at(3), False), (10, None, at(3), False)])
    add(spark, folder, [(20, "w", at(5000), False)])
    add(spark, folder, [(21, "u", at(11), False), (22, "w", at(9000), True)])  # a batch drops what the watermark of the one before had passed
    add(spark, folder, [(23, "u", at(12), False), (24, "w", at(9001), True)])
    plain = run(spark, folder, str(tmp_path / "o1"), str(tmp_path / "c1"))
    reset = run(spark, folder, str(tmp_path / "o2"), str(tmp_path / "c2"), reset=True)
    assert plain[5] == (5, True) and plain[21] == (6, True) and 23 not in plain and 10 not in plain and plain[20] == (0, False)
    assert (plain[6], plain[7], plain[9]) == ((0, False), (1, False), (2, False))
    assert (reset[5], reset[7], reset[8], reset[9]) == ((5, True), (1, False), (0, False), (1, False))


PROGRESS = "run_id string, url string, ts timestamp, status string, score int, total int"


def result(run, url, s, status="pass", score=50):
    return (run, url, T0 + dt.timedelta(seconds=s), status, score, 9)


def test_progress_is_replaced_bounded_and_safe_to_repeat(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / x) for x in ("in", "table", "c"))

    def feed(rows):
        spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(PROGRESS).option("maxFilesPerTrigger", 1).parquet(folder)
        q = upserts.write_progress(stream, path, checkpoint, buckets=4).trigger(availableNow=True).start()
        q.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]

    kept = []
    for hour in range(4):
        kept += feed([result(f"r{i % 3}", f"u{hour}-{i}", 3600 * hour + i) for i in range(50)] + [result("r0", f"u{hour}-0", 3600 * hour + 90, "fail", 10)] * 2)
    assert 51 <= max(kept) <= 102  # two files' rows at most: older ones went with the watermark
    feed([result("r0", "u3-0", 3600 * 3 + 80, "pass", 99)])  # earlier than what the table has
    table = upserts.progress_table(path, 4)
    rows = {(r.run_id, r.url): (r.status, r.score) for r in table.read(spark).collect()}
    assert len(rows) == 200 and rows["r0", "u3-0"] == ("fail", 10) and rows["r1", "u2-1"] == ("pass", 50)
    totals = {r.run_id: (r.done, r.failed) for r in jobs.run_progress(table.read(spark)).collect()}
    assert totals["r0"] == (68, 4) and sum(n for n, _ in totals.values()) == 200

    last = max(n for v in table.versions(spark).values() for n in v)
    before = sorted(table.read(spark).collect())
    batch = spark.createDataFrame([result("r0", "u3-0", 3600 * 3 + 80, "pass", 99), result("r1", "new", 20000)], PROGRESS)
    table.upsert(batch, last + 1)
    once = sorted(table.read(spark).collect())
    table.vacuum(spark)
    table.upsert(batch, last + 1)  # repeated after a crash
    assert sorted(table.read(spark).collect()) == once and len(once) == len(before) + 1
    os.remove(f"{path}/version={last + 1}/_SUCCESS")  # half written
    assert sorted(table.read(spark).collect()) == before


def test_an_empty_table_has_no_version(spark, tmp_path):
    table = upserts.progress_table(str(tmp_path / "t"))
    assert table.read(spark) is None and table.vacuum(spark) == []
    table.upsert(spark.createDataFrame([], PROGRESS), 0)
    assert table.read(spark) is None
    table.upsert(spark.createDataFrame([(None, "u", None, None, None, None)], PROGRESS), 1)
    assert table.read(spark).count() == 1
