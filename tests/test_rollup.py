"""The request log by day: late rows, repeated micro-batches, retention, and the job over input that grows."""

from __future__ import annotations

import json
import shutil
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from codexa.streaming import rollup
from jobs import request_rollup
from jobs.common import command_line

RAW = "path string, method string, status_code int, elapsed_s double, forwarded string, peer string, user_agent string, created_at timestamp_ntz"
D = lambda d: F.lit(d).cast("date")
N = lambda d: F.lit(d).cast("timestamp_ntz")


def raw(spark, *rows):
    """Requests by path, address and time."""
    return spark.createDataFrame([(path, "GET", 200, 0.01, None, peer, None, at) for path, peer, at in rows], RAW)


def day(d, hour=0):
    return datetime(2024, 1, d, hour)


class Run:
    def __init__(self, spark, base):
        self.spark, self.base, self.taken = spark, f"file://{base}", []

    def drop(self, *rows):
        raw(self.spark, *rows).coalesce(1).write.mode("append").parquet(f"{self.base}/raw")

    def take(self):
        stream = self.spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(f"{self.base}/raw")
        rollup.append_log(stream, f"{self.base}/log", f"{self.base}/c", self.taken).awaitTermination()

    def roll_up(self, as_of):
        return rollup.roll_up(self.spark, f"{self.base}/log", f"{self.base}/stats", D(as_of))

    def stats(self):
        return sorted((r.date, r.endpoint, r.request_count, r.unique_ips) for r in rollup.read_stats(self.spark, f"{self.base}/stats").collect())

    def log(self):
        return sorted((r.date or date.min, r.endpoint) for r in rollup.read_log(self.spark, f"{self.base}/log").collect())


@pytest.fixture
def job(spark, tmp_path):
    return Run(spark, tmp_path)


def test_late_rows_count_until_their_day_is_rolled_up(job):
    job.drop(("/api/a", "x", day(1)), ("/api/a", "x", day(1)), ("/api/b", "y", day(2)), ("/docs", "y", day(2)), ("/api/b", "z", day(9)), ("/api/n", "z", None))
    job.take()
    assert job.roll_up("2024-01-02") == [date(2024, 1, 1)]
    first = [(date(2024, 1, 1), "/api/a", 2, 1), (date(2024, 1, 1), "_total_", 2, 1)]
    assert job.stats() == first
    job.drop(("/api/a", "w", day(1)), ("/api/a", "w", day(2)))
    job.take()
    assert job.roll_up("2024-01-09") == [date(2024, 1, 2)]
    assert job.stats() == [*first, (date(2024, 1, 2), "/api/a", 1, 1), (date(2024, 1, 2), "/api/b", 1, 1), (date(2024, 1, 2), "_total_", 2, 2)]
    assert job.taken == [6, 2] and len(job.log()) == 7
    assert job.roll_up("2024-01-09") == []


def test_a_repeated_micro_batch_replaces_its_rows(job, tmp_path):
    job.drop(("/api/a", "x", day(1)))
    job.drop(("/api/b", "x", day(1)), ("/api/b", "x", day(2)))
    job.take()
    before = job.log()
    (tmp_path / "c/commits/1").unlink()
    for f in (tmp_path / "c/commits").glob(".1*"):
        f.unlink()
    job.take()
    assert job.log() == before and len(before) == 3


def test_files_without_rows_and_without_logged_requests(job):
    job.drop()
    job.drop(("/docs", "x", day(1)))
    job.take()
    assert sum(job.taken) == 1 and job.log() == [] and job.roll_up("2024-01-09") == []
    job.drop(("/api/a", "x", day(1)))
    job.take()
    assert sum(job.taken) == 2 and job.roll_up("2024-01-09") == [date(2024, 1, 1)]


def test_purge_drops_folders_and_keeps_the_session(spark, job, tmp_path):
    job.drop(*[("/api/a", "x", day(d, 8)) for d in range(1, 21)], ("/api/n", "x", None))
    job.take()
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "DYNAMIC")
    try:
        gone = rollup.purge(spark, f"{job.base}/log", N("2024-01-20 12:00:00"))
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "DYNAMIC" and not spark.catalog.listTables()
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert gone == [date(2024, 1, d) for d in range(1, 6)]
    assert sorted(p.name for p in (tmp_path / "log").glob("date=*"))[0] == "date=2024-01-06" and len(job.log()) == 16
    kept = rollup.kept(spark, f"{job.base}/log", N("2024-01-20 12:00:00"))
    assert kept.count() == 15 and kept.where("date IS NULL").count() == 1  # 6 January 8:00 is over 14 days old
    assert rollup.purge(spark, f"{job.base}/log", N("2024-01-20 12:00:00")) == []
    job.drop(("/api/late", "x", day(1)), ("/api/a", "x", day(21)))
    job.take()
    assert len(job.log()) == 18 and rollup.purge(spark, f"{job.base}/log", N("2024-01-20 12:00:00")) == [date(2024, 1, 1)]


def test_days_are_read_from_their_folders(spark, job):
    job.drop(*[("/api/a", "x", day(d)) for d in range(1, 6)])
    job.take()
    plan = rollup.of_days(spark, f"{job.base}/log", [date(2024, 1, 2), date(2024, 1, 3)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [date" in plan or "PartitionFilters: [isnotnull(date" in plan
    files = rollup.of_days(spark, f"{job.base}/log", [date(2024, 1, 2)]).select(F.input_file_name().alias("f")).distinct().collect()
    assert all("date=2024-01-02" in r.f for r in files)


def test_nothing_yet(spark, job, tmp_path):
    (tmp_path / "raw").mkdir()
    job.take()
    assert job.roll_up("2024-01-02") == [] and rollup.purge(spark, f"{job.base}/log", N("2024-01-20 12:00:00")) == []
    assert rollup.overview(spark, f"{job.base}/log", f"{job.base}/stats", N("2024-01-20 12:00:00")).count() == 0


def test_job_over_growing_input(spark, tmp_path):
    """A run takes only what is new; the same input again changes nothing; two runs give what one over all would, late rows apart."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    base, clock = f"file://{tmp_path}", {"now": "2024-01-25 12:00:00"}
    half = F.lit("2024-01-12").cast("timestamp")
    paths = {"events": f"{base}/in", "out": f"{base}/out", "checkpoint": f"{base}/c"}
    shown = lambda out: sorted(map(str, request_rollup.result(spark, out, **clock).collect()))
    events.where(F.col("ts") < half).repartition(3).write.parquet(f"{base}/in")
    first = request_rollup.run(spark, **paths, as_of="2024-01-12", **clock)
    assert first["events"] == events.where(F.col("ts") < half).count() and len(first["days"]) == 11
    events.where(F.col("ts") >= half).write.mode("append").parquet(f"{base}/in")
    second = request_rollup.run(spark, **paths, as_of="2024-01-25", **clock)
    assert second["events"] == events.where(F.col("ts") >= half).count() and second["days"][0] == date(2024, 1, 12) and first["dropped"] and not second["dropped"]
    after = shown(f"{base}/out")
    assert request_rollup.run(spark, **paths, as_of="2024-01-25", **clock) == {"events": 0, "days": [], "dropped": []}
    assert shown(f"{base}/out") == after
    request_rollup.run(spark, f"{base}/in", f"{base}/once", f"{base}/c2", "2024-01-25", **clock)
    assert shown(f"{base}/once") == after


def test_command_line(spark, tmp_path, monkeypatch):
    """The command line hands paths and settings over and stops the session that it made, here a stand-in."""
    shutil.copytree("/root/testdata/sf0.001", tmp_path / "in", ignore=lambda d, names: [n for n in names if n != "events.parquet"])
    (tmp_path / "config.json").write_text(json.dumps({"as_of": "2024-01-25", "now": "2024-01-25 12:00:00", "keep_days": 20, "files_per_batch": 1}))
    stopped = []
    monkeypatch.setattr(type(spark), "stop", lambda self: stopped.append(self))
    argv = ["--events", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/c", "--config", f"{tmp_path}/config.json"]
    done = command_line("request_rollup", "request_rollup.json", {"events": "", "out": "", "checkpoint": ""}, request_rollup.run, argv)
    assert done["events"] == 1000 and len(done["days"]) == 24 and done["dropped"][-1] == date(2024, 1, 4) and len(stopped) == 1
