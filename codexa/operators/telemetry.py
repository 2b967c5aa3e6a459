"""The request log and its daily rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.functions import scalars as S

TOTAL = "_total_"
KEEP_DAYS = 14


def clean_requests(raw: DataFrame) -> DataFrame:
    """What the log keeps of raw requests (path, method, status_code, elapsed_s, forwarded, peer, user_agent, created_at); batch or stream."""
    kept = raw.where(S.logged(F.col("path"), F.col("status_code")))
    return kept.select(
        S.normalize_endpoint(F.col("path")).alias("endpoint"), "method", "status_code", S.elapsed_ms(F.col("elapsed_s")).alias("response_time_ms"),
        S.client_ip(F.col("forwarded"), F.col("peer")).alias("client_ip"), S.user_agent(F.col("user_agent")).alias("user_agent"), "created_at",
    )


def missing_days(log: DataFrame, stats: DataFrame, as_of: Column, day: Column | None = None) -> DataFrame:
    """Closed days of the log without a total in stats. A total with a null date suppresses all, as NOT IN does.

    day: the log's day, where a column (of its folders) has it already.
    """
    day = F.to_date("created_at") if day is None else day
    days = log.where(day < as_of).select(day.alias("d")).distinct()
    done = stats.where(F.col("endpoint") == TOTAL).select("date").distinct()
    spark = log.sparkSession
    return spark.sql("SELECT d FROM {days} WHERE d NOT IN (SELECT date FROM {done})", days=days, done=done)


def daily_stats(log: DataFrame) -> DataFrame:
    """One row a day and endpoint and one total a day, in one pass: GROUPING SETS. Addresses are distinct within each."""
    rolled = log.withColumn("date", F.to_date("created_at")).groupingSets([["date", "endpoint"], ["date"]], "date", "endpoint")
    rolled = rolled.agg(
        F.grouping("endpoint").alias("whole"), F.count(F.lit(1)).alias("request_count"), F.count_distinct("client_ip").alias("unique_ips"),
        F.round(F.avg("response_time_ms")).alias("avg_response_time_ms"), F.sum((F.col("status_code") >= 400).cast("int")).alias("error_count"),
    )
    return rolled.select("date", F.when(F.col("whole") == 1, TOTAL).otherwise(F.col("endpoint")).alias("endpoint"), "request_count", "unique_ips", "avg_response_time_ms", "error_count")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target with source's rows in place of those with equal keys (null-safe); source holds each key once."""
    t, s = target.alias("t"), source.alias("s")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
    return t.join(s, same, "left_anti").unionByName(source)


def backfill(log: DataFrame, stats: DataFrame, as_of: Column) -> DataFrame:
    """stats with the rollup of all missing closed days."""
    days = missing_days(log, stats, as_of)
    due = log.join(F.broadcast(days), F.to_date("created_at") == days.d, "left_semi")  # a row a day
    return upsert(stats, daily_stats(due), ["date", "endpoint"])


def retained(log: DataFrame, now: Column, keep_days: int = KEEP_DAYS) -> DataFrame:
    """The log without rows older than keep_days; rows without a time stay."""
    return log.where((F.col("created_at") >= now - F.make_interval(days=F.lit(keep_days))) | F.col("created_at").isNull())
