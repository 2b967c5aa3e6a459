"""The request log and its rollup: a stream fills a log in folders by day, closed days are rolled up, old days are dropped.

Log: {folder}/date=.../batch=..., a folder for each day and micro-batch, so days are read by partition and a micro-batch that is
repeated after a lost commit replaces what it had written. Stats: {folder}/date=..., each day replaced as a whole.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codexa.operators import telemetry
from codexa.sources import partitions
from codexa.sources.tables import DDL

LOG_DDL = f"{DDL['api_requests']}, date date, batch bigint"
STATS_DDL = DDL["api_request_daily_stats"]


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """All rows of the log, with their date and micro-batch; filters on date read the folders of these days alone."""
    return partitions.read(spark, log, LOG_DDL)


def read_stats(spark: SparkSession, stats: str) -> DataFrame:
    return partitions.read(spark, stats, STATS_DDL)


def append_log(raw: DataFrame, log: str, checkpoint: str, taken: list[int] | None = None) -> StreamingQuery:
    """Cleans a stream of raw requests and adds them to the log, all that has come, then ends.

    Rows without a time have no date. taken gets the number of raw requests of each micro-batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        clean = telemetry.clean_requests(batch).withColumns({"date": F.to_date("created_at"), "batch": F.lit(number).cast("long")})
        partitions.replace(clean, log, "date", "batch")
        if taken is not None:
            taken.append(batch.count())  # of Parquet files the footers alone are read

    return raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due_days(spark: SparkSession, log: str, stats: str, as_of: Column) -> list[datetime.date]:
    """Closed days of the log without a total in stats; a row a day comes to the driver."""
    days = telemetry.missing_days(read_log(spark, log), read_stats(spark, stats), as_of, F.col("date"))
    return [r.d for r in days.orderBy("d").collect()]


def of_days(spark: SparkSession, log: str, days: list[datetime.date]) -> DataFrame:
    """The log of these days, read from their folders alone."""
    return read_log(spark, log).where(F.col("date").isin(days))


def roll_up(spark: SparkSession, log: str, stats: str, as_of: Column) -> list[datetime.date]:
    """Adds the due days to stats, each as a folder of its own, and tells which these were.

    A day that has a total stays as it is: rows that come late for it are not counted.
    """
    days = due_days(spark, log, stats, as_of)
    if days:
        partitions.replace(telemetry.daily_stats(of_days(spark, log, days)), stats, "date")
    return days


def expired_days(spark: SparkSession, log: str, now: Column, keep_days: int = telemetry.KEEP_DAYS) -> list[datetime.date]:
    """Days of the log of which no row is young enough to stay."""
    old = read_log(spark, log).select("date").distinct().where(F.col("date") < F.to_date(now - F.make_interval(days=F.lit(keep_days))))
    return [r.date for r in old.orderBy("date").collect()]


def purge(spark: SparkSession, log: str, now: Column, keep_days: int = telemetry.KEEP_DAYS) -> list[datetime.date]:
    """Drops the folders of expired days from the log and tells which these were.

    On the day of the bound itself old rows stay in their files: `kept` leaves them out.
    """
    days = expired_days(spark, log, now, keep_days)
    partitions.drop(spark, log, LOG_DDL, days, "date", "batch")
    return days


def kept(spark: SparkSession, log: str, now: Column, keep_days: int = telemetry.KEEP_DAYS) -> DataFrame:
    """The rows of the log that are young enough to stay, and those without a time."""
    day = F.to_date(now - F.make_interval(days=F.lit(keep_days)))
    return telemetry.retained(read_log(spark, log).where((F.col("date") >= day) | F.col("date").isNull()), now, keep_days)


def kept_by_endpoint(spark: SparkSession, log: str, now: Column, keep_days: int = telemetry.KEEP_DAYS) -> DataFrame:
    """date, endpoint (and the total of the day) and requests_kept: how many rows of the log are still there."""
    rows = kept(spark, log, now, keep_days).where("date IS NOT NULL").groupingSets([["date", "endpoint"], ["date"]], "date", "endpoint")
    rows = rows.agg(F.grouping("endpoint").alias("whole"), F.count(F.lit(1)).alias("requests_kept"))
    return rows.select("date", F.when(F.col("whole") == 1, telemetry.TOTAL).otherwise(F.col("endpoint")).alias("endpoint"), "requests_kept")


def overview(spark: SparkSession, log: str, stats: str, now: Column, keep_days: int = telemetry.KEEP_DAYS) -> DataFrame:
    """Stats of all days with the requests that the log still holds; days that aren't closed have only these."""
    return read_stats(spark, stats).join(kept_by_endpoint(spark, log, now, keep_days), ["date", "endpoint"], "full").withColumn("requests_kept", F.coalesce("requests_kept", F.lit(0)))
