"""Exact distinct counts that merge: each value has a dense number, a group holds bitmaps of its values' numbers.

A state has a row for each day, endpoint and block of 32768 numbers: counts and sums of requests, and the bitmap of the
addresses seen. States are added by union and merged by any coarser key; the log isn't read again and no row is expanded
for a grouping set. Numbers are dealt within SHARES groups of values, so no single task numbers all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexa.operators.telemetry import TOTAL

#: Groups of values that are numbered each by itself; numbers of one group are SHARES apart.
SHARES = 64
_SUMS = ("request_count", "timed", "time_sum", "error_count")


def number_values(values: DataFrame, column: str, known: DataFrame | None = None, shares: int = SHARES) -> DataFrame:
    """(column, number) of all distinct values: those known keep their number, others get the next ones of their share; null has none."""
    share = F.pmod(F.xxhash64(column), F.lit(shares)).cast("long")
    new = values.select(column).where(F.col(column).isNotNull()).distinct()
    if known is not None:
        new = new.join(known, column, "left_anti")
    new = new.withColumn("_share", share)
    rank = F.row_number().over(W.partitionBy("_share").orderBy(column)).cast("long") - 1
    if known is None:
        return new.select(column, (rank * shares + F.col("_share")).alias("number"))
    used = known.groupBy(F.pmod("number", F.lit(shares)).alias("_share")).agg((F.floor(F.max("number") / shares) + 1).alias("_used"))  # a row a share
    new = new.withColumn("_rank", rank).join(F.broadcast(used), "_share", "left")
    return known.unionByName(new.select(column, ((F.col("_rank") + F.coalesce("_used", F.lit(0))) * shares + F.col("_share")).alias("number")))


def state_of(log: DataFrame, numbers: DataFrame) -> DataFrame:
    """The state of a log: a row for each date, endpoint and block of numbers. Rows without an address are counted in a block that is null."""
    day = log.withColumn("date", F.to_date("created_at"))
    # by address first: one that holds a large share of the log has a row a day and endpoint when it meets its number
    each = day.groupBy("date", "endpoint", "client_ip").agg(
        F.count(F.lit(1)).alias("request_count"), F.count("response_time_ms").alias("timed"), F.coalesce(F.sum("response_time_ms"), F.lit(0)).cast("long").alias("time_sum"), F.count(F.when(F.col("status_code") >= 400, 1)).alias("error_count")
    )
    n = F.col("number")
    return each.join(numbers, "client_ip", "left").groupBy("date", "endpoint", F.bitmap_bucket_number(n).alias("block")).agg(*[F.sum(c).alias(c) for c in _SUMS], F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("seen"))


def merged(state: DataFrame, *keys: str) -> DataFrame:
    """The state by coarser keys; of states of several logs, their union, as all of them together had been one."""
    return state.groupBy(*keys, "block").agg(*[F.sum(c).alias(c) for c in _SUMS], F.bitmap_or_agg("seen").alias("seen"))


def counted(state: DataFrame, *keys: str) -> DataFrame:
    """keys, request_count, unique_ips, avg_response_time_ms and error_count of a merged state; without any timed request the average is null."""
    out = merged(state, *keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS], F.coalesce(F.sum(F.when(F.col("block").isNotNull(), F.bitmap_count("seen"))), F.lit(0)).alias("unique_ips"))
    average = F.round(F.try_divide(F.col("time_sum").cast("double"), F.col("timed")))
    return out.select(*keys, "request_count", "unique_ips", average.alias("avg_response_time_ms"), "error_count")


def daily_stats(state: DataFrame) -> DataFrame:
    """The rollup of telemetry.daily_stats from a state: days and endpoints, and totals of days from the same bitmaps."""
    whole = counted(state, "date").withColumn("endpoint", F.lit(TOTAL))
    return counted(state, "date", "endpoint").unionByName(whole)
