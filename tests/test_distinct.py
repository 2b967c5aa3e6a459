from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codexa.operators import distinct, telemetry

DDL = "endpoint string, method string, status_code int, response_time_ms int, client_ip string, user_agent string, created_at timestamp_ntz"


def log_of(spark, places, most=97):
    start = datetime(2024, 1, 1)
    rows = [(f"/api/{i % 3}" if i % 11 else None, "GET", 500 if i % 7 == 0 else 200, i % 50 if i % 5 else None, f"10.0.0.{i * i % most}" if i % 13 else None, "", start + timedelta(hours=i % 70) if i % 17 else None) for i in places]
    return spark.createDataFrame(rows, DDL)


def found(df):
    return sorted(str(tuple(r)) for r in df.select("date", "endpoint", "request_count", "unique_ips", "avg_response_time_ms", "error_count").collect())


def test_states_that_are_added_count_as_the_whole_log_does(spark):
    parts = [log_of(spark, range(0, 500)), log_of(spark, range(300, 900), 211), log_of(spark, [])]
    numbers, states = None, None
    for p in parts:
        numbers = distinct.number_values(p, "client_ip", numbers, shares=4)
        state = distinct.state_of(p, numbers)
        states = state if states is None else states.unionByName(state)
    whole = parts[0].unionByName(parts[1])
    assert found(distinct.daily_stats(states)) == found(telemetry.daily_stats(whole))
    ever = distinct.counted(states, "endpoint").collect()
    assert {r.endpoint: r.unique_ips for r in ever} == {r.endpoint: r.n for r in whole.groupBy("endpoint").agg(F.count_distinct("client_ip").alias("n")).collect()}


def test_numbers_stay_and_are_dense(spark):
    first = distinct.number_values(log_of(spark, range(300)), "client_ip", shares=4)
    second = distinct.number_values(log_of(spark, range(2000), 997), "client_ip", first, shares=4)
    one, two = ({r.client_ip: r.number for r in df.collect()} for df in (first, second))
    assert one.items() <= two.items() and len(set(two.values())) == len(two)
    for share in range(4):
        assert sorted(n // 4 for n in two.values() if n % 4 == share) == [*range(sum(n % 4 == share for n in two.values()))]


def test_values_beyond_one_block_and_no_values(spark):
    log = spark.range(70000).select(F.lit("/api/x").alias("endpoint"), F.lit(200).alias("status_code"), F.lit(1).alias("response_time_ms"), (F.col("id") % 40000).cast("string").alias("client_ip"), F.expr("timestamp_ntz'2024-01-01'").alias("created_at"))
    state = distinct.state_of(log, distinct.number_values(log, "client_ip"))
    assert state.select("block").distinct().count() > 1
    assert [(r.request_count, r.unique_ips) for r in distinct.daily_stats(state).collect()] == [(70000, 40000)] * 2
    none = log.where("false")
    assert distinct.daily_stats(distinct.state_of(none, distinct.number_values(none, "client_ip"))).count() == 0


def test_no_row_is_expanded_for_totals(spark):
    log = log_of(spark, range(50))
    plan = distinct.daily_stats(distinct.state_of(log, distinct.number_values(log, "client_ip")))._jdf.queryExecution().toString()
    assert "Expand" not in plan and "Expand" in telemetry.daily_stats(log)._jdf.queryExecution().toString()
