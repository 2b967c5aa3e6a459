"""Nightly request statistics, incremental: new event files go into the request log, closed days into daily stats, old days go.

    spark-submit jobs/request_rollup.py --events PATH --out FOLDER --checkpoint FOLDER [--config FILE]

--events is a folder (or glob) of Parquet event files that grows. The stream's checkpoint tells which files have been taken;
a run takes those that are new. FOLDER/log holds the cleaned requests by day, FOLDER/stats a row a day and endpoint. Days are
rolled up once they are over (before as_of) and dropped from the log keep_days later; a run that ended half way is made good
by the next. as_of and now are those of the session's clock where the config leaves them out.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.sources.tables import raw_requests
from codexa.streaming import rollup

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
log = logging.getLogger("request_rollup")


def run(spark: SparkSession, events: str, out: str, checkpoint: str, as_of: str | None = None, now: str | None = None, keep_days: int = 14, files_per_batch: int = 200) -> dict:
    """Takes what is new in `events`; what it read and wrote. The same input again changes nothing."""
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    clock = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(events)
    taken: list[int] = []
    rollup.append_log(raw_requests(stream), f"{out}/log", checkpoint, taken).awaitTermination()
    log.info("took %d new events from %s into %s/log, in %d micro-batches", sum(taken), events, out, len(taken))
    days = rollup.roll_up(spark, f"{out}/log", f"{out}/stats", today)
    log.info("rolled up %d days into %s/stats: %s", len(days), out, ", ".join(map(str, days)) or "none due")
    gone = rollup.purge(spark, f"{out}/log", clock, keep_days)
    log.info("dropped %d days from %s/log: %s", len(gone), out, ", ".join(map(str, gone)) or "none older")
    return {"events": sum(taken), "days": days, "dropped": gone}


def result(spark: SparkSession, out: str, now: str | None = None, keep_days: int = 14) -> DataFrame:
    """The output as it stands: stats of closed days, and what the log holds of each day."""
    return rollup.overview(spark, f"{out}/log", f"{out}/stats", F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp(), keep_days)


if __name__ == "__main__":
    from jobs.common import command_line

    command_line("request_rollup", "request_rollup.json", {"events": "event files", "out": "output folder", "checkpoint": "checkpoint folder of the stream"}, run)
