"""A scheduler's ticks: due jobs run, and when they run next is written back, once per tick.

Jobs are a versioned table (name, schedule, timezone, enabled, next_run, last_run, last_status). A tick is a time. At a
tick the jobs that are enabled, have a valid cron schedule and whose next_run has come are handed to `run` at once; what
it says of each is appended to a history and decides last_status. The commit of the new versions carries the tick, so that
a tick that comes again, as after a crash between the commit and the stream's checkpoint, changes nothing; `run` itself
may see jobs again whose outcome was never committed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import next_run
from ..sources import versioned

JOBS = "name string, schedule string, timezone string, enabled boolean, next_run timestamp, last_run timestamp, last_status string"
Run = Callable[[DataFrame], DataFrame]


def upcoming(schedule: Column, after: Column, zone: Column) -> Column:
    """The next time a cron expression holds after a time, in a zone, UTC if it is null or empty; null for an invalid one."""

    def work(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for expression, micros, name in zip(*batch, strict=True):
                at = datetime.fromtimestamp(micros / 1e6, UTC) if not pd.isna(micros) else None
                try:
                    out.append(next_run(expression, at, name or "UTC") if expression and at else None)
                except (KeyError, ValueError):  # no such zone
                    out.append(None)
            yield pd.Series([None if x is None else int(x.timestamp() * 1e6) for x in out], dtype="Int64")

    return F.timestamp_micros(F.pandas_udf(work, "long")(schedule, F.unix_micros(after), F.coalesce(zone, F.lit(""))))


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """Enabled jobs with a valid schedule whose time has come; a job that never got a next_run isn't due."""
    rows = jobs.filter(F.coalesce("enabled", F.lit(True)) & (F.col("next_run") <= now))
    return rows.withColumn("_next", upcoming(F.col("schedule"), now, F.col("timezone"))).filter("_next is not null")


def tick(spark: SparkSession, root: str, now: datetime, run: Run) -> int:
    """One tick over the jobs under root/jobs: run(due jobs) -> (name, success). Returns the version that is the newest after it."""
    token, at = now.astimezone(UTC).isoformat(), F.lit(now)
    head = versioned.newest(spark, f"{root}/jobs")
    if head and token in head["tokens"]:
        return head["tokens"][token]
    jobs = versioned.read(spark, f"{root}/jobs", head["version"])
    ready = due(jobs, at)
    told = run(ready.drop("_next")).select("name", F.col("success").cast("boolean").alias("success"), at.alias("at"))
    versioned.commit(spark, f"{root}/history", lambda _: told, append=True, token=token)
    done = versioned.read(spark, f"{root}/history").filter(F.col("at") == at).groupBy("name").agg(F.bool_and(F.coalesce("success", F.lit(False))).alias("_ok"))

    def marked(old: DataFrame) -> DataFrame:
        rows = old.join(done, "name", "left")
        ran = F.col("_ok").isNotNull()
        rows = rows.withColumn("_next", upcoming(F.col("schedule"), at, F.col("timezone")))
        return rows.select(
            "name", "schedule", "timezone", "enabled", F.when(ran, F.coalesce("_next", "next_run")).otherwise(F.col("next_run")).alias("next_run"),
            F.when(ran, at).otherwise(F.col("last_run")).alias("last_run"), F.when(ran, F.when(F.col("_ok"), "success").otherwise("failed")).otherwise(F.col("last_status")).alias("last_status"),
        )

    return versioned.commit(spark, f"{root}/jobs", marked, token=token)


def add_jobs(jobs: DataFrame, root: str, now: datetime) -> int:
    """Inserts or replaces jobs(name, schedule, timezone, enabled) by name; those with a valid schedule get a next_run."""
    spark = jobs.sparkSession
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("last_run", "timestamp"), ("last_status", "string"))]
    new = jobs.select("name", "schedule", "timezone", F.coalesce("enabled", F.lit(True)).alias("enabled"), upcoming(F.col("schedule"), F.lit(now), F.col("timezone")).alias("next_run"), *nothing)
    return versioned.commit(spark, f"{root}/jobs", lambda old: new if old is None else old.join(new, "name", "left_anti").unionByName(new))


def serve(ticks: DataFrame, root: str, run: Run, checkpoint: str, at: str = "at") -> None:
    """Ticks of a stream that are there now, a batch at a time: of several that have come together only the last counts, as of a
    scheduler that was away."""

    def handle(batch: DataFrame, _: int) -> None:
        now = batch.agg(F.max(F.unix_micros(F.col(at).cast("timestamp"))).alias("at")).first()["at"]
        if now is not None:
            tick(batch.sparkSession, root, datetime.fromtimestamp(now / 1e6, UTC), run)

    ticks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
