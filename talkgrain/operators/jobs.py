"""A table of jobs and what may happen to them: claims in order of age, retries with backoff, recovery of what a lost worker held.

jobs: id, queue, status (queued, running, succeeded, failed), attempts, available_at, claimed_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talkgrain.functions.times import backoff_seconds, micros

ATTEMPTS = 3


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """The oldest available job of each queue. A minimum of a struct: tasks exchange one row a queue."""
    ready = jobs.filter((F.col("status") == "queued") & (F.col("available_at") <= now))
    return ready.groupBy("queue").agg(F.min_by("id", F.struct("available_at", "id")).alias("id"))


def in_order(jobs: DataFrame) -> DataFrame:
    """Each queue's jobs with `turn`, their place in its order."""
    return jobs.withColumn("turn", F.row_number().over(W.partitionBy("queue").orderBy("available_at", "id")))


def recovered(jobs: DataFrame, now: Column, stale_seconds: int) -> DataFrame:
    """Running jobs claimed too long ago are queued again, or fail after ATTEMPTS attempts."""
    lost = F.coalesce((F.col("status") == "running") & (micros(F.col("claimed_at")) < micros(now) - stale_seconds * 1_000_000), F.lit(False))
    status = F.when(lost & (F.col("attempts") < ATTEMPTS), "queued").when(lost, "failed").otherwise(F.col("status"))
    return jobs.withColumns({"status": status, "claimed_at": F.when(~lost, F.col("claimed_at"))})


def after_failure(jobs: DataFrame, failed: Column, now: Column) -> DataFrame:
    """Jobs for which `failed` holds wait for their backoff, or fail after ATTEMPTS attempts."""
    again = failed & (F.col("attempts") < ATTEMPTS)
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff_seconds(F.col("attempts")))
    status = F.when(again, "queued").when(failed, "failed").otherwise(F.col("status"))
    return jobs.select("*", status.alias("next_status"), F.when(failed, now + wait).otherwise(F.col("available_at")).alias("next_at"))
