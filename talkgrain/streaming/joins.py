"""Tool calls and their results as two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.functions.times import millis_between
from talkgrain.operators.transcripts import TOOL_ERRORS


def outcomes_within(starts: DataFrame, results: DataFrame, seconds: int = 300, delay: str = "1 minute") -> DataFrame:
    """key, tool_call_id, at, status, error_code, duration_ms: each start(key, tool_call_id, at) with its result(tool_call_id, at, status).

    A result counts if it comes within so many seconds of its start; without one the status is timed_out. A result without a status is completed. Repeated
    results of one call at one time and with one status count once, others make rows of their own. The same for batches and for streams: there rows wait in state for their other side, and a
    start without one is told once both watermarks have passed the time in which its result could come. Late rows within the delay are joined.
    """
    s = starts.select("key", "tool_call_id", "at").withWatermark("at", delay)
    r = results.select(F.col("tool_call_id").alias("_id"), F.col("at").alias("_end"), F.coalesce("status", F.lit("completed")).alias("_status")).withWatermark("_end", delay)
    r = r.dropDuplicates(["_id", "_end", "_status"])
    near = (F.col("tool_call_id") == F.col("_id")) & (F.col("_end") >= F.col("at")) & (F.col("_end") <= F.col("at") + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    j = s.join(r, near, "left_outer")
    code = F.element_at(F.create_map(*(F.lit(x) for kv in TOOL_ERRORS.items() for x in kv)), F.col("_status"))
    ended = F.col("_status").isNotNull()
    status = F.coalesce("_status", F.lit("timed_out"))
    return j.select("key", "tool_call_id", "at", status.alias("status"), F.when(ended, code).otherwise(TOOL_ERRORS["timeout"]).alias("error_code"), F.when(ended, millis_between(F.col("at"), F.col("_end"))).alias("duration_ms"))
