"""Speech events and transcripts: what counts of repeated recognitions, whole responses from deltas, tools paired with their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talkgrain.functions.times import micros, millis_between


def recognitions(events: DataFrame) -> DataFrame:
    """What counts of recognition events (key, line, at, kind: interim, final or error; text).

    A line's first final ends it: whatever follows is dropped. An interim that repeats the one before is dropped. Errors have no line and all stay.
    """
    of_line = W.partitionBy("key", "line").orderBy("at")
    spoken = events.filter(F.col("kind") != "error")
    finals = F.count_if(F.col("kind") == "final").over(of_line.rowsBetween(W.unboundedPreceding, -1))
    before = F.lag("text").over(of_line)
    kept = spoken.withColumn("_done", finals).withColumn("_same", (F.col("kind") == "interim") & F.coalesce(before == F.col("text"), F.lit(False)))
    return kept.filter("_done = 0 and not _same").drop("_done", "_same").unionByName(events.filter("kind = 'error'"))


def finalization(marks: DataFrame, pairs: dict[str, tuple[str, str]]) -> Column:
    """A map of the milliseconds of each pair of times, at least 0, without those that lack a time."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), millis_between(marks[a], marks[b]).cast("double").alias("value")) for n, (a, b) in pairs.items()])
    return F.map_filter(F.map_from_entries(entries), lambda _, v: v.isNotNull())


def shorter_final(interim: Column, final: Column) -> Column:
    """Whether a final has fewer characters or words than the interim before it, if there was one."""
    words = lambda c: F.regexp_count(c, F.lit(r"\S+"))
    return F.coalesce((interim != "") & ((F.length(final) < F.length(interim)) | (words(final) < words(interim))), F.lit(False))


def responses(deltas: DataFrame, key: str, order: str) -> DataFrame:
    """Whole responses from deltas (kind delta or end; text; source): key, response, text, source.

    An end closes the response; what no end has closed yet is left out, as are empty ones. A recovery among the sources names the whole.
    """
    upto = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    d = deltas.withColumn("response", F.coalesce(F.count_if(F.col("kind") == "end").over(upto), F.lit(0)))
    g = d.groupBy(key, "response").agg(
        F.bool_or(F.col("kind") == "end").alias("_closed"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))).alias("_d"),
        F.bool_or((F.col("kind") == "delta") & (F.col("source") == "recovery")).alias("_recovery"),
    )
    text = F.trim(F.array_join(F.transform("_d", lambda s: s["t"]), ""))
    return g.filter("_closed").select(key, "response", text.alias("text"), F.when(F.coalesce("_recovery", F.lit(False)), "recovery").otherwise("llm").alias("source")).filter("text <> ''")


#: Statuses that a tool may report, and the code that each is recorded under.
TOOL_ERRORS = {"timeout": "tool.execution_timeout", "failed": "tool.execution_failed", "error": "tool.execution_failed", "unavailable": "tool.unavailable"}


def tool_outcomes(starts: DataFrame, results: DataFrame) -> DataFrame:
    """Each tool call with its outcome: key, tool_call_id, status (pending without a result), error_code, duration_ms, first (the first of its turn)."""
    r = results.select("tool_call_id", F.col("at").alias("_end"), F.coalesce("status", F.lit("completed")).alias("_status"))
    j = starts.join(r, "tool_call_id", "left")
    code = F.element_at(F.create_map(*(F.lit(x) for kv in TOOL_ERRORS.items() for x in kv)), F.col("_status"))
    first = F.row_number().over(W.partitionBy("key").orderBy("at", "tool_call_id")) == 1
    return j.select("key", "tool_call_id", F.coalesce("_status", F.lit("pending")).alias("status"), F.when(F.col("_status").isNotNull(), code).alias("error_code"), millis_between(F.col("at"), F.col("_end")).alias("duration_ms"), first.alias("first"))


def event_time(processed: Column, frame_age_ms: Column, stop_ms: Column) -> Column:
    """When it happened, in microseconds: when it was processed, less the frame's age and the silence waited for, rounded to whole microseconds."""
    return micros(processed) - F.round((F.coalesce(frame_age_ms, F.lit(0.0)) + F.coalesce(stop_ms, F.lit(0.0))) * 1000).cast("long")


def recording_state(log: DataFrame, key: str = "recording_id") -> DataFrame:
    """The last state of each recording; once deleted, whatever comes later, it is deleted."""
    return log.groupBy(key).agg(F.max_by("state", F.struct((F.col("state") == "deleted").alias("d"), "at")).alias("state"))


def first_marks(marks: DataFrame, key: list[str], stages: list[str]) -> DataFrame:
    """The first time of each stage; later ones of the stage don't move it."""
    return marks.groupBy(*key).agg(*[F.min(F.when(F.col("stage") == s, F.col("at"))).alias(s) for s in stages])


def latest_user_text(messages: DataFrame, key: str, order: str) -> DataFrame:
    return messages.filter("role = 'user'").groupBy(key).agg(F.max_by("text", order).alias("text"))
