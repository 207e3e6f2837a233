"""What providers and recognisers report, made uniform: typed events, ends of turns, usage, session starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Usage figures and where providers put them, the first that is there counts.
USAGE = {
    "prompt_tokens": ["prompt_tokens"],
    "completion_tokens": ["completion_tokens"],
    "total_tokens": ["total_tokens"],
    "cached_tokens": ["prompt_tokens_details.cached_tokens"],
    "reasoning_tokens": ["completion_tokens_details.reasoning_tokens"],
    "queue_time": ["queue_time"],
    "prompt_time": ["prompt_time"],
    "completion_time": ["completion_time"],
}


def recognizer_events(callbacks: DataFrame) -> DataFrame:
    """callbacks(name, text, complete, ...) with kind and the trimmed text: error, final or interim; callbacks that are none of these go.

    A completed line is final, a changed one interim unless it is complete; both need a text.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    kind = F.when(F.col("name") == "Error", "error").when(text == "", None).when(F.col("name") == "LineCompleted", "final").when((F.col("name") == "LineTextChanged") & ~F.coalesce("complete", F.lit(False)), "interim")
    return callbacks.withColumn("kind", kind).filter("kind is not null").withColumn("text", F.when(F.col("kind") == "error", "").otherwise(text))


def ends_of_turns(log: DataFrame, key: str, order: str) -> DataFrame:
    """Each analysis of log(key, order, kind, state, probability) with `complete` and `reason`.

    Where silence has forced an end since the key's analysis before, that decides, whatever the model says; else the model's state does. A forced end counts for
    one analysis only.
    """
    by = W.partitionBy(key).orderBy(order)
    before = F.sum((F.col("kind") == "analysis").cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1))
    rows = log.withColumn("_n", F.coalesce(before, F.lit(0)))
    forced = F.max((F.col("kind") == "silence").cast("int")).over(W.partitionBy(key, "_n")) == 1
    out = rows.withColumn("_forced", forced).filter("kind = 'analysis'")
    complete = F.col("_forced") | F.coalesce(F.col("state") == "complete", F.lit(False))
    return out.select(key, order, complete.alias("complete"), F.when(F.col("_forced"), "forced_silence_timeout").otherwise("model_prediction").alias("reason"), "probability")


def usage_figures(payload: Column) -> Column:
    """Column: map of the usage figures that a provider's JSON payload states, nested details included; those that it leaves out or sets to null are left out."""
    value = lambda path: F.get_json_object(payload, f"$.usage.{path}").cast("double")
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(*map(value, paths)).alias("value")) for k, paths in USAGE.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def usage_of_turns(frames: DataFrame, turn: list[str], order: str) -> DataFrame:
    """turn, input_tokens, output_tokens, characters: the last of each that frames(kind, first, second) of a turn report; a frame of one kind leaves the other's figures."""
    last = lambda kind, column: F.max_by(F.when(F.col("kind") == kind, F.col(column)), F.when((F.col("kind") == kind) & F.col(column).isNotNull(), F.col(order)))
    return frames.groupBy(*turn).agg(last("llm", "first").alias("input_tokens"), last("llm", "second").alias("output_tokens"), last("tts", "first").alias("characters"))


def last_recovered(items: DataFrame, call: str, turn: str, order: str) -> DataFrame:
    """call, turn, event: the last event of each turn that tells of a recovery; of items(item, kind, event) only events count."""
    hit = (F.col("item") == "event") & (F.col("kind") == "recovered") & F.col(turn).isNotNull()
    return items.filter(hit).groupBy(call, turn).agg(F.max_by("event", order).alias("event"))


def session_starts(sessions: DataFrame, held: DataFrame, user: str, limit: int = 2000) -> DataFrame:
    """A new call for each session(user, transport): title, status, transport, and the user's active facts as lines `type.key: value`, sorted and cut to `limit` characters.

    held: facts(user, type, key, value) that hold now. Users without facts start with an empty text; sessions without a user start no call.
    """
    line = F.concat(F.col("type"), F.lit("."), F.col("key"), F.lit(": "), F.col("value"))
    facts = held.select(user, line.alias("l")).groupBy(user).agg(F.array_join(F.array_sort(F.collect_list("l")), "\n").alias("facts"))
    calls = sessions.filter(F.col(user).isNotNull()).withColumn("transport", F.left(F.coalesce(F.nullif("transport", F.lit("")), F.lit("webrtc")), F.lit(32)))
    calls = calls.withColumn("title", F.lit("New call")).withColumn("status", F.lit("initializing"))
    return calls.join(facts, user, "left").withColumn("facts", F.left(F.coalesce("facts", F.lit("")), F.lit(limit)))


def decoded(data: Column) -> Column:
    """Column: bytes as text; what isn't UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(data.cast("string"))
