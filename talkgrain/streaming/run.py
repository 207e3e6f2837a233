"""Machines and aggregates over batches and streams of events (key, id, at in milliseconds, kind, text)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrain.streaming.machines import Machine


def _rows(machine: Machine, state: dict, events: pd.DataFrame) -> tuple[dict, list[dict]]:
    out = []
    for e in events.sort_values(["at", "id"], kind="stable").to_dict("records"):
        state, rows = machine.step(state, e)
        out += rows
    return state, out


def _frame(key, rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([{"key": key, **r} for r in rows], columns=names)


def batch(events: DataFrame, machine: Machine) -> DataFrame:
    """Each key's events in order of (at, id). A key's events go to one task, as their order is the point."""
    schema = T.StructType([T.StructField("key", events.schema["key"].dataType), *T._parse_datatype_string(machine.output)])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _frame(key[0], _rows(machine, machine.start(), group)[1], schema.names)

    return events.select("key", "id", "at", "kind", "text").groupBy("key").applyInPandas(run, schema)


def stream(events: DataFrame, machine: Machine, idle_minutes: int | None = None) -> DataFrame:
    """The same over a stream; events of a key must come in order from batch to batch.

    State of a key idle for idle_minutes is dropped; give them for streams that run on (with a trigger that ends when the input
    does, such a timeout keeps Spark running empty batches).
    """
    schema = T.StructType([T.StructField("key", events.schema["key"].dataType), *T._parse_datatype_string(machine.output)])

    def run(key, groups, state):
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else machine.start()
        events_ = pd.concat(list(groups))
        now, rows = _rows(machine, now, events_)
        state.update((json.dumps(now),))
        if idle_minutes:
            state.setTimeoutDuration(idle_minutes * 60_000)
        yield _frame(key[0], rows, schema.names)

    return events.select("key", "id", "at", "kind", "text").groupBy("key").applyInPandasWithState(run, schema, "state string", "append", "ProcessingTimeTimeout" if idle_minutes else "NoTimeout")


def event_stream(spark, folder: str, schema, files_a_batch: int = 100) -> DataFrame:
    """New files of a folder, so many a micro-batch: the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)


def deduplicated(events: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once within the delay; state of older keys is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def abandoned(events: DataFrame, key: str, time: str, silence: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """key, started, last: sessions that ended by silence; in append mode, once the watermark has passed their end."""
    w = F.session_window(time, silence)
    return events.withWatermark(time, delay).groupBy(key, w.alias("w")).agg(F.max(time).alias("last")).select(key, F.col("w.start").alias("started"), "last")


def cohort_counts(events: DataFrame, category: str, value: str) -> DataFrame:
    """Running figures of each category, in update mode: constant state a category."""
    v = F.col(value)
    return events.groupBy(category).agg(F.count(v).alias("n"), F.avg(v).alias("avg_ms"), F.max(v).alias("max_ms"))


def latest_generation(events: DataFrame, key: list[str], generation: str) -> DataFrame:
    """Only results of each key's highest generation; superseded ones go."""
    top = events.groupBy(*key).agg(F.max(generation).alias("_top"))
    return events.join(top, key).filter(F.col(generation) == F.col("_top")).drop("_top")


def fan_out(batch_: DataFrame, batch_id: int, targets: list[str]) -> None:
    """For foreachBatch: the same rows to several places. A batch that is run again overwrites what it wrote."""
    rows = batch_.persist()
    try:
        for t in targets:
            rows.write.mode("overwrite").parquet(f"{t}/batch={batch_id}")
    finally:
        rows.unpersist()
