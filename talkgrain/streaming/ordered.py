"""Machines over streams whose events come out of order: each key's events wait in list state until the watermark has passed them.

An event sets a timer at its own time. When the watermark reaches it, all events held up to then take the machine's step in the order of (at, id), so the rows
are those of the batch, however the events were dealt to micro-batches within the delay. State is as large as what the delay holds.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from talkgrain.streaming.machines import Machine

_EVENT = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])
_STATE = T.StructType([T.StructField("state", T.StringType())])
_NUMBER = T.StructType([T.StructField("generation", T.LongType())])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _needs_lists(spark: SparkSession) -> None:
    """List state and timers are kept by the store that Spark has for them; queries that start from now on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Held(StatefulProcessor):
    def __init__(self, machine: Machine, names: list[str]):
        self.machine, self.names = machine, names

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _EVENT)
        self.now = handle.getValueState("now", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        for r in rows:
            self.held.appendValue((r.id, r.at, r.kind, r.text))
            self.handle.registerTimer(r.at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs()
        held = [tuple(e) for e in self.held.get()]
        due = sorted((e for e in held if e[1] <= until), key=lambda e: (e[1], e[0]))
        if not due:
            return
        rest = [e for e in held if e[1] > until]
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        state = json.loads(self.now.get()[0]) if self.now.exists() else self.machine.start()
        out = []
        for e in due:
            state, rows = self.machine.step(state, dict(zip(("id", "at", "kind", "text"), e, strict=True)))
            out += rows
        self.now.update((json.dumps(state),))
        for r in out:
            yield Row(key=key[0], **{n: r.get(n) for n in self.names})

    def close(self) -> None:
        pass


def ordered(events: DataFrame, machine: Machine, delay: str = "1 minute") -> DataFrame:
    """run.batch over a stream of (key, id, at in milliseconds of the epoch, kind, text), in any order within the delay.

    Events that come after the watermark has passed them are dropped, as by Spark's own operators; a key's last events come out once the stream's time has gone on by the delay.
    """
    _needs_lists(events.sparkSession)
    schema = T.StructType([T.StructField("key", events.schema["key"].dataType), *T._parse_datatype_string(machine.output)])
    timed = events.select("key", "id", "at", "kind", "text", F.timestamp_millis("at").alias("_time")).withWatermark("_time", delay)
    return timed.groupBy("key").transformWithState(_Held(machine, schema.names[1:]), schema, "append", "EventTime")


class _Newest(StatefulProcessor):
    def __init__(self, generation: str, order: tuple[str, ...]):
        self.generation, self.order = generation, order

    def init(self, handle) -> None:
        self.top = handle.getValueState("top", _NUMBER)

    def handleInputRows(self, key, rows, timerValues):
        top = self.top.get()[0] if self.top.exists() else None
        for r in sorted(rows, key=lambda r: tuple(r[o] for o in self.order)):
            if r[self.generation] is not None and (top is None or r[self.generation] >= top):
                top = r[self.generation]
                yield r
        if top is not None:
            self.top.update((top,))

    def close(self) -> None:
        pass


def current_results(results: DataFrame, key: str, generation: str, order: tuple[str, ...]) -> DataFrame:
    """The results that aren't superseded when they come: no greater generation of their key came before. Those without a generation go.

    The same for a batch, in the order given, and for a stream, whose micro-batches come in that order; a key's state is one number.
    """
    if not results.isStreaming:
        top = F.max(generation).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        return results.filter(F.col(generation).isNotNull()).withColumn("_top", top).filter(F.col(generation) == F.col("_top")).drop("_top")
    _needs_lists(results.sparkSession)
    return results.groupBy(key).transformWithState(_Newest(generation, order), results.schema, "append", "None")
