"""Streaming forms of the library's incremental operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def windowed_counts(events: DataFrame, time: str, keys: list[str], length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts in tumbling or sliding windows; rows later than the watermark are left out, state older than it is dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "1 day") -> DataFrame:
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *keys).agg(F.count("*").alias("n"))


class KeyedState(StatefulProcessor):
    """The last state of a key and how often each state was met.

    All of it is one value (place, tie, state, steps, timer, counts of the states met
    as JSON), read and written once for each key of a batch.  A row that comes late
    counts, but does not undo a later one.  With `idle_ms`, a key whose watermark has
    passed its last place by so much is closed: a timer says so once more and frees
    its state.
    """

    def __init__(self, key: str, idle_ms: int | None = None):
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "place long, tie long, state string, steps long, timer long, met string")

    def row(self, key, place: int, state: str, steps: int, met: dict[str, int], closed: bool) -> Row:
        return Row(**{self.key: key[0], "state": state, "place": place, "n_steps": steps, "n_states": len(met), "closed": closed})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        place, tie, state, steps, timer, met = self.last.get() or (None, None, None, 0, None, None)
        counts: dict[str, int] = json.loads(met) if met else {}
        if place is not None and self.idle_ms is not None and timerValues.getCurrentWatermarkInMs() >= place // 1000 + self.idle_ms:
            yield self.row(key, place, state, steps, counts, True)  # timers run after a batch's rows
            place, tie, state, steps, counts = None, None, None, 0, {}
        for r in rows:
            steps += 1
            if place is None or (r.at_place, r.at_tie) > (place, tie):
                place, tie, state = r.at_place, r.at_tie, r.at_state
            if r.at_state is not None:
                counts[r.at_state] = counts.get(r.at_state, 0) + 1
        due = place // 1000 + self.idle_ms if self.idle_ms is not None else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.last.update((place, tie, state, steps, due, json.dumps(counts)))
        yield self.row(key, place, state, steps, counts, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.last.get()
        if held:
            place, _, state, steps, _, met = held
            yield self.row(key, place, state, steps, json.loads(met), True)
            self.last.clear()

    def close(self) -> None:
        pass


def keyed_states(events: DataFrame, key: str, time: str, tie: str, state: str, late: str, idle_ms: int | None = None) -> DataFrame:
    """(key, state, place, n_steps, n_states, closed): the last state of each key that a batch met, by time and tie, and the keys that it closed.

    place is the time in microseconds.  The session needs STATE_STORE.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = timed.select(key, time, F.unix_micros(time).alias("at_place"), F.col(tie).cast("long").alias("at_tie"), F.col(state).alias("at_state"))
    kind = dict(events.dtypes)[key]
    return rows.groupBy(key).transformWithState(KeyedState(key, idle_ms), f"{key} {kind}, state string, place long, n_steps long, n_states long, closed boolean", "Update", "EventTime")


def last_states(events: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """The last state of each key by sequence number, kept across batches; older rows that come late do not undo it.  The session needs STATE_STORE."""
    kind = dict(events.dtypes)[key]
    rows = events.select(key, F.col(seq).cast("long").alias("at_place"), F.lit(0).cast("long").alias("at_tie"), F.col(state).alias("at_state"))
    found = rows.groupBy(key).transformWithState(KeyedState(key), f"{key} {kind}, state string, place long, n_steps long, n_states long, closed boolean", "Update", "None")
    return found.select(key, "state", "n_steps")


def read_files(spark: SparkSession, folder: str, schema, glob: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def run_once(stream: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs all that is there and gives the result table: each batch replaces it in complete mode, and adds to it in others."""
    write = "overwrite" if mode == "complete" else "append"
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode(write).parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def logged(stream: DataFrame, path: str, checkpoint: str, listeners: list[Callable[[DataFrame, int], None]] = (), mode: str = "append") -> DataFrame:
    """Writes every batch under its own id, then tells the listeners (stored batch, id), and gives the log of all batches, with batch.

    A batch that is run again after a failure replaces what it wrote, so that each
    row is in the log once; a listener may hear of a batch again and can tell by its id.
    """

    def write(rows: DataFrame, batch: int) -> None:
        place = f"{path}/batch={batch}"
        rows.write.mode("overwrite").parquet(place)
        for tell in listeners:
            tell(rows.sparkSession.read.schema(rows.schema).parquet(place), batch)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends each batch to a log table, for readers of its newest rows."""
    return stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
