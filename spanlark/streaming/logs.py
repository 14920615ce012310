"""Result logs as streams: each key is appended once, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Lets the first row of each key through (by ``order`` within a batch) and remembers that it was there."""

    def __init__(self, columns: list[str], order: list[str]) -> None:
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("seen", T.BooleanType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        first = None
        for row in rows:  # one is held, however many there are
            if first is None or self.place(row) < self.place(first):
                first = row
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield Row(**{c: first[c] for c in self.columns})

    def place(self, row: Row) -> list[tuple]:
        return [(row[c] is None, row[c]) if row[c] is not None else (True,) for c in self.order]

    def handleInitialState(self, key: tuple, row: Row, timer_values) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def first_of_key(stream: DataFrame, keys: list[str], order: list[str] | None = None, done: DataFrame | None = None) -> DataFrame:
    """The rows of a stream that are the first of their key. Keys are kept in the state store, so a batch costs what it brings,
    whatever was appended before. done: a log that the stream did not write; its keys are taken into the state once, at the start."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    known = done.select(*keys).distinct().groupBy(*keys) if done is not None else None
    processor = FirstOfKey(stream.columns, order or [c for c in stream.columns if c not in keys])
    return stream.groupBy(*keys).transformWithState(processor, stream.schema, "Append", "None", known)


def append_new(stream: DataFrame, keys: list[str], target: str, checkpoint: str, *, order: list[str] | None = None, done: DataFrame | None = None) -> StreamingQuery:
    """Append the rows whose keys were not there before. State and output are committed by batch, so one that is run again after a
    failure leaves each key once; readers see whole batches."""
    fresh = first_of_key(stream, keys, order, done)
    return fresh.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed(events: DataFrame, ts: str, delay: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], delay: str = "1 hour") -> DataFrame:
    return timed(events, ts, delay).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, user: str, delay: str = "1 hour") -> DataFrame:
    return timed(events, ts, delay).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n"))


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
