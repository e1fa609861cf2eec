"""Event intake as a stream: idempotent by command, latest state per key, windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; a repeat within the watermark is dropped and state older than it is forgotten."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, keys: list[str], length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and distinct-free sums per window and key; windows close when the watermark passes them."""
    by = events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count(F.lit(1)).alias("events"))
    return by.select(F.col("window.start").alias("start"), *keys, "events")


def latest_state(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Every change of a key's state: an event counts if its ``order`` is greater than all before it.

    Late and repeated events change nothing, so the stream may be replayed. State is one row per key.
    """
    kinds = dict(events.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {state} {kinds[state]}, previous {kinds[state]}"

    def step(name: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        best, current = held.get if held.exists else (None, None)
        rows = []
        for at, value in sorted((x for pdf in frames for x in zip(pdf[order], pdf[state], strict=True)), key=lambda x: x[0]):
            if best is None or at > best:
                rows.append((name[0], at, value, current))
                best, current = at, value
        if rows:
            held.update((best, current))
            yield pd.DataFrame(rows, columns=[key, order, state, "previous"])

    return events.select(key, order, state).groupBy(key).applyInPandasWithState(step, out, f"{order} {kinds[order]}, {state} {kinds[state]}", "append", "NoTimeout")


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its output table (for tests and backfills of small streams)."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
