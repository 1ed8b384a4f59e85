"""Streams of ticks and items: daily bars, duplicates, marks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_bars(ticks: DataFrame, late: str | None = None) -> DataFrame:
    """Ticks (symbol, ts, value) to bars of each day, of a table or a stream; with late, a watermark on ts."""
    if late:
        ticks = ticks.withWatermark("ts", late)
    found = ticks.groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")
    )
    return found.select("symbol", F.to_date("w.start").alias("date"), "open", "high", "low", "close", "volume")


def fresh_items(items: DataFrame, max_age_hours: int = 36) -> DataFrame:
    """A stream of items (symbol, content_hash, published_at, received_at) without the stale and the repeated."""
    young = items.where(F.col("published_at") >= F.col("received_at") - F.expr(f"interval {max_age_hours} hours"))
    return young.withWatermark("published_at", f"{max_age_hours} hours").dropDuplicatesWithinWatermark(["symbol", "content_hash"])


def append_marks(samples: DataFrame, path: str, checkpoint: str):
    """Write a stream of marks (at, value, state) as JSON lines, what there is now, once each."""
    return samples.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


MARKS = "session string, at timestamp, value double, pnl double, pct double, state string"


def marked_to_market(samples: DataFrame) -> DataFrame:
    """A stream of book values (session, at, value, state) with profit since the session's first value, which is kept as state."""

    def mark(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        first = held.get[0] if held.exists else float(rows["value"].iloc[0])
        held.update((first,))
        pnl = rows["value"] - first
        yield pd.DataFrame({"session": key[0], "at": rows["at"], "value": rows["value"], "pnl": pnl, "pct": pnl / first if first else 0.0, "state": rows["state"]})

    return samples.select("session", "at", "value", "state").groupBy("session").applyInPandasWithState(mark, MARKS, "first double", "append", GroupStateTimeout.NoTimeout)


def watch(stream: DataFrame, seconds: float, show, count: int = 0):
    """Call show(rows) with what each trigger brings, every so many seconds; stop after count triggers, or never for 0."""

    def each(batch: DataFrame, number: int) -> None:
        if not count or number < count:
            show(batch.collect())

    return stream.writeStream.foreachBatch(each).trigger(processingTime=f"{seconds} seconds").start()
