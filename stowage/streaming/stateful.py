"""Streaming forms: the hysteresis latch, first-seen contents, a log's rollup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stowage.functions.constants import GATE, Gate


def latch_stream(samples: DataFrame, gate: Gate = GATE) -> DataFrame:
    """samples: key long, seq long, share double. Adds latched, its state kept
    per key: on at the high mark, off at the low mark. Within a micro-batch rows
    are taken by seq."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for share in rows["share"]:
            on = True if share >= gate.latch_high else False if share <= gate.latch_low else on
            out.append(on)
        state.update((on,))
        yield rows.assign(latched=out)[["key", "seq", "share", "latched"]]

    return samples.groupBy("key").applyInPandasWithState(run, "key long, seq long, share double, latched boolean", "latched boolean", "append", GroupStateTimeout.NoTimeout)


def first_seen(files: DataFrame, key: str = "sha256", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Contents that weren't seen within the watermark; state is dropped behind it."""
    return files.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Operations per event-time window. Beyond the archive domain, which has no
    event time."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "operation").agg(F.count("*").alias("n"), F.sum("ms").alias("ms")).select(F.col("w.start").alias("start"), "operation", "n", "ms")
