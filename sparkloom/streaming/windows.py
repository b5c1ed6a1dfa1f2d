"""Windowed aggregation, sessions, de-duplication and custom state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder


def windowed(stream: DataFrame, time: str, length: str, aggs: dict[str, Column], keys: list[str] | None = None, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Tumbling windows, or sliding ones with ``slide``; rows later than ``late`` go."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    rows = stream.withWatermark(time, late).groupBy(window, *(keys or [])).agg(*[c.alias(n) for n, c in aggs.items()])
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(keys or []), *aggs)


def session_counts(stream: DataFrame, time: str, gap: str, keys: list[str], late: str = "0 seconds") -> DataFrame:
    """Sessions of rows at most ``gap`` apart, per key."""
    rows = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def deduplicate(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def keep_latest(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Per key the value of the latest row seen so far, as custom state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for frame in frames:
            row = frame.sort_values([time, value]).iloc[-1]
            got = (int(pd.Timestamp(row[time]).value // 1000), float(row[value]))
            best = got if best is None or got > tuple(best) else tuple(best)
        state.update(best)
        yield pd.DataFrame({key: [k[0]], "at_us": [best[0]], value: [best[1]]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, at_us long, {value} double", "at_us long, v double", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns the result table.

    Executors write each batch to a folder of its own, so the result is never
    in the driver; a complete result is the last batch. State is checkpointed
    where all executors find it, unless ``checkpoint`` names another place.
    """
    spark = stream.sparkSession
    path, done = shared_folder(spark, "stream"), []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/{batch}")
        if batch not in done:
            done.append(batch)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True)
    query.option("checkpointLocation", checkpoint or f"{path}/state").start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{path}/rows/{b}" for b in (done[-1:] if mode == "complete" else done)])
