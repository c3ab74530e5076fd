"""Traces as streams: an extension, since a running build is watched as it happens.

events: (ts TIMESTAMP, lane, tag, name). Late rows are waited for as long as the
watermark says; state is dropped behind it, so it does not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import upserted
from ..shared import reach_workers


def read_events(spark: SparkSession, path: str, schema: str = "ts timestamp, lane long, tag string, name string") -> DataFrame:
    """Events from a folder of JSON lines to which files are added."""
    return spark.readStream.schema(schema).json(path)


def windowed_counters(events: DataFrame, tags: dict[str, str], window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(begin, lane, one column a name): counts of tags in windows of time."""
    counts = [F.count_if(F.col("tag") == tag).alias(name) for name, tag in tags.items()]
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "lane").agg(*counts)
    return rows.select(F.col("window.start").alias("begin"), "lane", *tags)


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(lane, begin, end, events): runs of a lane's events without a longer gap."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "lane").agg(F.count("*").alias("events"))
    return rows.select("lane", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "events")


def paired(events: DataFrame, begin: str = "begin", end: str = "end", late: str = "5 minutes", forget: int = 3_600_000) -> DataFrame:
    """(lane, name, begin, end): each end with the begin of its lane and name that came
    before it, across batches. An open begin is forgotten `forget` milliseconds behind the
    watermark. The state of a key is one time."""
    import pandas as pd

    reach_workers(events.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_at = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            if row.tag == begin:
                open_at = row.ts
            elif row.tag == end and open_at is not None:
                out.append((key[0], key[1], open_at, row.ts))
                open_at = None
        if open_at is not None:
            state.update((int(open_at.value // 1000),))
            state.setTimeoutTimestamp(max(int(open_at.value // 1_000_000), state.getCurrentWatermarkMs()) + forget)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["lane", "name", "begin", "end"])

    rows = events.where(F.col("tag").isin(begin, end)).withWatermark("ts", late)
    return rows.groupBy("lane", "name").applyInPandasWithState(step, "lane long, name string, begin timestamp, end timestamp", "open_us long", "append", "EventTimeTimeout")


def keep_latest(results: DataFrame, folder: str, keys: list[str]):
    """A writer that keeps, below folder, the latest result of each key: each batch is
    merged with the snapshot before it, and the newest snapshot is the highest number."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), "epoch").alias("r")).select(*keys, "r.*")
        before = spark.read.schema(new.schema).parquet(f"{folder}/{n - 1}") if n else new.where("false")
        upserted(before, new, keys).write.mode("overwrite").parquet(f"{folder}/{n}")

    return results.writeStream.foreachBatch(merge).outputMode("append")
