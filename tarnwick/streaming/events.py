"""Structured Streaming twins of event reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwick.session import shared_path


def event_stream(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """The events of a Parquet folder or file as a stream with a time-zoned timestamp."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    stream = reader.parquet(folder + "/" + name + "*")
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def daily(stream: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), kind).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def times_seen(stream: DataFrame, key: str = "user_id", ts: str = "ts", debounce_s: int = 3600) -> DataFrame:
    """Stateful twin of sightings(): a key's counter goes up after a pause of over debounce_s; each batch emits the keys it touched.

    A batch's events of a key are sorted in its task as plain numbers, eight bytes each. What is older than the key's last event by the time it
    comes adds nothing.
    """

    def step(found: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (0, None)
        stamps = np.sort(np.concatenate([f[ts].to_numpy("datetime64[us]").astype(np.int64) for f in frames]))
        stamps = stamps if last is None else stamps[stamps > last]
        if len(stamps):
            gaps = np.diff(stamps, prepend=stamps[0] if last is None else last)
            seen += int((gaps > debounce_s * 1_000_000).sum()) + (last is None)
            last = int(stamps[-1])
        state.update((seen, last))
        yield pd.DataFrame({key: [found[0]], "times_seen": [seen]})

    return stream.select(key, ts).groupBy(key).applyInPandasWithState(step, f"{key} long, times_seen long", "seen long, last long", "update", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, mode: str = "complete") -> DataFrame:
    """All that a bounded stream yields: each batch is written to the shared folder, where the state is kept too; of a complete stream the last batch counts.

    Nothing passes through the driver, and a batch that runs again overwrites what it wrote.
    """
    spark = df.sparkSession
    out, state = shared_path(spark, "stream"), shared_path(spark, "state")
    done: list[int] = []

    def put(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={no}")
        done.append(no)

    df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    wanted = done[-1:] if mode == "complete" else done
    return spark.read.schema(df.schema).parquet(*[f"{out}/batch={no}" for no in dict.fromkeys(wanted)]) if wanted else spark.createDataFrame([], df.schema)
