"""Structured Streaming over the event files: windows, sessions, deduplication, keyed state.

Every job takes a streaming DataFrame and gives one; ``run`` drives it over all files that are
there and returns what the sink holds. State is kept by Spark under the shared folder and is
bounded by watermarks or by the number of keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stackroom.session import shared_dir

#: How late an event may be.
DELAY = "1 hour"


def read(spark: SparkSession, folder: str, name: str, at: str, files_per_trigger: int = 16) -> DataFrame:
    """Stream over the parquet files called ``name`` in a folder; ``at`` is made a timestamp with a watermark."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, DELAY)


def run(stream: DataFrame, mode: str) -> DataFrame:
    """Process what is there, then read the result. mode: append, update (last batch's rows win) or complete."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", f"{base}/out").start()
    else:
        q = w.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def tumbling(stream: DataFrame, at: str, size: str, *by: str) -> DataFrame:
    g = stream.groupBy(F.window(at, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n")


def sliding(stream: DataFrame, at: str, size: str, slide: str, *by: str) -> DataFrame:
    g = stream.groupBy(F.window(at, size, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n")


def sessions(stream: DataFrame, at: str, key: str, gap_seconds: int) -> DataFrame:
    g = stream.groupBy(F.session_window(at, f"{gap_seconds} seconds 1 microsecond").alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("end"))
    return g.select("key", F.col("w.start").alias("start"), "end", "n")


def deduplicated(stream: DataFrame, *keys: str) -> DataFrame:
    """First row per key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def latest(stream: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """Newest row per key, kept as one extreme per key."""
    g = stream.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("x"))
    return g.select(key, *[F.col(f"x.{c}") for c in (at, *columns)])


def bounded_history(stream: DataFrame, key: str, order: str, value: str, keep: int = 10) -> DataFrame:
    """(key, n_seen, history) with the last ``keep`` values per key; state never holds more than those."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, at, vals = state.get if state.exists else (0, [], [])
        rows = sorted(zip(at, vals)) if vals else []
        for b in batches:
            n += len(b)
            rows = sorted(rows + list(zip(b["o"].tolist(), b["v"].tolist())))[-keep:]
        state.update((n, [r[0] for r in rows], [r[1] for r in rows]))
        yield pd.DataFrame({"key": [k[0]], "n_seen": [n], "history": [[r[1] for r in rows]]})

    s = stream.select(F.col(key).alias("key"), F.col(order).cast("long").alias("o"), F.col(value).cast("string").alias("v"))
    return s.groupBy("key").applyInPandasWithState(step, "key long, n_seen long, history array<string>", "n long, at array<bigint>, vals array<string>", "update", GroupStateTimeout.NoTimeout)


def rate_limited(stream: DataFrame, key: str, at: str, most: int, window: str) -> DataFrame:
    """(key, window_start, n, allowed): requests per fixed window and how many the limit lets through."""
    g = tumbling(stream, at, window, key)
    return g.select(F.col(key).alias("key"), "window_start", "n", F.least("n", F.lit(most)).alias("allowed"))
