"""Streaming ingest at most once per content, and a circuit breaker as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import content_key


def ingest_once(stream: DataFrame, target: str, text: str, checkpoint: str) -> None:
    """Append the rows of a stream to a Parquet folder, each content once (T05); runs over all there is, then stops.

    Each micro-batch goes to a folder of its own number, written over when a batch is run again, and leaves out contents
    that the folders of other batches hold. Of equal contents in a batch one stays.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("content_key", content_key(F.coalesce(text, F.lit("")))).dropDuplicates(["content_key"])
        held = _existing(spark, target)
        if held is not None:
            new = new.join(held.where(F.col("batch") != number).select("content_key"), "content_key", "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _existing(spark: SparkSession, target: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path) or not any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(path)):
        return None
    return spark.read.parquet(target)


def breaker_stream(calls: DataFrame, threshold: int = 2, recovery_us: int = 120_000_000) -> DataFrame:
    """(event_id, streak, blocked_until) of a stream calls(event_id, user_id, us, failed) (T07; batch twin: usage.breaker).

    State is the failures in a row; rows of one trigger are taken in time order.
    """

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        streaks = []
        for bad in rows["failed"]:
            streak = streak + 1 if bad else 0
            streaks.append(streak)
        state.update((streak,))
        until = [u + recovery_us if s >= threshold else None for u, s in zip(rows["us"], streaks)]
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "streak": streaks, "blocked_until": pd.array(until, "Int64")})

    return calls.groupBy("user_id").applyInPandasWithState(
        run, "event_id bigint, streak bigint, blocked_until bigint", "streak bigint", "append", "NoTimeout"
    )
