"""Streaming ingest and the breaker against their batch twins."""

from pyspark.sql import functions as F

from quarry.operators import usage
from quarry.streaming import ingest
from quarry.streaming import usage as S

SF = "/root/testdata/sf0.001"


def test_ingest_once(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k, texts in enumerate([["a", "A ", "b"], ["b", "c", None]]):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("text string").parquet(src)
        ingest.ingest_once(stream, target, "text", str(tmp_path / "cp"))
        got = [r.k for r in spark.read.parquet(target).select(F.lower(F.trim(F.coalesce("text", F.lit("")))).alias("k")).collect()]
        assert sorted(got) == [["a", "b"], ["", "a", "b", "c"]][k]


def test_breaker_stream(spark, tmp_path):
    def calls(events):
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        return events.select("event_id", "user_id", us.alias("us"), (F.col("event_type") == "click").alias("failed"))

    stream = ingest.breaker_stream(calls(S.read_events(spark, SF)))
    got = S.drain(stream, "breaker_test", "append", str(tmp_path / "cp")).collect()
    want = usage.breaker(calls(spark.read.parquet(f"{SF}/events.parquet")), "user_id", "us", "event_id", "failed")
    want = want.select("event_id", "streak", "blocked_until").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
