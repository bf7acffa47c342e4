"""Paged scans, schema probes and JSON aggregates on what the queries' tables don't have."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import json as J
from quarry.sources import keyset, probes


def write(spark, rows, path, kind="k bigint, v string", mode="append"):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode(mode).parquet(path)


def source(spark, path, how="read", **options):
    spark.dataSource.register(keyset.KeysetSource)
    return getattr(spark, how).format("keyset").options(path=path, key="k", columns="k bigint, v string", **options).load()


ROWS = [(k * k % 91 - 40, f"v{k}") for k in range(120)] + [(7, "same")] * 30 + [(None, "none"), (None, None), (10_000_000, "far")]


@pytest.mark.parametrize("page,parts", [(1000, 8), (5, 3), (1, 1)])
def test_pages_give_every_row_once(spark, tmp_path, page, parts):
    """Gaps, repeated keys at the end of a page, null keys, several files."""
    path = str(tmp_path / "t")
    write(spark, ROWS[:70], path)
    write(spark, ROWS[70:], path)
    got = source(spark, path, page=page, parts=parts).collect()
    assert sorted(map(tuple, got), key=str) == sorted(ROWS, key=str)


def test_a_short_page_is_the_last(tmp_path, spark):
    path = str(tmp_path / "t")
    write(spark, [(k, "x") for k in range(10)], path)
    store, asked = keyset.ParquetStore(path, "k", ["k", "v"]), []
    whole = store.page
    store.page = lambda *a: asked.append(a) or whole(*a)
    assert [t.column("k").to_pylist() for t in keyset.pages(store, "k", -1, 9, 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert [a[0] for a in asked] == [-1, 3, 7] and store.bounds() == (0, 9)
    assert list(keyset.pages(store, "k", 9, 99, 4)) == []


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    write(spark, [], path)
    assert source(spark, path).collect() == []
    assert [(r.after, r.upto) for r in keyset.ranges(0, 3, 8)] == [(0, 1), (1, 2), (2, 3)]


def test_stream_goes_on_behind_its_last_key(spark, tmp_path):
    path, out, log = (str(tmp_path / n) for n in ("t", "out", "log"))

    def run():
        q = source(spark, path, "readStream", page=7).writeStream.format("parquet").option("path", out).option("checkpointLocation", log)
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()), key=str)

    write(spark, [(k, "a") for k in range(50)] + [(None, "no key")], path)
    first = run()
    assert first == sorted([(k, "a") for k in range(50)], key=str) and run() == first
    write(spark, [(k, "b") for k in range(50, 80)] + [(3, "too late")], path)
    assert run() == sorted([(k, "a" if k < 50 else "b") for k in range(80)], key=str)


def test_probe(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", "x", 2.0)], "id int, Text string, lang string, score double")
    probes.declared(df, 10).write.partitionBy("lang").parquet(path)
    probes.declared(df.withColumn("later", F.lit(1)), 10).write.mode("append").partitionBy("lang").parquet(path)
    (tmp_path / "hollow").mkdir()
    paths = {"a": path, "b": path, "c": str(tmp_path / "nowhere"), "d": str(tmp_path / "hollow")}
    plain = {"id": "int", "text": "string", "lang": "string", "score": "double"}
    expected = {
        "a": {"columns": plain, "partitions": ["lang"], "version": 10},
        "b": {"columns": {"id": "bigint", "gone": "string"}, "partitions": [], "version": 11},
        "c": {"columns": plain}, "d": {"columns": plain}, "e": {"columns": {}},
    }
    a, b, c, d, e = probes.probe(spark, paths, expected).orderBy("name").collect()
    assert a.ok and a.extra == ["later"] and a.partitions == ["lang"] and a.version == 10
    assert not b.ok and b.missing == ["gone"] and b.retyped == ["id: bigint, int"]
    assert not any(x.present or x.ok for x in (c, d, e)) and c.missing == sorted(plain)
    said = {r.name: r.difference for r in probes.difference(probes.probe(spark, paths, expected)).collect()}
    assert said["b"] == "missing gone; other type id: bigint, int" and said["c"].startswith("not there; missing")


def test_json_aggregates(spark):
    rows = [(1, "b", 2, None), (1, "a", 1, "x"), (1, "b", 1, "old"), (1, None, 5, "no key"), (2, "é\"", 1, "1")]
    df = spark.createDataFrame(rows, "g int, k string, n int, v string")
    made = df.groupBy("g").agg(
        J.text(J.object_agg(F.col("k"), F.struct("v", "n"), F.col("n"))).alias("o"),
        J.text(J.object_agg(F.col("k"), F.col("v"), F.col("n"))).alias("flat"), J.text(J.array_agg(F.col("v"), -F.col("n"), F.col("v"))).alias("a"),
    )
    one, two = made.orderBy("g").collect()
    assert one.o == '{"a":{"v":"x","n":1},"b":{"v":null,"n":2}}' and one.flat == '{"a":"x","b":null}'
    assert one.a == '["no key",null,"old","x"]' and json.loads(two.o) == {'é"': {"v": "1", "n": 1}}
