"""Queries of stored tables: paged scans, schema probes, JSON rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import json as J
from quarry.plans.base import Tables, query
from quarry.plans.streams import kept, stream_dir
from quarry.sources import probes
from quarry.sources.keyset import KeysetSource

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string"


def paged(t: Tables) -> dict[str, str]:
    t.spark.dataSource.register(KeysetSource)
    return {"path": f"{t.sf_dir}/orders.parquet", "key": "o_orderkey", "columns": ORDERS, "page": "1000"}


@query("s15_paged_scan", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def s15(t: Tables) -> DataFrame:
    return t.spark.read.format("keyset").options(**paged(t)).load()


@query("s15_paged_stream", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def s15_stream(t: Tables) -> DataFrame:
    return kept(t.spark.readStream.format("keyset").options(**paged(t)).load(), stream_dir(t))


#: What is expected of four tables; of labels and orders, something that they don't have.
EXPECTED = {
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "labels": {"doc_id": "bigint", "quality": "string", "score": "double"},
    "trechos": {"id": "string"},
}
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "FLOAT[]": "array<float>"}


@query(
    "r16_schema_probe",
    "WITH e(name, col, want) AS (VALUES " + ", ".join(f"('{n}', '{c}', '{k}')" for n, cs in EXPECTED.items() for c, k in cs.items()) + "),"
    " f AS (SELECT table_name AS name, lower(column_name) AS col, CASE data_type " + " ".join(f"WHEN '{d}' THEN '{s}'" for d, s in TYPES.items())
    + " ELSE lower(data_type) END AS got FROM information_schema.columns),"
    " b AS (SELECT coalesce(e.name, f.name) AS name, coalesce(e.col, f.col) AS col, want, got FROM e FULL JOIN f ON e.name = f.name AND e.col = f.col"
    " WHERE coalesce(e.name, f.name) IN (SELECT name FROM e))"
    " SELECT name, count(got) > 0 AS present, coalesce(string_agg(col, ',' ORDER BY col) FILTER (got IS NULL), '') AS missing,"
    " coalesce(string_agg(col || ': ' || want || ', ' || got, ',' ORDER BY col) FILTER (want <> got), '') AS retyped,"
    " coalesce(string_agg(col, ',' ORDER BY col) FILTER (want IS NULL), '') AS extra, count(*) FILTER (got IS NULL OR want <> got) = 0 AS ok FROM b GROUP BY name",
)
def r16(t: Tables) -> DataFrame:
    found = probes.probe(t.spark, {n: f"{t.sf_dir}/{n}.parquet" for n in EXPECTED}, {n: {"columns": c} for n, c in EXPECTED.items()})
    return found.select("name", "present", *[F.array_join(c, ",").alias(c) for c in ("missing", "retyped", "extra")], "ok")


@query(
    "a22_json_objects",
    "WITH o AS (SELECT o_custkey AS customer, o_orderpriority AS priority, o_orderkey AS k, o_orderstatus AS status, floor(o_totalprice)::BIGINT AS total FROM orders),"
    " p AS (SELECT customer, priority, {'n': count(*), 'last': arg_max_null(CASE WHEN status = 'F' THEN NULL ELSE [status] END, k),"
    " 'orders': list({'key': k, 'total': CASE WHEN status = 'P' THEN NULL ELSE total END} ORDER BY total DESC, k)} AS v FROM o GROUP BY ALL)"
    " SELECT customer, to_json(map(list(priority ORDER BY priority), list(v ORDER BY priority)))::VARCHAR AS by_priority,"
    " (SELECT to_json(list(CASE WHEN o.status = 'P' THEN NULL ELSE o.total END ORDER BY o.k))::VARCHAR FROM o WHERE o.customer = p.customer) AS totals FROM p GROUP BY customer",
)
def a22(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("k"),
                        F.col("o_orderstatus").alias("status"), F.floor("o_totalprice").alias("total"))
    open_ = F.when(F.col("status") != "P", F.col("total"))
    entry = F.struct(F.col("k").alias("key"), open_.alias("total"))
    last = F.max_by(F.struct(F.when(F.col("status") != "F", F.array("status")).alias("v")), "k")["v"]
    p = o.groupBy("customer", "priority").agg(F.count("*").alias("n"), last.alias("last"), J.array_agg(entry, -F.col("total"), F.col("k")).alias("orders"))
    objects = p.groupBy("customer").agg(J.text(J.object_agg(F.col("priority"), F.struct("n", "last", "orders"))).alias("by_priority"))
    totals = o.groupBy("customer").agg(J.text(J.array_agg(open_, F.col("k"))).alias("totals"))
    return objects.join(totals, "customer")
