"""Queries of joins, aggregations, windows, quality and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import chunk, quality, usage
from quarry.plans.base import Tables, query

KEY = "lower(regexp_replace(trim(coalesce(text, '')), '\\s+', ' ', 'g'))"


@query(
    "a01_quality_stats",
    f"WITH r AS (SELECT source AS collection, doc_id, length(trim(coalesce(text, ''))) AS n, {KEY} AS k, n_chars IS NULL AS novec FROM documents),"
    " g AS (SELECT collection, k, count(*) AS c FROM r WHERE n > 0 GROUP BY ALL), d AS (SELECT collection, sum(c - 1) AS dup FROM g GROUP BY 1)"
    " SELECT collection, count(DISTINCT doc_id) AS documents, count(*) AS chunks, count(*) FILTER (novec) AS without_vector, count(*) FILTER (n = 0) AS empty,"
    " count(*) FILTER (n BETWEEN 1 AND 79) AS short, CAST(any_value(dup) AS BIGINT) AS duplicates FROM r JOIN d USING (collection) GROUP BY collection",
)
def a01(t: Tables) -> DataFrame:
    out = quality.quality_stats(t.documents, "source", "text", "doc_id", F.col("n_chars").isNull())
    return out.select("collection", "documents", "chunks", "without_vector", "empty", "short", "duplicates")


@query(
    "a03_daily_usage",
    "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (value > 50) AS hits, count(*) FILTER (event_type = 'click') AS failures,"
    " CAST(round(100.0 * count(*) FILTER (value > 50) / count(*)) AS BIGINT) AS hit_rate FROM events GROUP BY 1",
)
def a03(t: Tables) -> DataFrame:
    return usage.daily(t.events, "ts", F.col("value") > 50, F.col("event_type") == "click")


@query("a06_count_by_type", "SELECT event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1")
def a06(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


@query(
    "a07_legacy_groups",
    "SELECT coalesce(source, 'sem fonte') AS source, lang, count(*) AS n FROM documents GROUP BY ALL",
)
def a07(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.coalesce("source", F.lit("sem fonte")).alias("source"), "lang").agg(F.count("*").alias("n"))


@query(
    "a12_grouped_split",
    "SELECT part, count(*) AS n FROM (SELECT CASE WHEN source IN ('src1', 'src2') THEN 'test' ELSE 'development' END AS part FROM documents) GROUP BY 1",
)
def a12(t: Tables) -> DataFrame:
    test = t.documents.select("source").distinct().where("source in ('src1', 'src2')")
    return quality.grouped_split(t.documents.select("doc_id", "source"), "source", test).groupBy("part").agg(F.count("*").alias("n"))


@query(
    "a13_readiness",
    "WITH s AS (SELECT source, count(*) AS items, count(*) FILTER (n_chars < 20) AS bad FROM documents GROUP BY 1) SELECT source,"
    " CASE WHEN items <= 0 OR bad > 0 THEN 'critica' WHEN items % 2 = 0 THEN 'pronta' ELSE 'atencao' END AS status FROM s",
)
def a13(t: Tables) -> DataFrame:
    from quarry.operators.rules import readiness

    s = t.documents.groupBy("source").agg(F.count("*").alias("items"), F.count_if(F.col("n_chars") < 20).alias("bad"))
    hit = F.when(F.col("items") % 2 == 0, 100).otherwise(80)
    return s.select("source", readiness(F.col("bad"), F.lit(0), F.col("items"), hit, F.lit(100)).alias("status"))


@query(
    "a15_latest",
    "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1",
)
def a15(t: Tables) -> DataFrame:
    return usage.latest(t.events.select("user_id", "event_id", "ts"), ["user_id"], F.col("ts").desc(), F.col("event_id"))


@query("a17_repeated_codes", "SELECT l_partkey AS code, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 30")
def a17(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("code")).agg(F.count("*").alias("n")).where("n > 30")


@query(
    "a20_unique_only",
    f"SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY {KEY}) AS n FROM documents) WHERE n = 1",
)
def a20(t: Tables) -> DataFrame:
    from quarry.functions.text import content_key

    return quality.unique_only(t.documents.select("doc_id", content_key(F.coalesce("text", F.lit(""))).alias("k")), F.col("k")).select("doc_id")


@query(
    "a22_json_rollup",
    "SELECT n_regionkey AS region, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1",
)
def a22(t: Tables) -> DataFrame:
    names = F.array_join(F.sort_array(F.collect_list("n_name")), ",")
    return t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), names.alias("names"))


@query(
    "w01_rolling_limit",
    "SELECT event_id, used, used <= 5 AS allowed, greatest(5 - used, 0) AS remaining FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts"
    " RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS used FROM events)",
)
def w01(t: Tables) -> DataFrame:
    return usage.rolling_limit(t.events, "user_id", "ts", 5).select("event_id", "used", "allowed", "remaining")


@query(
    "w04_islands",
    "WITH d AS (SELECT DISTINCT o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS n FROM orders),"
    " g AS (SELECT *, n - row_number() OVER (PARTITION BY o_custkey ORDER BY n) AS g FROM d) SELECT o_custkey, min(n) AS first, max(n) AS last, count(*) AS length FROM g GROUP BY o_custkey, g",
)
def w04(t: Tables) -> DataFrame:
    days = t.orders.select("o_custkey", F.unix_date(F.to_date("o_orderdate")).cast("long").alias("n"))
    return usage.islands(days, "o_custkey", "n")


@query(
    "w05_carry_forward",
    "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events",
)
def w05(t: Tables) -> DataFrame:
    out = usage.carry_forward(t.events, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")))
    return out.select("event_id", "carried")


@query(
    "j05_field_differences",
    "WITH o AS (SELECT o_orderkey, o_orderstatus AS a, o_orderpriority AS b FROM orders), s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS a2,"
    " o_orderpriority AS b2 FROM orders WHERE o_orderkey % 7 <> 0) SELECT o_orderkey, CASE WHEN a2 IS NULL THEN 'missing' WHEN a <> a2 THEN 'different' ELSE 'equal' END AS status,"
    " CASE WHEN a2 IS NOT NULL AND a <> a2 THEN 'a' ELSE '' END AS differences FROM o LEFT JOIN s USING (o_orderkey)",
)
def j05(t: Tables) -> DataFrame:
    ours = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    sheet = ours.where("o_orderkey % 7 <> 0").withColumn("a", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("a")))
    return quality.field_differences(ours, sheet, "o_orderkey", ["a", "b"])


@query(
    "j06_prefix_join",
    "SELECT p_partkey, theme FROM part JOIN (VALUES ('Brand#1'), ('Brand#2'), ('Brand#31')) v(theme) ON starts_with(p_brand, theme)",
)
def j06(t: Tables) -> DataFrame:
    themes = t.spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#31",)], "theme string")  # three rows
    return t.part.join(F.broadcast(themes), F.startswith("p_brand", "theme")).select("p_partkey", "theme")


@query(
    "j08_nearest",
    "WITH a AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS x FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000000 AS y FROM events"
    " WHERE event_type = 'purchase') SELECT event_id, y FROM a JOIN b ON a.user_id = b.user_id AND abs(x - y) <= 86400"
    " QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(x - y), y) = 1",
)
def j08(t: Tables) -> DataFrame:
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    a = t.events.where("event_type = 'click'").select("event_id", "user_id", sec.alias("x"))
    b = t.events.where("event_type = 'purchase'").select("user_id", sec.alias("y")).distinct()
    return usage.nearest(a, b, "user_id", "x", "y", 86400).select("event_id", "y")


@query("j09_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j09(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j10_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def j10(t: Tables) -> DataFrame:
    large = t.lineitem.where("l_quantity > 30")
    return t.orders.join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query(
    "j11_overlap_join",
    "SELECT a.o_orderkey, count(DISTINCT b.l_orderkey) AS related FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey AS k FROM lineitem) a"
    " JOIN (SELECT DISTINCT l_orderkey, l_partkey AS k FROM lineitem WHERE l_linenumber = 1) b USING (k) WHERE a.o_orderkey <> b.l_orderkey GROUP BY 1",
)
def j11(t: Tables) -> DataFrame:
    a = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("k")).distinct()
    b = t.lineitem.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("k")).distinct()
    both = a.join(b, "k").where("o_orderkey <> l_orderkey")
    return both.groupBy("o_orderkey").agg(F.countDistinct("l_orderkey").alias("related"))


@query("s24_dedupe", f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {KEY}")
def s24(t: Tables) -> DataFrame:
    from quarry.functions.text import content_key

    k = content_key(F.coalesce("text", F.lit("")))
    return t.documents.groupBy(k.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


@query("s21_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def s21(t: Tables) -> DataFrame:
    from quarry.sources.files import upsert

    old = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return upsert(old, old.where("o_orderkey % 4 = 0").withColumn("status", F.lit("new")), ["o_orderkey"])


@query(
    "t03_expired",
    "SELECT event_id FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > user_id % 30",
)
def t03(t: Tables) -> DataFrame:
    return usage.expired(t.events, F.col("ts"), F.col("user_id") % 30, F.lit("2024-01-31").cast("date")).select("event_id")


@query(
    "q15_history",
    "SELECT conv_id, turn, substr(text, 1, 800) AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) <= 6",
)
def q15(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), "text")
    rows = t.conversations.withColumn("_r", F.row_number().over(w)).where("_r <= 6")
    return rows.select("conv_id", "turn", F.substring("text", 1, 800).alias("text"))


@query("c01_chunks")
def c01(t: Tables) -> DataFrame:
    return chunk.chunks(t.documents, "doc_id", "text")


@query("c01_sections")
def c01_sections(t: Tables) -> DataFrame:
    return chunk.chunks(t.documents, "doc_id", "text", mode="secoes")


@query("t02_stream_daily", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def t02(t: Tables) -> DataFrame:
    return _stream(t, "daily_counts", "complete")


@query(
    "t01_stream_rolling",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS used FROM events",
)
def t01(t: Tables) -> DataFrame:
    from quarry.plans.streams import kept, stream_dir
    from quarry.streaming import usage as S

    return kept(S.rolling_counts(S.read_events(t.spark, t.sf_dir)), stream_dir(t))


def _stream(t: Tables, what: str, mode: str) -> DataFrame:
    import uuid

    from quarry.plans.streams import stream_dir
    from quarry.streaming import usage as S

    name = f"quarry_{uuid.uuid4().hex}"
    return S.drain(getattr(S, what)(S.read_events(t.spark, t.sf_dir)), name, mode, f"{stream_dir(t)}/{name}")
