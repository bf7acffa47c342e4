"""Quality of collections and of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import content_key


def quality_stats(chunks: DataFrame, by: str, text: str, doc: str, vector_missing: Column, short: int = 80) -> DataFrame:
    """Per collection: documents, chunks, without vector, empty, short, duplicates (rows beyond the first per text).

    One aggregation by (collection, text key) on the way to one per collection, so no text is shuffled.
    """
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    rows = chunks.select(
        F.col(by).alias("collection"), F.col(doc).alias("doc"), content_key(body).alias("k"), F.length(body).alias("n"),
        vector_missing.alias("novec"),
    )
    per = rows.groupBy("collection", "k").agg(
        F.count("*").alias("c"), F.first("n").alias("n"), F.count_if("novec").alias("novec")
    )
    stats = per.groupBy("collection").agg(
        F.sum("c").alias("chunks"), F.sum("novec").alias("without_vector"),
        F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("c"))), F.lit(0)).alias("empty"),
        F.coalesce(F.sum(F.when(F.col("n").between(1, short - 1), F.col("c"))), F.lit(0)).alias("short"),
        F.coalesce(F.sum(F.when((F.col("n") > 0) & (F.col("c") > 1), F.col("c") - 1)), F.lit(0)).alias("duplicates"),
    )
    docs = rows.groupBy("collection").agg(F.countDistinct("doc").alias("documents"))
    return stats.join(docs, "collection")


def ranking_metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """One row hit1, hit3, mrr, false_positives of ranked(qid, id, rank) against expected(qid, id or null).

    A question whose expected id is null should return nothing.
    """
    positive = expected.where("id is not null")
    first = ranked.join(positive, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("pos"))
    asked = positive.select("qid").distinct().join(first, "qid", "left")
    good = asked.agg(
        F.avg((F.coalesce("pos", F.lit(0)) == 1).cast("double")).alias("hit1"),
        F.avg((F.coalesce("pos", F.lit(9)) <= 3).cast("double")).alias("hit3"),
        F.avg(F.coalesce(1.0 / F.col("pos"), F.lit(0.0))).alias("mrr"),
    )
    none = expected.where("id is null").select("qid").distinct()
    wrong = none.join(ranked.select("qid").distinct().withColumn("got", F.lit(1.0)), "qid", "left")
    bad = wrong.agg(F.coalesce(F.avg(F.coalesce("got", F.lit(0.0))), F.lit(0.0)).alias("false_positives"))
    return good.crossJoin(bad)  # one row each


def grouped_split(cases: DataFrame, group: str, test_groups: DataFrame) -> DataFrame:
    """cases with ``part``: whole groups go to test, the others to development."""
    marks = test_groups.select(F.col(group).alias("_g")).distinct().withColumn("_t", F.lit(True))
    joined = cases.join(marks, F.col(group) == F.col("_g"), "left")
    return joined.withColumn("part", F.when(F.col("_t"), "test").otherwise("development")).drop("_g", "_t")


def unique_only(rows: DataFrame, key: Column) -> DataFrame:
    """Rows whose key occurs once."""
    w = Window.partitionBy(key)
    return rows.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_n")


def field_differences(ours: DataFrame, official: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, differences): ours against the official sheet, field by field."""
    sheet = official.select(F.col(key), *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_found"))
    diff = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    joined = ours.join(sheet, key, "left")
    status = F.when(F.col("_found").isNull(), "missing").when(F.size(diff) > 0, "different").otherwise("equal")
    named = F.when(F.col("_found").isNull(), F.lit("")).otherwise(F.array_join(diff, ","))
    return joined.select(key, status.alias("status"), named.alias("differences"))
