"""Usage analytics: rolling limits, daily counts, expiry, runs. Batch forms; streaming ones are in quarry.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def rolling_limit(events: DataFrame, key: str, ts: str, limit: int, window_us: int = HOUR) -> DataFrame:
    """events with used (in the window up to and including the row), allowed and remaining.

    Rows of one key and instant count together, as a RANGE frame has it.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(us).rangeBetween(-window_us, 0)
    used = F.count("*").over(w)
    return events.withColumn("used", used).withColumns(
        {"allowed": F.col("used") <= limit, "remaining": F.greatest(F.lit(limit) - F.col("used"), F.lit(0))}
    )


def daily(events: DataFrame, ts: str, hit: Column, failed: Column) -> DataFrame:
    """(day, n, hits, failures, hit_rate)."""
    return (
        events.groupBy(F.to_date(ts).alias("day"))
        .agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(failed).alias("failures"))
        .withColumn("hit_rate", F.round(100 * F.col("hits") / F.col("n")).cast("long"))
    )


def expired(rows: DataFrame, ts: Column, ttl_days: Column, now: Column) -> DataFrame:
    """Rows past their own time to live; now is a value, never the clock."""
    return rows.where(F.datediff(now, ts) > ttl_days)


def islands(rows: DataFrame, key: str, n: str) -> DataFrame:
    """(key, first, last, length) of runs of consecutive numbers."""
    w = Window.partitionBy(key).orderBy(n)
    marked = rows.select(key, n).distinct().withColumn("_g", F.col(n) - F.row_number().over(w))
    runs = marked.groupBy(key, "_g").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count("*").alias("length"))
    return runs.drop("_g")


def carry_forward(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """rows with ``carried``: the last value that isn't null so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def nearest(left: DataFrame, right: DataFrame, key: str, x: str, y: str, within: int) -> DataFrame:
    """Each left row with the right row of its key whose y is nearest to x, at most ``within`` away.

    Both sides fall in bands of that width; a left row looks in its own band and its two neighbours, so the join has
    equi keys. Of equally near ones the smaller y counts.
    """
    band = lambda c: F.floor(F.col(c) / within)
    a = left.withColumn("_id", F.monotonically_increasing_id()).withColumn("_b", F.explode(F.array(band(x) - 1, band(x), band(x) + 1)))
    b = right.withColumn("_b", band(y))
    near = a.join(b, [key, "_b"]).where(F.abs(F.col(x) - F.col(y)) <= within)
    w = Window.partitionBy("_id").orderBy(F.abs(F.col(x) - F.col(y)), y)
    return near.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_id", "_b")


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def breaker(calls: DataFrame, key: str, us: str, call: str, failed: str, threshold: int = 2, recovery_us: int = 120_000_000) -> DataFrame:
    """calls with streak (failures in a row up to the row) and blocked_until (null while fewer than the threshold).

    calls are ordered by instant, then by the id of the call.
    """
    w = Window.partitionBy(key).orderBy(us, call).rowsBetween(Window.unboundedPreceding, 0)
    run = calls.withColumn("_g", F.count_if(~F.col(failed)).over(w))
    inside = Window.partitionBy(key, "_g").orderBy(us, call).rowsBetween(Window.unboundedPreceding, 0)
    run = run.withColumn("streak", F.count_if(F.col(failed)).over(inside)).drop("_g")
    return run.withColumn("blocked_until", F.when(F.col(failed) & (F.col("streak") >= threshold), F.col(us) + recovery_us))


def numbered(rows: DataFrame, *order: tuple[str, str]) -> DataFrame:
    """rows with ``place``, their position from 1 in that order of (column, direction such as "asc_nulls_last").

    No task orders all rows: each row's place is the rows with a smaller first key, and with the same first key a smaller
    second one, and so on, from counts per key. Windows run over tables with one row per key, and over the rows of equal
    keys but for the last. The order must be total to be repeatable.
    """
    names = [n for n, _ in order]
    ways = [getattr(F.col(n), how)() for n, how in order]
    out = rows.withColumn("place", F.lit(0).cast("long"))
    for i in range(len(names) - 1):
        upto = names[: i + 1]
        w = Window.partitionBy(*names[:i]).orderBy(ways[i]).rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy(*upto).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        counts = counts.select(*[F.col(n).alias(f"_{k}") for k, n in enumerate(upto)], "_before")
        out = out.join(counts, [F.col(n).eqNullSafe(F.col(f"_{k}")) for k, n in enumerate(upto)])
        out = out.withColumn("place", F.col("place") + F.col("_before")).drop("_before", *[f"_{k}" for k in range(len(upto))])
    last = Window.partitionBy(*names[:-1]).orderBy(ways[-1])
    return out.withColumn("place", F.col("place") + F.row_number().over(last))
