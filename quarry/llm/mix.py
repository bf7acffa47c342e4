"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, materialize, packed, release

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often than this, and no source beyond this many times its size.
CAP = 3
#: Newton stops when every source's tokens are this near to its target, relatively.
PRECISION = 1e-6
#: Bins of the rounding histogram, in each of its two passes.
BINS = 1024
#: Rounding passes at most, and the relative gap to a target below which a source needs no more of them.
PASSES, NEAR = 4, 5e-4

GRANTS = "array<struct<theta:double,most:double>>"


def n_words(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n, target) per source of sized(source, size).

    All sizes are shared out by weight; a source gets at most cap times its size, and what it leaves is shared by weight
    among the others. Sources in order of cap / weight reach their caps one after the other as the level rises, so two
    running sums over the one-row-per-source table find the level.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    rise = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(rise.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(every) - before) / left)
    per = per.withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)  # levels fall again after the first open source
    return per.select(
        "source", "source_size", "n", "full", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("w")).alias("target")
    )


def tilt(sized: DataFrame, goal: DataFrame, cap: float = CAP, precision: float = PRECISION, rounds: int = 80) -> DataFrame:
    """(source, lam, mean, full, ...) per source: rates min(cap, exp(lam * size / mean)) meet the token constraints.

    Of all rates up to the cap, these are nearest in entropy to taking each document once. The dual is convex in one
    multiplier per source; each round is one distributed aggregation over the table of distinct (source, size), from
    which every source takes a Newton step, or halves its bracket where the step would leave it.
    """
    cells = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    state = goal.select(
        "source", "source_size", "target", "full",
        (F.col("source_size") / F.col("n")).alias("mean"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
    )
    state = materialize(state.withColumn("done", F.col("full") | (F.col("source_size") == 0)))
    for _ in range(rounds):
        if state.where("not done").isEmpty():
            break
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("lam") * x))
        open_ = state.where("not done").select(F.col("source").alias("_s"), "lam", "mean")
        sums = (
            cells.join(open_, cells["source"].eqNullSafe(F.col("_s")))
            .groupBy("_s")
            .agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                F.sum(F.when(rate < cap, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
            )
        )
        off = F.col("got") - F.col("target")
        lo = F.when(off < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.try_divide(off, F.col("slope"))
        away = F.lit(1.0) + F.abs("lam")
        lower, upper = F.coalesce("lo2", F.col("lam") - away), F.coalesce("hi2", F.col("lam") + away)
        inside = (F.col("slope") > 0) & (newton > lower) & (newton < upper)
        step = F.when(inside, newton).otherwise((lower + upper) / 2)
        moved = state.join(sums, state["source"].eqNullSafe(F.col("_s")), "left").withColumns({"lo2": lo, "hi2": hi})
        met = F.coalesce(F.abs(off) <= precision * F.greatest("target", F.lit(1.0)), F.lit(True))
        nxt = materialize(
            moved.select(
                "source", "source_size", "target", "full", "mean",
                F.when(met, F.col("lam")).otherwise(step).alias("lam"),
                F.when(F.col("done"), F.col("lo")).otherwise(F.col("lo2")).alias("lo"),
                F.when(F.col("done"), F.col("hi")).otherwise(F.col("hi2")).alias("hi"),
                (F.col("done") | met).alias("done"),
            )
        )
        release(state)
        state = nxt
    release(cells)
    return state.drop("lo", "hi", "done")


def _rate(cap: float) -> F.Column:
    x = F.when(F.col("mean") > 0, F.col("size") / F.col("mean")).otherwise(0.0)
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("lam") * x)))


def _parts(rows: DataFrame, cap: float) -> DataFrame:
    """floor: copies for sure; u: rank for one more, uniform below and above zero as the rate's fraction says."""
    rated = rows.withColumn("_r", _rate(cap))
    whole = F.floor("_r").cast("long")
    chance = F.shiftrightunsigned("_h", 11).cast("double") / F.lit(float(1 << 53))
    return rated.withColumns({"_floor": whole, "_u": chance - (F.col("_r") - whole)})


def _cut(rows: DataFrame, state: DataFrame, cap: float, bins: int = BINS, passes: int = PASSES) -> DataFrame:
    """state with ``grants``, an array of (theta, most): a document gets one more copy if for one of them its u is below
    theta and its size at most ``most``.

    Each pass counts the weight over u in ``bins`` bins, then again within the bin where a source would pass its target,
    and grants all below that. A long document may stand there, so the next pass goes on among those that still fit.
    """
    side = state.select(F.col("source").alias("_s"), "full", "mean", "lam")
    parts = _parts(rows.join(side, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), cap)
    base = parts.groupBy("source").agg(F.sum(F.col("size") * F.col("_floor")).cast("double").alias("have"))
    base = base.withColumnRenamed("source", "_b")
    now = state.join(base, state["source"].eqNullSafe(F.col("_b")), "left").drop("_b")
    start = {"have": F.coalesce("have", F.lit(0.0)), "from": F.lit(-1.0), "grants": F.lit(None).cast(GRANTS)}
    now = materialize(now.withColumns(start))
    spare = parts.where((F.col("_floor") < cap) & (F.col("size") > 0)).select(F.col("source").alias("_p"), "size", "_u")
    for _ in range(passes):
        gap = F.col("target") - F.col("have")
        if now.where(gap > F.col("target") * NEAR).isEmpty():
            break
        now = now.withColumns({"most": gap, "wide": 1.0 - F.col("from")})
        for _ in range(2):
            edge = now.select(F.col("source").alias("_b"), "from", "wide", "most")
            at = spare.join(edge, F.col("_p").eqNullSafe(F.col("_b"))).where(F.col("size") <= F.col("most"))
            bin_ = F.floor(F.try_divide(F.col("_u") - F.col("from"), F.col("wide")) * bins)
            at = at.withColumn("bin", bin_).where((F.col("bin") >= 0) & (F.col("bin") < bins))
            hist = at.groupBy("_b", "bin").agg(F.sum("size").alias("w"))
            run = Window.partitionBy("_b").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            left = now.select(F.col("source").alias("_c"), (F.col("target") - F.col("have")).alias("left"))
            hist = hist.withColumn("upto", F.sum("w").over(run)).join(left, F.col("_b").eqNullSafe(F.col("_c")))
            under = F.col("upto") <= F.col("left")
            reach = hist.groupBy("_b").agg(
                F.coalesce(F.max(F.when(under, F.col("upto"))), F.lit(0)).alias("got"),
                F.coalesce(F.min(F.when(~under, F.col("bin"))), F.lit(bins)).alias("over"),
            )
            step = F.col("wide") / bins
            moved = {
                "from": F.col("from") + step * F.coalesce("over", F.lit(0)),
                "wide": step,
                "have": F.col("have") + F.coalesce("got", F.lit(0)),
            }
            joined = now.join(reach, F.col("source").eqNullSafe(F.col("_b")), "left")
            nxt = materialize(joined.withColumns(moved).select(now.columns))
            release(now)
            now = nxt
        grant = F.array(F.struct(F.col("from").alias("theta"), "most"))
        now = now.withColumn("grants", F.concat(F.coalesce("grants", F.array().cast(GRANTS)), grant)).drop("most", "wide")
    return now.drop("from", "have")


def copies(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    cap: float = CAP,
) -> DataFrame:
    """docs with four more columns: size (words), source_size, target (both of its source) and copies (0 to cap).

    A null source is a source of its own, after the others. A null or empty text has size 0 and is taken once. Rounding
    depends on a hash of id and text, so reruns agree and repeated rows fare alike; within a source the last places go
    by that hash until its words meet the target, to within about one document. An empty table stays empty. Columns of
    docs with the names of the new ones are replaced.
    """
    new = ("size", "source_size", "target", "copies")
    made = {
        "source": F.col(source),
        "size": n_words(text),
        "_h": F.xxhash64(F.lit(11), F.col(doc_id), F.col(text)),
    }
    slim = materialize(docs.select(*[c.alias(n) for n, c in made.items()]))
    goal = materialize(targets(slim, weights, cap))
    state = materialize(_cut(slim, tilt(slim, goal, cap), cap))
    side = state.select(F.col("source").alias("_s"), "source_size", "target", "full", "mean", "lam", "grants")
    rows = packed(docs, new, **made)
    got = _parts(rows.join(side, F.col("source").eqNullSafe(F.col("_s"))), cap)
    granted = F.exists("grants", lambda g: (F.col("_u") < g["theta"]) & (F.col("size") <= g["most"]))
    more = F.coalesce((F.col("_floor") < cap) & (F.col("size") > 0) & granted, F.lit(False)).cast("long")
    return got.select("_row.*", "size", "source_size", "target", (F.col("_floor") + more).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as copies() says, in docs's columns."""
    wrapped = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        *[F.col(options.get(c, c)).alias(options.get(c, c)) for c in ("source", "text", "doc_id")],
    )
    got = copies(wrapped, **options)
    return got.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
