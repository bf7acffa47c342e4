"""Sharding by histogram sort: probe key boundaries, count exact bytes below them, refine, then exchange once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, packed

#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Candidate boundaries that each open splitter gets in a round: for shards, and for the key ranges within them.
PROBES, INNER_PROBES = 127, 7
#: A splitter is settled when the bytes below it are this share of a shard from where they should be.
TOLERANCE = 0.0005
#: Bytes that one task should order; shards with more are ordered in several key ranges.
RANGE_BYTES = 128 << 20

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def size_of(text: str = "text") -> F.Column:
    """UTF-8 bytes of the text, none for null, plus ROW_BYTES."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def sort_key(text: str = "text", doc_id: str = "doc_id") -> F.Column:
    """One long: high 40 bits from the text, low 24 from the id.

    Equal texts are neighbours, so they share a shard unless a boundary has to run through a large group of them.
    """
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 24), 24)
    return high.bitwiseOR(F.xxhash64(F.lit(7), doc_id).bitwiseAND(F.lit((1 << 24) - 1)))


def _place(bounds: np.ndarray, key: F.Column) -> F.Column:
    """How many of the sorted bounds are at or below the key."""

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(np.int64), side="right").astype(np.int32))

    return place(key)


def _small(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A table of tuples, by Arrow: from a list, Spark would start Python workers of another kind in each executor for it."""
    cols = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), cols)}))


def splitters(keyed: DataFrame, wanted: list[float], slack: float, weight: str = "size", probed: int = PROBES) -> list[int]:
    """Keys k such that the exact weight of rows with key < k is as near to each wanted weight as the keys allow.

    Each round counts the weight between all open probes in one distributed aggregation; the driver holds the probes
    and their counts only. A splitter is settled within ``slack``, or once its interval holds no further key.
    """
    total = keyed.agg(F.sum(F.col(weight).cast("long"))).first()[0] or 0
    ends = [[_LOW, 0, _HIGH, total] for _ in wanted]
    best = [_LOW if w <= total - w else _HIGH for w in wanted]
    error = [min(w, abs(total - w)) for w in wanted]
    open_ = [i for i, w in enumerate(wanted) if error[i] > slack]
    while open_:
        probes = set()
        for i in open_:
            lo, _, hi, _ = ends[i]
            step = max(1, (hi - lo) // (probed + 1))
            probes.update(range(lo + step, min(hi, lo + step * (probed + 1)), step))
        if not probes:
            break
        keys = sorted(probes)
        counts = keyed.groupBy(_place(np.array(keys, np.int64), F.col("key")).alias("b")).agg(F.sum(weight).alias("w"))
        inside = {r.b: int(r.w) for r in counts.collect()}
        below = np.cumsum([inside.get(b, 0) for b in range(len(keys))])
        still = []
        for i in open_:
            at = int(np.searchsorted(below, wanted[i], side="right"))
            for j in (at - 1, at):
                if 0 <= j < len(keys):
                    if abs(below[j] - wanted[i]) < error[i]:
                        best[i], error[i] = keys[j], abs(int(below[j]) - wanted[i])
            if at > 0 and keys[at - 1] > ends[i][0]:
                ends[i][:2] = keys[at - 1], int(below[at - 1])
            if at < len(keys) and keys[at] < ends[i][2]:
                ends[i][2:] = keys[at], int(below[at])
            if error[i] > slack and ends[i][2] - ends[i][0] > 1:
                still.append(i)
        open_ = still
    return [int(b) for b in np.maximum.accumulate(best)] if best else []


def shard(
    docs: DataFrame,
    n_shards: int = 40,
    text: str = "text",
    doc_id: str = "doc_id",
    tolerance: float = TOLERANCE,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """docs with three more columns: size, shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    Shards are contiguous key ranges of near equal bytes; no boundary is further from its place than half the longest
    document or the tolerance. Where a boundary falls among rows that repeat both text and id, which have one key and one
    size, it counts them off. Nulls are values like any other, rows repeat as they come, an empty table stays empty, and
    columns of docs that are called size, shard or slot are replaced.
    """
    made = {"size": size_of(text), "key": sort_key(text, doc_id)}
    slim = materialize(docs.select(*[c.alias(n) for n, c in made.items()]))
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wanted = [total * k / n_shards for k in range(1, n_shards)]
    cuts = splitters(slim, wanted, tolerance * total / n_shards)
    ranges = max(1, -(-total // (n_shards * range_bytes)))
    inner = [total * k / (n_shards * ranges) for k in range(1, n_shards * ranges) if k % ranges]
    fine = sorted({*cuts, *(splitters(slim, inner, 0.2 * total / n_shards / ranges, probed=INNER_PROBES) if inner else [])})
    tied = _tied(slim, cuts, wanted)

    bounds = np.array(fine, np.int64)
    shard_of = np.searchsorted(np.array(cuts, np.int64), np.concatenate([[_LOW], bounds]), side="right")
    loose = slim.where(~F.col("key").isin([*tied])) if tied else slim
    inside = {r.b: r.n for r in loose.groupBy(_place(bounds, F.col("key")).alias("b")).agg(F.count("*").alias("n")).collect()}
    start, seen = [], {}
    for b in range(len(bounds) + 1):
        s = int(shard_of[b])
        start.append((b, s, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + inside.get(b, 0)
    rows = packed(docs, ("size", "shard", "slot"), size=made["size"], _key=made["key"], _id=F.col(f"`{doc_id}`"))
    same = rows.where(F.col("_key").isin([*tied])) if tied else None
    rows = (rows.where(~F.col("_key").isin([*tied])) if tied else rows).withColumn("_range", _place(bounds, F.col("_key")))
    order = Window.partitionBy("_range").orderBy("_key", F.col("_id").asc_nulls_first(), "size")
    rows = rows.withColumn("_n", F.row_number().over(order) - 1)
    lookup = _small(docs.sparkSession, start, _range=pa.int32(), shard=pa.int32(), _start=pa.int64())  # one row a task
    placed = rows.join(F.broadcast(lookup), "_range")
    out = placed.select("_row.*", "size", "shard", (F.col("_start") + F.col("_n")).alias("slot"))
    return out if same is None else out.unionByName(_counted_off(same, tied, cuts, wanted, seen))


def _tied(slim: DataFrame, cuts: list[int], wanted: list[float]) -> dict[int, tuple[int, int, int]]:
    """key: (bytes below it, rows, size of one) for the keys of repeated rows that a boundary should run through.

    A boundary that lies further off than the rows of its key are long stands beside such a key, which is the last before
    it or the first from it on.
    """
    if not cuts:
        return {}
    at = np.array(sorted(set(cuts)), np.int64)
    near = slim.groupBy(_place(at, F.col("key")).alias("b")).agg(F.max("key").alias("last"), F.min("key").alias("first")).collect()
    keys = sorted({k for r in near for k in (r.first, r.last)})  # two for each boundary and end
    found = slim.where(F.col("key").isin(keys)).groupBy("key").agg(F.count("*").alias("n"), F.min("size").alias("s"), F.max("size").alias("t"))
    many = {r.key: (r.n, r.s) for r in found.where("n > 1 and s = t").collect()}
    if not many:
        return {}
    ends = sorted(many)
    place = slim.where(~F.col("key").isin(ends)).groupBy(_place(np.array(ends, np.int64), F.col("key")).alias("b")).agg(F.sum("size").alias("w"))
    inside, below, out = {r.b: r.w for r in place.collect()}, 0, {}
    for i, k in enumerate(ends):
        below += inside.get(i, 0)
        n, s = many[k]
        if any(below + s / 2 < w < below + (n - 0.5) * s for w in wanted):
            out[k] = (below, n, s)
        below += n * s
    return out


def _counted_off(same: DataFrame, tied: dict[int, tuple[int, int, int]], cuts: list[int], wanted: list[float], seen: dict[int, int]) -> DataFrame:
    """Rows of tied keys with shard and slot: numbered over all input partitions, then dealt out by those numbers.

    The rows are written once, so that their numbers hold whatever is run again. ``seen`` has the slots that are taken.
    """
    rows = materialize(same.withColumn("_uid", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_uid", 33)))
    starts, upto = [], {}
    for r in rows.groupBy("_key", "_part").agg(F.count("*").alias("n")).orderBy("_key", "_part").toLocalIterator():
        starts.append((r["_key"], r["_part"], upto.get(r["_key"], 0)))
        upto[r["_key"]] = upto.get(r["_key"], 0) + r.n
    pieces = []
    for key, (below, n, s) in sorted(tied.items()):
        ends = [min(n, max(0, round((w - below) / s))) for w in wanted] + [n]
        first = 0
        for shard_, end in enumerate(ends):
            if end > first:
                pieces.append((key, first, end, shard_, seen.get(shard_, 0) - first))
                seen[shard_] = seen.get(shard_, 0) + end - first
                first = end
    spark = rows.sparkSession
    lookup = F.broadcast(_small(spark, starts, _key=pa.int64(), _part=pa.int64(), _start=pa.int64()))  # keys cut by boundaries x input partitions
    deal = F.broadcast(_small(spark, pieces, _k=pa.int64(), _from=pa.int64(), _to=pa.int64(), shard=pa.int32(), _shift=pa.int64()))  # boundaries, twice
    order = Window.partitionBy("_part", "_key").orderBy("_uid")
    rows = rows.withColumn("_n", F.row_number().over(order) - 1).join(lookup, ["_key", "_part"])
    rows = rows.withColumn("_n", F.col("_start") + F.col("_n"))
    rows = rows.join(deal, (F.col("_key") == F.col("_k")) & (F.col("_n") >= F.col("_from")) & (F.col("_n") < F.col("_to")))
    return rows.select("_row.*", "size", "shard", (F.col("_n") + F.col("_shift")).alias("slot"))
