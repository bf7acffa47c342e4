"""Exact top-k search by inner product with the three-phase uniform threshold (Cao and Wang, 2004).

The lists of the method are slices of the components: a vector's score is the sum of its partial products, one per slice.
(1) Every task takes, per query and slice, the k rows with the highest partial products and gathers their scores; the k-th
best of what all tasks gathered is a cutoff no higher than the k-th best score of all. (2) The cutoffs are sent out; a row
can reach a cutoff only if some slice reaches the cutoff over the number of slices, which is the same for all slices, and
those rows are collected. (3) Their missing partial products are added, and scores at or above the cutoff are kept.
A task holds all slices of its rows, so that phases 2 and 3 need one pass and no vector is exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, checkpoint_dir, materialize, release
from quarry.llm.vectors import whole

#: Scores returned per query, and slices of the components.
TOP, SLICES = 20, 4
#: Bytes of the queries sent out at once, as 64-bit numbers; more queries come in further blocks, one after another.
BLOCK_BYTES = 8 << 20
#: Rows and queries that are multiplied at once.
TILE, SUB = 4096, 256
#: Queries whose gathered scores travel in one row.
CHUNK = 64
#: Below any sum of partial products; _OUT marks a query's own row in integer products.
LOW, _OUT = -(2**62), -(2**60)


class Asked:
    """Queries of one length: their places in the block, row numbers and components."""

    def __init__(self, places: np.ndarray, rids: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.places, self.rids, self.ids, self.x = places, rids, ids, x


def _by_length(vectors: list[np.ndarray]) -> dict[int, np.ndarray]:
    n = np.array([len(v) for v in vectors], np.int64)
    return {int(d): np.flatnonzero(n == d) for d in np.unique(n)}


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[s - ends[0] : e - ends[0]] for s, e in zip(ends[:-1], ends[1:])]


def asked(block: pa.Table) -> list[Asked]:
    """The queries of a block of rows (rid, vec_id, v) by length."""
    vectors = [v for c in block.column("v").chunks for v in _lists(c)]
    rids, ids = (block.column(c).to_numpy().astype(np.int64) for c in ("rid", "vec_id"))
    return [Asked(p, rids[p], ids[p], np.stack([vectors[i] for i in p]).astype(np.int64).reshape(len(p), -1)) for p in _by_length(vectors).values()]


class Tile:
    """Rows of one length in order of id (null last), the order of ties."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, null: np.ndarray, x: np.ndarray) -> None:
        order = np.lexsort((rids, ids, null))
        self.rids, self.ids, self.null, self.x = rids[order], ids[order], null[order], x[order]
        self.most = int(np.abs(x).max(initial=0))


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[Tile]:
    """Rows (rid, vec_id, v) in tiles of one length and at most TILE rows."""
    held: dict[int, list[tuple]] = {}
    for b in batches:
        vectors, null = _lists(b.column("v")), b.column("vec_id").is_null().to_numpy(zero_copy_only=False)
        rids, ids = b.column("rid").to_numpy(), b.column("vec_id").fill_null(0).to_numpy()
        for d, p in _by_length(vectors).items():
            x = np.stack([vectors[i] for i in p]).reshape(len(p), d)
            for s in range(0, len(p), TILE):
                q = p[s : s + TILE]
                held.setdefault(d, []).append((rids[q], ids[q], null[q], x[s : s + TILE]))
                if sum(len(h[0]) for h in held[d]) > TILE:
                    last = held[d].pop()
                    yield Tile(*(np.concatenate(y) for y in zip(*held[d])))
                    held[d] = [last]
    for parts in held.values():
        yield Tile(*(np.concatenate(y) for y in zip(*parts)))


def partials(group: Asked, tile: Tile, slices: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """For SUB queries at a time, their exact partial products with the tile's rows, one matrix per slice.

    Of vectors of unequal length the shorter counts as filled up with zeros. A query's own row gets the lowest value.
    """
    d = min(group.x.shape[1], tile.x.shape[1])
    bound = int(np.abs(group.x).max(initial=0)) * tile.most * max(d, 1)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    x = tile.x[:, :d].astype(kind)
    cuts = np.array_split(np.arange(d), min(slices, d) or 1)
    _, mine, theirs = np.intersect1d(group.rids, tile.rids, return_indices=True)
    for s in range(0, len(group.rids), SUB):
        q = group.x[s : s + SUB, :d].astype(kind)
        found = [q[:, c] @ x[:, c].T for c in cuts]
        here = (mine >= s) & (mine < s + SUB)
        for p in found:
            p[mine[here] - s, theirs[here]] = _OUT if kind is np.int64 else -np.inf
        yield slice(s, s + len(q)), found


def _scores(x: np.ndarray) -> np.ndarray:
    """Sums of partial products as 64-bit numbers, LOW for what doesn't count."""
    return np.where(x > _OUT // 2, x, LOW).astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], groups: list[Asked], k: int, slices: int) -> np.ndarray:
    """Phase 1 in one task: per query the k best scores among the k highest rows of each slice."""
    best = np.full((sum(len(g.rids) for g in groups), k), LOW, np.int64)
    for t in tiles(batches):
        n = min(k, len(t.rids))
        for g in groups:
            for s, parts in partials(g, t, slices):
                picks = np.concatenate([np.argpartition(p, len(t.rids) - n, 1)[:, -n:] for p in parts], 1)
                picks.sort(1)
                total = _scores(sum(np.take_along_axis(p, picks, 1) for p in parts))
                total[:, 1:][picks[:, 1:] == picks[:, :-1]] = LOW
                at = g.places[s]
                best[at] = np.partition(np.concatenate([best[at], total], 1), total.shape[1], 1)[:, -k:]
    return best


def _first(order: tuple, k: int) -> np.ndarray:
    """Places of the k first entries of each query, by keys for lexsort of which the last is the query."""
    o = np.lexsort(order)
    q = order[-1][o]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return o[rank < k]


def sufficient(batches: Iterator[pa.RecordBatch], groups: list[Asked], cutoffs: np.ndarray, k: int, slices: int) -> Iterator[tuple]:
    """Phases 2 and 3 in one task: (query id, query row, id, whether null, score) of the rows that reach their query's cutoff,
    per query the k best (ties: smaller ids), as more of one task can't be among the k best of all."""
    held: dict[tuple[int, int], tuple] = {}
    for t in tiles(batches):
        for w, g in enumerate(groups):
            for s, parts in partials(g, t, slices):
                cut = cutoffs[g.places[s]]
                share = -(-cut // len(parts))
                hit = parts[0] >= share[:, None]
                for p in parts[1:]:
                    hit |= p >= share[:, None]
                i, j = np.nonzero(hit)
                score = _scores(sum(p[i, j] for p in parts)) if len(i) else np.empty(0, np.int64)
                on = (score >= cut[i]) & (score > LOW)
                i, j, score = i[on], j[on], score[on]
                new = (i, score, t.null[j], t.ids[j])
                was = held.get((w, s.start))
                new = tuple(np.concatenate(y) for y in zip(was, new)) if was else new
                keep = _first((new[3], new[2], -new[1], new[0]), k)
                held[w, s.start] = tuple(y[keep] for y in new)
    for (w, s), (i, score, null, ids) in held.items():
        yield groups[w].ids[s + i], groups[w].rids[s + i], ids, null, score


def _cutoffs(rows: DataFrame, groups: list[Asked], k: int, slices: int) -> np.ndarray:
    n = sum(len(g.rids) for g in groups)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = gathered(batches, groups, k, slices)
        parts = [best[c : c + CHUNK].tobytes() for c in range(0, n, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "best"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("best").to_pylist()):
                x = np.frombuffer(x, np.int64).reshape(-1, k)
                best[c] = np.partition(np.concatenate([best[c], x], 1), k, 1)[:, -k:] if c in best else x
        arrays = [pa.array([*best], pa.int32()), pa.array([x.min(1).tobytes() for x in best.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "best"])

    kind = "chunk int, best binary"
    found = rows.mapInArrow(gather, kind).repartition("chunk").mapInArrow(merge, kind).collect()
    out = np.full(n, LOW, np.int64)
    for r in found:
        x = np.frombuffer(r.best, np.int64)
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(x)] = x
    return out


def search(vectors: DataFrame, asks: Column, k: int = TOP, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of vectors(vec_id, embedding) that fulfils ``asks`` (a condition on
    vec_id) the k rows with the highest inner products of whole components floor(64 * x), all others being candidates.

    Scores are exact; ties go to smaller ids, null ids last. A query's own row is no candidate; another row with its id is,
    and rows that repeat an id that asks are queries each. Vectors that are null or hold null or non-finite components take
    no part; shorter ones count as filled up with zeros. Fewer candidates than k make shorter lists, none make none. Other
    columns aren't read. Queries come to the driver in blocks of BLOCK_BYTES, with their cutoffs and nothing else.
    """
    spark = vectors.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(whole(vectors).withColumn("rid", F.monotonically_increasing_id()).repartition(parts).select("rid", "vec_id", "v"))
    queries = rows.where(F.coalesce(asks, F.lit(False)))
    size = queries.agg(F.sum(F.size("v") + 2).alias("x")).first().x or 0
    blocks = max(1, -(-8 * size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")
    queries = materialize(queries.withColumn("block", block).repartition(min(blocks, parts), "block").sortWithinPartitions("block", "rid"))
    folder = f"{checkpoint_dir(spark)}/quarry-top-{queries._folder.rsplit('-', 1)[1]}"
    kind = "query_id bigint, qrid bigint, vec_id bigint, score bigint"

    def enough(groups: list[Asked], cutoffs: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for q, r, i, null, s in sufficient(batches, groups, cutoffs, k, slices):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(r), pa.array(i, mask=null), pa.array(s)], names=["query_id", "qrid", "vec_id", "score"])

        return run

    order = Window.partitionBy("qrid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    with arrow_rows(spark, 2000):
        for at in range(blocks):
            groups = asked(queries.where(F.col("block") == at).select("rid", "vec_id", "v").toArrow())
            cutoffs = _cutoffs(rows, groups, k, slices)
            found = rows.mapInArrow(enough(groups, cutoffs), kind)
            top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            top.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
    release(queries)
    return spark.read.schema("query_id bigint, rank int, vec_id bigint, score bigint").parquet(folder)
