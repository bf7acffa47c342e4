"""Embedding near-dedup: PCA-ordered comparison of tiles with bounds from leading dimensions and suffix norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quarry.llm.common import arrow_rows, components, join_counted, materialize

#: Links are pairs of at least this cosine.
THRESHOLD = 0.98
#: Vectors of a tile, and bytes of one at most, so that a task holds two tiles whatever the group's size.
TILE, TILE_BYTES = 8192, 8 << 20
#: Rows of the blocks in which two tiles are compared.
BLOCK = 512
#: Dimensions, in PCA order, after which the bound is tried again.
STEPS = (8, 16, 32)
#: Room for rounding in bounds; pairs that pass are decided on the original vectors.
ROOM = 1e-9


def _usable() -> F.Column:
    """Whether a row can link: a label, and a vector without null or non-finite parts that isn't zero."""
    plain = F.col("embedding").cast("array<double>")
    fine = F.forall(plain, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    able = F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists(plain, lambda x: x != 0)
    return F.coalesce(able, F.lit(False))


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit rows; each is scaled by its largest part first, so that neither huge nor tiny vectors lose their length."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector, its principal directions as columns, leading first, from all vectors' second moments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            by: dict[int, list[bytes]] = {}
            for x in b.column(0).to_pylist():
                by.setdefault(len(x) // 8, []).append(x)
            for d, blobs in by.items():
                u = _unit(_matrix(blobs))
                u = np.concatenate([u, np.ones((len(u), 1))], 1)
                sums[d] = sums.get(d, 0) + u.T @ u
        yield pa.RecordBatch.from_arrays(
            [pa.array([*sums], pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["d", "s"]
        )

    total: dict[int, np.ndarray] = {}
    for r in nodes.select("v").mapInArrow(run, "d int, s binary").toLocalIterator():
        total[r.d] = total.get(r.d, 0) + np.frombuffer(r.s).reshape(r.d + 1, r.d + 1)
    out = {}
    for d, s in total.items():
        mean = s[-1, :-1] / s[-1, -1]
        _, basis = np.linalg.eigh(s[:-1, :-1] / s[-1, -1] - np.outer(mean, mean))
        out[d] = basis[:, ::-1].copy()
    return out


def _tiles(nodes: DataFrame, bases: dict[int, np.ndarray]) -> DataFrame:
    """Vectors in order of label and leading coordinate, cut into tiles with the box of their coordinates."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = [float(_unit(_matrix([x]))[0] @ bases[len(x) // 8][:, 0]) for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, pa.float64())], names=[*b.schema.names, "p"])

    schema = "nid bigint, grp string, n bigint, v binary"
    placed = nodes.select("nid", "grp", "n", "v").mapInArrow(lead, schema + ", p double")
    parts = max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = placed.repartitionByRange(parts, "grp", "p", "nid").sortWithinPartitions("grp", "p", "nid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, held = None, []

        def tile() -> pa.RecordBatch:
            u = _unit(_matrix([x[2] for x in held])) @ bases[len(held[0][2]) // 8]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([grp], pa.string()),
                    pa.array([held[0][0]], pa.int64()),
                    pa.array([u[:, 0].min()]), pa.array([u[:, 0].max()]),
                    pa.array([u.min(0).tolist()]), pa.array([u.max(0).tolist()]),
                    pa.array([np.array([x[0] for x in held], np.int64).tobytes()], pa.binary()),
                    pa.array([np.array([x[1] for x in held], np.int64).tobytes()], pa.binary()),
                    pa.array([b"".join(x[2] for x in held)], pa.binary()),
                ],
                names=["grp", "tile", "low", "high", "lows", "highs", "ids", "ns", "vs"],
            )

        for b in batches:
            for g, i, n, v in zip(*(b.column(c).to_pylist() for c in ("grp", "nid", "n", "v"))):
                if held and (g != grp or len(held) >= TILE or (len(held) + 1) * len(v) > TILE_BYTES):
                    yield tile()
                    held = []
                grp = g
                held.append((i, n, v))
        if held:
            yield tile()

    kind = "grp string, tile bigint, low double, high double, lows array<double>, highs array<double>, ids binary, ns binary, vs binary"
    return ordered.select("nid", "grp", "n", "v").mapInArrow(cut, kind)


class Side:
    """Unit vectors of a tile with their coordinates in PCA order, norms of the suffixes after each step, and blocks' boxes."""

    def __init__(self, unit: np.ndarray, basis: np.ndarray) -> None:
        self.unit, self.x = unit, unit @ basis
        self.steps = [s for s in STEPS if s < basis.shape[1]]
        self.rest = [np.sqrt((self.x[:, k:] ** 2).sum(1)) for k in self.steps]
        self.blocks = [(s, min(s + BLOCK, len(unit))) for s in range(0, len(unit), BLOCK)]
        self.low = np.array([self.x[s:e].min(0) for s, e in self.blocks])
        self.high = np.array([self.x[s:e].max(0) for s, e in self.blocks])


def compare(a: Side, b: Side, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of two tiles whose cosine reaches the threshold."""
    reach = 2 - 2 * threshold + ROOM
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for p, (s, e) in enumerate(a.blocks):
        gap = np.maximum(0, np.maximum(a.low[p] - b.high, b.low - a.high[p]))
        for q in np.flatnonzero((gap * gap).sum(1) <= reach):
            t, f = b.blocks[q]
            i, j = _pairs(a, slice(s, e), b, slice(t, f), threshold)
            found.append((i + s, j + t))
    return tuple(np.concatenate(x) for x in zip(*found))


def _pairs(a: Side, at: slice, b: Side, to: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Products accumulate over the leading dimensions, from one step to the next; by Cauchy-Schwarz the rest adds at most
    the product of the suffix norms. Rows and columns that can reach the threshold with nothing fall away after each step,
    and nothing is left to do once none can. Pairs that come through are decided on the original vectors."""
    x, y = a.x[at], b.x[to]
    rows, cols, done = np.arange(len(x)), np.arange(len(y)), 0
    total = np.zeros((len(x), len(y)))
    for n, k in enumerate(a.steps):
        total += x[rows, done:k] @ y[cols, done:k].T
        done = k
        able = total + a.rest[n][at][rows, None] * b.rest[n][to][cols] >= threshold - ROOM
        r, c = able.any(1), able.any(0)
        rows, cols, total = rows[r], cols[c], total[np.ix_(r, c)]
        if not len(rows):
            return rows, cols
    total += x[rows, done:] @ y[cols, done:].T
    i, j = np.nonzero(total >= threshold - ROOM)
    i, j = rows[i], cols[j]
    sure = np.concatenate([np.empty(0, bool)] + [
        np.einsum("ij,ij->i", a.unit[at][i[k : k + 65536]], b.unit[to][j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)
    ])
    return i[sure], j[sure]


def _block(r: dict, bases: dict[int, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, weighted link counts, root ids) of one pair of tiles: a star for each group that links join here."""
    ids = [np.frombuffer(r[k], np.int64) for k in ("ids_a", "ids_b")]
    ns = [np.frombuffer(r[k], np.int64) for k in ("ns_a", "ns_b")]
    d = len(r["vs_a"]) // 8 // len(ids[0])
    same = r["tile_a"] == r["tile_b"]
    a, b = (Side(_unit(np.frombuffer(r[k], np.float64).reshape(-1, d)), bases[d]) for k in ("vs_a", "vs_b"))
    i, j = compare(a, b, threshold)
    if same:
        i, j = i[i < j], j[i < j]
    nodes = ids[0] if same else np.concatenate(ids)
    weight = ns[0] if same else np.concatenate(ns)
    j = j if same else j + len(ids[0])
    count = np.bincount(i, weight[j], len(nodes)) + np.bincount(j, weight[i], len(nodes))
    root = np.arange(len(nodes))
    while len(i):
        low = np.minimum(root[i], root[j])
        nxt = root.copy()
        np.minimum.at(nxt, root[i], low)
        np.minimum.at(nxt, root[j], low)
        nxt = nxt[nxt[nxt]]
        if (nxt == root).all():
            break
        root = nxt
    on = count > 0
    return nodes[on], count[on].astype(np.int64), nodes[root[on]]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors(vec_id, embedding, label).

    Only vectors with equal labels that aren't null, and of equal length, are compared. Vectors that are null, empty,
    zero or hold null or non-finite parts link with nothing. Rows with the same label and vector are one node that counts
    as often as it occurs, so copies make no pairs. Null ids link too but never name a component (null, and kept false,
    where there is no other). Rows repeat as they come; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label")
    plain = F.col("embedding").cast("array<double>")
    # + 0.0 makes the two zeros one
    usable = rows.where(_usable()).select("vec_id", F.transform(plain, lambda x: x + 0.0).alias("embedding"), F.col("label").cast("string").alias("label"))
    nodes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    nodes = nodes.withColumns({"nid": F.monotonically_increasing_id(), "grp": F.concat_ws(":", F.size("embedding").cast("string"), "label")})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("embedding")
            blobs = [np.array(x, np.float64).tobytes() for x in b.column("embedding").to_pylist()]
            yield b.set_column(at, "v", pa.array(blobs, pa.binary()))

    nodes = nodes.select("label", "embedding", "rep", "n", "nid", "grp")
    kind = StructType([nodes.schema["label"], StructField("v", BinaryType()), *(nodes.schema[c] for c in ("rep", "n", "nid", "grp"))])
    with arrow_rows(spark, 2000):
        nodes = materialize(nodes.mapInArrow(pack, kind))
        bases = principal(nodes)
        tiles = materialize(_tiles(nodes, bases))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + ROOM

    def side(s: str, full: bool) -> DataFrame:
        cols = ["grp", "tile", "ids", "ns", "vs"] if full else ["grp", "tile", "low", "high", "lows", "highs"]
        return tiles.select(*[F.col(c).alias(c if c == "grp" else f"{c}_{s}") for c in cols])

    gaps = F.zip_with(
        F.zip_with("lows_a", "highs_b", lambda x, y: F.greatest(x - y, F.lit(0.0))),
        F.zip_with("lows_b", "highs_a", lambda x, y: F.greatest(x - y, F.lit(0.0))),
        lambda x, y: (x + y) * (x + y),
    )
    near = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x) <= reach * reach
    # tiles meet in the stripes of the leading coordinate that both reach, and in the first of those only
    stripe = lambda c: F.floor(F.col(c) / reach)
    left = side("a", False).withColumns({"first_a": stripe("low_a"), "at": F.explode(F.sequence(stripe("low_a"), stripe("high_a")))})
    right = side("b", False).withColumn("first_b", stripe("low_b") - 1)
    right = right.withColumn("at", F.explode(F.sequence("first_b", stripe("high_b") + 1)))
    pairs = (
        left.join(right, ["grp", "at"]).where(F.col("at") == F.greatest("first_a", "first_b"))
        .where((F.col("tile_a") <= F.col("tile_b")) & (F.col("low_a") <= F.col("high_b") + reach))
        .where((F.col("low_b") <= F.col("high_a") + reach) & near)
        .select("grp", "tile_a", "tile_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                found = _block(b.slice(k, 1).to_pylist()[0], bases, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["nid", "n_links", "root"])

    blocks = pairs.join(side("a", True), ["grp", "tile_a"]).join(side("b", True), ["grp", "tile_b"])
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with arrow_rows(spark, 1):
        blocks = blocks.repartition(parts, F.xxhash64("tile_a", "tile_b"))
        links = materialize(blocks.mapInArrow(run, "nid bigint, n_links bigint, root bigint"))
    comp = components(links, "nid", "root").withColumnRenamed("node", "nid")
    least = comp.join(nodes.select("nid", "rep"), "nid")
    roots = least.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    least = join_counted(least, roots, ["root"]).select("nid", "least")
    totals = links.groupBy("nid").agg(F.sum("n_links").alias("others"))
    whole = (
        nodes.join(least, "nid", "left").join(totals, "nid", "left")
        .select(
            "label", "v", "n",
            (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("least", "rep").alias("component_id"),
        )
    )
    with arrow_rows(spark, 2000):
        kind = StructType([usable.schema["vec_id"], StructField("v", BinaryType()), usable.schema["label"]])
        keyed = materialize(usable.select("vec_id", "embedding", "label").mapInArrow(pack, kind))
    linked = join_counted(keyed, materialize(whole), ["label", "v"]).select("vec_id", "n_links", "component_id")
    bad = rows.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(bad)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

