"""SimHash near-duplicate detection with a byte-position inverted index and count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, join_counted, materialize, schema_of, slices

#: Fingerprints link at so many differing bits or fewer; each bit spoils one of eight positional bytes at most.
NEAR = 2
#: For each choice of six byte positions, the bits of a fingerprint that lie there (as Spark's signed long).
MASKS = [
    sum(0xFF << 8 * p for p in kept) - (1 << 64 if 7 in kept else 0) for kept in combinations(range(8), 8 - NEAR)
]


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 where there are no words. Signed, as Spark's long."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return 0
    if n < shingle:
        bits = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        joined, lens = b" ".join(words), np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lens + 1) - 1
        starts = (ends - lens)[: n - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        bits = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    total, size = np.zeros(64, np.int64), len(bits)
    for k in range(0, size, 8192):
        part = np.unpackbits(bits[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += part.sum(axis=0, dtype=np.uint32)
    out = np.packbits((2 * total > size).astype(np.uint8), bitorder="little").view("<i8")
    return int(out[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(id, fp) per row of docs(id, text). Whole texts are read; null counts as no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return docs.select("id", "text").mapInArrow(run, schema_of(docs, "id", "fp bigint"))

def links(fps: DataFrame) -> DataFrame:
    """(a, b) between distinct fingerprints ``fp`` that links of at most two bits join, enough to join up all of them.

    Two differing bits touch at most two of the eight byte positions, so six positional bytes at least are shared: the
    count that the index filters by. A posting list is named by six positions and the bytes there. A pair that shares m
    positional bytes is on C(m, 6) lists together, so the tally is taken by the lists: pairs short of six meet on none,
    and no pair is made before it has reached six. Members of a list differ in two bytes, so it holds 65,536 distinct
    fingerprints at most, whatever the input; their bits are compared in blocks, and a star per linked group comes out.
    """
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for c, m in enumerate(MASKS)])
    posts = fps.select("fp", F.explode(keys).alias("p")).select("fp", "p.c", "p.k")
    lists = materialize(posts.groupBy("c", "k").agg(F.min("fp").alias("b"), F.max("fp").alias("a"), F.count("*").alias("n")).where("n > 1"))
    pairs = lists.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR)).select("a", "b")
    longer = posts.join(lists.where("n > 2").select("c", "k"), ["c", "k"]).groupBy("c", "k").agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for members in b.column(0):
                found = star(members.values.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    return pairs.union(longer.select("fps").mapInArrow(run, "a bigint, b bigint")).distinct()


def star(members: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): every linked member of a list with the smallest member that links of this list reach from it."""
    x = np.sort(members)
    bits = x.view(np.uint64)
    root = np.arange(len(x))
    while True:
        low = root.copy()
        for s in range(0, len(x), block):
            for t in range(0, len(x), block):
                near = np.bitwise_count(bits[s : s + block, None] ^ bits[None, t : t + block]) <= NEAR
                least = np.where(near, root[None, t : t + block], len(x)).min(1)
                np.minimum(low[s : s + block], least, out=low[s : s + block])
        low = low[low]
        if (low == root).all():
            break
        root = low
    on = root != np.arange(len(x))
    return x[on], x[root[on]]


def _classes(sig: DataFrame, best: DataFrame) -> DataFrame:
    """(fp, n, best): each distinct fingerprint, its rows, and the least ``best`` of its component; best(fp, n, best)."""
    comp = components(links(best.select("fp")), "a", "b").withColumnRenamed("node", "fp")
    named = comp.join(best, "fp")
    roots = named.groupBy("root").agg(F.min("best").alias("least"), F.count("*").alias("n"))
    named = join_counted(named.drop("n"), roots, ["root"]).select("fp", "least")
    return materialize(best.join(named, "fp", "left").select("fp", "n", F.coalesce("least", "best").alias("best")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id) per row of docs: groups of fingerprints within two bits, named by their smallest id.

    Null or empty texts have fingerprint 0 and link like any other. A null id never names a group; rows whose group has
    no id at all get a null component_id. Repeated rows stay. An empty table gives no rows. Other columns are not read.
    """
    sig = materialize(with_fingerprint(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), shingle))
    best = materialize(sig.groupBy("fp").agg(F.min("id").alias("best"), F.count("*").alias("n")))
    whole = _classes(sig, best).withColumnRenamed("best", "component_id")
    return join_counted(sig, whole, ["fp"]).select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of docs without near duplicates: one row of each group, in docs's columns.

    It is the row with the smallest id, ids before null; of several texts under that id, the one of least hash; of rows
    that repeat both, the one of least hash over all columns. Unlike texts under one id are documents of their own: each
    stays unless its own group keeps another. An empty table stays empty.
    """
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    key = {"k1": F.xxhash64(F.lit(1), ident, text), "k2": F.xxhash64(F.lit(2), text, ident)}
    slim = docs.select(F.struct(ident.isNull().alias("no"), ident.alias("id"), *[c.alias(n) for n, c in key.items()]).alias("id"), text.alias("text"))
    sig = materialize(with_fingerprint(slim, shingle))
    best = materialize(sig.groupBy("fp").agg(F.min("id").alias("best"), F.count("*").alias("n")))
    winners = _classes(sig, best).select("best.k1", "best.k2").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in key.items()])
    repeats = sig.groupBy("id.k1", "id.k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    stay = materialize(winners.join(repeats.withColumn("more", F.lit(True)), ["k1", "k2"], "left"))
    kept = rows.join(stay.where("more is null").select("k1", "k2"), ["k1", "k2"], "left_semi").select("_row")
    again = rows.join(stay.where("more").select("k1", "k2"), ["k1", "k2"], "left_semi")
    once = again.groupBy("k1", "k2").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row")
    return kept.unionByName(once).select("_row.*")
