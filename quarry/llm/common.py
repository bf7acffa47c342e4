"""Shared pieces: tables cut from their lineage, small Arrow batches, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Word separators of the contracts: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: A key of more than one in so many rows is hot.
HEAVY = 1000


def packed(docs: DataFrame, new: tuple[str, ...], **made) -> DataFrame:
    """(_row, made...): the columns of docs in one struct, without those that clash with new ones in any case.

    Nothing that an operator adds can then meet a column of docs; ``_row.*`` brings them back.
    """
    clash = {n.lower() for n in new}
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in clash]
    return docs.select(F.struct(*keep).alias("_row"), *[c.alias(n) for n, c in made.items()])


def schema_of(df: DataFrame, keep: str, made: str) -> StructType:
    """Columns of df called ``keep`` (names by commas), then those of the DDL ``made``, for functions over Arrow batches."""
    return StructType([*(df.schema[n] for n in keep.split(",")), *StructType.fromDDL(made)])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one for sessions
    whose executors are threads of the driver, as in tests; an error on a cluster, whose executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = "file://" + tempfile.mkdtemp(prefix="quarry-checkpoint-")
    return _FALLBACK["dir"]


_FALLBACK: dict[str, str] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared checkpoint folder and read it back: short lineage that outlives executors.

    The frame that comes back knows its folder (``_folder``), so that loops can release() what they no longer need.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete the folders behind materialized frames."""
    for df in frames:
        folder = getattr(df, "_folder", None)
        if folder:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs that are done. It learns of them when the driver's JVM collects
    garbage, which a driver with memory to spare may put off for long while disks fill."""
    gc.collect()
    spark._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of so many rows: what a worker makes of texts at once is small, whatever the session sends."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for the jobs that run inside: bounds a Python worker's memory on long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def join_counted(left: DataFrame, right: DataFrame, on: list[str], heavy: int = HEAVY, total: int | None = None) -> DataFrame:
    """Inner join of left with right, whose keys ``on`` are unique and whose ``n`` counts the rows of left that have them.

    Keys with more than one in ``heavy`` of those rows, fewer than ``heavy`` keys, come by broadcast, so that no key fills a
    task; the rest is exchanged. left is read for both. ``n`` isn't returned. ``total`` is at least the sum of n, if known.
    """
    total = (right.agg(F.sum("n")).first()[0] or 0) if total is None else total
    much = F.col("n") * heavy > total
    hot = F.broadcast(right.where(much).drop("n"))
    cold = left.join(hot.select(*on), on, "left_anti").join(right.where(~much).drop("n"), on)
    return left.join(hot, on).unionByName(cold)


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Connected components of an undirected edge list: (node, root), root the smallest node, for every node with an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014) as joins and aggregates: a hub is never
    collected or joined in one task, the edge list never grows, and both steps of each round are cut from their lineage:
    joins read their sides several times, so the second step's plan would hold the first step's six times over, and the
    driver plans anew as each exchange ends. What plans and broadcasts leave in it goes after each round. Loops and null ends
    are ignored.
    """
    e = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    e = materialize(e.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select("b", "a"))
        low = both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select("x", F.least("x", "m").alias("m"), "n")
        up = e.select(F.col("b").alias("x"), F.col("a").alias("y"))
        large = join_counted(up, low, ["x"], total=2 * mark[0]).select(F.col("y").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, ["a"], total=2 * mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a != b").union(least.drop("n"))
        nxt = materialize(small.distinct())
        now = _mark(nxt)
        release(e, large)
        sweep(edges.sparkSession)
        e = nxt
        if now == mark:
            break
        mark = now
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h
