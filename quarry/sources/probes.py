"""Probes of stored tables against what is expected of them (R16, S26): presence, columns, types, partitions, version."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Key of a column's metadata under which a table declares its version; Parquet footers keep it.
VERSION = "schema_version"


def declared(df: DataFrame, version: int) -> DataFrame:
    """df whose first column declares the table's version, to be written as Parquet."""
    first = df.columns[0]
    return df.withMetadata(first, df.schema[first].metadata | {VERSION: version})


def partition_columns(spark: SparkSession, path: str) -> list[str] | None:
    """Names of the folders k=v below a path, outermost first, from one folder of each level; None if there is no such path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(at):
        return None
    names: list[str] = []
    while True:
        below = [s.getPath() for s in system.listStatus(at) if s.isDirectory() and "=" in s.getPath().getName()]
        if not below:
            return names
        at = below[0]
        names.append(at.getName().split("=")[0])


def stored(spark: SparkSession, path: str) -> tuple[StructType, list[str]] | None:
    """Schema of a Parquet table over the footers of all its files, which a job reads, and its partition columns."""
    parts = partition_columns(spark, path)
    if parts is None:
        return None
    try:
        return spark.read.option("mergeSchema", "true").parquet(path).schema, parts
    except AnalysisException:  # no Parquet file in it
        return None


def probe(spark: SparkSession, paths: dict[str, str], expected: dict[str, dict]) -> DataFrame:
    """A row per expected table: (name, present, missing, retyped, extra, partitions, version, ok).

    expected: {name: {"columns": {column: type}, "partitions": [...], "version": n}}, the last two if they matter. missing
    and extra are columns, retyped those of another type as ``column: expected, found``, partitions and version what was found
    (null: none declared). Names are compared without case, as the session does. ok if nothing but extra columns differs.
    """
    rows = []
    for name, want in sorted(expected.items()):
        found = stored(spark, paths[name]) if name in paths else None
        schema, parts = found or (StructType(), [])
        types = {f.name.lower(): f.dataType.simpleString() for f in schema}
        columns = {c.lower(): t for c, t in want["columns"].items()}
        version = next((f.metadata[VERSION] for f in schema if VERSION in f.metadata), None)
        missing = sorted(columns.keys() - types.keys())
        retyped = [f"{c}: {columns[c]}, {types[c]}" for c in sorted(columns.keys() & types.keys()) if columns[c] != types[c]]
        fits = parts == want.get("partitions", parts) and version == want.get("version", version)
        ok = found is not None and fits and not missing and not retyped
        rows.append((name, found is not None, missing, retyped, sorted(types.keys() - columns.keys()), parts, version, ok))
    kind = "name string, present boolean, missing array<string>, retyped array<string>, extra array<string>, partitions array<string>, version int, ok boolean"
    return spark.createDataFrame(rows, kind)


def difference(row_columns: DataFrame) -> DataFrame:
    """(name, difference) of probe() rows that aren't ok, in words."""
    said = F.concat_ws(
        "; ",
        F.when(~F.col("present"), "not there"),
        F.when(F.size("missing") > 0, F.concat(F.lit("missing "), F.array_join("missing", ", "))),
        F.when(F.size("retyped") > 0, F.concat(F.lit("other type "), F.array_join("retyped", "; "))),
    )
    return row_columns.where(~F.col("ok")).select("name", said.alias("difference"))
