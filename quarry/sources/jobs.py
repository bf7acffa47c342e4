"""Catalogues, manifests, bills and jobs: what is read from and written to files besides plain tables."""

from __future__ import annotations

import io
import json
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.documents import title_of_file
from quarry.functions.text import content_key

#: A manifest may list so many files; each is one read.
MOST_FILES = 1000

# What a bill shows besides its own fields.
BILL_STATE = "Em tramitação (consultar o link oficial)"
BILL_SCHEMA = "id bigint, kind string, number bigint, year bigint, summary string"


def read_catalogue(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A JSON catalogue, an array of records or one per line; empty where there is no file.

    strict: a record that does not fit the schema fails the read, else its fields that don't fit are null (S14).
    """
    mode = "FAILFAST" if strict else "PERMISSIVE"
    try:
        return spark.read.schema(schema).option("multiLine", "true").option("mode", mode).json(path)
    except AnalysisException as e:
        if strict or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """(id, file, text) of the files that manifest(id, file) lists, in one scan of them all."""
    listed = manifest.select("id", "file").limit(MOST_FILES + 1).collect()
    if len(listed) > MOST_FILES:
        raise ValueError(f"a manifest lists {MOST_FILES} files at most")
    if not listed:
        return spark.createDataFrame([], "id string, file string, text string")
    found = spark.read.text([f"{root.rstrip('/')}/{r.file}" for r in listed], wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    ends = F.expr("endswith(path, concat('/', file))")
    return found.join(F.broadcast(manifest), ends).select("id", "file", "text")  # MOST_FILES rows at most


class BillsSource(DataSource):
    """Bills from a local JSON answer ``{"dados": [...]}``: ``spark.read.format("bills").option("path", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "bills"

    def schema(self) -> str:
        return BILL_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BillsReader(self.options["path"])


class _BillsReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition):
        with open(partition.value.removeprefix("file://"), encoding="utf-8") as f:
            records = json.load(f).get("dados") or []
        for r in records:
            yield r.get("id"), r.get("siglaTipo"), r.get("numero"), r.get("ano"), r.get("ementa")


def bills_on(bills: DataFrame, words: list[str], year: int, link: str, k: int = 5) -> DataFrame:
    """(number, year, summary, state, link) of the newest bills whose summary has one of the words."""
    asked = [w.lower() for w in words if w]
    text = F.lower(F.coalesce("summary", F.lit("")))
    hit = F.exists(F.array(*map(F.lit, asked)), lambda w: F.contains(text, w)) if asked else F.lit(False)
    when = F.coalesce("year", F.lit(year))
    number = F.concat(F.coalesce("kind", F.lit("PL")), F.lit(" "), F.coalesce("number", "id").cast("string"), F.lit("/"), when.cast("string"))
    return bills.where(hit).orderBy(F.col("id").desc()).limit(k).select(
        number.alias("number"), when.alias("year"), F.coalesce("summary", F.lit("")).alias("summary"), F.lit(BILL_STATE).alias("state"),
        F.concat(F.lit(link), F.col("id").cast("string")).alias("link"),
    )


def docx_of(content: bytes | None) -> str | None:
    """Text of a DOCX file, a line per paragraph; null if it isn't one."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    marks = {f"{w}tab": "\t", f"{w}br": "\n"}
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            root = ET.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None
    return "\n".join("".join(t.text or "" if t.tag == f"{w}t" else marks.get(t.tag, "") for t in p.iter()) for p in root.iter(f"{w}p"))


def docx_text(content: Column) -> Column:
    """Text of DOCX files (S08); the older DOC format is not read."""

    def run(c: pd.Series) -> pd.Series:
        return c.map(docx_of)

    return F.pandas_udf(run, "string")(content)


def index_documents(files: DataFrame, registry: DataFrame, chunks) -> tuple[DataFrame, DataFrame]:
    """New registry rows and their chunks: chunk, hash, leave out known contents, register, replace older versions.

    files(collection, name, title, text), registry(collection, name, hash, title, letters, n_chunks); chunks is a function
    of (files with a doc column) to (doc, ord, text). A content that a collection has is not indexed again; a document
    without chunks is none; a file of a known name replaces that name's older rows, which the caller writes over.
    """
    hashed = files.withColumn("hash", content_key(F.coalesce("text", F.lit("")))).dropDuplicates(["collection", "hash"])
    new = hashed.join(registry.where("n_chunks > 0").select("collection", "hash"), ["collection", "hash"], "left_anti")
    new = new.withColumn("doc", F.concat_ws(":", "collection", "hash"))
    made = chunks(new)
    sizes = made.groupBy("doc").agg(F.count("*").alias("n_chunks"))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), title_of_file(F.col("name")))
    rows = new.join(sizes, "doc").select("collection", "name", "hash", title.alias("title"), F.length("text").alias("letters"), "n_chunks")
    older = registry.join(rows.select("collection", "name"), ["collection", "name"], "left_anti")
    return older.unionByName(rows, allowMissingColumns=True), made


def catalogue_audit(spark: SparkSession, required: list[str]) -> DataFrame:
    """One JSON document on the session's catalogue: required tables, those there are with their columns, functions."""
    there = {t.name: t for t in spark.catalog.listTables()}
    rows = [(n, n in there, sorted(c.name for c in spark.catalog.listColumns(n)) if n in there else []) for n in sorted(set(required) | set(there))]
    tables = spark.createDataFrame(rows, "name string, present boolean, columns array<string>")
    entry = F.struct("name", F.struct("present", "columns"))
    return tables.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tables"))).alias("audit"))


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write df in the folder of a corpus version; readers of another version never meet it."""
    where = f"{root.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(where)
    return where


def read_version(spark: SparkSession, root: str, version: int, schema: str) -> DataFrame:
    """What a corpus version has; empty where it has nothing yet, as after a change of the corpus."""
    try:
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def export_json(df: DataFrame, where: str) -> None:
    """Write df as JSON lines."""
    df.write.mode("overwrite").json(where)


def backfill(pending: DataFrame, text: str, embed, target: str, checkpoint: str) -> None:
    """Give vectors to a stream of rows that lack one, all there are, then stop.

    embed is a Column function of the text. A micro-batch is written to a folder of its number, so a run that was cut off
    goes on where it stopped and leaves no row twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("embedding", embed(F.col(text))).write.mode("overwrite").parquet(f"{target}/batch={number}")

    pending.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
