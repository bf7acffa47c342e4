"""File sources: kind by magic bytes, decoding, paged text, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 100 << 20

# What Windows-1252 has in the places of the Latin-1 controls.
_C1 = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_CP1252 = _C1.encode("latin-1").decode("cp1252")


def kind(content: Column) -> Column:
    """pdf, gzip, docx, doc or text, by the first bytes rather than the name."""
    head = F.hex(F.substring(content, 1, 8))
    ladder = (("25504446", "pdf"), ("1F8B", "gzip"), ("504B0304", "docx"), ("D0CF11E0A1B11AE1", "doc"))
    out = F.lit("text")
    for start, name in reversed(ladder):
        out = F.when(head.startswith(start), name).otherwise(out)
    return out


def decoded(content: Column) -> Column:
    """UTF-16 by its mark, else UTF-8, else Windows-1252."""
    head = F.hex(F.substring(content, 1, 2))
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(
        F.coalesce(F.regexp_replace(utf8, "^\\uFEFF", ""), F.translate(F.decode(content, "ISO-8859-1"), _C1, _CP1252))
    )


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, kind, bytes, text, problem) of a folder; files that are too large keep a row with the
    problem (S06). Spark's file scan leaves empty files out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    problem = F.when(F.col("length") > max_bytes, "too large")
    k = kind(F.col("content"))
    text = F.when(problem.isNull() & (k == "text"), decoded(F.col("content")))
    return raw.select("path", k.alias("kind"), F.col("length").alias("bytes"), text.alias("text"), problem.alias("problem"))


def paged(df: DataFrame, text: str) -> DataFrame:
    """One row per form-feed page, numbered from 1."""
    return df.select("*", F.posexplode(F.split(text, "\f", -1)).alias("_p", "page_text")).withColumn("page", F.col("_p") + 1).drop("_p")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df in the given columns; those that it lacks are null."""
    want = df.sparkSession.createDataFrame([], schema).schema
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in or over it, by key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
