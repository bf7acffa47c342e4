"""Vectors as whole numbers, so that products and distances are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A component x becomes floor(64 * x).
SCALE = 64
#: Largest square of a component times the number of components; sums of squared differences then fit 60 bits.
ROOM = 2.0**58


def whole(vectors: DataFrame, length: int | None = None, scale: int = SCALE) -> DataFrame:
    """(vec_id bigint, v array<int>) of vectors(vec_id, embedding): floor(scale * x) of every component x, taken as double.

    Vectors that are null, hold null or non-finite components or (with ``length``) are of another length fall away. Other
    columns aren't read. A vector too long for exact 64-bit sums raises an error, as integer overflow does elsewhere in SQL.
    """
    plain = F.col("embedding").cast("array<double>")
    fine = F.forall(plain, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    if length is not None:
        fine &= F.size(plain) == length
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(F.coalesce(fine, F.lit(False)))
    most = F.coalesce(F.array_max(F.transform(plain, lambda x: F.abs(x) * scale + 1)), F.lit(0.0))
    v = F.transform(plain, lambda x: F.floor(x * scale).cast("int"))
    large = F.raise_error(F.lit("the components of a vector are too large for exact 64-bit scores"))
    return kept.select("vec_id", F.when(most * most * F.size(plain) < ROOM, v).otherwise(large).alias("v"))
