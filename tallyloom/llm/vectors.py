"""Tables of vectors: which rows take part, and rows of equal length as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool = False, **more) -> DataFrame:
    """(id, v, width, *more): one row for each id whose vector is not null and finite throughout.

    Rows with a null id take no part. Of rows with one id the least vector counts, then the least
    of the further columns, so repeats change nothing. `nonzero` also drops vectors of zeros.
    """
    x = F.col("v")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kind = vectors.schema[vector_col].dataType.simpleString()
    vector = vectors[vector_col] if kind in ("array<float>", "array<double>") else vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vector.alias("v"), *(c.alias(k) for k, c in more.items()))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & finite)
    if nonzero:
        rows = rows.where(F.exists(x, lambda e: e != 0))
    least = F.min(F.struct("v", *more)).alias("r")
    return rows.groupBy("id").agg(least).select("id", "r.v", F.size("r.v").alias("width"), *(f"r.{k}" for k in more))


def matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """The lists of a column, each of `width` values, as rows."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(chunk), width)


def cores(df: DataFrame) -> int:
    """Tasks that can run at once; work is dealt into a few times as many pieces at least."""
    return max(1, df.sparkSession.sparkContext.defaultParallelism)
