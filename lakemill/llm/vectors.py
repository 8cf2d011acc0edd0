"""Valid rows of a table of vectors, in a form for numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(embedding: str) -> Column:
    """True for vectors without null, NaN or infinite components."""
    v = F.col(embedding).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & good, F.lit(False))


def matrix(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    """Binary values of equal length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def doubles(df: DataFrame, embedding: str) -> DataFrame:
    return df.withColumn(embedding, F.col(embedding).cast("array<double>"))
