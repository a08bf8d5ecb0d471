"""Rows of vectors that can be computed with."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(rows: DataFrame, vector: str, below: float) -> DataFrame:
    """``rows`` whose ``vector`` is not null and holds only finite entries smaller than ``below`` in size; it is array<double> then."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(below), F.lit(False)))
    return rows.filter(F.col(vector).isNotNull() & fine).withColumn(vector, v)


def commonest_length(rows: DataFrame, vector: str) -> int:
    """The length above 0 that most vectors have (of equal counts the longer); 0 if there is none."""
    size = F.size(vector)
    most = rows.select(size.alias("d")).filter("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    return most["d"] if most else 0


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A list column without nulls, each list of ``length`` entries, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
