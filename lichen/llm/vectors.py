"""Vectors as numpy matrices, shared by the two operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, no null, NaN or infinite component, and not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; -0.0 is 0.0."""
    kind = df.schema["embedding"].dataType.elementType.simpleString()
    zero = F.lit(0.0).cast(kind)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where("vec_id IS NOT NULL").where(usable(F.col("v")))
    return rows.withColumn("v", F.transform("v", lambda x: x + zero))


def classes(rows: DataFrame, most_ids: int = 1) -> DataFrame:
    """(rep, n, ids, v): each different vector once, with its smallest vec_id, the number of rows that have it, and
    its ``most_ids`` smallest vec_ids. Copies are first brought together in 64 salted parts."""
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, most_ids)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    if most_ids == 1:
        whole = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.array(F.min("vec_id")).alias("ids"))
    else:
        part = salted.groupBy("v", "salt").agg(F.count(F.lit(1)).alias("n"), least(F.collect_list("vec_id")).alias("ids"))
        whole = part.groupBy("v").agg(F.sum("n").alias("n"), least(F.flatten(F.collect_list("ids"))).alias("ids"))
    return whole.select(F.element_at("ids", 1).alias("rep"), "n", "ids", "v")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column as doubles; all of the same length."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1) for c in chunks if len(c)]
    return np.concatenate(parts) if parts else np.empty((0, 0))
