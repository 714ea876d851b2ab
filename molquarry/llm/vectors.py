"""What the vector operators share: the usual length of a table's vectors, and batches of them as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usual_length(rows: DataFrame, vector: str, divisor: int = 1) -> int:
    """The length that most vectors have, the smallest of several, among those that `divisor` divides; 0 if there is none."""
    sizes = rows.select(F.size(vector).alias("n")).where(f"n > 0 and n % {divisor} = 0").groupBy("n").count()
    best = sizes.orderBy(F.desc("count"), "n").first()
    return best["n"] if best else 0


def matrices(batches: Iterator[pa.RecordBatch], column: int, dim: int, zero: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each batch that hold `dim` finite components, and those as doubles; zero vectors only with `zero`. Null vectors and
    vectors of another length or with null or non-finite components are left out."""
    for batch in batches:
        lists = batch.column(column)
        good = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False)
        part = batch.filter(good)
        flat = part.column(column).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        x = flat.reshape(-1, dim)
        keep = np.isfinite(x).all(axis=1)
        if not zero:
            keep &= x.any(axis=1)
        if not keep.all():
            part, x = part.filter(pa.array(keep)), x[keep]
        if len(x):
            yield part, x
