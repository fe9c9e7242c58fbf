"""Python over whole series in their order, many series at a time.

A group for each series costs Spark and pandas milliseconds, whatever its length, so rows come
sorted and marked instead, and a worker takes as many series at once as a block holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are taken at once; a series that is longer is held whole.
BLOCK = 65_536


def in_order(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Rows of a series in one partition and in order, one series after the other; ``_first`` marks a series' first."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1).sortWithinPartitions(*by, order)


def firsts(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Where series start."""
    return np.flatnonzero(rows.column("_first").to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column("_first").to_numpy())


def whole_series(batches: Iterator[pa.RecordBatch], block: int | None = None) -> Iterator[pa.Table]:
    """Rows of ``in_order``, as tables that hold whole series."""
    held, n, block = [], 0, block or BLOCK
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= block and len(at := firsts(batch)) and n - batch.num_rows + at[-1] > 0:
            cut = int(at[-1])
            held[-1] = batch.slice(0, cut)
            yield pa.Table.from_batches(held)
            held, n = [batch.slice(cut)], batch.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)
