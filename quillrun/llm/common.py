"""What the operators share: Arrow batch maps, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..workspace import materialize, new_path, shared_dir

#: Arrow batches are bounded in bytes, so that very long texts don't add up in a Python worker.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(
    df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str
) -> DataFrame:
    """``fn()`` runs once a task and returns what maps one Arrow batch to another."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for b in batches:
            if b.num_rows and (out := each(b)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def list_array(values: pa.Array, lengths) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


__all__ = ["BATCH_BYTES", "bound_batches", "list_array", "map_batches", "materialize", "new_path", "shared_dir"]
