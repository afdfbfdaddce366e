"""Arrow batches of bounded size between Spark and Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Spark's bound for an Arrow batch, and ours: the JVM holds a batch outside its heap, twice while it grows, for each task.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in batches of ``BATCH_BYTES`` instead of Spark's 64 MB, unless the session names a bound of its own. The
    setting stays in the session; it changes how rows travel, not what comes of them. Workers outlive their tasks, so a task
    gives back what Arrow keeps for later allocations."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    if df.sparkSession.conf.get(BATCH_LIMIT, None) is None:
        df.sparkSession.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(task, schema)
