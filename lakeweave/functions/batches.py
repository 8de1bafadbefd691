"""Arrow batches of bounded size, and bounded parts of them as Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows, and bytes of texts, that a Python worker turns into Python objects at a time; one row may have more.
SLICE, SLICE_BYTES = 256, 4 << 20


def cuts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts of at most ``SLICE`` rows and ``SLICE_BYTES`` of
    texts; a row that is larger is a part alone."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = max(1, min(SLICE, int(np.searchsorted(ends, before + SLICE_BYTES, "right")) - at))
        yield at, n
        at += n


#: Settings of Arrow's batches that are lowered where a session has Spark's defaults: a
#: batch is held by the executor and by its Python worker at the same time.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b"))


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends texts to Python in batches of modest size."""
    for name, default, value in BATCHES:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, value)
