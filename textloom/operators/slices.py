"""Arrow batches in slices of bounded text: a batch is counted in rows, and what Python makes of its texts is many times their size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20  # of an Arrow batch that is sent to Python
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def byte_batches(spark: SparkSession) -> None:
    """The session's Arrow batches held to BATCH_BYTES: a batch is held several times over in the JVM and in Python, and grows with the
    rows of a task up to 64 MB else. Spark has this setting for a session only; it is lowered, never raised."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch("(-?[0-9]+)([bkmg]?)b?", spark.conf.get(key).lower()).groups()
    if not 0 < int(number) * _UNITS[unit] <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def parts(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Texts in order, in parts of at most so many bytes; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        past = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, past + size, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def slices(batch: pa.RecordBatch, place: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in the parts of its texts, column `place`."""
    lo = 0
    for part in parts(batch.column(place), size):
        yield batch.slice(lo, len(part))
        lo += len(part)


def structs(counts: list[int], **fields: pa.Array) -> pa.Array:
    """An array of lists of structs, so many in each, from flat fields."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))
