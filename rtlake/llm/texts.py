"""Arrow batches of texts through Python functions, in bounded pieces."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Setting of the session for the bytes of an Arrow batch between the JVM and a Python worker, its default, and what
#: stands for the default here: two workers of an executor and their JVM hold several batches each at once.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(4 << 20))
#: Characters of text that are held as Python strings at once; one longer text makes a piece of its own.
PIECE_CHARS = 1_000_000


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of ``column`` each; rows are neither dropped nor reordered."""
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        if i > start and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def kept_by_worker(key: Hashable, make: Callable[[], object]):
    """``make()``, made once in each Python worker and kept for its later tasks."""
    kept = sys.__dict__.setdefault("_rtlake_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def map_texts(df: DataFrame, schema: str, body: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], limit: int = PIECE_CHARS) -> DataFrame:
    """``df`` through ``body``, which turns an iterator of pieces into dictionaries of columns. ``df`` needs a column ``text``."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in body(p for b in batches for p in pieces(b, limit=limit)):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in ((columns[f.name], f) for f in arrow)], schema=arrow)

    conf, (key, default, size) = df.sparkSession.conf, BATCH_BYTES
    if conf.get(key) == default:
        conf.set(key, size)
    return df.mapInArrow(run, schema)
