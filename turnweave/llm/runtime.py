"""Size-checked broadcasts and grouped streaming for the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.lineage import bucketed, cut, discard, shared_folder

__all__ = ["BROADCAST_BYTES", "bucketed", "cut", "discard", "grouped", "shared_folder", "small"]

#: A side of a join is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted size allows it. df must be cheap
    to count (a table of cut()); otherwise it is left to a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches that come sorted by those keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        new = [False] * n
        for c in columns:
            differs = pa.compute.fill_null(pa.compute.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            for i in differs.nonzero()[0]:
                new[int(i) + 1] = True
        start = 0
        first = tuple(c[0].as_py() for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for i in range(1, n):
            if new[i]:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, start = [], i
        held.append(batch.slice(start))
        last = tuple(c[n - 1].as_py() for c in columns)
    if held:
        yield pa.Table.from_batches(held)
