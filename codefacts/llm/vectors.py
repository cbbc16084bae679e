"""What the vector operators share: which vectors count, their copies, groups of sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column | str) -> Column:
    """True for vectors without null, NaN or infinite components that aren't zero or empty."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def sample(df: DataFrame, vector: str, limit: int) -> np.ndarray:
    """At most ``limit`` distinct vectors of the most common length, by order of a hash: the bounded sample that models fit on."""
    hashed = df.select(F.xxhash64(vector).alias("h"), F.col(vector).alias("v"))
    least = hashed.select("h").distinct().orderBy("h").limit(limit)
    once = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.first("v").alias("v"))  # (copies are merged before the shuffle)
    rows = once.orderBy("h").select("v").toArrow().column(0).to_pylist()
    if not rows:
        return np.empty((0, 0))
    sizes, counts = np.unique([len(r) for r in rows], return_counts=True)
    d = int(sizes[np.argmax(counts)])
    return np.array([r for r in rows if len(r) == d], dtype=np.float64)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows that agree in the first ``keys`` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of vectors of one length, in double precision."""
    parts = [np.asarray(c.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(c), -1) for c in column.chunks if len(c)]
    return np.concatenate(parts)
