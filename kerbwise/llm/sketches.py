"""Fixed-size count sketches over a whole table.

A sketch has ``2 ** bits`` counters whatever the table's size, so the merged one may go to
the driver and to every task (4 or 8 bytes a counter). Counts may be too high, never too low.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SEGMENT_BITS = 16


def cells(keys: np.ndarray, bits: int) -> np.ndarray:
    """The counter of each 64-bit key."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def counted(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, kind: type = np.int64) -> np.ndarray:
    """Counts of all keys that ``keys_of`` draws from the batches of ``df``; of kind bool, whether there are any."""
    segment = 1 << min(_SEGMENT_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, kind)
        for batch in batches:
            for keys in keys_of(batch):
                if kind is bool:
                    total[cells(keys, bits)] = True
                else:
                    total += np.bincount(cells(keys, bits), minlength=1 << bits)
        filled = [i for i in range(len(total) // segment) if total[i * segment:(i + 1) * segment].any()]
        yield pa.record_batch(
            {
                "segment": pa.array(filled, pa.int64()),
                "counts": pa.array([total[i * segment:(i + 1) * segment].tobytes() for i in filled], pa.binary()),
            }
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(counts, kind)
                totals[i] = totals[i] + part if i in totals else part.copy()
        yield pa.record_batch(
            {"segment": pa.array(list(totals), pa.int64()), "counts": pa.array([x.tobytes() for x in totals.values()], pa.binary())}
        )

    schema = "segment long, counts binary"
    merged = df.mapInArrow(count, schema).repartition((1 << bits) // segment, "segment").mapInArrow(merge, schema)
    out = np.zeros(1 << bits, kind)
    for i, counts in merged.collect():
        out[i * segment:(i + 1) * segment] = np.frombuffer(counts, kind)
    return out
