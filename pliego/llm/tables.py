"""Tables of fixed size over a whole frame: filled in tasks, merged slice by slice, small enough for any driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm import words as W

SLICES = 16
#: Tables of so many tasks are merged at a time, so that no group holds those of all tasks.
FAN_IN = 64
#: The filter of `narrowed` has a power of two of bits, at least 8 for each row that is wanted, within these bounds.
LEAST_BITS, MOST_BITS = 20, 28


def fixed_table(frame: DataFrame, fill: Callable[[pa.RecordBatch, np.ndarray], None], size: int, kind: str, merge: Callable) -> np.ndarray:
    """A table of fixed size, filled in each task and merged slice by slice: those of `FAN_IN` tasks first, then the rest."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, kind)
        for batch in batches:
            fill(batch, table)
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in np.split(table, SLICES)], pa.binary())], names=["slice", "part"])

    def join(parts: pa.Table) -> pa.Table:
        total = merge([np.frombuffer(b, kind) for b in parts.column("part").to_pylist()])
        return pa.table({"slice": pa.array([parts.column("slice")[0].as_py()], pa.int32()), "part": pa.array([total.astype(kind).tobytes()], pa.binary())})

    filled = frame.mapInArrow(each, "slice int, part binary").withColumn("tasks", F.floor(F.spark_partition_id() / FAN_IN))
    merged = filled.groupBy("slice", "tasks").applyInArrow(join, "slice int, part binary")
    rows = merged.groupBy("slice").applyInArrow(join, "slice int, part binary").collect()
    return np.concatenate([np.frombuffer(r.part, kind) for r in sorted(rows)]) if rows else np.zeros(size, kind)


def passed_by(needed: DataFrame, column: str = "doc_id") -> Callable[[np.ndarray], np.ndarray]:
    """A test for tasks that all values in a column of longs pass, and few others.

    It has 32 megabytes at most; beyond some thirty million rows ever more pass.
    """
    bits = min(max((8 * needed.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def places(ids: np.ndarray) -> np.ndarray:
        return (W.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        at = places(batch.column(column).to_numpy())
        np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))

    table = fixed_table(needed.select(column), fill, 2 ** (bits - 3), "u1", lambda parts: np.bitwise_or.reduce(parts))
    shared = needed.sparkSession.sparkContext.broadcast(table)

    def passes(ids: np.ndarray) -> np.ndarray:
        at = places(ids)
        return (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    return passes


def narrowed(docs: DataFrame, needed: DataFrame, column: str = "doc_id") -> DataFrame:
    """`docs` without most of those that `needed` doesn't hold, and never without a wanted one: a filter before any shuffle."""
    passes = passed_by(needed, column)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(column).to_numpy())))

    return docs.mapInArrow(work, docs.schema)
