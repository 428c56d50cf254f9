"""Folds over rows that belong together: one shuffle by key, then a task's groups pass by in order, in Arrow batches.

A group costs what its rows cost; there is no frame and no call for each group, of which the tables have millions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROWS = 10_000


def grouped(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows that follow one another with equal first ``width`` fields, a list at a time."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            key = row[:width]
            if key != last:
                if rows:
                    yield rows
                last, rows = key, []
            rows.append(row)
    if rows:
        yield rows


def batched(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], size: int = ROWS) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), types)], names)

    for row in rows:
        kept.append(row)
        if len(kept) >= size:
            yield batch()
            kept.clear()
    if kept:
        yield batch()


def fold(rows: DataFrame, keys: list[str], order: list[str], schema: T.StructType, each: Callable[[list[tuple]], Iterable[tuple]]) -> DataFrame:
    """``each`` over the rows (tuples) of every key, sorted by ``order``; the keys must be the first columns of ``rows``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made, width = to_arrow_schema(schema), len(keys)
    names, types = made.names, made.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((row for group in grouped(batches, width) for row in each(group)), names, types)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
