"""Order-dependent folds in bounded memory.

Rows are dealt by key and sorted by key and order; a worker passes over its sorted partition and keeps the state of
one key at a time. No group is ever held as a table, so a long run costs time but not memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Output rows that a worker gathers into one batch.
BATCH = 5_000


def fold_sorted(
    df: DataFrame,
    keys: list[str],
    order: list[Any],
    start: Callable[[dict], Any],
    step: Callable[[Any, dict], Iterable[tuple]],
    schema: str,
    finish: Callable[[Any], Iterable[tuple]] | None = None,
) -> DataFrame:
    """Folds each key's rows in order.

    start makes a key's state from its first row; step and finish yield output rows. order must make the order of a
    key's rows unique where it matters.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out, begun = None, None, [], False
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if not begun or key != current:
                    if begun and finish is not None:
                        out.extend(finish(state))
                    current, state, begun = key, start(row), True
                out.extend(step(state, row))
                if len(out) >= BATCH:
                    yield batch_of(out)
                    out = []
        if begun and finish is not None:
            out.extend(finish(state))
        yield batch_of(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)
