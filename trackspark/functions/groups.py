"""Many small groups in one call of Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def _starts(table: pa.Table, by: list[str], before: pa.RecordBatch | None) -> np.ndarray:
    """The places of a table at which a group begins; ``before`` ends with the row before it."""
    new = np.zeros(table.num_rows, bool)
    new[0] = before is None
    for c in by:
        now = table.column(c)
        now = now.combine_chunks() if isinstance(now, pa.ChunkedArray) else now
        if before is not None:
            now = pa.concat_arrays([before.column(c).slice(before.num_rows - 1), now])
        a, b = now.slice(0, len(now) - 1), now.slice(1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[len(new) - len(differs) :] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def in_groups(df: DataFrame, by: list[str], order: list[str], kernel: Callable[[pa.Table, np.ndarray], Iterable[pa.RecordBatch]], schema: StructType | str, rows: int | None = None, rows_per_task: int = 1_000_000) -> DataFrame:
    """The kernel's rows of each group. It gets a table of whole groups, one after another and each in ``order``, and
    the places at which they begin: as many as an Arrow batch holds, so that small groups cost no call each. A group
    of several batches is put together; one group is what a task holds at most, beside a batch. ``rows``, if known:
    how many there are, so that tasks grow in number with them, not in what they sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group that may go on
        for b in batches:
            if not b.num_rows:
                continue
            starts = _starts(b, by, held[-1] if held else None)
            if len(starts):
                done = held + ([b.slice(0, starts[-1])] if starts[-1] else [])
                if done:
                    t = pa.Table.from_batches(done)
                    yield from kernel(t, _starts(t, by, None))
                b, held = b.slice(starts[-1]), []
            held.append(b)
        if held:
            t = pa.Table.from_batches(held)
            yield from kernel(t, _starts(t, by, None))

    parts = 0 if rows is None else max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))
    return (df.repartition(parts, *by) if parts else df.repartition(*by)).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def heads(table: pa.Table, names: list[str], rows: np.ndarray) -> list[pa.Array]:
    """The named columns of some rows."""
    return [c.combine_chunks() for c in table.select(names).take(pa.array(rows)).columns]


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]
