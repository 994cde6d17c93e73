"""Groups of rows, many at a time: for fits of small groups, where a call for each would cost more than the fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a call gets at least, if there are so many; a group is never cut.
ROWS = 20_000


def starts_of(keys: pa.ChunkedArray) -> np.ndarray:
    """Where each run of equal keys starts."""
    code = keys.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, code[1:] != code[:-1]])


def in_batches(rows: DataFrame, key: str, fit: Callable[[pa.Table, np.ndarray], pa.Table], ddl: str, least: int = ROWS) -> DataFrame:
    """What fit makes of whole groups, which lie one after another in a table, and where each starts.

    A task holds a batch and the group that goes on in the next; sorting brings groups together and may spill.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, want = None, least
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < want:
                continue
            starts = starts_of(held.column(key))
            if len(starts) == 1:
                want = 2 * held.num_rows
                continue
            yield from fit(held.slice(0, starts[-1]).combine_chunks(), starts[:-1]).to_batches()
            held, want = held.slice(starts[-1]), least
        if held is not None and held.num_rows:
            yield from fit(held.combine_chunks(), starts_of(held.column(key))).to_batches()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, ddl)
