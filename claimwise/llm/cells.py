"""Sorted 64-bit keys in the shuffle: a task sends its distinct keys as packed
cells, one for each of ``parts`` even ranges of the key space, and the task of a
range merges the cells of all senders in numpy. A key comes once from each
sender, so a hot key costs as many entries as there are senders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from claimwise.llm import arrow

CELL = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("sender", T.LongType()), T.StructField("cell", T.BinaryType())])


def cells(sender: int, parts: int, keys: np.ndarray, *columns: np.ndarray, span: int = 1 << 64) -> pa.RecordBatch:
    """Rows (part, sender, cell) of ascending ``keys`` below ``span`` and the
    columns beside them; empty ranges are left out."""
    bounds = np.array([-(-p * span // parts) for p in range(1, parts)], np.uint64)
    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    full = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
    packed = [arrow.pack_sorted(keys[cuts[p] : cuts[p + 1]], *(c[cuts[p] : cuts[p + 1]] for c in columns)) for p in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([sender] * len(full), pa.int64()), pa.array(packed, pa.binary())], names=CELL.names)


def ranged(rows: DataFrame, parts: int) -> DataFrame:
    """Cells of a range next to each other in one task."""
    return rows.repartition(parts, "part").sortWithinPartitions("part", "sender")


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, list[np.ndarray]]]]]:
    """(part, [(sender, [keys, *columns])]) of one range after another."""
    part, group = None, []
    for b in batches:
        for p, sender, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if p != part and group:
                yield part, group
                group = []
            part = p
            group.append((sender, arrow.unpack_sorted(cell)))
    if group:
        yield part, group


def merge(group: list[tuple[int, list[np.ndarray]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a range by key: keys, (entries, columns) as i64, and the
    place in ``group`` that each comes from."""
    keys = np.concatenate([a[0] for _, a in group])
    owner = np.repeat(np.arange(len(group), dtype=np.int32), [len(a[0]) for _, a in group])
    cols = np.stack([np.concatenate([a[i] for _, a in group]).astype(np.int64) for i in range(1, len(group[0][1]))], axis=1)
    order = np.argsort(keys, kind="stable")
    return keys[order], cols[order], owner[order]


def summed(keys: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys and the sums of their columns."""
    if not len(keys):
        return keys, cols
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(cols, start, axis=0)


def split(owner: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Values by owner, in the order they have."""
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    u, start = np.unique(owner, return_index=True)
    for k, a, b in zip(u.tolist(), start.tolist(), [*start[1:].tolist(), len(owner)]):
        yield k, values[a:b]
