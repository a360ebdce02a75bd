"""Turning rows of arrays: from a row a trace to a row a sample, and the like, by blocks.

A batch of rows is a matrix. It is cut into tiles of all its rows and some of its
columns, and a tile is one row of the shuffle, with its numbers in one array. The
tiles of a block of columns meet in one group, which holds about ``TILE`` numbers,
or one number for each row of the profile where that is more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Numbers of a group.
TILE = 1 << 18


def floats(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The numbers of a list column; nulls count as zero."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(float))


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    ends = np.arange(len(rows) + 1, dtype="int32") * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows, float).ravel()))


def turn(df: DataFrame, arrays: list[str], work: Callable, named: list[str], tile: int = TILE) -> DataFrame:
    """Rows (profile_id, n, place, arrays) become rows (profile_id, n, place, named) of the arrays' index.

    ``n`` is the number of rows of the profile, and ``place`` tells their order. All
    arrays of a profile have one length, m; it is the new ``n``. ``work`` gets some
    places of the arrays' index, m, and for each of ``arrays`` a matrix with a row
    for each of these places; it gives a matrix of each of ``named``.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.asarray(batch.column(0).to_pylist(), object)
            n, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            sizes = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            out: list[list] = [[] for _ in range(6 + len(arrays))]
            for name, m in dict.fromkeys(zip(names.tolist(), sizes.tolist())):
                if not m == m:  # null arrays
                    continue
                at = np.flatnonzero((names == name) & (sizes == m))
                matrices = [floats(batch.column(3 + i).take(pa.array(at))).reshape(len(at), int(m)) for i in range(len(arrays))]
                width = max(1, tile // int(n[at[0]]))
                for block, first in enumerate(range(0, int(m), width)):
                    parts = [x[:, first : first + width].ravel() for x in matrices]
                    for column, value in zip(out, [name, int(m), block, first, len(at), place[at].astype("int32"), *parts]):
                        column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), *[pa.list_(pa.float64())] * len(arrays)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["profile_id", "m", "block", "first", "rows", "places", *arrays])

    def meet(table: pa.Table) -> pa.Table:
        name, m, first = (table.column(c)[0].as_py() for c in ("profile_id", "m", "first"))
        if pc.max(table.column("m")).as_py() != m or pc.min(table.column("m")).as_py() != m:
            raise ValueError(f"the arrays of {name} have different lengths")
        rows = table.column("rows").to_numpy()
        order = np.argsort(table.column("places").combine_chunks().flatten().to_numpy(), kind="stable")
        matrices = []
        for c in arrays:
            flat = floats(table.column(c))
            width = len(flat) // rows.sum()
            ends = np.cumsum(rows * width)
            matrices.append(np.vstack([flat[e - r * width : e].reshape(r, width) for r, e in zip(rows, ends)])[order].T)
        places = np.arange(first, first + width)
        made = work(places, m, *matrices)
        return pa.table([pa.array([name] * width), pa.array([m] * width, pa.int64()), pa.array(places, pa.int32()), *map(lists, made)], names=["profile_id", "n", "place", *named])

    rows = df.select("profile_id", "n", "place", *arrays)
    pieces = rows.mapInArrow(cut, "profile_id string, m long, block int, first int, rows int, places array<int>, " + ", ".join(f"`{c}` array<double>" for c in arrays))
    return pieces.groupBy("profile_id", "block").applyInArrow(meet, "profile_id string, n long, place int, " + ", ".join(f"`{c}` array<double>" for c in named))
