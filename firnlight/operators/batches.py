"""Numpy on arrays of many rows at a time, where the rows lie."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_arrays(df: DataFrame, arrays: list[str], work: Callable, *scalars: str, **named: str) -> DataFrame:
    """Replace the columns ``arrays`` by arrays made from them, in Arrow batches; nothing is shuffled.

    ``work`` gets a (rows x length) matrix of each column, and a vector of each of
    ``scalars``, and returns a tuple of matrices. ``named``: the new columns and the
    kinds of their elements, in the order of the tuple. The arrays of a row have one
    length, and rows of equal length go together; nulls among the elements count as
    zero, and a null array gives null.
    """
    keep = [c for c in df.columns if c not in arrays]
    picked = df.select(*keep, *arrays)
    schema = StructType([*picked.schema.fields[: len(keep)], *StructType.fromDDL(", ".join(f"{n} array<{k}>" for n, k in named.items())).fields])
    places = [keep.index(s) for s in scalars]

    def run(batches):
        for batch in batches:
            columns = [batch.column(len(keep) + i) for i in range(len(arrays))]
            sizes = np.nan_to_num(pc.list_value_length(columns[0]).to_numpy(zero_copy_only=False), nan=-1).astype(int)
            out: list[list] = [[None] * batch.num_rows for _ in named]
            for n in np.unique(sizes[sizes >= 0]):
                at = np.flatnonzero(sizes == n)
                some = pa.array(at)
                matrices = [np.nan_to_num(c.take(some).flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(at), n) for c in columns]
                made = work(*matrices, *[batch.column(p).take(some).to_numpy(zero_copy_only=False) for p in places])
                for column, matrix in zip(out, made):
                    for i, row in zip(at.tolist(), matrix):
                        column[i] = row
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c, pa.list_(pa.float64())) for c in out], names=[*keep, *named])

    return picked.mapInArrow(run, schema)
