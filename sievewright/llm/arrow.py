"""Small helpers to run array kernels over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Run `kernel` on each Arrow batch of `df`; it yields columns, which are cast to `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for columns in kernel(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def values(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signed(x: np.ndarray) -> np.ndarray:
    """The bit pattern of an unsigned hash as bigint."""
    return x.view(np.int64)


def list_column(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat, type=kind))
