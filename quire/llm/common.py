"""What the operators of this package share: tables and Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.scratch import forget, saved

__all__ = ["add_columns", "blocks", "forget", "saved", "table"]

#: Text that a mapping task holds at once, in bytes. Only the memory depends on it, never a result.
BLOCK_BYTES = 12 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that one column's strings, bytes or lists in a block have `most` bytes or are a single row."""
    for batch in batches:
        if batch.nbytes <= most:
            if batch.num_rows:
                yield batch
            continue
        values = batch.column(column)
        length = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        start, size = 0, 0
        for i, n in enumerate(pc.fill_null(length, 0).to_pylist()):
            n *= 4 if pa.types.is_list(values.type) else 1
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def add_columns(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[list], list], most: int = BLOCK_BYTES, arrow: bool = False) -> DataFrame:
    """df with further columns that make derives from the list of one column's values, block by block, in Arrow.

    A column of df that has the name of a new one is replaced. make returns one Arrow array or list for each field; with
    arrow it gets the values as an Arrow array.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names or f.name == column]
    out = T.StructType([f for f in kept if f.name not in names] + fields)
    types = [to_arrow_type(f.dataType) for f in fields]
    carry = [f.name for f in kept if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, column, most):
            made = make(block.column(column) if arrow else block.column(column).to_pylist())
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in carry), *arrays], names=[*carry, *(f.name for f in fields)])

    return df.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, out)
