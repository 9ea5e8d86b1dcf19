"""Maps over texts in Arrow batches; carried columns pass through untouched, nulls included."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: texts -> (row each output comes from, or None for one each; the added columns)
Kernel = Callable[[list], tuple[Sequence[int] | None, list[pa.Array]]]

#: Characters handled at once.
SLICE = 500_000


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` characters, one row at least."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        length = len(t.as_buffer()) if t.is_valid else 0
        if size and size + length > most:
            yield start, k
            start, size = k, 0
        size += length
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, kernel: Kernel, added: str, most: int = SLICE) -> DataFrame:
    """df: carried columns and the text last.  added: schema of the columns that ``kernel`` makes of texts of about ``most`` characters."""
    carried = df.columns[:-1]
    schema = StructType([*df.schema.fields[:-1], *StructType.fromDDL(added).fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(len(carried)), most):
                part = batch.slice(start, end - start)
                index, made = kernel(part.column(len(carried)).to_pylist())
                kept = [part.column(k) if index is None else part.column(k).take(pa.array(index, pa.int64())) for k in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    return df.mapInArrow(run, schema)
