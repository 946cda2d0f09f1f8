"""Adding columns that Python computes from a text column, Arrow batch by Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.names import col, cols
from siltstone.runtime import ship

#: Rows of a batch that are worked on at once.
ROWS = 1024


def add_columns(docs: DataFrame, inputs: list[str | Column], make: Callable[..., list[pa.Array]], fields: str, *, drop: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """``docs`` with the columns ``fields`` (a DDL string) that ``make`` computes from slices of the columns ``inputs``, which are
    names or expressions.

    Columns of ``docs`` with the names of ``fields``, in any letter case, are replaced. Those named in ``drop`` don't come
    back from Python.
    """
    ship(docs.sparkSession)
    added = T.StructType.fromDDL(fields)
    gone = {n.lower() for n in (*added.names, *drop)}
    kept = [f for f in docs.schema.fields if f.name.lower() not in gone]
    n = len(kept)
    # Python sees plain names; the caller's, which may need quoting, come back at the end.
    given = [*cols(f.name for f in kept), *[col(c) if isinstance(c, str) else c for c in inputs]]
    source = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(given)])
    made = [T.StructField(f"m{i}", f.dataType, f.nullable) for i, f in enumerate(added.fields)]
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(kept)], *made])
    plain = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *make(*part.columns[n:])], plain)

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(name).alias(f.name) for name, f in zip(plain, [*kept, *added.fields], strict=True)])


def as_bytes(column: pa.Array) -> list[bytes]:
    """The rows' UTF-8 bytes; null is empty."""
    return [v or b"" for v in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [v or "" for v in column.to_pylist()]
