"""Kernels that find any number of rows in a text: rows straight from Arrow batches, never a list of structs per text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: rows that a task holds as Python objects before it hands them on
ROWS = 8192


def flat(df: DataFrame, carried: list[str], texts: list[str], kernel: Callable[[], Callable[..., Iterable[tuple]]], found: T.StructType) -> DataFrame:
    """The columns to be carried and those found, a row for each tuple that the kernel gives for a row's texts (null as empty).

    kernel: called once per task, gives the function of the texts. A task holds the tuples of one row, or ``ROWS`` of them if that is more.
    """
    df = df.select(*carried, *texts)
    schema = T.StructType([*(df.schema[c] for c in carried), *found])
    rows_at_once = ROWS

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        each, own = kernel(), to_arrow_schema(found)

        def made(batch, rows, origin):
            columns = [batch.column(k).take(pa.array(origin, pa.int32())) for k in range(len(carried))]
            columns += [pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), own, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            rows, origin = [], []
            for i in range(batch.num_rows):
                more = list(each(*[batch.column(len(carried) + k)[i].as_py() or "" for k in range(len(texts))]))
                for at in range(0, len(more), rows_at_once):
                    part = more[at : at + rows_at_once]
                    rows += part
                    origin += [i] * len(part)
                    if len(rows) >= rows_at_once:
                        yield made(batch, rows, origin)
                        rows, origin = [], []
            if rows:
                yield made(batch, rows, origin)

    return df.mapInArrow(run, schema)
