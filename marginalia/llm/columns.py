"""Add what a function makes of each text to a table, in Arrow batches, beside all its other columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def add_struct(df: DataFrame, inputs: list[str], name: str, kind: T.StructType, make: Callable[[], Callable]) -> DataFrame:
    """``df`` with a struct column ``name``.

    ``make()`` runs once in a task and gives a function that takes the ``inputs`` of a batch as
    lists and returns a dict of lists, one for each field of ``kind``.
    """
    arrow = to_arrow_type(kind)
    places = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = work(*[batch.column(i).to_pylist() for i in places])
            fields = [pa.array(made[f.name], f.type) for f in arrow]
            struct = pa.StructArray.from_arrays(fields, fields=list(arrow))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))
