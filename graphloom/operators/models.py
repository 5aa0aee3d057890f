"""Calls of a model in the executors, batch by batch, where a failure costs the rows that fail and nothing else."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A Pandas batch to its new columns, a row for each row.
Ask = Callable[[pd.DataFrame], pd.DataFrame]
#: One row and the error it raised to the values that stand in for its answer.
Fallback = Callable[[Mapping[str, object], Exception], Mapping[str, object]]


def _columns(batch: pa.RecordBatch, made: pa.Schema, ask: Ask) -> list[pa.Array]:
    answers = ask(batch.to_pandas())
    if len(answers) != batch.num_rows:
        raise ValueError(f"{len(answers)} answers to {batch.num_rows} rows")
    return [pa.Array.from_pandas(answers[f.name], type=f.type) for f in made]


def _answered(batch: pa.RecordBatch, made: pa.Schema, ask: Ask, fallback: Fallback) -> Iterator[list[pa.Array]]:
    """The new columns of a batch in parts: whole, or row by row where the batch as a whole raises."""
    try:
        yield _columns(batch, made, ask)
    except Exception as error:  # noqa: BLE001 - a model's failure must not stop the batch
        if batch.num_rows == 1:
            values = fallback(batch.to_pylist()[0], error)
            yield [pa.array([values[f.name]], f.type) for f in made]
            return
        for i in range(batch.num_rows):
            yield from _answered(batch.slice(i, 1), made, ask, fallback)


def in_batches(rows: DataFrame, ask: Ask, made: str, fallback: Fallback) -> DataFrame:
    """`rows` with the columns `made` (as DDL) that `ask` answers in the executors.

    Where a batch raises, or answers with other columns, types or numbers of rows, its rows are asked one by one; those that
    raise again take `fallback`. A column of `rows` that has the name of an answer gives way to it. Batches are Arrow's.
    """
    new = StructType.fromDDL(made)
    kept = rows.select(*[f"`{c}`" for c in rows.columns if c not in new.names])
    schema = StructType([*kept.schema.fields, *new.fields])
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for columns in _answered(batch, arrow, ask, fallback) if batch.num_rows else ():
                part = batch.slice(at, len(columns[0]))
                at += len(columns[0])
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *arrow.names])

    return kept.mapInArrow(run, schema)
