"""Python functions over Arrow batches, for what built-in expressions cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


ROWS = 2_000  # rows that are worked on at a time, which bounds a worker's memory whatever the session's batch size


def flat_map(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], list[tuple]]]) -> DataFrame:
    """``make`` builds, once per task, a function from a row (as a dict) to rows of the given schema.

    Nothing passes from row to row, so a lost task is simply run again. Only the columns that the function needs should be in ``df``.
    """

    def rows() -> Callable[[list[dict]], list[tuple]]:
        work = make()
        return lambda some: [out for row in some for out in work(row)]

    return flat_map_rows(df, schema, rows)


def flat_map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[list[dict]], list[tuple]]], rows: int = ROWS) -> DataFrame:
    """The same for a function from some rows at once, at most ``rows``."""
    struct = _parse_datatype_string(schema)
    if len(set(struct.names)) < len(struct.names):
        raise ValueError(f"columns with one name: {struct.names}")
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                if out := work(batch.slice(start, rows).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, struct)
