"""Running a Python function over the batches of a few columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.functions.lineage import cut_lineage  # noqa: F401 - the operators here take both from this module


ROWS = 2_000  # rows that are worked on at a time, which bounds a worker's memory whatever the session's batch size


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = ROWS) -> DataFrame:
    """``make`` builds, once per task, a function from a batch to ``{column: values}`` of the given schema.

    The batches hold at most ``rows`` whole rows and no state passes between them, so a lost task is simply run again.
    """
    struct: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                out = work(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)
