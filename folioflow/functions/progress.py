"""Watching a run: counts while rows pass, and a listener for issues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str = "progress", **metrics: Column) -> tuple[DataFrame, Observation]:
    """(the same rows, an observation that holds their number and the metrics once an action has run over them). Costs no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(k) for k, m in metrics.items())), seen


def notify(issues: DataFrame, listener: Callable[[], Callable[[Row], None]]) -> None:
    """Gives every issue to a listener that is built once per task. A task that is run again tells its issues again, so listeners go by the issues' keys."""

    def tell(rows) -> None:
        hear = listener()
        for row in rows:
            hear(row)

    issues.foreachPartition(tell)
