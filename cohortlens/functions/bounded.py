"""Small aggregates as broadcasts, once their size is known."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(table: DataFrame, most: int = 10_000) -> DataFrame:
    """An aggregate of at most `most` rows as a broadcast; a larger one is left to the planner.

    At most `most` + 1 rows reach the driver, so the rows aren't computed a second time."""
    rows = table.limit(most + 1).collect()
    return table if len(rows) > most else F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))
