"""Keys that hold so many rows that one task must not get them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A list of more hot keys than this is not broadcast.
MOST_HOT_KEYS = 100_000


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int, name: str = "n_salts", most: int = MOST_HOT_KEYS) -> DataFrame:
    """(keys, n_salts) of each key with more than ``rows_per_task`` rows, so many to a part at most, whatever the table's size.

    The list carries a broadcast hint if it was counted to hold at most ``most`` keys; else it is joined by shuffle. Null
    keys never match a join and are left out. One pass over the table; without hot keys none follows.
    """
    alive = F.lit(True)
    for k in keys:
        alive = alive & F.col(k).isNotNull()
    hot = df.filter(alive).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows_per_task)
    out = hot.select(*keys, F.ceil(F.col("__n") / F.lit(rows_per_task)).cast("int").alias(name))
    some = out.limit(most + 1).toArrow()  # a bounded list
    if some.num_rows > most:
        return out
    return F.broadcast(df.sparkSession.createDataFrame(some, out.schema) if some.num_rows else df.sparkSession.createDataFrame([], out.schema))
