"""Values of a single row beside every row of a table, without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one: DataFrame, *more: DataFrame) -> DataFrame:
    """``df`` with the columns of ``one``, an aggregate of exactly one row, as constants: a scalar subquery that runs once.

    Further single rows are attached in turn.
    """
    for i, row in enumerate((one, *more)):
        name = f"__row{i}"
        df = df.withColumn(name, row.select(F.struct(*row.columns)).scalar()).select("*", f"{name}.*").drop(name)
    return df
