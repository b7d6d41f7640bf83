"""Tables of other names into the engine's columns: renames, required columns, null checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns each kind of table must have.
KINDS = {
    "periods": ("customer_id", "period_start", "period_end", "total_orders", "total_spend", "total_margin", "total_quantity"),
    "rfm": ("customer_id", "recency_days", "frequency", "monetary", "total_spend"),
    "orders": ("order_id", "customer_id", "order_ts", "total_spend", "total_margin", "total_quantity"),
}


def adapt(df: DataFrame, kind: str, renames: dict[str, str] | None = None) -> DataFrame:
    """The table with its columns renamed (from -> to), required ones first. A missing column raises; rows with a null in a
    required column are kept and found by ``null_counts``."""
    out = df.withColumnsRenamed(renames or {})
    if lacking := [c for c in KINDS[kind] if c not in out.columns]:
        raise ValueError(f"a table of {kind} lacks {lacking}")
    return out.select(*KINDS[kind], *[c for c in out.columns if c not in KINDS[kind]])


def null_counts(df: DataFrame, kind: str) -> DataFrame:
    """(column, nulls) of the required columns, in one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in KINDS[kind]])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in KINDS[kind]])).alias("p")).select("p.*")
