"""Per-entity feature table from events, over a store of cumulative daily counts and totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import micros

DAY_US = 86_400_000_000
MONEY = "decimal(38,2)"


def current_orders(orders: DataFrame) -> DataFrame:
    """One row per order_id: the one with the latest ingested_at.

    Equal ones are copies; if they differ after all, the greatest row by (order_ts, customer, event, spend)
    wins, so the result doesn't depend on row order. Rows without order_id are kept, exact copies once.
    """
    row = F.struct("ingested_at", "order_ts", "customer_id", "event_name", "total_spend")
    loose = F.when(F.col("order_id").isNull(), F.xxhash64("ingested_at", "order_ts", "customer_id", "event_name", "total_spend"))
    return orders.groupBy("order_id", loose.alias("loose")).agg(F.max(row).alias("r")).select("order_id", "r.*")


def cumulative_store(orders: DataFrame, *, entity: str = "customer_id", kind: str = "event_name", ts: str = "order_ts", amount: str = "total_spend") -> DataFrame:
    """(entity, kind, day, cum_n, cum_total, last_us): running counts and totals by entity, type and day.

    Days are whole days since the epoch. Rows without entity or time are left out; a null type is a type of
    its own; a null amount counts as an event without amount. Hot entities shrink to one row per type and day
    in the map-side aggregate, before anything is keyed by entity alone.
    """
    return _cumulated(_daily(orders, entity, kind, ts, amount))


def _daily(orders: DataFrame, entity: str, kind: str, ts: str, amount: str) -> DataFrame:
    return (
        orders.filter(F.col(entity).isNotNull() & F.col(ts).isNotNull())
        .select(F.col(entity).alias("entity"), F.col(kind).alias("kind"), micros(ts).alias("us"), F.col(amount).cast("decimal(18,2)").alias("amount"))
        .groupBy("entity", "kind", F.floor(F.col("us") / F.lit(DAY_US)).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("total"), F.max("us").alias("last_us"))
    )


def _cumulated(days: DataFrame) -> DataFrame:
    run = Window.partitionBy("entity", "kind").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.repartition("entity").select("entity", "kind", "day", F.sum("n").over(run).alias("cum_n"), F.sum("total").over(run).cast(MONEY).alias("cum_total"), "last_us")


def append_orders(store: DataFrame, orders: DataFrame, *, entity: str = "customer_id", kind: str = "event_name", ts: str = "order_ts", amount: str = "total_spend") -> DataFrame:
    """The store with further orders added, whatever their days: as if it had been built from all at once.

    Only pairs of entity and type that have new orders are taken apart into days and summed up again; the rest is passed on.
    Orders that the store holds already count twice. Rows without entity or time are left out.
    """
    fresh = _daily(orders, entity, kind, ts, amount)
    key = F.struct("entity", "kind")  # a null type equals itself
    touched = fresh.select(key.alias("key")).distinct()
    keyed = store.withColumn("key", key)
    old = Window.partitionBy("entity", "kind").orderBy("day")
    less = lambda c: F.col(c) - F.coalesce(F.lag(c).over(old), F.lit(0))
    days = keyed.join(touched, "key", "left_semi").select("entity", "kind", "day", less("cum_n").alias("n"), less("cum_total").cast(MONEY).alias("total"), "last_us")
    both = days.union(fresh).groupBy("entity", "kind", "day").agg(F.sum("n").alias("n"), F.sum("total").cast(MONEY).alias("total"), F.max("last_us").alias("last_us"))
    return keyed.join(touched, "key", "left_anti").drop("key").unionByName(_cumulated(both))


def event_features(store: DataFrame, as_of: dt.date, windows: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """One row per (entity, kind) as of the start of a day: count, days since the last event, total, and for each
    trailing window its count and total, by subtracting the cumulative values at the window's endpoints.

    Events on or after ``as_of`` are not seen. Days since are whole days from the last event to ``as_of``.
    """
    end = (as_of - dt.date(1970, 1, 1)).days
    before = lambda limit, value: F.max_by(F.when(F.col("day") < limit, F.col(value)), F.when(F.col("day") < limit, F.col("day")))
    ends = {"all": end} | {f"{w}d": end - w for w in windows}
    cells = [before(limit, f"cum_{v}").alias(f"{v}_{name}") for name, limit in ends.items() for v in ("n", "total")]
    last = F.max(F.when(F.col("day") < end, F.col("last_us"))).alias("last_us")
    at = store.groupBy("entity", "kind").agg(*cells, last).filter("n_all is not null")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    columns = [F.col("n_all").alias("count"), F.floor((F.lit(end * DAY_US) - F.col("last_us")) / F.lit(DAY_US)).cast("int").alias("days_since"), F.col("total_all").cast("decimal(28,2)").alias("total_spend")]
    for w in windows:
        columns += [(F.col("n_all") - zero(f"n_{w}d")).alias(f"count_{w}d"), (F.col("total_all") - zero(f"total_{w}d")).cast("decimal(28,2)").alias(f"total_spend_{w}d")]
    return at.select("entity", "kind", *columns)


def feature_table(features: DataFrame) -> DataFrame:
    """One row per entity with the features of all its event types, sorted by type (a null type first).

    The array holds one element per type, so its length is bounded by the number of types, not of events.
    """
    cells = [c for c in features.columns if c != "entity"]
    return features.groupBy("entity").agg(F.sum("count").alias("events"), F.count(F.lit(1)).alias("kinds"), F.min("days_since").alias("days_since"), F.sum("total_spend").cast("decimal(28,2)").alias("total_spend"), F.sort_array(F.collect_list(F.struct(*cells))).alias("features"))
