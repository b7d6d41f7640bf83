"""Line items to orders to the customer x period mart, with staged HALF_UP rounding to cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rows import attach

MONEY = "decimal(18,2)"
GRANULARITIES = ("month", "quarter", "year")
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def current_lines(lines: DataFrame) -> DataFrame:
    """One row per (order_id, line_no): the one that came in last; copies count once."""
    rest = [c for c in lines.columns if c not in ("order_id", "line_no", "ingested_at")]
    return lines.groupBy("order_id", "line_no").agg(F.max(F.struct("ingested_at", *rest)).alias("r")).select("order_id", "line_no", "r.*")


def derive_lines(lines: DataFrame) -> DataFrame:
    """Adds ts, qty, price, line_total and line_margin to raw lines.

    ts is event_ts, else order_ts. A missing quantity column counts as 1, a null quantity as 0; missing and null prices
    as 0. line_total is the given one, else price * quantity; line_margin the given one, else (unit_margin, or price less
    unit_cost, a missing cost being 0) * quantity. A null in an optional column counts as absent.
    """
    have = set(lines.columns)
    given = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    qty = F.coalesce(given("quantity", "int"), F.lit(0)) if "quantity" in have else F.lit(1)
    price = F.coalesce(given("unit_price", MONEY), F.lit(0).cast(MONEY))
    margin = F.coalesce(given("unit_margin", MONEY), (price - F.coalesce(given("unit_cost", MONEY), F.lit(0).cast(MONEY))).cast(MONEY))
    total = F.coalesce(given("line_total", "decimal(28,4)"), (price * qty).cast("decimal(28,4)"))
    return lines.withColumns({
        "ts": F.coalesce(given("event_ts", "timestamp_ntz"), given("order_ts", "timestamp_ntz")), "qty": qty.cast("int"), "price": price, "line_total": total,
        "line_margin": F.coalesce(given("line_margin", "decimal(28,4)"), (margin * qty).cast("decimal(28,4)")),
    })


def violations(derived: DataFrame) -> Column:
    """The rules a derived line breaks, as an array of names."""
    rules = {"order_id missing": F.col("order_id").isNull(), "customer_id missing": F.col("customer_id").isNull(), "time missing": F.col("ts").isNull(), "negative quantity": F.col("qty") < 0, "negative price": F.col("price") < 0, "negative total": F.col("line_total") < 0}
    if "unit_cost" in derived.columns:
        rules["negative cost"] = F.col("unit_cost") < 0
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda r: r.isNotNull())


def valid_lines(lines: DataFrame) -> DataFrame:
    derived = derive_lines(lines)
    return derived.filter(F.size(violations(derived)) == 0)


def aggregate_orders(lines: DataFrame) -> DataFrame:
    """One row per order_id. The customer is that of the first line; a null product counts as an empty one, which is not counted."""
    money = lambda c: F.round(F.sum(c), 2).cast(MONEY)
    return lines.groupBy("order_id").agg(
        F.min_by("customer_id", F.struct("line_no", "customer_id")).alias("customer_id"), F.min("ts").alias("order_ts"), F.min("ts").alias("first_item_ts"), F.max("ts").alias("last_item_ts"),
        money("line_total").alias("total_spend"), money("line_margin").alias("total_margin"), F.sum("qty").alias("total_quantity"), F.count_distinct(F.nullif("product_id", F.lit(""))).alias("distinct_products"),
    )


def period_start(ts: Column, granularity: str) -> Column:
    return F.date_trunc(granularity, ts).cast("timestamp_ntz")


def period_end(start: Column, granularity: str) -> Column:
    """The exclusive end."""
    return (start + F.make_interval(months=F.lit(MONTHS[granularity]))).cast("timestamp_ntz")


def aggregate_periods(orders: DataFrame, granularities: tuple[str, ...] = ("month",)) -> DataFrame:
    """Sums of rounded orders by granularity, customer and the period of order_ts; all granularities in one pass."""
    spans = F.explode(F.array(*[F.struct(F.lit(g).alias("granularity"), period_start(F.col("order_ts"), g).alias("period_start"), period_end(period_start(F.col("order_ts"), g), g).alias("period_end")) for g in granularities])).alias("p")
    return orders.select("*", spans).groupBy("p.granularity", "customer_id", "p.period_start", "p.period_end").agg(
        F.count(F.lit(1)).alias("total_orders"), F.round(F.sum("total_spend"), 2).cast(MONEY).alias("total_spend"), F.round(F.sum("total_margin"), 2).cast(MONEY).alias("total_margin"),
        F.sum("total_quantity").alias("total_quantity"), F.max("order_ts").alias("last_transaction_ts"),
    )


def until(lines: DataFrame, cut_off: Column) -> DataFrame:
    """Raw lines up to a time, by order_ts before event_ts (the mart itself prefers event_ts)."""
    times = [F.col(c) for c in ("order_ts", "event_ts") if c in lines.columns]
    return lines.filter(F.coalesce(*times) <= cut_off)


def mart_summary(orders: DataFrame, periods: DataFrame) -> DataFrame:
    a = orders.agg(F.count(F.lit(1)).alias("order_count"))
    b = periods.agg(F.count(F.lit(1)).alias("period_count"), F.count_distinct("customer_id").alias("customer_count"), F.min("period_start").alias("first_period"), F.max("period_start").alias("last_period"))
    return attach(a, b)


def mart_json(orders: DataFrame, periods: DataFrame) -> DataFrame:
    """The mart as JSON rows with ISO timestamps: kind ``orders`` or ``periods_<granularity>``."""
    iso = lambda df: df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c, t in df.dtypes if t.startswith("timestamp")})
    as_json = lambda df: F.to_json(F.struct(*df.columns)).alias("json")
    o, p = iso(orders), iso(periods)
    return o.select(F.lit("orders").alias("kind"), as_json(o)).union(p.select(F.concat(F.lit("periods_"), "granularity"), as_json(p.drop("granularity"))))
