"""Running sums and quantiles over a whole table in order, without one task for all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rows import attach
from tidemark.session import stored

LEAST_BUCKETS = 64


def buckets_of(df: DataFrame) -> int:
    """Ranges that a table is parted into: as many as the session makes parts of a shuffle, which is set by the data's size."""
    return max(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sums_before(df: DataFrame, order: str, sums: list[str], *, descending: bool = False, buckets: int | None = None) -> DataFrame:
    """Adds ``<c>_before``, the sum of each column over the rows strictly before a row. ``order`` is numeric and distinct,
    as in a table of value counts.

    The table is written once, as three steps read it. Rows are parted by approximate quantiles into at most ``buckets``
    ranges; the ranges' totals are a handful of rows, and running sums are taken within each range.
    """
    buckets, df = buckets or buckets_of(df), stored(df)
    key = F.col(order).cast("double")
    edges = df.agg(F.percentile_approx(key, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), max(1000, 4 * buckets)).alias("__edges"))
    placed = attach(df, edges).withColumn("__b", F.size(F.filter("__edges", lambda e: e < key))).drop("__edges")
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    across = Window.orderBy(way("__b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])  # at most `buckets` rows
    offsets = totals.select("__b", *[F.coalesce(F.sum(f"__t_{c}").over(across), F.lit(0)).alias(f"__o_{c}") for c in sums])
    within = Window.partitionBy("__b").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offsets), "__b")
    return out.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"__o_{c}") for c in sums}).drop("__b", *[f"__o_{c}" for c in sums])


def quantiles(df: DataFrame, values: dict[str, Column], fractions: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, metric, n, n_distinct, q): for each group and named value the interpolated quantiles, exact, as an array of doubles.

    The quantile f of n values lies at place f (n - 1), between its neighbours by distance. Nulls are left out; a group
    without values has no row. Values are counted, and the counts parted by group and range of values, so that no task
    holds a group's values; only the totals of the ranges are brought together.
    """
    by = by or []
    return counted_quantiles(value_counts(df, values, by), fractions, by)


def value_counts(df: DataFrame, values: dict[str, Column], by: list[str]) -> DataFrame:
    """(g, v, k): how often each value v occurs by group g, a struct of ``by`` and the value's name ``metric``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("v")) for m, c in values.items()])).alias("p")
    group = F.struct(*[F.col(b) for b in by], F.col("p.metric").alias("metric"))  # structs compare with their nulls
    return df.select(*by, pairs).select(group.alias("g"), F.col("p.v").alias("v")).filter("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("k"))


def counted_quantiles(counts: DataFrame, fractions: list[float], by: list[str]) -> DataFrame:
    """The ``quantiles`` of ``value_counts``, which are written once, as three steps read them."""
    counts, buckets = stored(counts), buckets_of(counts)
    cuts = F.percentile_approx("v", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), max(1000, 4 * buckets))
    edges = counts.groupBy(F.col("g.metric").alias("metric")).agg(cuts.alias("e"))  # a row per metric
    placed = counts.withColumn("metric", F.col("g.metric")).join(F.broadcast(edges), "metric").select("g", "v", "k", F.size(F.filter("e", lambda e: e < F.col("v"))).alias("b"))
    totals = placed.groupBy("g", "b").agg(F.sum("k").alias("t"), F.count(F.lit(1)).alias("d"))
    whole = Window.partitionBy("g")
    offsets = totals.select("g", "b", "t", F.coalesce(F.sum("t").over(whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"), F.sum("t").over(whole).alias("n"), F.sum("d").over(whole).alias("n_distinct"))
    within = Window.partitionBy("g", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    place = [F.lit(float(f)) * (F.col("n") - 1) for f in fractions]
    holds = lambda first, end: reduce(Column.__or__, [(first <= F.ceil(p)) & (end > F.floor(p)) for p in place])
    asked = offsets.filter(holds(F.col("o"), F.col("o") + F.col("t"))).drop("t")  # only ranges that hold a wanted place go on
    run = placed.join(asked if by else F.broadcast(asked), ["g", "b"]).withColumn("before", F.coalesce(F.sum("k").over(within), F.lit(0)) + F.col("o"))
    after = F.col("before") + F.col("k")
    touched = holds(F.col("before"), after)
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < after), F.col("v")))
    found = run.filter(touched).groupBy("g", "n", "n_distinct").agg(*[at(F.floor(p)).alias(f"lo{i}") for i, p in enumerate(place)], *[at(F.ceil(p)).alias(f"hi{i}") for i, p in enumerate(place)])
    between = [F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise((F.ceil(p) - p) * F.col(f"lo{i}") + (p - F.floor(p)) * F.col(f"hi{i}")) for i, p in enumerate(place)]
    return found.select(*[F.col(f"g.{b}").alias(b) for b in by], F.col("g.metric").alias("metric"), "n", "n_distinct", F.array(*between).alias("q"))


def quantile_row(df: DataFrame, values: dict[str, Column], fractions: list[float]) -> DataFrame:
    """One row with the ``quantiles`` of each named value: q_<name>, n_<name> and d_<name>, the number of distinct values; nulls
    and zeros without values."""
    rows = quantiles(df, values, fractions)
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return rows.agg(*[x for m in values for x in (of(m, "q").alias(f"q_{m}"), F.coalesce(of(m, "n"), F.lit(0)).alias(f"n_{m}"), F.coalesce(of(m, "n_distinct"), F.lit(0)).alias(f"d_{m}"))])
