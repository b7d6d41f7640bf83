"""Event-time windows, the same for batch and stream. Windows are half open, aligned to the epoch in UTC; sessions merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATENESS = "10 seconds"


def numeric(value: Column) -> Column:
    """A number from a JSON value: texts that aren't numbers are null, true and false are 1 and 0."""
    t = value.cast("string")
    return F.coalesce(F.when(t == "true", F.lit(1.0)).when(t == "false", F.lit(0.0)), t.try_cast("double"))


def aggregates(value: Column, ts: str, exact: bool = True, percent: float = 95.0, streaming: bool = False) -> list[Column]:
    """COUNT SUM AVG MIN MAX DISTINCT_COUNT PERCENTILE FIRST LAST of a value; an empty sum and mean are 0.

    ``exact`` counts distinct values and takes the percentile at sorted[min(int(n p / 100), n - 1)]; else sketches.
    """
    v = numeric(value)
    first, last = (F.min_by(value, F.col(ts)), F.max_by(value, F.col(ts)))
    base = [F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.coalesce(F.avg(v), F.lit(0.0)).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), first.alias("first"), last.alias("last")]
    if not exact or streaming:
        return [*base, F.approx_count_distinct(value).alias("distinct_count"), F.percentile_approx(v, percent / 100).alias("percentile")]
    s = F.sort_array(F.collect_list(v))
    place = F.least(F.floor(F.size(s) * percent / 100) + 1, F.size(s)).cast("int")
    return [*base, F.count_distinct(value).alias("distinct_count"), F.when(F.size(s) > 0, F.try_element_at(s, F.greatest(place, F.lit(1)))).alias("percentile")]


def windowed(df: DataFrame, ts: str, window: Column, keys: list[str], columns: list[Column]) -> DataFrame:
    """Aggregates per window and key; a stream gets a watermark of the allowed lateness and emits closed windows only."""
    source = df.withWatermark(ts, LATENESS) if df.isStreaming else df
    out = source.groupBy(window.alias("w"), *keys).agg(*columns)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], columns: list[Column]) -> DataFrame:
    return windowed(df, ts, F.window(ts, size), keys, columns)


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], columns: list[Column]) -> DataFrame:
    return windowed(df, ts, F.window(ts, size, slide), keys, columns)


def session(df: DataFrame, ts: str, keys: list[str], columns: list[Column], gap: str = "300 seconds") -> DataFrame:
    return windowed(df, ts, F.session_window(ts, gap), keys, columns)


def overall(df: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """The one global window (complete mode in a stream)."""
    return df.groupBy(*keys).agg(*columns)


def scorer(load: Callable[[], Callable[[pd.DataFrame], pd.Series]]) -> Callable:
    """A Pandas UDF over a struct of features whose model each worker loads once."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load()
        for features in batches:
            yield model(features)

    return score


def breaches(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, ts, value, breached) of rules (rule, metric, op, threshold) over rows (metric, ts, value); equality within 0.001."""
    v, t = F.col("value"), F.col("threshold")
    near = F.abs(v - t) < 0.001
    hit = F.when(F.col("op") == "greater_than", v > t).when(F.col("op") == "less_than", v < t).when(F.col("op") == "equals", near).when(F.col("op") == "not_equals", ~near)
    return metrics.join(rules, "metric").select("rule", "ts", "value", hit.alias("breached"))


def alert_changes(breached: DataFrame) -> DataFrame:
    """Rows at which a rule's state turns: triggered or resolved, by time. A rule is followed day by day, each day after the last
    state of the one before, so that no task holds all rows of a rule."""
    dated = breached.withColumn("__day", F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date")))
    ends = dated.groupBy("rule", "__day").agg(F.max_by("breached", "ts").alias("__end"))  # a row for each rule and day
    carried = ends.select("rule", "__day", F.lag("__end").over(Window.partitionBy("rule").orderBy("__day")).alias("__carried"))
    of_day = Window.partitionBy("rule", "__day").orderBy("ts")
    first = F.row_number().over(of_day) == 1
    before = F.coalesce(F.when(first, F.col("__carried")).otherwise(F.lag("breached").over(of_day)), F.lit(False))
    return dated.join(carried, ["rule", "__day"]).withColumn("before", before).filter("breached <> before").select("rule", "ts", "value", F.when(F.col("breached"), "triggered").otherwise("resolved").alias("state"))


def utilisation(cpu: Column, memory: Column, throughput: Column, lag: Column, queue: Column) -> Column:
    return F.lit(0.4) * F.greatest(cpu, memory) + F.lit(0.3) * throughput / 10_000 + F.lit(0.2) * lag / 1_000 + F.lit(0.1) * queue / 100
