"""Feature store reads and writes over bitemporal values, and computed features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import elapsed_us

TYPES = ("STRING", "INTEGER", "FLOAT", "BOOLEAN", "TIMESTAMP", "JSON")


def valid_at(values: DataFrame, at: Column) -> DataFrame:
    return values.filter((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (at < F.col("valid_until"))))


def read_asof(requested: DataFrame, values: DataFrame, features: list[str], at: Column) -> DataFrame:
    """One row per requested entity with a column per feature: the valid value of the latest created_at, absent ones null.
    Of equal created_at the smallest value_id counts, the one that was written first. Values are JSON texts."""
    order = F.struct("created_at", (-F.col("value_id")).alias("o"))
    cells = [F.max_by(F.when(F.col("feature_name") == f, F.col("value")), F.when(F.col("feature_name") == f, order)).alias(f) for f in features]
    wide = valid_at(values, at).filter(F.col("feature_name").isin(features)).groupBy("entity_id").agg(*cells)
    return requested.select("entity_id").join(wide, "entity_id", "left")


def read_latest(values: DataFrame, at: Column, ts: str = "created_at") -> DataFrame:
    """The latest value at or before a time per (feature, entity); ties go to the larger value_id."""
    rest = [c for c in values.columns if c not in ("feature_name", "entity_id")]
    last = F.max_by(F.struct(*rest), F.struct(ts, "value_id")).alias("r")  # an aggregate, so a hot entity needs no task of its own
    return values.filter(F.col(ts) <= at).groupBy("feature_name", "entity_id").agg(last).select("feature_name", "entity_id", "r.*")


def serve(entities: DataFrame, definitions: DataFrame, latest: DataFrame) -> DataFrame:
    """Values of every defined feature for the entities, the default where there is none; empty, zero and false defaults
    count as none. Definitions (feature_name, default_value) are few."""
    default = F.when(~F.coalesce("default_value", F.lit("")).isin("", "0", "0.0", "false", '""'), F.col("default_value"))
    grid = entities.select("entity_id", F.explode(F.array(*[F.lit(r["feature_name"]) for r in definitions.select("feature_name").collect()])).alias("feature_name"))
    out = grid.join(latest.select("feature_name", "entity_id", "value"), ["feature_name", "entity_id"], "left").join(definitions, "feature_name")
    return out.select("entity_id", "feature_name", F.coalesce("value", default).alias("value"))


def violations(values: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """(value_id, violation) against rules by feature: type, min, max, allowed. SQL null and JSON null break no rule."""
    checks = []
    bare = F.trim(F.col("value"), F.lit('"'))
    number = bare.try_cast("double")
    for feature, rule in rules.items():
        mine = (F.col("feature_name") == feature) & F.col("value").isNotNull() & (F.col("value") != "null")
        kind = rule.get("type")
        if kind in ("INTEGER", "FLOAT"):
            checks.append(F.when(mine & number.isNull(), F.lit("not a number")))
        if kind == "INTEGER":
            checks.append(F.when(mine & (number != F.floor(number)), F.lit("not an integer")))
        if kind == "BOOLEAN":
            checks.append(F.when(mine & ~F.col("value").isin("true", "false"), F.lit("not a boolean")))
        if "min" in rule:
            checks.append(F.when(mine & (number < rule["min"]), F.lit("below the minimum")))
        if "max" in rule:
            checks.append(F.when(mine & (number > rule["max"]), F.lit("above the maximum")))
        if "allowed" in rule:
            checks.append(F.when(mine & ~bare.isin(list(rule["allowed"])), F.lit("not allowed")))
    found = F.filter(F.array(*checks), lambda v: v.isNotNull()) if checks else F.array().cast("array<string>")
    return values.select("value_id", F.explode(found).alias("violation"))


def write_values(values: DataFrame, path: str, rules: dict[str, dict] | None = None) -> DataFrame:
    """Appends the values that break no rule, as parquet by feature, and returns those that do."""
    bad = violations(values, rules or {})
    values.join(bad.select("value_id").distinct(), "value_id", "left_anti").write.mode("append").partitionBy("feature_name").parquet(path)
    return bad


def discover(definitions: DataFrame, text: str = "", tags: list[str] | None = None) -> DataFrame:
    """Definitions whose name or description holds the text, and all the tags."""
    hit = F.lower(F.concat_ws(" ", *[c for c in ("feature_name", "description") if c in definitions.columns])).contains(text.lower())
    for t in tags or []:
        hit = hit & F.array_contains("tags", t)
    return definitions.filter(hit)


def store_stats(values: DataFrame, now: Column) -> DataFrame:
    """Per feature: values, entities, and those that became known within the last day."""
    return values.groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("entities"), F.count_if((F.col("created_at") > now - F.expr("INTERVAL 1 DAY")) & (F.col("created_at") <= now)).alias("recent"))


# ---------------------------------------------------------------- computed features


def session_minutes(start: Column, end: Column) -> Column:
    return elapsed_us(end, start) / F.lit(60_000_000.0)


def popularity(views: Column, rating: Column) -> Column:
    return F.lit(0.7) * views + F.lit(3) * rating


def affinity(category: Column, preferred: Column) -> Column:
    return F.when(category == preferred, F.lit(1.0)).otherwise(F.lit(0.3))


def compute(df: DataFrame, computers: dict[str, tuple[tuple[str, ...], Column]]) -> DataFrame:
    """Adds computed features in the order of their dependencies; a cycle raises."""
    done, left = set(df.columns), dict(computers)
    while left:
        ready = [n for n, (needs, _) in left.items() if set(needs) <= done]
        if not ready:
            raise ValueError(f"unmet or circular dependencies: {sorted(left)}")
        df = df.withColumns({n: left.pop(n)[1] for n in ready})
        done |= set(ready)
    return df
