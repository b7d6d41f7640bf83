"""Rolling totals over trailing periods for each entity and calendar day."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

#: Rows of a task: few, so that its table of sums stays in a processor's cache; more where that would make too many tasks.
ROWS_PER_TASK, MANY_TASKS, MOST_ROWS_PER_TASK = 250_000, 20_000, 5_000_000


#: Columns of a period that tell rows apart; ``loaded_at`` comes first.
CELLS = ("loaded_at", "granularity", "period_start", "customer_id", "total_spend", "city", "source_system")


def current_periods(periods: DataFrame, cells: tuple[str, ...] = CELLS) -> DataFrame:
    """One row per period_id, with the given cells: the one with the latest loaded_at (equal ones are copies; should they
    differ, the greatest row wins, whatever the order). Rows without period_id are kept, exact copies once."""
    loose = F.when(F.col("period_id").isNull(), F.xxhash64(*CELLS))
    return periods.groupBy("period_id", loose.alias("loose")).agg(F.max(F.struct(*cells)).alias("r")).select("period_id", "r.*")


#: Sums of cents below this can't overflow a bigint.
MOST_CENTS = 2**62


def trailing_totals(daily: DataFrame, windows: tuple[int, ...] = (7, 30), *, entity: str = "customer_id", start: str = "period_start", amount: str = "total_spend") -> DataFrame:
    """(entity, day, total_<w>d, avg_<w>d): for every entity and every day of the table's calendar.

    The calendar runs from the first to the last day in the input. A window of w days ends with the day itself;
    the average is the total over w calendar days, days without activity counting as zero, rounded half away from zero to
    four places. Rows without entity or day are left out; null amounts count as zero, and an entity with only those has rows
    of zeros. Several rows of one entity and day add up.

    Each daily total is exploded onto the days it influences, and on to the day before the entity's next total, where it
    counts as the calendar's zero; the first also goes back to the calendar's start. Daily pre-aggregation bounds an entity
    to one row a day before rows are keyed by entity; explode and aggregate then need no further shuffle. Sums are of whole
    cents, unless the totals are so large that only decimals hold them.
    """
    day = F.to_date(F.col(start))
    clean = daily.filter(F.col(entity).isNotNull() & F.col(start).isNotNull()).select(F.col(entity).alias("entity"), day.alias("day"), F.col(amount).cast("decimal(18,2)").alias("amount"))
    days = clean.groupBy("entity", "day").agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(28,2)").alias("amount"))
    days = stored(days)  # read twice: for the calendar, and to explode
    low, high, entities, most = days.agg(F.min("day"), F.max("day"), F.approx_count_distinct("entity"), F.max(F.abs("amount"))).first()
    first, last = F.lit(low).cast("date"), F.lit(high).cast("date")
    # parts by the rows that come out, of which the few that go in give no idea
    rows_out = entities * ((high - low).days + 1) if entities else 0
    parts = max(int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MANY_TASKS, -(-rows_out // ROWS_PER_TASK)), -(-rows_out // MOST_ROWS_PER_TASK))
    in_cents = most is None or 400 * 100 * most * max(windows) < MOST_CENTS
    value, zero = (F.col("amount") * 100).cast("bigint") if in_cents else F.col("amount"), F.lit(0).cast("bigint" if in_cents else "decimal(28,2)")
    keyed = days.select("entity", "day", value.alias("amount")).repartition(parts, "entity")
    order = Window.partitionBy("entity").orderBy("day")
    before, after = F.lag("day").over(order), F.lead("day").over(order)
    reach = F.sequence(F.when(before.isNull(), F.datediff(first, "day")).otherwise(0), F.least(F.datediff(last, "day"), F.greatest(F.lit(max(windows) - 1), F.coalesce(F.datediff(after, "day") - 1, F.datediff(last, "day")))), F.lit(1))
    rows = keyed.select("entity", "amount", "day", reach.alias("reach")).select("entity", "amount", "day", F.explode("reach").alias("lag"))
    sums = [F.sum(F.when(F.col("lag").between(0, w - 1), F.col("amount")).otherwise(zero)).alias(f"s{w}") for w in windows]
    out = rows.groupBy("entity", F.date_add("day", F.col("lag")).alias("day")).agg(*sums)
    cents = lambda w: F.col(f"s{w}") if in_cents else (F.col(f"s{w}") * 100).cast("decimal(38,0)")
    total = lambda w: ((F.col(f"s{w}").cast("decimal(20,0)") * F.lit(Decimal("0.01"))) if in_cents else F.col(f"s{w}")).cast("decimal(28,2)")
    mean = lambda w: (F.call_function("div", cents(w) * F.lit(200) + F.signum(cents(w)).cast("bigint") * F.lit(w), F.lit(2 * w)) / F.lit(10000.0)).cast("double")
    return out.select(F.col("entity").alias(entity), "day", *[total(w).alias(f"total_{w}d") for w in windows], *[mean(w).alias(f"avg_{w}d") for w in windows])
