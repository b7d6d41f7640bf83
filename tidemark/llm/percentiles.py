"""Exact percentiles per group by bisection over mergeable value counts.

The mergeable partial is a table of (keys, value, n): partials of separate days or partitions combine by adding
n. Percentiles come from value intervals that are kept per group and percentile: each pass counts the rows below the
midpoint of every interval still open and keeps the half that holds the target rank, until the ranks are resolved.

Groups that fit in a task are bisected where they lie, all groups of a task at once, after one shuffle by group. A larger
group stays spread: a pass sends its intervals to the rows, cuts each into many sections at once instead of two, and
shuffles only the counts of the sections. The error is 0 when bisection runs to the end, and at most ``tolerance`` otherwise.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.skew import hot_keys
from tidemark.session import stored


def value_counts(df: DataFrame, keys: list[str], value: Column, where: str | None = None) -> DataFrame:
    """The mergeable partial: (keys, v, n) with v in the value's own type. Null values are left out; null keys form groups;
    NaN is a value above all others."""
    picked = df.filter(where) if where else df
    return picked.select(*keys, value.alias("v")).filter("v is not null").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up partials over the given (fewer, or coarser) keys."""
    return counts.groupBy(*keys, "v").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- groups that fit in a task


def _ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles: NaN above all, both zeros alike."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)


def _doubles(o: np.ndarray) -> np.ndarray:
    return np.where(o < 0, np.int64(-(2**63)) - o, o).view(np.float64)


def _sums(group: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount(group, counts, groups).astype(np.int64)  # exact: a task's rows stay far below 2**53


def bisect(v: np.ndarray, n: np.ndarray, starts: np.ndarray, probs: tuple[Decimal, ...], wide: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(totals, values): for groups that begin at ``starts`` in v (integers), the value of each percentile, one column each.

    ``wide`` says which intervals (low, high] are wider than tolerated.
    """
    sizes = np.diff(np.append(starts, len(v)))
    totals = np.add.reduceat(n, starts)
    values = np.empty((len(starts), len(probs)), np.int64)
    least, most = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
    for i, q in enumerate(probs):
        top, bottom = q.as_integer_ratio()
        whole, rest = np.divmod(totals, bottom)  # ceil(q * total) without overflow
        rank = np.maximum(whole * top + -(-(rest * top) // bottom), 1)
        low, high, rows, counts, begins = least.copy(), most.copy(), v, n, starts
        group = np.repeat(np.arange(len(starts)), sizes)
        open_ = wide(low, high)
        while open_.any():
            inside = open_[group] & (rows >= low[group]) & (rows <= high[group])
            if 2 * inside.sum() < len(rows):  # go on with what lies in open intervals; what is below was counted
                below = ~inside & open_[group] & (rows < low[group])
                rank = rank - _sums(group[below], counts[below], len(rank))
                rows, counts, group = rows[inside], counts[inside], group[inside]
            mid = (low & high) + ((low ^ high) >> 1)  # floor of the mean, without overflow
            under = rows <= mid[group]
            holds = _sums(group[under], counts[under], len(low)) >= rank
            high = np.where(open_ & holds, mid, high)
            low = np.where(open_ & ~holds, mid + 1, low)
            open_ = open_ & wide(low, high)
        values[:, i] = high
    return totals, values


#: Rows of a task that are bisected together; a larger group is still taken whole.
AT_ONCE = 500_000


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where each group begins in rows that are sorted by group. Nulls are alike, and so are NaNs."""
    changes = np.zeros(len(table), bool)
    changes[:1] = True
    for k in names:
        c = table.column(k)
        here, before = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.fill_null(pc.not_equal(here, before), False)
        if pa.types.is_floating(c.type):
            differ = pc.and_(differ, pc.invert(pc.fill_null(pc.and_(pc.is_nan(here), pc.is_nan(before)), False)))
        changes[1:] |= pc.or_(differ, pc.not_equal(pc.is_null(here), pc.is_null(before))).to_numpy()
    return np.flatnonzero(changes)


def _local(names: list[str], kind: str, probs: tuple[Decimal, ...], tolerance: float) -> Callable:
    def wide(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if not tolerance:
            return high > low
        a, b = (_doubles(low), _doubles(high)) if kind == "double" else (low, high)
        with np.errstate(invalid="ignore"):
            return (high > low) & ~(b - a.astype(np.float64) <= tolerance)

    def solved(table: pa.Table, starts: np.ndarray) -> pa.Table:
        v, n = (table.column(c).to_numpy() for c in ("v", "n"))
        totals, values = bisect(_ordered(v) if kind == "double" else v, n, starts, probs, wide)
        q, flat = len(probs), values.reshape(-1)
        place = pa.array(np.repeat(starts, q))
        columns = [*[table.column(k).take(place) for k in names], np.repeat(totals, q), np.tile(np.arange(q, dtype=np.int32), len(starts)), _doubles(flat) if kind == "double" else flat]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names=[*names, "total", "i", "v"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, wait = 0, AT_ONCE
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if not held or batch is not None and rows < wait:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table, names)
            end = len(table) if batch is None else int(starts[-1])  # the last group may go on
            if end:
                yield from solved(table.slice(0, end), starts[starts < end]).combine_chunks().to_batches()
            held = table.slice(end).to_batches()
            rows = len(table) - end
            wait = max(AT_ONCE, 2 * rows)

    return solve


def _transport(kind: T.DataType) -> tuple[str, Callable[[Column], Column], Callable[[Column], Column]] | None:
    """How values of a type go to numpy and back; None if they don't fit in 64 bits."""
    if isinstance(kind, T.DecimalType):
        up, down = F.lit(Decimal(10**kind.scale)), F.lit(Decimal(1).scaleb(-kind.scale))
        return ("bigint", lambda c: (c * up).cast("bigint"), lambda c: (c.cast("decimal(18,0)") * down).cast(kind)) if kind.precision <= 18 else None
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double", lambda c: c.cast("double"), lambda c: c.cast(kind)
    if isinstance(kind, T.IntegralType):
        return "bigint", lambda c: c.cast("bigint"), lambda c: c.cast(kind)
    raise TypeError(f"no percentiles of {kind.simpleString()}")


# ---------------------------------------------------------------- groups that stay spread


def _is_open(tolerance: float) -> Column:
    low, high = F.col("lo"), F.col("hi")
    return (high > low) & (F.lit(not tolerance) | (high.cast("double") - low.cast("double") > F.lit(float(tolerance))))


def _spread(data: DataFrame, names: list[str], probs: tuple[Decimal, ...], sections: int, tolerance: float, few: bool) -> DataFrame:
    """(names, total, i, v). ``few``: the groups are counted to be few enough to broadcast their intervals."""
    hint = F.broadcast if few else (lambda df: df)
    same = lambda a, b, keys: reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    qs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).cast("decimal(10,9)").alias("q")) for i, q in enumerate(probs)])).alias("p")
    groups = data.groupBy(*names).agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rank = F.greatest(F.ceil(F.col("p.q") * F.col("total")), F.lit(1)).cast("bigint").alias("rank")
    state = stored(groups.select(*names, "total", "lo", "hi", qs).select(*names, "total", F.col("p.i").alias("i"), rank, "lo", "hi"))
    kind = data.schema["v"].dataType.simpleString()
    done: list[DataFrame] = []
    while True:
        done.append(state.filter(~_is_open(tolerance)))
        active = state.filter(_is_open(tolerance))
        if active.isEmpty():
            break
        spans = active.select(*names, "lo", "hi").distinct()  # a group's intervals don't overlap
        inside = same("d", "s", names) & F.col("d.v").between(F.col("s.lo"), F.col("s.hi"))
        rows = data.alias("d").join(hint(spans).alias("s"), inside).select(*[f"d.{k}" for k in names], "d.v", "d.n", "s.lo", "s.hi")
        # the ends have sections of their own, so that every pass leaves less between them, whatever rounding does
        low, wide = F.col("lo").cast("double"), F.col("hi").cast("double") - F.col("lo").cast("double")
        part = F.try_divide(F.col("v").cast("double") - low, wide / sections)
        middle = F.when((part >= 0) & (part < sections), F.floor(part)).otherwise(F.when(part >= sections, sections - 1).otherwise(0))
        section = F.when(F.col("v") <= F.col("lo"), 0).when(F.col("v") >= F.col("hi"), sections + 1).otherwise(middle.cast("int") + 1)
        counted = rows.withColumn("s", section).groupBy(*names, "lo", "hi", "s").agg(F.sum("n").alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))
        table = counted.groupBy(*names, "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("s", "n", "vmin", "vmax"))).alias("sections"))  # at most sections + 2
        joined = active.alias("a").join(hint(table).alias("t"), same("a", "t", [*names, "lo", "hi"])).select("a.*", "t.sections")
        none = F.lit(None).cast(kind)
        step = lambda acc, s: F.when(acc["lo"].isNotNull(), acc).when(acc["below"] + s["n"] >= F.col("rank"), F.struct(acc["below"].alias("below"), s["vmin"].alias("lo"), s["vmax"].alias("hi"))).otherwise(F.struct((acc["below"] + s["n"]).alias("below"), acc["lo"].alias("lo"), acc["hi"].alias("hi")))
        found = F.aggregate("sections", F.struct(F.lit(0).cast("bigint").alias("below"), none.alias("lo"), none.alias("hi")), step)
        state = stored(joined.withColumn("b", found).select(*names, "total", "i", (F.col("rank") - F.col("b.below")).alias("rank"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi")))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select(*names, "total", "i", F.col("hi").alias("v"))


# ---------------------------------------------------------------- operator


def percentiles(counts: DataFrame, keys: list[str], probs: tuple[float, ...], *, sections: int = 64, tolerance: float = 0.0, rows_per_task: int = 2_000_000) -> DataFrame:
    """(keys, n, q, value): for each group and q the smallest value whose cumulative count reaches ceil(q * n), at least 1.

    ``counts`` comes from ``value_counts`` or ``merge_counts``; values are integers, decimals, floats or doubles and keep
    their type. Groups without values give no row; no keys mean one group. Ties and repeated rows count as often as they
    occur; NaN lies above infinity, -0.0 equals 0.0. With a ``tolerance`` the value lies at most that far above the
    exact one, never below it.

    A group with more than ``rows_per_task`` distinct values is never held by one task. Every pass leaves an open interval
    strictly smaller, so bisection ends.
    """
    names, qs = [f"k{i}" for i in range(len(keys))] or ["k0"], tuple(Decimal(str(q)) for q in probs)
    columns = [F.col(k).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias("k0")]
    data = stored(counts.select(*columns, "v", "n").filter("n > 0"))
    kind = data.schema["v"].dataType
    moved, key = _transport(kind), F.struct(*names)
    parts: list[DataFrame] = []
    if moved is None:  # wider than 64 bits: all groups stay spread
        parts.append(_spread(data, names, qs, sections, tolerance, False))
    else:
        hot = hot_keys(data.select(key.alias("key")), ["key"], rows_per_task)
        all_fit = hot.isEmpty()
        rest = data if all_fit else data.withColumn("key", key).join(hot, "key", "left_anti").drop("key")
        name, out, back = moved
        schema = T.StructType([*[data.schema[n] for n in names], T.StructField("total", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType() if name == "double" else T.LongType())])
        placed = rest.select(*names, out(F.col("v")).alias("v"), "n").repartition(*names).sortWithinPartitions(*names)
        parts.append(placed.mapInArrow(_local(names, name, qs, tolerance * 10**kind.scale if isinstance(kind, T.DecimalType) else tolerance), schema).withColumn("v", back(F.col("v"))))
        if not all_fit:
            parts.append(_spread(stored(data.withColumn("key", key).join(hot, "key", "left_semi").drop("key")), names, qs, sections, tolerance, True))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    which = F.element_at(F.array(*[F.lit(float(q)) for q in probs]), F.col("i") + 1)
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("total").alias("n"), which.alias("q"), F.col("v").alias("value"))
