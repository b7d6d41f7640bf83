"""A small cube layer: metadata over one table, queries that are rewritten by operations and run as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT_DISTINCT": F.count_distinct, "STDDEV": F.stddev_samp, "VARIANCE": F.var_samp,
}


@dataclass(frozen=True)
class Measure:
    name: str
    column: str
    aggregate: str = "SUM"

    def expression(self) -> Column:
        target = F.lit(1) if self.column == "*" else F.col(self.column)
        return AGGREGATES[self.aggregate](target).alias(self.name)


@dataclass(frozen=True)
class Dimension:
    """A named column; levels go from coarse to fine, each a column or an SQL expression."""

    name: str
    column: str
    kind: str = "categorical"
    levels: tuple[tuple[str, str], ...] = ()

    def at(self, level: str | None) -> Column:
        source = dict(self.levels)[level] if level else self.column
        return F.expr(source).alias(f"{self.name}_{level}" if level else self.name)


@dataclass(frozen=True)
class Cube:
    dimensions: tuple[Dimension, ...]
    measures: tuple[Measure, ...]

    def dimension(self, name: str) -> Dimension:
        for d in self.dimensions:
            if d.name == name:
                return d
        raise ValueError(f"no dimension {name!r}")

    def measure(self, name: str) -> Measure:
        for m in self.measures:
            if m.name == name:
                return m
        raise ValueError(f"no measure {name!r}")

    def describe(self) -> dict:
        return {"dimensions": [{"name": d.name, "column": d.column, "kind": d.kind, "levels": [n for n, _ in d.levels]} for d in self.dimensions], "measures": [{"name": m.name, "column": m.column, "aggregate": m.aggregate} for m in self.measures]}


@dataclass(frozen=True)
class CubeQuery:
    """dimensions: (name, level or None). filters: value or list of values by dimension. having: (operator, value) by measure."""

    dimensions: tuple[tuple[str, str | None], ...] = ()
    measures: tuple[str, ...] = ()
    filters: dict = field(default_factory=dict)
    having: dict = field(default_factory=dict)
    order_by: tuple[tuple[str, str], ...] = ()
    limit: int | None = None


Operation = Callable[[Cube, CubeQuery], CubeQuery]


def slice_(name: str, value) -> Operation:
    """Fixes a dimension and drops it from the grouping."""
    return lambda cube, q: replace(q, dimensions=tuple(x for x in q.dimensions if x[0] != cube.dimension(name).name), filters=q.filters | {name: value})


def dice(**filters) -> Operation:
    """Adds filters and keeps the grouping."""
    return lambda cube, q: replace(q, filters=q.filters | {cube.dimension(n).name: v for n, v in filters.items()})


def drill(name: str, finer: bool) -> Operation:
    """Moves a dimension one level down or up; above the coarsest level it leaves the grouping."""

    def apply(cube: Cube, q: CubeQuery) -> CubeQuery:
        levels = [n for n, _ in cube.dimension(name).levels]
        if not levels:
            raise ValueError(f"dimension {name!r} has no levels")
        now = dict(q.dimensions).get(name, "absent")
        i = len(levels) - 1 if now is None else -1 if now == "absent" else levels.index(now)
        i = min(i + 1, len(levels) - 1) if finer else i - 1
        rest = tuple(x for x in q.dimensions if x[0] != name)
        return replace(q, dimensions=rest if i < 0 else (*rest, (name, levels[i])))

    return apply


def drill_down(name: str) -> Operation:
    return drill(name, True)


def drill_up(name: str) -> Operation:
    return drill(name, False)


def pivot(rows: tuple[str, ...], columns: tuple[str, ...]) -> Operation:
    """Regroups by rows and columns, in long form; ``spread`` turns the last column wide."""
    return lambda cube, q: replace(q, dimensions=tuple((cube.dimension(n).name, None) for n in (*rows, *columns)))


def roll_up(name: str) -> Operation:
    """Removes a dimension and its filter."""
    return lambda cube, q: replace(q, dimensions=tuple(x for x in q.dimensions if x[0] != cube.dimension(name).name), filters={k: v for k, v in q.filters.items() if k != name})


def top_n(measure: str, n: int, ascending: bool = False) -> Operation:
    """Adds the measure, the order by it and a limit; equal ones are ordered by the dimensions."""

    def apply(cube: Cube, q: CubeQuery) -> CubeQuery:
        name = cube.measure(measure).name
        return replace(q, measures=q.measures if name in q.measures else (*q.measures, name), order_by=((name, "asc" if ascending else "desc"),), limit=n)

    return apply


def composite(*operations: Operation) -> Operation:
    def apply(cube: Cube, q: CubeQuery) -> CubeQuery:
        for op in operations:
            q = op(cube, q)
        return q

    return apply


def execute(df: DataFrame, cube: Cube, query: CubeQuery, *operations: Operation) -> DataFrame:
    """Runs a query after the operations. Unknown dimensions and measures raise; filters reach the scan."""
    q = composite(*operations)(cube, query)
    for name, value in q.filters.items():
        c = F.expr(cube.dimension(name).column)
        df = df.filter(c.isin(list(value)) if isinstance(value, (list, tuple, set)) else c.isNull() if value is None else c == value)
    keys = [cube.dimension(n).at(level) for n, level in q.dimensions]
    out = df.groupBy(*keys).agg(*[cube.measure(m).expression() for m in q.measures])
    for name, (op, value) in q.having.items():
        c = F.col(cube.measure(name).name)
        out = out.filter({">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value, "=": c == value}[op])
    if q.order_by:
        names = [f"{n}_{level}" if level else n for n, level in q.dimensions]
        out = out.orderBy(*[F.col(n).desc() if way == "desc" else F.col(n).asc() for n, way in q.order_by], *names)
    return out.limit(q.limit) if q.limit is not None else out


def spread(long: DataFrame, column: str, measure: str, values: list) -> DataFrame:
    """The long form of a pivot with one column per value; the values are given, so no extra job looks for them."""
    rest = [c for c in long.columns if c not in (column, measure)]
    return long.groupBy(*rest).pivot(column, values).agg(F.first(measure))


def cube_all(df: DataFrame, cube: Cube, dims: tuple[str, ...], measures: tuple[str, ...], rollup: bool = False) -> DataFrame:
    """All combinations (or the prefixes) of the dimensions in one pass, with a grouping id."""
    keys = [cube.dimension(n).at(None) for n in dims]
    grouped = df.rollup(*keys) if rollup else df.cube(*keys)
    return grouped.agg(F.grouping_id().alias("grouping_id"), *[cube.measure(m).expression() for m in measures])


def summary(cells: DataFrame, measure: str) -> DataFrame:
    c = F.col(measure)
    return cells.agg(F.count(c).alias("count"), F.sum(c).alias("sum"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"))


def discover(df: DataFrame) -> Cube:
    """Guesses a cube from names and types: texts and times are dimensions, numbers named like ids or codes too, other
    numbers are measures (AVG if their name says average). Without measures rows are counted."""
    dims, measures = [], []
    for f in df.schema.fields:
        name = f.name.lower()
        if isinstance(f.dataType, (T.StringType, T.BooleanType)):
            dims.append(Dimension(f.name, f"`{f.name}`"))
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            dims.append(Dimension(f.name, f"`{f.name}`", "temporal"))
        elif isinstance(f.dataType, T.NumericType):
            if any(part in name for part in ("id", "key", "code", "type")):
                dims.append(Dimension(f.name, f"`{f.name}`", "numerical"))
            else:
                measures.append(Measure(f.name, f.name, "AVG" if any(p in name for p in ("avg", "average", "mean")) else "SUM"))
    return Cube(tuple(dims), tuple(measures) or (Measure("record_count", "*", "COUNT"),))
