"""A named catalog of tables with guarded identifiers, parameterised queries and asynchronous runs."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*){0,2}")
#: What an identifier must not hold. Words count inside others too ("last_update" is refused).
FORBIDDEN = (";", "--", "/*", "*/", "drop", "delete", "update", "insert")
LONGEST = 128


def guard_identifier(name: str) -> str:
    """The name itself, or ValueError."""
    if not name or len(name) > LONGEST or any(x in name.lower() for x in FORBIDDEN) or not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name[:LONGEST]!r}")
    return name


class Catalog:
    """Tables by name: parquet paths (by suffix also csv or json), or functions that give a DataFrame."""

    def __init__(self, spark: SparkSession, tables: dict[str, str | Callable[[SparkSession], DataFrame]]):
        self.spark, self.tables = spark, {guard_identifier(n): t for n, t in tables.items()}
        self.pool = ThreadPoolExecutor(4)
        self.running: dict[str, Future] = {}

    def table(self, name: str) -> DataFrame:
        source = self.tables[guard_identifier(name)]
        if callable(source):
            return source(self.spark)
        from tidemark.sources.files import read_by_suffix

        return read_by_suffix(self.spark, source)

    def query(self, sql: str, params: dict | None = None) -> DataFrame:
        """SQL with named markers; tables are given to the query as arguments of their own names, not as global views."""
        frames = {n: self.table(n) for n in self.tables if re.search(rf"\b{re.escape(n)}\b", sql)}
        marked = sql
        for n in frames:
            marked = re.sub(rf"(?<![\w.:{{]){re.escape(n)}(?![\w(])", "{" + n + "}", marked)
        return self.spark.sql(marked, args=params or {}, **frames)

    def submit(self, sql: str, params: dict | None = None) -> str:
        """Starts a query whose rows are bounded by the caller's SQL and returns its id."""
        run = uuid.uuid4().hex
        self.running[run] = self.pool.submit(lambda: self.query(sql, params).collect())
        return run

    def status(self, run: str) -> str:
        f = self.running[run]
        return "running" if not f.done() else "failed" if f.exception() else "completed"

    def result(self, run: str) -> list:
        return self.running[run].result()

    def schema_info(self) -> DataFrame:
        rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t in self.tables for i, f in enumerate(self.table(t).schema.fields)]
        return self.spark.createDataFrame(rows, "table_name string, position int, column_name string, type string, nullable boolean")

    def sample(self, name: str, n: int = 100) -> DataFrame:
        return self.table(name).limit(n)


class Factory:
    """Connector kinds by name, made from settings that are checked for required keys."""

    def __init__(self) -> None:
        self.kinds: dict[str, tuple[Callable[..., Catalog], tuple[str, ...]]] = {}

    def register(self, kind: str, make: Callable[..., Catalog], required: tuple[str, ...] = ()) -> None:
        self.kinds[kind.lower()] = (make, required)

    def missing(self, kind: str, settings: dict) -> list[str]:
        return [k for k in self.kinds[kind.lower()][1] if not settings.get(k)]

    def create(self, kind: str, settings: dict) -> Catalog:
        if kind.lower() not in self.kinds:
            raise ValueError(f"unknown connector {kind!r}; known: {sorted(self.kinds)}")
        if lacking := self.missing(kind, settings):
            raise ValueError(f"settings lack {lacking}")
        return self.kinds[kind.lower()][0](**settings)


def jdbc_table(url: str, name: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> Callable[[SparkSession], DataFrame]:
    """A table of an SQL warehouse; with a numeric column and its bounds the read is split over that many tasks."""

    def read(spark: SparkSession) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", guard_identifier(name)).options(**options)
        if partition_column and bounds:
            reader = reader.options(partitionColumn=guard_identifier(partition_column), lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
        return reader.load()

    return read
