"""File and HTTP sources, and file sinks by suffix."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType


def read_by_suffix(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """csv (with header), parquet or json (lines) by suffix; another suffix raises."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if suffix == "parquet":
        return reader.parquet(path)
    if suffix in ("json", "jsonl"):
        return reader.json(path)
    raise ValueError(f"no reader for .{suffix}")


def write_by_suffix(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = df.write.mode(mode)
    if suffix == "csv":
        writer.option("header", True).csv(path)
    elif suffix == "parquet":
        writer.parquet(path)
    elif suffix in ("json", "jsonl"):
        writer.json(path)
    else:
        raise ValueError(f"no writer for .{suffix}")


TRANSACTIONS = "order_id string, customer_id string, event_ts string, order_ts string, product_id string, quantity int, unit_price decimal(18,2), unit_cost decimal(18,2), unit_margin decimal(18,2), line_total decimal(18,2), line_margin decimal(18,2)"


def read_transactions(spark: SparkSession, path: str, jail: str | None = None, limit: int | None = None) -> DataFrame:
    """Transactions of a JSON array (or lines) with ISO times, a final Z meaning UTC; no size cap. With ``jail`` the path
    must lie under that folder. ``limit`` keeps a prefix, as a preview does. Unreadable times are null."""
    if jail is not None and os.path.commonpath([os.path.realpath(path), os.path.realpath(jail)]) != os.path.realpath(jail):
        raise ValueError("path lies outside the data folder")
    raw = spark.read.schema(TRANSACTIONS).option("multiLine", True).json(path)
    out = with_times(raw)
    return out.limit(limit) if limit is not None else out


def write_json_arrays(df: DataFrame, path: str) -> None:
    """One JSON array a file; nulls are left out of its records. A part without rows is an empty array."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = "["
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield pa.RecordBatch.from_pydict({"value": [(start if i == 0 else ",") + t for i, t in enumerate(texts)]})
                start = ","
        yield pa.RecordBatch.from_pydict({"value": ["[]" if start == "[" else "]"]})

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(lines, "value string").write.text(path)


def with_times(raw: DataFrame) -> DataFrame:
    """Transactions with naive UTC times from ISO texts; texts without zone are taken as they are."""

    def naive(c: str) -> Column:
        utc = F.when(F.col(c).endswith("Z"), F.regexp_replace(c, "Z$", "").try_cast("timestamp_ntz"))
        return F.coalesce(utc, F.try_to_timestamp(c).cast("timestamp_ntz"))

    return raw.withColumns({"event_ts": naive("event_ts"), "order_ts": naive("order_ts")})


def transactions_summary(df: DataFrame) -> DataFrame:
    ts = F.coalesce("event_ts", "order_ts")
    return df.agg(F.count(F.lit(1)).alias("transactions"), F.count_distinct("customer_id").alias("customers"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


class _HttpReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options = schema.names, options

    def read(self, partition) -> Iterator[tuple]:
        body = self.options.get("body")
        request = urllib.request.Request(self.options["url"], data=body.encode() if body else None, method="POST" if body else "GET")
        with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", "30"))) as answer:
            data = json.loads(answer.read())
        for row in records_of(data):
            yield tuple(None if row.get(c) is None else str(row[c]) for c in self.columns)


def records_of(data) -> list[dict]:
    """The records of an answer: a list, or the list under data, results, items or records, or one record."""
    if isinstance(data, list):
        return data
    for key in ("data", "results", "items", "records"):
        if isinstance(data.get(key), list):
            return data[key]
    return [data]


class HttpSource(DataSource):
    """``spark.read.format("http_json").schema("a string, ...").option("url", ...).load()``; all columns are strings."""

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def reader(self, schema: StructType) -> _HttpReader:
        return _HttpReader(schema, dict(self.options))
