"""Attributes as known at event time: a bitemporal as-of join.

Each entity's records go, in the order in which they became known, into a persistent search tree over the
breakpoints of valid time. Inserting a record overwrites its valid span and copies only the path to it, so
every insertion leaves a root that still shows what was known then. An event picks the root of its known
time by bisection and descends to its place in valid time.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import micros
from tidemark.operators.skew import hot_keys

FOREVER = 2**63 - 1


def assign(node, lo: int, hi: int, a: int, b: int, record: int):
    """The root of a copy of ``node`` (spanning [lo, hi)) in which [a, b) holds ``record``. Leaves are ints."""
    if a <= lo and hi <= b:
        return record
    left, right = node if type(node) is tuple else (node, node)
    mid = (lo + hi) >> 1
    if a < mid:
        left = assign(left, lo, mid, a, b, record)
    if b > mid:
        right = assign(right, mid, hi, a, b, record)
    return (left, right)


class History:
    """The versions of one feature of one entity. Records: (known, valid_from, value_id or None, valid_until)."""

    __slots__ = ("cuts", "known", "records", "roots", "size")

    def __init__(self, records: list[tuple]):
        records.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
        self.records = records
        self.cuts = sorted({r[1] for r in records} | {r[3] for r in records})
        self.size = len(self.cuts) - 1
        self.known, self.roots, root = [], [], -1
        for i, (known, start, _, end) in enumerate(records):
            root = assign(root, 0, self.size, bisect_left(self.cuts, start), bisect_left(self.cuts, end), i)
            self.known.append(known)
            self.roots.append(root)

    def at(self, known: int, valid: int) -> tuple | None:
        """The record that counts at a known and a valid time."""
        version = bisect_right(self.known, known) - 1
        place = bisect_right(self.cuts, valid) - 1
        if version < 0 or place < 0 or place >= self.size:
            return None
        node, lo, hi = self.roots[version], 0, self.size
        while type(node) is tuple:
            mid = (lo + hi) >> 1
            node, lo, hi = (node[0], lo, mid) if place < mid else (node[1], mid, hi)
        return None if node < 0 else self.records[node]


OUT = pa.schema([("event_id", pa.int64()), ("feature", pa.string()), ("known", pa.int64()), ("valid_from", pa.int64()), ("value_id", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard and kind: a shard's records (0), then its events (1)."""
    key, raw, trees = None, {}, {}
    for batch in batches:
        out = ([], [], [], [], [])
        for *shard, kind, feature, t0, start, end, ident in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if shard != key:
                key, raw, trees = shard, {}, {}
            if kind == 0:
                raw.setdefault(feature, []).append((t0, start, ident, end))
                continue
            if raw:  # trees are built only where an event asks for them
                trees, raw = {f: History(r) for f, r in raw.items()}, {}
            for name, tree in trees.items():
                if (r := tree.at(t0, t0)) is not None:
                    for column, v in zip(out, (ident, name, r[0], r[1], r[2])):
                        column.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, OUT)], schema=OUT)


def asof_features(
    events: DataFrame, values: DataFrame, *, event_id: str = "label_id", event_entity: str = "customer_id", event_ts: str = "label_ts",
    entity: str = "entity_id", feature: str = "feature_name", value_id: str = "value_id", known: str = "created_at",
    valid_from: str = "valid_from", valid_until: str = "valid_until", rows_per_task: int = 200_000,
) -> DataFrame:
    """(event_id, feature, value_id): for each event and feature the record valid and known at the event's time.

    Qualifying: known <= t, valid_from <= t, and valid_until null or t < valid_until. The latest known counts,
    then the latest valid_from, then the largest value_id (null ids last). Events without entity or time, and
    records without entity, known or valid_from time or with an empty span, give nothing. A null feature is a
    feature of its own. Repeated rows count once; extra columns are ignored; empty tables give no rows.

    Entities with more than ``rows_per_task`` records or events are split: records by hash into shards, each
    with a tree of its own, events into blocks; the best of an event's shards is picked by a final aggregate.
    """
    records = (
        values.select(F.col(entity).cast("string").alias("entity"), F.col(feature).cast("string").alias("feature"), micros(known).alias("t0"), micros(valid_from).alias("start"), F.coalesce(micros(valid_until), F.lit(FOREVER)).alias("end"), F.col(value_id).cast("bigint").alias("id"))
        .filter("entity is not null and t0 is not null and start is not null and start < end")
    )
    asked = events.select(F.col(event_entity).cast("string").alias("entity"), micros(event_ts).alias("t0"), F.col(event_id).cast("bigint").alias("id")).filter("entity is not null and t0 is not null")
    shards, blocks = hot_keys(records, ["entity"], rows_per_task, "shards"), hot_keys(asked, ["entity"], rows_per_task, "blocks")

    def spread(df: DataFrame, own: DataFrame, own_n: str, own_as: str, other: DataFrame, other_n: str, other_as: str) -> DataFrame:
        """Each row goes to one of its own entity's parts, and to all of the other side's."""
        part = F.pmod(F.xxhash64("id", "t0"), F.coalesce(F.col(own_n), F.lit(1))).cast("int")
        every = F.sequence(F.lit(0), F.coalesce(F.col(other_n), F.lit(1)) - 1)
        return df.join(own, "entity", "left").join(other, "entity", "left").withColumn(own_as, part).withColumn(other_as, F.explode(every))

    columns = ["entity", "shard", "block", "kind", "feature", "t0", "start", "end", "id"]
    left = spread(records, shards, "shards", "shard", blocks, "blocks", "block").withColumn("kind", F.lit(0)).select(columns)
    null = F.lit(None)
    right = spread(asked, blocks, "blocks", "block", shards, "shards", "shard").select("entity", "shard", "block", F.lit(1).alias("kind"), null.cast("string").alias("feature"), "t0", null.cast("bigint").alias("start"), null.cast("bigint").alias("end"), "id")
    hits = left.union(right).repartition("entity", "shard", "block").sortWithinPartitions("entity", "shard", "block", "kind").mapInArrow(_search, "event_id bigint, feature string, known bigint, valid_from bigint, value_id bigint")
    best = F.max(F.struct("known", "valid_from", "value_id"))
    return hits.groupBy("event_id", "feature").agg(best.alias("r")).select(F.col("event_id").alias(event_id), F.col("feature").alias(feature), F.col("r.value_id").alias(value_id))
