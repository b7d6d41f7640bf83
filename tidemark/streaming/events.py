"""Event schemas, validation and dead letters, Kafka in and out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of event and the payload fields each must have.
EVENT_TYPES = ("page_view", "user_action", "transaction", "system_event", "custom", "error", "metric")
ENVELOPE = "event_id string, event_type string, event_name string, timestamp string, source_service string, payload string, metadata string"
REQUIRED: dict[str, tuple[str, ...]] = {"page_view": ("page",), "user_action": ("user_id", "action"), "transaction": ("transaction_id", "amount"), "error": ("message",), "metric": ("value",)}


def register_schema(kind: str, fields: tuple[str, ...]) -> None:
    REQUIRED[kind] = fields


def event_time(text: Column) -> Column:
    """A time from epoch seconds or an ISO text, with a final Z meaning UTC; null if neither."""
    seconds = text.try_cast("double")
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("bigint")), F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))


def parse(raw: DataFrame, value: str = "value") -> DataFrame:
    """Envelope columns, event time ``ts`` and ``errors`` from JSON texts; payload and metadata stay JSON."""
    e = F.from_json(F.col(value).cast("string"), ENVELOPE)
    df = raw.withColumn("raw", F.col(value).cast("string")).withColumn("e", e).select("raw", "e.*").withColumn("ts", event_time(F.col("timestamp")))
    return df.withColumn("errors", errors(df))


def errors(df: DataFrame) -> Column:
    """The rules an event breaks."""
    checks = [F.when(F.col("event_id").isNull(), F.lit("no event_id")), F.when(F.col("event_type").isNull() | ~F.col("event_type").isin(*EVENT_TYPES), F.lit("unknown event_type")), F.when(F.col("ts").isNull(), F.lit("no time"))]
    for kind, fields in REQUIRED.items():
        checks += [F.when((F.col("event_type") == kind) & F.get_json_object("payload", f"$.{f}").isNull(), F.lit(f"payload lacks {f}")) for f in fields]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def split_sink(good: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that sends valid events one way and the rest to the dead letters."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            good(kept.filter(F.size("errors") == 0), batch_id)
            dead(kept.filter(F.size("errors") > 0).select("raw", "errors"), batch_id)
        finally:
            kept.unpersist()

    return handle


def read_kafka(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """A parsed stream from Kafka; needs the Kafka package on the class path."""
    return parse(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).options(**options).load())


def write_kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str):
    """Sends rows as JSON, keyed by event_id."""
    rows = stream.select(F.col("event_id").cast("string").alias("key"), F.to_json(F.struct(*stream.columns)).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def subscription(filters: dict, payload: str = "payload") -> Column:
    """Whether an event passes: every dotted path equals its value, or one of a list; a missing path fails."""
    ok = F.lit(True)
    for path, want in filters.items():
        got = F.get_json_object(payload, f"$.{path}")
        ok = ok & F.coalesce(got.isin([str(w) for w in want]) if isinstance(want, (list, tuple)) else got == str(want), F.lit(False))
    return ok


def broadcast_to(filters_by_subscriber: dict[str, dict]) -> Callable[[DataFrame], DataFrame]:
    """(subscriber, event columns) for each subscriber whose filter an event passes."""

    def fan_out(df: DataFrame) -> DataFrame:
        names = [F.when(subscription(f), F.lit(name)) for name, f in filters_by_subscriber.items()]
        return df.select(F.explode(F.filter(F.array(*names), lambda n: n.isNotNull())).alias("subscriber"), "*")

    return fan_out


def features_of(df: DataFrame, paths: dict[str, str], payload: str = "payload", ts: str = "ts") -> DataFrame:
    """Model features of events: payload values by path, hour and weekday (Monday 0)."""
    return df.select("*", *[F.get_json_object(payload, f"$.{p}").alias(n) for n, p in paths.items()], F.hour(ts).alias("hour"), F.weekday(ts).alias("weekday"))
