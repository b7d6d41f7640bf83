"""Task graphs on the driver: order, waves, retries; and tables about runs."""

from __future__ import annotations

import math
import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rows import attach
from tidemark.operators.ordered import sums_before


def delay_fixed(n: int, base: float = 1.0) -> float:
    return base


def delay_exponential(n: int, base: float = 1.0, cap: float = 300.0, jitter: float = 0.1) -> float:
    d = min(base * 2 ** (n - 1), cap)
    return d * (1 + random.uniform(-jitter, jitter))


def delay_linear(n: int, base: float = 1.0) -> float:
    return base * n


def delay_polynomial(n: int, base: float = 1.0) -> float:
    return base * n**2


@dataclass
class Task:
    name: str
    run: Callable[[dict], object]
    after: tuple[str, ...] = ()
    retries: int = 0
    delay: Callable[[int], float] = delay_exponential
    skip_if: Callable[[dict], bool] | None = None
    valid: Callable[[object], bool] | None = None
    cpu: float = 1.0
    memory: float = 0.0


class Pool:
    """Processors and memory that tasks take while they run; who finds too little waits."""

    def __init__(self, cpu: float = math.inf, memory: float = math.inf):
        self.cpu, self.memory, self.free = cpu, memory, [cpu, memory]
        self.change = threading.Condition()

    @contextmanager
    def taken(self, task: Task) -> Iterator[None]:
        if task.cpu > self.cpu or task.memory > self.memory:
            raise ValueError(f"{task.name} needs more than the pool has")
        with self.change:
            self.change.wait_for(lambda: self.free[0] >= task.cpu and self.free[1] >= task.memory)
            self.free = [self.free[0] - task.cpu, self.free[1] - task.memory]
        try:
            yield
        finally:
            with self.change:
                self.free = [self.free[0] + task.cpu, self.free[1] + task.memory]
                self.change.notify_all()


@dataclass
class Dag:
    tasks: dict[str, Task] = field(default_factory=dict)

    def add(self, task: Task) -> Dag:
        self.tasks[task.name] = task
        return self

    def order(self) -> list[str]:
        """A topological order, by name within a wave; ValueError on a cycle or an unknown task."""
        return [n for wave in self.waves() for n in wave]

    def waves(self) -> list[list[str]]:
        left = {n: set(t.after) for n, t in self.tasks.items()}
        if unknown := {a for s in left.values() for a in s} - left.keys():
            raise ValueError(f"unknown tasks {sorted(unknown)}")
        out = []
        while left:
            ready = sorted(n for n, s in left.items() if not s)
            if not ready:
                raise ValueError(f"cycle among {sorted(left)}")
            out.append(ready)
            left = {n: s - set(ready) for n, s in left.items() if n not in ready}
        return out

    def execute(self, workers: int = 4, sleep: Callable[[float], None] = time.sleep, pool: Pool | None = None) -> dict[str, str]:
        """Runs the waves; states are succeeded, failed, skipped or upstream_failed, so a failure never hangs the run. A result
        that ``valid`` refuses is a failure, and so is a task that needs more than the ``pool`` of resources has."""
        resources = pool or Pool()
        results: dict[str, object] = {}
        state: dict[str, str] = {}

        def attempt(task: Task) -> str:
            if any(state[a] in ("failed", "upstream_failed") for a in task.after):
                return "upstream_failed"
            if task.skip_if and task.skip_if(results):
                return "skipped"
            for n in range(1, task.retries + 2):
                try:
                    with resources.taken(task):
                        results[task.name] = task.run(results)
                    if task.valid and not task.valid(results[task.name]):
                        raise ValueError(f"{task.name} gave a result that isn't valid")
                    return "succeeded"
                except Exception as e:
                    results[task.name] = e
                    if n <= task.retries:
                        sleep(task.delay(n))
            return "failed"

        with ThreadPoolExecutor(workers) as threads:
            for wave in self.waves():
                for name, outcome in zip(wave, threads.map(attempt, [self.tasks[n] for n in wave])):
                    state[name] = outcome
        return state


# ---------------------------------------------------------------- tables about runs


def run_stats(runs: DataFrame) -> DataFrame:
    """One row of (status, duration_s, error): runs, success %, mean, shortest and longest duration."""
    ok = F.col("status") == "success"
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("succeeded"), F.round(F.try_divide(F.count_if(ok) * 100.0, F.count(F.lit(1)).cast("double")), 4).alias("success_rate"), F.round(F.avg("duration_s"), 4).alias("avg_duration"), F.min("duration_s").alias("min_duration"), F.max("duration_s").alias("max_duration"))


def top_errors(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.filter("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "error").limit(n)


def buckets(runs: DataFrame, ts: str, now: Column, count: int, unit: str) -> DataFrame:
    """The last ``count`` hours or days up to ``now``, empty ones with zeros: (bucket, runs, failures)."""
    start = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    step = F.expr(f"INTERVAL 1 {unit}")
    n = runs.groupBy(start.alias("bucket")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") != "success").alias("failures"))
    last = F.date_trunc(unit, now).cast("timestamp_ntz")
    grid = runs.sparkSession.range(1).select(F.explode(F.sequence(last - F.expr(f"INTERVAL {count - 1} {unit}"), last, step)).alias("bucket"))
    return grid.join(n, "bucket", "left").fillna(0, ["runs", "failures"])


def health(success: Column, errors: Column, over_hour: Column, runs: Column, task_success: Column) -> Column:
    """100 less 0.4 per point of success under 95, 0.2 per point of errors over 5, up to 20 for runs over an hour, 10 without
    runs and 0.1 per point of task success under 95; at least 0."""
    score = 100 - 0.4 * F.greatest(95 - success, F.lit(0.0)) - 0.2 * F.greatest(errors - 5, F.lit(0.0)) - F.least(over_hour.cast("double"), F.lit(20.0)) - F.when(runs == 0, 10.0).otherwise(0.0) - 0.1 * F.greatest(95 - task_success, F.lit(0.0))
    return F.greatest(score, F.lit(0.0))


def recurring(runs: DataFrame, ts: str, last: int = 50, least: int = 3) -> DataFrame:
    """(pattern, count) of the last failures: the first three words of more than five letters, seen at least ``least`` times."""
    recent = runs.filter("error is not null").orderBy(F.desc(ts)).limit(last)
    words = F.slice(F.filter(F.split("error", r"\s+"), lambda w: F.length(w) > 5), 1, 3)
    return recent.select(F.array_join(words, " ").alias("pattern")).filter("pattern <> ''").groupBy("pattern").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least)


def compare_runs(values: DataFrame, runs: list[str]) -> DataFrame:
    """(key, one column per run): metrics or parameters side by side, missing ones null."""
    return values.groupBy("key").pivot("run", runs).agg(F.first("value"))


def last_executions(executions: DataFrame, last: int = 1000) -> DataFrame:
    """Per name over its last executions: count, success %, mean, shortest and longest milliseconds."""
    w = Window.partitionBy("name").orderBy(F.desc("ts"), F.desc("id"))
    rows = executions.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= last)
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("executions"), F.round(F.count_if("ok") * 100.0 / F.count(F.lit(1)), 4).alias("success_rate"), F.round(F.avg("ms"), 4).alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def storage_stats(artifacts: DataFrame, now: Column) -> DataFrame:
    """One row: versions, artifacts, bytes, those of the last day."""
    return artifacts.agg(F.count(F.lit(1)).alias("artifacts"), F.count_distinct("version").alias("versions"), F.sum("bytes").alias("bytes"), F.count_if((F.col("ts") > now - F.expr("INTERVAL 1 DAY")) & (F.col("ts") <= now)).alias("last_day"))


def latency(df: DataFrame, ms: str) -> DataFrame:
    """One row: p95 by the exclusive method of (n + 1) places, p99 by nearest rank."""
    counts = df.filter(F.col(ms).isNotNull()).groupBy(F.col(ms).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    total = counts.agg(F.sum("k").alias("n"))
    run = attach(sums_before(counts, "x", ["k"]), total)
    at = lambda r: F.max(F.when((F.col("k_before") < r) & (r <= F.col("k_before") + F.col("k")), F.col("x")))
    place = F.lit(0.95) * (F.col("n") + 1)
    low = F.greatest(F.least(F.floor(place), F.col("n") - 1), F.lit(1))
    row = run.agg(at(low).alias("a"), at(F.least(low + 1, F.col("n"))).alias("b"), at(F.greatest(F.ceil(F.lit(0.99) * F.col("n")), F.lit(1))).alias("p99"), F.max(place - low).alias("part"))
    return row.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("p95"), "p99")
