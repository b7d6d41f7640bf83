"""Combining the results of several sources: joins that match nulls, unions aligned by name, merges."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored


def last_per_key(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row with the greatest ordinal of each key; null keys are keys like others."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(ordinal).alias("__o"), *[c for c in rest])).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def federated_join(sources: dict[str, DataFrame], keys: list[str], ordinal: str = "ord") -> DataFrame:
    """Inner joins in the order of the sources. Each step keeps one row per key on its left, the last by ``ordinal``; null
    keys match each other; keys that a source lacks don't count; without a common key the source is skipped. Key columns come
    once; columns of the same name get the source's name in front."""
    names = list(sources)
    left = sources[names[0]]
    for name in names[1:]:
        right = sources[name].drop(ordinal)
        common = [k for k in keys if k in left.columns and k in right.columns]
        if not common:
            continue
        if ordinal in left.columns:
            left = last_per_key(left, common, ordinal)
        taken = set(left.columns)
        renamed = right.select(*[F.col(k).alias(f"__{k}") for k in common], *[F.col(c).alias(f"{name}_{c}" if c in taken else c) for c in right.columns if c not in common])
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in common])
        left = left.join(renamed, on).drop(*[f"__{k}" for k in common])
    return left


def federated_union(sources: list[DataFrame]) -> DataFrame:
    """All rows with the first source's columns: missing ones null, others dropped."""
    first = sources[0]
    return reduce(lambda a, b: a.unionByName(b.select(*[c for c in b.columns if c in first.columns]), allowMissingColumns=True), sources[1:], first).select(*first.columns)


def federated_merge(sources: list[DataFrame], keys: list[str], aggregates: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """The union, aggregated by the keys if aggregates are given."""
    rows = federated_union(sources)
    return rows.groupBy(*keys).agg(*[f(c).alias(c) for c, f in aggregates.items()]) if aggregates else rows


@dataclass
class FederatedQuery:
    """Sources by name: (priority, a function that gives the DataFrame). Sources are fetched side by side, the first by priority
    first. A failing source is tried again after 1, 2, 4 ... times ``wait`` seconds; its error is kept and the others are
    combined."""

    sources: dict[str, tuple[int, Callable[[], DataFrame]]]
    retries: int = 2
    wait: float = 1.0
    errors: dict[str, str] = field(default_factory=dict)

    def execution_order(self) -> list[str]:
        return sorted(self.sources, key=lambda n: (-self.sources[n][0], n))

    def fetch(self, workers: int = 8, execute: bool = False) -> dict[str, DataFrame]:
        """The sources that answered, in the order in which they were given. With ``execute`` each is also run and its rows
        stored, so that an error on the way counts as the source's own and is tried again."""

        def one(name: str) -> DataFrame | None:
            for k in range(self.retries + 1):
                try:
                    df = self.sources[name][1]()
                    _ = df.schema  # resolves the source now, so that its errors are its own
                    df = stored(df) if execute else df
                    self.errors.pop(name, None)
                    return df
                except Exception as e:
                    self.errors[name] = f"{type(e).__name__}: {e}"
                    if k < self.retries:
                        time.sleep(self.wait * 2**k)
            return None

        with ThreadPoolExecutor(workers) as pool:
            asked = {name: pool.submit(one, name) for name in self.execution_order()}
        got = {name: f.result() for name, f in asked.items()}
        return {name: got[name] for name in self.sources if got[name] is not None}
