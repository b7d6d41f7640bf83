"""The as-of join against brute force, and its edge cases."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.asof import FOREVER, History, asof_features

T0 = dt.datetime(2024, 1, 1)
LABELS = "label_id bigint, customer_id string, label_ts timestamp_ntz"
VALUES = "value_id bigint, feature_name string, entity_id string, value string, created_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz"


def t(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


def brute(labels, values):
    best = {}
    for label, customer, ts in labels:
        for vid, feature, entity, _, known, start, end in values:
            if None in (customer, ts, entity, known, start) or entity != customer or not (start <= ts and known <= ts and (end is None or ts < end)):
                continue
            rank = (known, start, vid is not None, vid or 0)
            if (label, feature) not in best or rank > best[label, feature][0]:
                best[label, feature] = (rank, vid)
    return sorted(((k[0], k[1], v[1]) for k, v in best.items()), key=str)


def run(spark, labels, values, **options):
    out = asof_features(spark.createDataFrame(labels, LABELS), spark.createDataFrame(values, VALUES), **options)
    return sorted((tuple(r) for r in out.collect()), key=str)


def cases(seed, n=60):
    rng = random.Random(seed)
    pick = lambda hi: t(rng.choice([None, *range(hi)]))
    values = [(rng.choice([None, *range(40)]), rng.choice(["f", "g", None]), rng.choice(["a", "b", None]), None, pick(20), pick(20), pick(24)) for _ in range(n)]
    values += values[:5]
    labels = [(i % 25 if i % 9 else None, rng.choice(["a", "b", "c", None]), pick(26)) for i in range(n)]
    return labels + labels[:5], values


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    labels, values = cases(seed)
    assert run(spark, labels, values) == brute(labels, values)


@pytest.mark.parametrize("seed", range(2))
def test_hot_entities_are_split_without_change(spark, seed):
    labels, values = cases(seed, 90)
    assert run(spark, labels, values, rows_per_task=7) == brute(labels, values)


def test_boundaries_and_later_knowledge(spark):
    values = [(1, "f", "a", "1", t(0), t(0), t(10)), (2, "f", "a", "2", t(6), t(0), t(10)), (3, "f", "a", None, t(10), t(10), None), (4, "f", "a", "x", t(0), t(5), t(5))]
    labels = [(1, "a", t(0)), (2, "a", t(5)), (3, "a", t(6)), (4, "a", t(10)), (5, "b", t(5)), (6, "a", None)]
    assert run(spark, labels, values) == [(1, "f", 1), (2, "f", 1), (3, "f", 2), (4, "f", 3)]


def test_ties_go_to_later_start_then_larger_id(spark):
    values = [(5, "f", "a", "1", t(0), t(0), None), (2, "f", "a", "2", t(0), t(1), None), (9, "f", "a", "3", t(0), t(1), None)]
    assert run(spark, [(1, "a", t(2)), (2, "a", t(0))], values) == [(1, "f", 9), (2, "f", 5)]


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], []) == [] and run(spark, [(1, "a", t(1))], []) == []
    labels = spark.createDataFrame([(1, "a", t(1), "z")], LABELS + ", value string")
    values = spark.createDataFrame([(1, "f", "a", "1", t(0), t(0), None, 7, "q")], VALUES + ", label_id int, kind string")
    assert [tuple(r) for r in asof_features(labels, values).collect()] == [(1, "f", 1)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(0, 9), st.integers(1, 6)), min_size=1, max_size=30), st.integers(-1, 14), st.integers(-1, 20))
def test_every_version_of_the_tree(rows, known, valid):
    records = [(k, s, i, s + w if w < 6 else FOREVER) for k, s, i, w in rows]
    fits = [r for r in records if r[0] <= known and r[1] <= valid < r[3]]
    got = History(list(records)).at(known, valid)
    assert (got is None) == (not fits)
    if fits:
        assert got[:3] == max(r[:3] for r in fits)
