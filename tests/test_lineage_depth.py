"""Paths and cycles of more than ten steps."""

from tidemark.operators import lineage as li


def test_long_path(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(18)] + [("n3", "n1"), (None, "n4")], "src string, dst string")
    assert li.shortest_path(edges, "n0", "n18") == [f"n{i}" for i in range(19)]
    assert li.shortest_path(edges, "n18", "n0") is None
    assert li.reach(edges, spark.createDataFrame([("n0",)], "id string")).agg({"distance": "max"}).first()[0] == 10


def test_long_cycle(spark):
    ring = [(f"c{i}", f"c{(i + 1) % 13}") for i in range(13)]
    edges = spark.createDataFrame(ring + [("a", "c0"), ("c5", "x"), ("x", "y"), ("s", "s"), ("c1", "s"), (None, "a")], "src string, dst string")
    assert {r["id"] for r in li.on_cycles(edges).collect()} == {f"c{i}" for i in range(13)} | {"s"}
    assert li.on_cycles(edges.filter("src in ('a', 'c5', 'x')")).count() == 0
