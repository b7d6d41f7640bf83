"""Removing the documents that leak."""

from tidemark.llm.leaks import leaks, without_leaks
from tidemark.llm.queries import p7_clean, p7_found

W = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def test_removes_whole_documents(spark):
    rows = [(1, "x " + " ".join(W[:12]), "a"), (2, " ".join(W[:11]), "b"), (3, None, "c"), (None, "<b>" + "</b> <b>".join(W[1:13]), "d"), (2, " ".join(W[:11]), "b"), (5, " ".join(W[::-1]), "e")]
    docs = spark.createDataFrame(rows, "id bigint, text string, note string")
    items = spark.createDataFrame([("i", " ".join(W)), ("j", " ".join(W[::-1]))], "item_id string, text string")
    for size in (1, 200_000):
        got = without_leaks(docs, items, grams_per_pass=size)
        assert got.columns == docs.columns and sorted(r["note"] for r in got.collect()) == ["b", "b", "c"]
    assert without_leaks(docs, items.filter("false")).count() == 6


def test_query_is_the_rest_of_found(spark):
    d = "/root/testdata/sf0.001"
    every = {r["doc_id"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()}
    found, left = ({r["doc_id"] for r in q(spark, d).collect()} for q in (p7_found, p7_clean))
    assert found and left == every - found
