"""Recall and precision over the smallest tables with passages planted in every disguise."""

import json
import random

import pyarrow.parquet as pq

from tidemark.llm.leaks import leaks, variants, words

DATA = "/root/testdata/sf0.001"
DISGUISES = [
    lambda w: " ".join(w), lambda w: " ".join(w).upper(), lambda w: "// " + "\n// ".join(w), lambda w: "_".join(w), lambda w: json.dumps("\n".join(w))[1:-1], lambda w: "<p class='x y'>" + "</p><p>".join(w) + "</p>", lambda w: "&nbsp;".join(w),
    lambda w: " ".join("\u200b".join(x) for x in w), lambda w: " <!-- n --> ".join(w), lambda w: " * " + "\r\n * ".join(w), lambda w: "**" + "** *".join(w) + "*",
]


def test_planted_passages_are_found_and_nothing_else(spark):
    rng = random.Random(5)
    items = [(r["item_id"], words(variants(r["text"])[0])) for r in pq.read_table(f"{DATA}/eval_items.parquet").to_pylist() if r["text"]]
    items = [(i, w) for i, w in items if len(w) >= 14]
    hosts = [r["text"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist() if r["text"]][:80]
    grams = {}
    for i, w in items:
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    texts, want = [], set()
    for d, host in enumerate(hosts):
        item, w = rng.choice(items)
        n = rng.choice([11, 12, 13, 14])
        at = rng.randrange(len(w) - n + 1)
        lines = host.split("\n")
        cut = rng.randrange(len(lines) + 1)
        passage = rng.choice(DISGUISES)(w[at : at + n])
        texts.append("\n".join([*lines[:cut], "zqx " + passage + " zqx", *lines[cut:]]))
        want |= {(d, i) for k in range(n - 11) for i in grams[tuple(w[at + k : at + k + 12])]}
        for reading in variants(host):  # what the host held before
            v = words(reading)
            want |= {(d, i) for k in range(len(v) - 11) for i in grams.get(tuple(v[k : k + 12]), ())}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for size in (0, 200_000):
        got = {tuple(r) for r in leaks(docs, spark.read.parquet(f"{DATA}/eval_items.parquet"), grams_per_pass=size).collect()}
        assert got == want and len(want) > 50
