"""Leaks against a plain search, through every disguise the definition names."""

import json
import random

import pytest

from tidemark.llm.leaks import Grams, Hasher, leaks, variants, words

W = "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
ITEM = " ".join(W[:13])
TWELVE = W[:12]


def run(spark, texts, items=(("i", ITEM),), **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    table = spark.createDataFrame(list(items), "item_id string, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in leaks(docs, table, **options).collect())


DISGUISES = [
    " ".join(TWELVE), "x " + " ".join(TWELVE).upper() + " y", "// " + "\n// ".join(TWELVE), " * " + "\r\n * ".join(TWELVE), "_".join(TWELVE), ", ".join(f'"{w}"' for w in TWELVE), '"' + "\\n".join(TWELVE) + '"', json.dumps("\t".join(TWELVE)),
    json.dumps({"a": json.dumps("\n".join(TWELVE))}), "<b>" + "</b> <i>".join(TWELVE), "&nbsp;".join(TWELVE), "&#32;".join(TWELVE), " ".join("​".join(w) for w in TWELVE), " ".join(w.replace("e", "­e") for w in TWELVE), " ".join("".join(chr(ord(c) + 0xFEE0) for c in w) for w in TWELVE),
    "".join(f"\\u{ord(c):04x}" for c in " ".join(TWELVE)), "﻿" + "…".join(TWELVE), "<b>al</b>pha " + " ".join(TWELVE[1:]),
]


@pytest.mark.parametrize("text", DISGUISES)
def test_disguises(spark, text):
    assert run(spark, ["nothing here", text]) == [(1, "i")]


def test_too_short_out_of_order_or_interrupted(spark):
    assert run(spark, [" ".join(W[:11]), " ".join(reversed(TWELVE)), " ".join(W[:6] + ["other"] + W[6:12]), None, "", "zz"]) == []


def test_accents_scripts_and_shared_passages(spark):
    ru, fr = "один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать", "é è à ç ù î ô û ê â ë ï"
    items = [("ru", ru), ("fr", fr), ("both", ru + " конец"), ("short", "a b c"), ("null", None), (None, ru), ("ru", ru)]
    import unicodedata

    texts = [ru.upper(), unicodedata.normalize("NFD", fr), ru + "\n" + fr]
    assert run(spark, texts, items) == [(0, "both"), (0, "ru"), (1, "fr"), (2, "both"), (2, "fr"), (2, "ru")]


def test_passages_do_not_cross_documents(spark):
    assert run(spark, [" ".join(W[:6]), " ".join(W[6:12])]) == []


@pytest.mark.parametrize("size", [1, 40])
def test_many_passes_find_the_same(spark, size):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=30))) for k in range(12)]
    texts = [" ".join(rng.choices(vocabulary, k=15)) + " " + " ".join(rng.choice(items)[1].split()[rng.randrange(15) :][: rng.randrange(8, 16)]) for _ in range(60)]
    want = set()
    for d, t in enumerate(texts):
        w = words(t)
        for name, text in items:
            v = words(text)
            grams = {tuple(v[i : i + 12]) for i in range(len(v) - 11)}
            if any(tuple(w[i : i + 12]) in grams for i in range(len(w) - 11)):
                want.add((d, name))
    assert run(spark, texts, items, grams_per_pass=size) == sorted(want) and want


def test_hashes_do_not_depend_on_place():
    h = Hasher(2)
    a, *_ = h.windows(["one two three"])
    b, text, start, end = h.windows(["zz", "x one two three"])
    assert set(a) <= set(b) and list(text) == [1, 1, 1] and (start[1], end[1]) == (2, 9)


def test_empty_items(spark):
    assert run(spark, [ITEM], [("x", None)]) == []
    assert not Grams([], 12).scanner()([ITEM])
    assert variants("a &amp; b")[-1] == "a & b"
