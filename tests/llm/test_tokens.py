"""Encoding against the tokenizer library, and its round trip."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.tokens import DEFAULT_PATH, Vocabulary, decode, encode

TEXTS = [
    None, "", " ", "\n\n", "   \t \r\n x", "Hello, world! It's 3.14 o'clock; we'll see they're I'd", "<|endoftext|> is text <s></s>", "สวัสดีครับ ทุกคน", "नमस्ते दुनिया", "你好，世界！等等……", "こんにちは。", "Привет, мир!", "مرحبا بالعالم",
    "﻿bom", "a b　c d\u0085e", "zero​width ­soft", "👩‍🔬🚀 é é ½ Ⅷ ٣", "=" * 1000, "a" * 3000, "x y " * 2000, "\x00\x01\x7f", "def f(x):\n    return x**2  # 平方\n", "'S 'T 's's ''ll", "𝒳𝓎 𠀀", "the mark \uffff in\uffff a text \uffff\uffff",
]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(DEFAULT_PATH)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(spark, tokenizer):
    rows = [(i, t, "extra", 0) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "extra", 0), (None, "null id", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string, kind int")
    got = encode(df, docs_per_block=3)
    out = got.collect()
    assert len(out) == len(rows)
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)} | {None: tokenizer.encode("null id").ids}
    for r in out:
        assert r["ids"] == want[r["doc_id"]], TEXTS[r["doc_id"]] if r["doc_id"] is not None else None


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    back = encode(df).select("doc_id", decode(F.col("ids"), Vocabulary()).alias("back"))
    assert {r["doc_id"]: r["back"] for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_nothing(spark):
    assert encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_the_mark_in_a_text_and_hot_ids(spark, tokenizer):
    rows = [(7, f"a \x1e mark {i}\x1e\x1e") for i in range(9)] + [(None, f"no id {i % 3}") for i in range(9)] + [(7, "plain")] * 3
    got = encode(spark.createDataFrame(rows, "doc_id bigint, text string"), docs_per_block=2, bytes_per_block=16).collect()
    want = sorted((str(d), tokenizer.encode(t).ids) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want


def test_long_words_take_little_time(spark, tokenizer):
    import random
    import string
    import time

    rng = random.Random(1)
    words = ["".join(rng.choices(string.ascii_letters, k=32_000)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(6000)), "ab" * 20_000, "a" * 32_000, "-=" * 5000]
    for word in words:
        df = spark.createDataFrame([(1, word)], "doc_id bigint, text string").coalesce(1)
        began = time.time()
        ids = encode(df).first()["ids"]
        assert time.time() - began < 30, len(word)
        assert ids == tokenizer.encode(word).ids
