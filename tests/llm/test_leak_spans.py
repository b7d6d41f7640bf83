"""Places of leaked passages, their removal, markup of any length, and both ways of searching."""

import random
import time

import pytest

from tidemark.llm import leaks as lk
from tidemark.llm.leaks import TAG, cut, leak_spans, leaks, variants, without_leaks, without_spans, words

W = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
TWELVE = " ".join(W[:12])
WAYS = (1, 200_000)  # by shuffle, and by broadcast


def tables(spark, texts, items=(("i", " ".join(W)),)):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(list(items), "item_id string, text string")


def pairs(df):
    return sorted((r["doc_id"], r["item_id"]) for r in df.collect())


MARKUP = [
    f'alpha <b class="{"a" * 5000}">beta</b> ' + " ".join(W[2:12]), "alpha <my-widget:x-1 a=1>beta</my-widget:x-1> " + " ".join(W[2:12]), 'alpha <a title="a > b">beta</a> ' + " ".join(W[2:12]), "al<b>pha</b><br/>beta<p>" + " ".join(W[2:12]),
    "<p>x</p><!-- " + "&quot;".join(W[:12]) + " -->", "<i>x</i> alpha <!-- a note of <b>some</b> words --> " + " ".join(W[1:12]), "alpha <!-- " + " ".join(W[1:12]), "&lt;b&gt;alpha&lt;/b&gt; &lt;i&gt;" + " ".join(W[1:12]), "&#0000000000032;".join(W[:12]),
    "&#" + "9" * 6000 + "; " + TWELVE + " <b>",
]


@pytest.mark.parametrize("text", MARKUP)
@pytest.mark.parametrize("size", WAYS)
def test_markup_of_any_length(spark, text, size):
    assert pairs(leaks(*tables(spark, ["no", text]), grams_per_pass=size)) == [(1, "i")]


def test_markup_takes_linear_time():
    for text in ("<" * 200_000, "<!--" * 50_000, "<a b=" * 40_000, "<a ='" * 40_000, '<a b="c' * 30_000, "&" * 200_000, "&#x" * 60_000, "\\" * 200_000):
        began = time.time()
        assert variants(text + " end")
        assert time.time() - began < 5, text[:8]
    assert TAG.sub("", '<a href="x" b>y</a >z<br/>') == "yz" and TAG.sub("", "a < b > c <3 <-x>") == "a < b > c <3 <-x>"


@pytest.mark.parametrize("size", WAYS)
def test_repeats_count_once(spark, size):
    docs, items = tables(spark, [TWELVE, TWELVE, "x"], [("i", TWELVE), ("i", TWELVE), ("i", TWELVE + " nu"), ("j", None), (None, TWELVE)])
    twice = docs.union(docs).union(docs.filter("doc_id = 0").selectExpr("cast(null as bigint) as doc_id", "text"))
    got = leaks(twice, items, grams_per_pass=size).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == [(0, "i"), (1, "i"), (None, "i")]


DISGUISED = ["see " + TWELVE + " end", "// " + "\n// ".join(W[:12]) + "\ncode", 'x = "' + "\\n".join(W[:12]) + '";', "<p>" + "</p>\n<p>".join(W[:12]) + "</p>", "á " + " ".join(w.replace("e", "­e") for w in W[:12]) + " Å", " ".join("".join(chr(ord(c) + 0xFEE0) for c in w) for w in W[:12]) + " ﬁn",
             "&amp; " + "&nbsp;".join(W[:12]) + " &lt;"]


@pytest.mark.parametrize("size", WAYS)
def test_places_lie_in_the_text_as_it_is(spark, size):
    docs, items = tables(spark, DISGUISED)
    got = {r["doc_id"]: (r["start_char"], r["end_char"]) for r in leak_spans(docs, items, grams_per_pass=size).collect()}
    assert sorted(got) == list(range(len(DISGUISED)))
    for d, (a, b) in got.items():
        first, last = words(variants(DISGUISED[d][a:b])[-1])[0], words(variants(DISGUISED[d][a:b])[-1])[-1]
        assert (first, last) == ("alpha", "mu"), DISGUISED[d][a:b]
    assert (got[0], DISGUISED[0][slice(*got[0])]) == ((4, 4 + len(TWELVE)), TWELVE)


@pytest.mark.parametrize("size", WAYS)
def test_cut_leaves_no_passage(spark, size):
    rows = [(d, t, d % 2) for d, t in enumerate([*DISGUISED, None, "", "clean " + " ".join(W[:11]), " ".join(W[:11]) + " " + " ".join(W) + " " + " ".join(W[11:])])]
    docs = spark.createDataFrame([*rows, (None, TWELVE, 7), (0, "zz", 8)], "doc_id bigint, text string, digest int")
    items = spark.createDataFrame([("i", " ".join(W))], "item_id string, text string")
    out = without_spans(docs, items, grams_per_pass=size)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert out.columns == docs.columns and len(got) == len(rows) + 2
    assert leaks(out, items).count() == 0
    assert {(len(DISGUISED), None, len(DISGUISED) % 2), (0, "see  [removed]  end", 0), (None, " [removed] ", 7), (0, "zz", 8)} <= set(got)
    kept = without_leaks(docs, items, grams_per_pass=size)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, len(DISGUISED), len(DISGUISED) + 1, len(DISGUISED) + 2]


def test_both_ways_and_a_plain_search_agree(spark, monkeypatch):
    monkeypatch.setattr(lk, "ROWS_PER_TASK", 5)  # so that common windows are salted
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=20))) for k in range(8)]
    texts = [" ".join(rng.choices(vocabulary, k=10)) + " " + " ".join(items[0][1].split()[:13] if k % 3 == 0 else rng.choice(items)[1].split()[rng.randrange(8) :]) + " tail" for k in range(60)]
    want_spans = set()
    for d, text in enumerate(texts):
        at, w = [0], text.split()
        for x in w:
            at.append(at[-1] + len(x) + 1)
        for name, item in items:
            v = item.split()
            grams = {tuple(v[i : i + 12]) for i in range(len(v) - 11)}
            runs = []
            for i in range(len(w) - 11):
                if tuple(w[i : i + 12]) in grams:
                    a, b = at[i], at[i + 12] - 1
                    if runs and a <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], b)
                    else:
                        runs.append((a, b))
            want_spans |= {(d, name, *r) for r in runs}
    docs, table = tables(spark, texts, items)
    for size in WAYS:
        assert {tuple(r) for r in leak_spans(docs, table, grams_per_pass=size).collect()} == want_spans
        assert pairs(leaks(docs, table, grams_per_pass=size)) == sorted({s[:2] for s in want_spans})
        cleaned = {r["doc_id"]: r["text"] for r in without_spans(docs, table, filler="#", grams_per_pass=size).collect()}
        assert cleaned == {d: cut(t, [s[2:] for s in want_spans if s[0] == d], "#") if any(s[0] == d for s in want_spans) else t for d, t in enumerate(texts)}


@pytest.mark.parametrize("size", (0, 200_000))
def test_nothing_to_search_or_to_find(spark, size):
    docs, items = tables(spark, [TWELVE, None])
    assert leaks(docs, items.filter("false"), grams_per_pass=size).count() == 0
    assert leaks(docs.filter("false"), items, grams_per_pass=size).count() == 0
    assert leak_spans(docs.filter("false"), items, grams_per_pass=size).count() == 0
    assert without_spans(docs, items.filter("false"), grams_per_pass=size).count() == 2
