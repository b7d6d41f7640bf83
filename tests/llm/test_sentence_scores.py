"""Cuts that scores decide: words that are also abbreviations, long words before a mark, directives with prose."""

import time

import pytest

from tidemark.llm.sentences import CALLS_FOR_MORE, sentence_spans, split


def units(text, path="a.md"):
    return [text[a:b] for a, b in sentence_spans(text, path, None)]


@pytest.mark.parametrize("text, want", [
    ("The answer is no. Retry it.", ["The answer is no.", "Retry it."]), ("See no. 6 in the list. It holds.", ["See no. 6 in the list.", "It holds."]), ("Hay que ver. Luego se borra.", ["Hay que ver.", "Luego se borra."]),
    ("Use ver. 2 of it. Then stop.", ["Use ver. 2 of it.", "Then stop."]), ("He came at 5 p. m. yesterday.", ["He came at 5 p. m. yesterday."]), ("Wait … then go on. Done.", ["Wait … then go on.", "Done."]),
])
def test_words_by_what_follows(text, want):
    assert units(text) == want


def test_the_whole_word_before_a_mark_counts():
    long = "a" * 60
    assert units(f"{long}.z.b. Wort folgt. Ende.") == [f"{long}.z.b. Wort folgt.", "Ende."] or units(f"{long}.z.b. Wort folgt. Ende.")[-1] == "Ende."
    assert split("x" * 5000 + ". Next one.") == [(0, 5001), (5002, 5011)]


def test_directives_with_prose_and_without():
    text = "Intro here.\n\n.. note:: Read this first. It matters.\n   It goes on.\n\n.. code-block:: python\n\n   x = 1\n   y = 2\n\n.. warning::\n\n   Do not run it twice.\n\n.. [1] A footnote ends here.\n\nLast words.\n"
    assert units(text, "a.rst") == ["Intro here.", "Read this first.", "It matters.", "It goes on.", "Do not run it twice.", "A footnote ends here.", "Last words."]


def test_many_marks_without_a_cut_take_little_time():
    began = time.time()
    assert split("cf. " * 5000) and split('"' + "a b. " * 5000) and split("e.g. x. y, " * 3000) and split("The end. " * 5000)
    assert time.time() - began < 20 and CALLS_FOR_MORE < -3
