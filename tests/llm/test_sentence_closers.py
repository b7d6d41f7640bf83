"""Sentences that end in a quotation mark or a bracket; ⟦ and ⟧ stand around each unit."""

import pytest

from tidemark.llm.sentences import sentence_spans


def check(marked):
    text = marked.replace("⟦", "").replace("⟧", "")
    want = [u.split("⟧")[0] for u in marked.split("⟦")[1:]]
    assert [text[a:b] for a, b in sentence_spans(text, "a.md")] == want


QUOTATIONS = [
    "⟦他说：“先合并，再写入。”⟧⟦请不要手动修改a.json！⟧", "⟦他说：“先合并，再写入。”⟧⟦（另见a.json。）⟧⟦他说：“先合并，再写入。”⟧⟦他说：“先合并，再写入。”⟧", "⟦他说：“先合并，再写入。”⟧⟦等等……还开着！⟧", "⟦他问：“为什么？”⟧⟦没有人回答。⟧",
    "⟦程序显示“记录丢失。是否重试？”然后等待输入。⟧⟦完了。⟧", "⟦程序显示“记录丢失。是否重试？”等待输入。⟧", "⟦“先合并。”他说。⟧", "⟦画面に「行がありません。再試行しますか？」と表示されます。⟧⟦終わりです。⟧", "⟦彼は言う：「先に併合する。」⟧⟦次に書きます。⟧",
    "⟦उसने कहा: \"पहले जोड़ें।\"⟧ ⟦यह सही है।⟧", "⟦قال: «ادمج أولا.»⟧ ⟦هذا صحيح.⟧",
]


@pytest.mark.parametrize("marked", QUOTATIONS)
def test_quotations(marked):
    check(marked)


SMALL = [
    "⟦(See also No. 6 in the list.)⟧ ⟦emit_rate returns early.⟧", "⟦It runs.⟧ ⟦(See No. 6.)⟧ ⟦mergeCohort returns early.⟧", "⟦*(See a.py.)*⟧ ⟦emit_rate returns early.⟧", "⟦He says: \"Merge first.\"⟧ ⟦emit_rate returns early.⟧", "⟦it is so.⟧ ⟦(see the list.)⟧ ⟦they go on.⟧",
    "⟦It is flat (under 5 KB!) in all runs.⟧", "⟦It is flat (under 5 KB!) emit_rate says.⟧", "⟦Ask Mo (Ph.D.) about it.⟧", "⟦He asks \"Lost. Retry?\" and waits.⟧", "⟦He says: \"Merge first.\" and waits.⟧",
]


@pytest.mark.parametrize("marked", SMALL)
def test_small_letters_and_code(marked):
    check(marked)


def test_hostile_quotes_are_linear():
    text = "He says “a.” b" * 5_000 + "„" * 20_000 + "x.” 他" * 5_000
    assert sentence_spans(text, "a.txt")[-1][1] == len(text)
