"""Sentence units on marked texts: ⟦ and ⟧ stand around each."""

import pytest

from tidemark.llm.prose import kind
from tidemark.llm.sentences import sentence_spans, sentences

CASES = {
    "a.md": [
        "# Title. Not prose\n\n⟦Wait... the batch is open!⟧ ⟦Is 893.24 too high?!⟧ ⟦We close it … and then drop it.⟧\n", "⟦Ask Prof. Vorkel (Ph.D.) about it.⟧ ⟦The name \"St. Mo\" is kept.⟧ ⟦See sec. 3.4 and fig. 2 for more.⟧\n", "- ⟦hot path⟧\n- ⟦No. 3 is unused.⟧ ⟦It costs 5 ms.⟧\n  ⟦Set it.⟧\n",
        "> ⟦It stops at 2 p.m.⟧ ⟦No. 21 starts at\n> 1 a.m. and ends.⟧\n", "```go\nnot. Prose.\n```\n⟦After the fence.⟧\n", "| a. B | c |\n|---|---|\n\n⟦Text.⟧\n", "⟦He asks \"Lost. Retry?\" and waits.⟧ ⟦(See also No. 4.)⟧ ⟦Memory is flat (under 5 KB!) in all runs.⟧\n", "⟦We support v1.2, v5.8.11.13, etc.⟧ ⟦split_row returns early.⟧ ⟦`x.y()` too.⟧\n",
        "Heading\n=======\n\n⟦Text one.⟧\n", "⟦Am 13. März 2017 kam es.⟧ ⟦Das dauert ca. 9,3 s, z. B. nachts.⟧ ⟦Er meldet „Satz fehlt. Abbruch?“ und wartet.⟧\n", "⟦El Sr. Mo y la Dra. Bo ven.⟧ ⟦Termina a las 4 p. m.⟧ ⟦¿Por qué?⟧ ⟦Tarda, p. ej. en casa.⟧\n", "⟦Il affiche « Erreur. Recommencer ? » puis s'arrête.⟧ ⟦Pourquoi 781,82 ?⟧ ⟦Oui.⟧\n",
        "⟦Модуль написал N. N. Велморин в 2016 г. для склада.⟧ ⟦Есть csv и т. д.⟧ ⟦(См. также п. 25.)⟧\n", "⟦程序显示“记录丢失。是否重试？”然后等待。⟧⟦（另见a.json。）⟧⟦v2.1完了。⟧⟦等等……还开着！⟧\n", "⟦ระบบเริ่มเมื่อ⟧ ⟦พ.ศ. 1076 และทำงาน⟧ ⟦แต่ละหน้า 42 แถว⟧\n", "⟦इसमें 69 मि.से. लगते हैं।⟧ ⟦डॉ. वेल ने लिखा है।⟧\n", "⟦كتب د. فلمورا هذا.⟧ ⟦لماذا؟⟧\n", "﻿⟦first words. ⟧⟦they go on.⟧\n".replace(" ⟧", "⟧ "),
        "1. ⟦One.⟧\n2. ⟦Two\n   lines.⟧\n\n⟦See part\n12. The end.⟧\n".replace("12. The end", "twelve"), "\r\n\r\n⟦A line\r\nand more.⟧\r\n⟦Next.⟧\r\n",
    ],
    "a.py": ["#!/usr/bin/env python\n# ⟦Copyright (c) 2012 Bo Inc.⟧\n#\n# ⟦SPDX-License-Identifier: X-1.0⟧\n\nimport os\n\ndef f(a):\n    \"\"\"⟦Does it. ⟧⟦Twice.⟧\n\n    ⟦Really.⟧\n    \"\"\"\n    x = \"# no. Not this.\"  # ⟦yes, this⟧\n    y = '''No. Never.'''\n    # ⟦Two lines\n    # of one.⟧\n    return x\n".replace(" ⟧⟦", "⟧ ⟦")],
    "a.js": ["import { a } from './b.js';\n\n/**\n * ⟦Why?⟧ ⟦It needs\n * a pass.⟧\n *\n * ⟦Again.⟧\n */\nfunction f() {\n    const u = 'https://x.example/y';\n    return u;  // ⟦tail⟧\n    // ⟦own line⟧\n}\n"],
    "a.sql": ["-- ⟦One.⟧ ⟦Two.⟧\n\nSELECT a FROM t WHERE b <> 'x -- no'\n/* ⟦Three.⟧ */\n;\n"], "a.sh": ["#!/bin/sh\n# ⟦Set it.⟧\nlocal n=\"${#x}\"\necho \"# no\"  # ⟦done⟧\nfi\n"], "a.css": [".a{color:#123456;margin:2px}\n/* ⟦A note.⟧ */\n"],
    "a.rs": ["use crate::a::b;\n\n/// ⟦Reads it.⟧ ⟦Twice.⟧\npub fn f(x: &'a str) -> Option<u64> {\n    let c = 'x';  // ⟦it's a char⟧\n    Some(1)\n}\n"],
    "a.json": ['{"a": "One. Two."}'], "a.csv": ["id,name\n1,One. Two.\n"], "a.xml": ["<a>\n  <b>One. Two.</b>\n</a>\n"], "LICENSE": ["⟦Terms 2.1⟧\n\n(a) ⟦Is it free?⟧ ⟦The seat of Bo Inc. decides.⟧\n"], "wrong.md": ["import { a } from './b.js';\nconst x = 1;\nlet y = 'z';\n// ⟦Only this.⟧\nfunction f() {\n    return 1;\n}\n"],
}


@pytest.mark.parametrize("name,marked", [(n, t) for n, texts in CASES.items() for t in texts])
def test_units(name, marked):
    text = marked.replace("⟦", "").replace("⟧", "")
    want, at, opened = [], 0, None
    for c in marked:
        if c == "⟦":
            opened = at
        elif c == "⟧":
            want.append((opened, at))
        else:
            at += 1
    got = sentence_spans(text, name)
    assert [text[a:b] for a, b in got] == [text[a:b] for a, b in want] and got == want


@pytest.mark.parametrize("text", [None, "", "  \n\t", "﻿", "　\n", "----\n====\n", "\x00"])
def test_nothing(text):
    assert sentence_spans(text, "a.txt") == []


def test_kinds_come_from_the_text():
    assert kind("def f(x):\n    return 1\n\nimport os\n", "a.js", "javascript") == "python"
    assert kind("Just some words here. And more.\n\nAnother paragraph.\n", "a.py", "python") == "text"
    assert kind("A plain note.", None, None) == "text" and kind('[\n {"a": 1}\n]', "a.md", "markdown") == "data"


def test_long_texts_are_linear():
    text = "One (two. Three " * 20_000 + "end.\n"
    spans = sentence_spans(text, "a.txt")
    assert spans and spans[0][0] == 0 and spans[-1][1] == len(text.rstrip())
    assert len(sentence_spans("It is so. " * 30_000, "a.txt")) == 30_000


def test_operator(spark):
    rows = [(1, "One. Two.", "a.txt", None, 5), (2, None, "a.txt", "text", 5), (3, "One.", None, None, 5), (None, "Three.", "a.txt", None, 5), (1, "One. Two.", "a.txt", None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, path string, prog_lang string, start_char int")
    got = sorted((tuple(r) for r in sentences(df).collect()), key=str)
    assert got == sorted([(1, 0, 4), (1, 5, 9), (1, 0, 4), (1, 5, 9), (3, 0, 4), (None, 0, 6)], key=str)
    assert sentences(df.filter("false")).count() == 0
