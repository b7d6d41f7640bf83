"""Where the prose of a repository file lies: paragraphs of text files, comments and docstrings of source files.

The kind of a file is told from its text; its name only settles what the text leaves open. A paragraph is a list of
(start, end) pieces of the text, one a line, without list, quote and comment marks.
"""

from __future__ import annotations

import re

Pieces = list[tuple[int, int]]

LINE = re.compile(r"([^\r\n]*)(?:\r\n|\n|\r|\Z)")
BLANK = "\ufeff \t\f\v\u00a0\u3000\u200b"

#: The family that a file's name declares.
FAMILIES = {
    "md": "text", "markdown": "text", "rst": "text", "restructuredtext": "text", "txt": "text", "text": "text", "LICENSE": "text", "COPYING": "text", "NOTICE": "text",
    "json": "data", "jsonl": "data", "csv": "data", "tsv": "data", "xml": "data",
    "py": "python", "python": "python", "sh": "hash", "shell": "hash", "bash": "hash", "yml": "hash", "yaml": "hash", "toml": "hash",
    "js": "c", "javascript": "c", "ts": "c", "typescript": "c", "java": "c", "c": "c", "h": "c", "cpp": "c", "go": "c", "rs": "rust", "rust": "rust",
    "css": "css", "sql": "sql",
}

#: Literal signs of each family, counted in the text.
SIGNS = {
    "python": ("\ndef ", "\nimport ", "\nfrom ", " is None:\n", " in range(", "\n    return ", "):\n", "logger.", "    assert ", "\nclass ", "for x in ", "self."),
    "c": (";\n", "{\n", "}\n", "\nfunc ", ":= ", "const ", " => ", "#include <", "#endif", "\npackage ", "\nimport {", "if (", "for (", "function ", "return nil", "public ", "});", "nil {"),
    "rust": ("\nuse crate", "pub fn ", "let mut ", "Some(", "&str", ")?;", "fn ", "let ", "#[derive", " -> ", "!(\""),
    "sql": ("SELECT ", " FROM ", "CREATE VIEW", "UNION ALL", "WHERE ", "GROUP BY", "JOIN ", "INSERT INTO", "CREATE TABLE"),
    "hash": ("local ", "() {\n", "\nfi\n", "\ndone", "echo ", "=\"${", "$(", " then\n", "[ \"$", "; do\n", "    fi\n", "set -e", "esac\n"),
    "css": ("{color:", ";margin:", "px ", "em}", "color: #", "margin: ", "padding:", "{margin", "{\n  "),
}

FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})", re.M)
UNDERLINE = re.compile(r"[ \t]*([=\-~^\"*+#`':.])\1{2,}[ \t]*\Z")
HEADING = re.compile(r"#{1,6}(?:[ \t]|\Z)")
ITEM = re.compile(r"(?:[-*+•‣–]|\d{1,4}[.)]|\(?[a-zA-Z0-9]{1,2}\)|[a-z]\.)[ \t]+(?=\S)")
BULLET = re.compile(r"[-*+•‣][ \t]+(?=\S)")
DIRECTIVE = re.compile(r"\.\.[ \t]|\.\.\Z|:\w+:[ \t]")
#: Directives whose body is prose, and the labels of footnotes and citations.
PROSE_DIRECTIVE = re.compile(r"\.\.[ \t]+(?:\[[#*\w.-]+\][ \t]+|(?:note|warning|tip|important|caution|attention|danger|error|hint|seealso|admonition|versionadded|versionchanged|deprecated|todo|epigraph|topic)::[ \t]*)", re.I)
HAS_WORD = re.compile(r"[^\W_]")

COMMENTS = {
    "c": re.compile(r"""//[^\n\r]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n\r])*"|'(?:\\.|[^'\\\n\r])*'|`(?:\\.|[^`\\])*`""", re.S),
    "rust": re.compile(r"""//[^\n\r]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"|'(?:\\.[^'\n\r]{0,8}|[^'\\\n\r])'""", re.S),
    "css": re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n\r])*"|'(?:\\.|[^'\\\n\r])*'""", re.S),
    "sql": re.compile(r"""--[^\n\r]*|/\*.*?(?:\*/|\Z)|'(?:''|[^'\n\r])*'|"[^"\n\r]*\"""", re.S),
    "hash": re.compile(r"""(?<![^\s;])#[^\n\r]*|"(?:\\.|[^"\\])*"|'[^'\n\r]*'""", re.S),
    "python": re.compile(r"""#[^\n\r]*|(?<![\w])[rRuUbBfF]{0,2}(?:\"{3}(?:\\.|[^\\])*?(?:\"{3}|\Z)|'{3}(?:\\.|[^\\])*?(?:'{3}|\Z))|(?<![\w])[rRuUbBfF]{0,2}"(?:\\.|[^"\\\n\r])*"|(?<![\w])[rRuUbBfF]{0,2}'(?:\\.|[^'\\\n\r])*'""", re.S),
}
ASSIGNMENT = re.compile(r"^[ \t]*[\w.\"\[\]]+ = [^\n;{]*[)\]\"\d]$", re.M)
SETTING = re.compile(r"^[ \t]*(?:- )?[A-Za-z_][\w-]*:(?: [^\s,;{}]+| \"[^\"\n]*\"| '[^'\n]*')?$", re.M)
LINE_MARK = {"c": re.compile(r"//+!?"), "rust": re.compile(r"//+!?"), "sql": re.compile(r"--+"), "hash": re.compile(r"#+"), "python": re.compile(r"#+:?")}
STRING = re.compile(r"""([rRuUbBfF]{0,2})(\"{3}|'{3}|"|')""")
OPENS_BODY = re.compile(r"(?:async\s+def|def|class)\b|.*\)\s*(?:->.*)?:\s*\Z")


def declared(path: str | None, prog_lang: str | None) -> str | None:
    name = (path or "").rsplit("/", 1)[-1]
    return FAMILIES.get(name) or FAMILIES.get(name.rsplit(".", 1)[-1].lower() if "." in name else "") or FAMILIES.get(prog_lang or "")


def kind(text: str, path: str | None, prog_lang: str | None) -> str:
    """text, data, python, hash, c, rust, css or sql."""
    said = declared(path, prog_lang)
    body = text.lstrip(BLANK + "\r\n")
    plain = body.replace("\r\n", "\n").replace("\r", "\n") if "\r" in body else body
    first = plain[:1]
    lines = plain.count("\n") + 1
    if first in "{[" and _is_json(plain):
        return "data"
    if first == "<" and (plain.startswith("<?xml") or re.match(r"<[A-Za-z][\w.:-]*(\s[^<>]*)?>\s*<", plain)) and re.search(r"</[A-Za-z][\w.:-]*>\s*\Z", plain):
        return "data"
    if said == "data" and first not in "{[<" and _is_csv(plain):
        return "data"
    if _is_csv(plain) and said != "text":
        return "data"
    outside = _without_fences(plain) if "```" in plain or "~~~" in plain else plain
    scores = {f: sum(outside.count(s) for s in signs) for f, signs in SIGNS.items()}
    if " = " in outside:
        scores["python"] += len(ASSIGNMENT.findall(outside))
    if ":\n" in outside or ": " in outside:
        scores["hash"] += len(SETTING.findall(outside))
    scores["rust"] = scores["rust"] + scores["c"] if scores["rust"] > 0.4 * scores["c"] and ("fn " in outside or "let " in outside) and "function " not in outside and "const " not in outside else 0
    if scores["css"] and not ("{" in outside and ("px" in outside or "em" in outside or "color" in outside)):
        scores["css"] = 0
    if outside.startswith("#!") and ("sh\n" in outside[:40] or "python" in outside[:60]):
        scores["python" if "python" in outside[:60] else "hash"] += 5
    best = max(scores, key=lambda f: (scores[f], f == said))
    top = scores[best]
    full = max(1, sum(1 for s in outside.split("\n") if s.strip()))
    if said in scores and scores[said] >= 0.6 * top and (top or said != "text"):
        if not (said != "text" and top == 0 and _looks_like_text(outside, said)):
            return said
    if top >= 0.22 * full and top >= 2 or (top and lines <= 3 and top >= 3):
        return best
    if said == "text" or said is None or said == "data":
        return "text" if top < 0.22 * full else best
    return said if not _looks_like_text(outside, said) else "text"


def _looks_like_text(plain: str, said: str) -> bool:
    """Whether text under a source file's name is prose: words in lines without any comment mark."""
    marks = {"python": ("#", '"""', "'''"), "hash": ("#",), "sql": ("--", "/*", "*"), "css": ("/*", "*")}.get(said, ("//", "/*", "*"))
    lines = [s.strip() for s in plain.split("\n") if s.strip()]
    if not lines:
        return False
    bare = sum(1 for s in lines if not s.startswith(marks))
    words = sum(1 for s in lines if not s.startswith(marks) and s.count(" ") >= 3 and s[-1:] not in ";{}:,")
    if said in ("python", "hash") and any(s.startswith("# ") for s in lines[:2]) and bare > 0.5 * len(lines) and words > 0.5 * bare:
        return True
    return bare > 0.6 * len(lines) and words >= 0.5 * bare


def _is_json(plain: str) -> bool:
    end = plain.rstrip()[-1:]
    head = re.match(r"[\[{]\s*(?:[\[{]\s*)*(?:\"[^\"\n]*\"\s*[:,\]]|-?\d+(?:\.\d+)?\s*[,\]]|[\]}]|true|false|null)", plain)
    return bool(head) and (end in "]}" or '":' in plain[:200])


def _is_csv(plain: str) -> bool:
    head, _, rest = plain.partition("\n")
    if not re.match(r"[\w\"]+(?:[,;\t][\w\"]+)+\Z", head):
        return False
    return len(re.findall(r"[,;\t]", rest.partition("\n")[0])) >= len(re.findall(r"[,;\t]", head)) or not rest.strip()


def _without_fences(plain: str) -> str:
    out, keep = [], True
    for s in plain.split("\n"):
        if FENCE.match(s):
            keep = not keep
        elif keep:
            out.append(s)
    return "\n".join(out)


def paragraphs(text: str, path: str | None = None, prog_lang: str | None = None) -> list[Pieces]:
    """All paragraphs of prose, in order."""
    what = kind(text, path, prog_lang)
    if what == "data":
        return []
    if what == "text":
        return _blocks([(m.start(1), m.end(1)) for m in LINE.finditer(text)], text, True)
    return _source(text, what)


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in BLANK:
        a += 1
    while b > a and text[b - 1] in BLANK:
        b -= 1
    return a, b


def _blocks(lines: list[tuple[int, int]], text: str, markup: bool) -> list[Pieces]:
    """Paragraphs of lines. ``markup``: headings, fences, tables and quotes count, as in a text file."""
    out: list[Pieces] = []
    now: Pieces = []
    fence = item = None  # item: (indent, mark without digits) of the list item that is open
    quoted, fresh, skip_indent = False, True, None

    def flush() -> None:
        nonlocal now
        if now:
            out.append(now)
            now = []

    for i, (a0, b0) in enumerate(lines):
        a, b = _trim(text, a0, b0)
        if a == b:
            flush()
            quoted, fresh = False, True
            continue
        c = text[a]
        if markup:
            if c in "`~" and (m := FENCE.match(text[a:b])):
                mark = m.group(1)
                if fence is None:
                    flush()
                    fence = mark
                elif mark[0] == fence[0] and len(mark) >= len(fence) and b - a == len(mark):
                    fence = None
                fresh = True
                continue
            if fence is not None:
                continue
            if skip_indent is not None:
                if a - a0 > skip_indent:
                    continue
                skip_indent = None
            if c == "#" and a - a0 < 4 and HEADING.match(text[a:b]):
                flush()
                item, fresh = None, True
                continue
            if c == "|" or c == "+" and text.startswith("+-", a):
                flush()
                fresh = True
                continue
            if c in "=-~^\"*+#`':." and UNDERLINE.match(text, a, b) or c == "-" and text.startswith("- - -", a):
                if len(now) == 1 and c in "=-~^\"*+#`'" and not quoted and out is not None and item is None:
                    now = []  # the line above was a heading
                flush()
                item, fresh = None, True
                continue
            if c == "." and text.startswith("..", a) and DIRECTIVE.match(text[a:b]):
                flush()
                fresh = True
                if not (m := PROSE_DIRECTIVE.match(text[a:b])):
                    skip_indent = a - a0
                elif a + m.end() < b:
                    now.append((a + m.end(), b))
                    fresh = False
                continue
            if c == "<" and text.startswith("<!--", a):
                pass
            if c == ">":
                if not quoted:
                    flush()
                    fresh = True
                quoted = True
                while a < b and text[a] in "> \t":
                    a += 1
                if a == b:
                    flush()
                    fresh = True
                    continue
                c = text[a]
            elif quoted:
                flush()
                quoted, fresh = False, True
        if (c in "-*+•‣–(" or c.isdigit() or c.isalpha() and text[a + 1 : a + 2] in ").") and (m := ITEM.match(text[a:b])):
            mark, indent = re.sub(r"\w+", "1", m.group().strip()), a - a0
            number = re.sub(r"\D", "", m.group())
            bullet = c in "-*+•‣–"
            follows = item is not None and item[1] == mark and abs(item[0] - indent) < 2 and (not number or not item[2] or int(number) == int(item[2]) + 1)
            lone_letter = c.isalpha() and text[a + 1] == "."
            if (fresh or bullet or follows) and not (lone_letter and not follows):
                flush()
                item = (indent, mark, number)
                a += m.end()
                fresh = False
                now.append((a, b))
                continue
        if fresh and item is not None and a - a0 <= item[0] and not now:
            item = None
        fresh = False
        now.append((a, b))
    flush()
    return [p for p in out if any(HAS_WORD.search(text, x, y) for x, y in p)]


def _source(text: str, what: str) -> list[Pieces]:
    out: list[Pieces] = []
    run: list[tuple[int, int]] = []  # lines of a block of comment lines
    run_end = -1
    code_before, last_code, at = False, "", 0  # what is before the match, for docstrings

    def close() -> None:
        nonlocal run
        if run:
            out.extend(_blocks(run, text, False))
            run = []

    line_mark = LINE_MARK.get(what)
    for m in COMMENTS[what].finditer(text):
        a, b = m.span()
        c = text[a]
        comment = line_mark is not None and line_mark.match(text, a) is not None and (c != "/" or text.startswith("//", a))
        if not comment and not (c == "/" and text.startswith("/*", a)):
            if what == "python":
                s = STRING.match(text, a)
                start = max(text.rfind("\n", 0, a), text.rfind("\r", 0, a)) + 1
                if s and not text[start:a].strip(BLANK) and not set("bBfF") & set(s.group(1)):
                    before = _last_statement(text, at, start, last_code)
                    if not before and not code_before or before and OPENS_BODY.match(before) and before.endswith(":"):
                        rest = text[b : b + 1]
                        if rest in ("", "\n", "\r", " ", ";", "\t", "#"):
                            close()
                            n = len(s.group(2))
                            inner_end = b - n if text[a:b].endswith(s.group(2)) and b - a >= len(s.group()) + n else b
                            out.extend(_blocks(_lines(text, s.end(), inner_end), text, False))
                last_code = text[a:b][-200:]
                code_before, at = True, b
            continue
        if what == "python":
            gap = text[at:a]
            if gap.strip(BLANK + "\r\n"):
                code_before = True
                last_code = _last_statement(text, at, a, last_code) or last_code
            at = b
        start = max(text.rfind("\n", 0, a), text.rfind("\r", 0, a)) + 1
        own = not text[start:a].strip(BLANK)
        if c == "/" and text.startswith("/*", a):
            close()
            inner = b - 2 if b - a >= 4 and text.endswith("*/", a, b) else b
            lines = []
            for k, (x, y) in enumerate(_lines(text, a + 2, inner)):
                while x < y and text[x] in BLANK:
                    x += 1
                if k == 0:
                    while x < y and text[x] in "*!":
                        x += 1
                elif x < y and text[x] == "*" and not (x + 1 < y and text[x + 1] == "*" and x + 2 < y and text[x + 2].isalnum()):
                    x += 1
                    while x < y and text[x] == "*":
                        x += 1
                while y > x and text[y - 1] in BLANK + "*" and (text[y - 1] != "*" or y == inner):
                    y -= 1
                lines.append((x, y))
            out.extend(_blocks(lines, text, False))
            continue
        if text.startswith("#!", a) and own and (start == 0 or not text[:start].strip(BLANK + "\r\n")) and what in ("hash", "python"):
            continue
        x = line_mark.match(text, a).end()
        if not own:
            close()
            out.extend(_blocks([(x, b)], text, False))
            run_end = -1
            continue
        if run and not _adjacent(text, run_end, start):
            close()
        run.append((x, b))
        run_end = b
    close()
    out.sort(key=lambda p: p[0][0])
    return out


def _adjacent(text: str, end: int, start: int) -> bool:
    """Whether just one line end lies between."""
    return text[end:start] in ("\n", "\r\n", "\r")


def _lines(text: str, a: int, b: int) -> list[tuple[int, int]]:
    out = []
    for m in LINE.finditer(text, a, b):
        out.append((m.start(1), m.end(1)))
        if m.end() >= b:
            break
    return out


def _last_statement(text: str, a: int, b: int, before: str) -> str:
    """The last line of code in [a, b), or what came before it."""
    gap = text[a:b].rstrip(BLANK + "\r\n")
    if not gap.strip(BLANK + "\r\n"):
        return before
    line = re.split(r"[\r\n]", gap)[-1]
    full = max(text.rfind("\n", 0, a + len(gap)), text.rfind("\r", 0, a + len(gap))) + 1
    return text[full : a + len(gap)].strip() if line.strip() else before
