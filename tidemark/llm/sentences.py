"""Sentence units by semi-Markov dynamic programming over whole spans.

Candidate ends are all marks that white space or a wide script follows, and (in Thai) spaces. A segmentation of a
paragraph is scored by its spans: the closing word and the opening word at each cut, the span's length, and whether
quotation marks and brackets are balanced within it. The best sum over all segmentations wins; nothing but a score
forbids a cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.prose import BLANK, Pieces, paragraphs

#: Abbreviations that need what follows them (lower case, without the last period).
NEVER = frozenset("""
i.e e.g cf vs viz no nos fig figs sec secs ch chap eq vol pp p dr mr mrs prof st mt rev gen approx ca c incl excl min max rel ed eds ver resp est dept
z.b d.h u.a z ca abb nr bzw vgl inkl exkl bspw ggf hr fr kap abs bd tel
p.ex p.ej c.-à-d m mme mlle mm env art pág págs núm núms sr sra srta dra aprox cap ej ex
т т.е рис табл п пп ок см ср гл напр г-н г-жа им ул стр
د डॉ श्री प्रो
""".split())
#: Case counts: ms. is a unit, Ms. a title.
NEVER_AS_WRITTEN = frozenset(["Ms", "Mx", "Messrs", "M", "Abs", "No", "St"])
#: Abbreviations that may also end a sentence.
SOMETIMES = frozenset("""
etc al inc ltd co corp llc a.m p.m ph.d b.sc m.sc u.k u.s u.s.a u.t.c u.n usw u.s.w uhr jr sr.ltd a.d b.c
т.д т.п руб коп тыс млн млрд г гг в вв д др pm am
""".split())
ORDINAL_BEFORE = frozenset("am vom zum im der die das des den dem beim ab bis seit".split())

CLOSERS = r"""["'”’“»)\]}」』）】〉》*_]"""
MARK = re.compile(rf"(?:[.!?…。！？।॥؟．｡]+)(?:[ \u00a0\u202f]?»|{CLOSERS})*|(?<=[\u0e01-\u0e5b]) +(?=[\u0e01-\u0e5b])")
PAIRS = re.compile(r"""["“”„«»‟「」『』()\[\]（）【】`]""")
OPEN, CLOSE = dict(zip("«「『([（【", "»」』)]）】")), dict(zip("»」』)]）】", "«「『([（【"))
WORD_STARTS = frozenset(" \t\n\r\f\v\u00a0\u202f\u3000\u2003\u2009([{\"“„«»（「『”’`")
#: Abbreviations that are also words, which end a sentence where neither a number nor a small letter follows.
ALSO_WORDS = frozenset("no art ver".split())
#: What a cut loses: after a word or before a sign that calls for more; after dots of omission in a running sentence.
CALLS_FOR_MORE, RUNS_ON = -10.0, -10.0
CODE_LIKE = re.compile(r"`|[A-Za-z]\w*(?:[._]\w+)+|[a-z]+\w*[A-Z]\w*|\w+\(|https?://|--?\w")
CUT, UNBALANCED = 3.0, -4.5
#: What a span loses for each character above 400, and the most that a bracket at its end can take away.
PER_CHARACTER, BRACKET = 0.001, 6.0
QUOTES = re.compile(r'["“”„«»‟「」『』‘’]')
STOPS = ".。．｡।॥"
QUOTE_OF = {"”": "“„", "‟": "“„", "»": "«", "」": "「", "』": "『", "’": "‘"}
#: What introduces a quotation, directly before it.
INTRODUCES = re.compile(
    r"""(?:[:：]|(?:\b(?:said|says?|asks?|asked|answers?|answered|repl(?:y|ies|ied)|writes?|wrote|tells?|told|adds?|added|sagte?|schreibt|schrieb|fragte?|dit|demande|écrit|dice|dijo|escribe|pregunta|говорит|сказала?|пишет|написала?|спрашивает|спросила?)"""
    r"""|(?<!小)[说說]|[问問答喊]|[说說问問答喊写寫]道|ว่า|कह[ाते]+(?: है)?|बोला|पूछा|قالت?|[يت]قول|سأل)[,，،]?)[\s\u3000]*\Z"""
)
#: What goes on with the sentence after a quotation.
GOES_ON = re.compile(
    r"""然[后後]|接着|[随隨][后後]|之[后後前]|[后後](?![来來者面续續])|[时時](?![间間常候刻])|[的了和]|[与與](?!此)|或|以?及|而|[并並](?![非不没])|就|便|才|[则則]|字[样樣]|一[词詞句]|等(?![等待到])"""
    r"""|と(?!て|ころ|りわけ|に|も)|って|[をへに]|の(?!ち)|は(?!い|じ)|が(?!ん)|も(?!し|ち|う)|や(?!は|め)|から|まで|より|など|なら|で|だ(?!が|け)|(?:이?라|하)(?:고|는|며)"""
    r"""|แล้ว|และ|หรือ|ก่อน|ซึ่ง|ที่|จาก|(?:और|तथा|या|फिर|कि|को|क[ेीा]|से|में|पर|तो|ही|भी|ثم|أو|في|من|على|إلى)(?!\w)"""
    r"""|(?:and|or|but|then|while|when|before|after|as|to|in|on|at|if|for|with|from|by|is|was|und|oder|aber|dann|et|ou|mais|puis|y|e|o|pero|luego|и|или|а|но|затем|потом)(?!\w)"""
)
SAYS = re.compile(r"[他她它我你]?[们們]?(?:[说說问問答喊]道?|[写寫]道)(?![:：])")


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x370 <= o < 0x590 or 0x1E00 <= o < 0x2000:
        return "cased"
    if 0x0900 <= o < 0x0980:
        return "deva"
    if 0x0E00 <= o < 0x0E80:
        return "thai"
    if 0x0590 <= o < 0x0780:
        return "arab"
    if 0x2E80 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 or 0xF900 <= o < 0xFB00 or 0x3000 <= o < 0x3100 or 0xFF00 <= o < 0xFFF0 or o >= 0x20000:
        return "cjk"
    return "other"


def _word_before(text: str, at: int) -> int:
    """Where the word that ends at ``at`` starts."""
    i = at
    while i > 0 and text[i - 1] not in WORD_STARTS and not text[i - 1].isspace():
        i -= 1
    return i


def _closing(text: str, at: int, marks: str, follows: str) -> float:
    """How well the word before a mark closes a sentence, before the character that ``follows``."""
    if marks[0] != "." or len(marks) > 1:
        return 0.0
    start = _word_before(text, at)
    if start == at:
        return 0.0
    word = text[start:at]
    last = word[-1]
    script = _script(last)
    if script in ("thai", "deva"):
        return CALLS_FOR_MORE
    low = word.lower().rstrip(",;")
    if low in NEVER and not (word.islower() and len(word) == 1 and _after_number(text, start)) or word in NEVER_AS_WRITTEN:
        if low == "m" and _half_day(text, start):
            return -1.0
        return -0.5 if word in ALSO_WORDS and follows.isupper() else CALLS_FOR_MORE
    if low in SOMETIMES:
        return -1.0
    if "." in low and re.fullmatch(r"(?:\w{1,3}\.)+\w{1,3}", low) and not low.replace(".", "").isdigit() and not re.match(r"v?\d", low):
        return -1.0
    if len(word) == 1 and word.isalpha() and script != "cjk":
        if low == "m" and _half_day(text, start):
            return -1.0
        if _after_number(text, start):
            return -1.0 if script == "cased" and ord(last) >= 0x400 else -0.5
        return CALLS_FOR_MORE
    if word.isdigit() and len(word) < 3:
        end = start
        while end > 0 and text[end - 1].isspace():
            end -= 1
        if text[_word_before(text, end) : end].lower() in ORDINAL_BEFORE:
            return CALLS_FOR_MORE
    return 0.0


def _half_day(text: str, at: int) -> bool:
    """Whether "a." or "p." as a word stands before."""
    i = at
    while i > 0 and text[i - 1].isspace():
        i -= 1
    return i > 1 and text[i - 1] == "." and text[i - 2] in "ap" and not (i > 2 and (text[i - 3].isalnum() or text[i - 3] == "_"))


def _after_number(text: str, at: int) -> bool:
    i = at - 1
    while i >= 0 and text[i] in " \u00a0\u202f\n":
        i -= 1
    return i >= 0 and text[i].isdigit()


def _openers(text: str) -> dict[int, int]:
    """The opening place of each closing quotation mark."""
    partner, stack, held, straight = {}, [], dict.fromkeys("„“«「『‘", 0), -1
    for m in QUOTES.finditer(text):
        i, c = m.start(), m.group()
        if c == '"':
            if straight >= 0:
                partner[i] = straight
            straight = -1 if straight >= 0 else i
            continue
        wanted = "„" if c == "“" and stack and stack[-1][0] == "„" else QUOTE_OF.get(c)
        if wanted is None:
            stack.append((c, i))
            held[c] += 1
        elif any(held[w] for w in wanted):
            while stack:
                s, place = stack.pop()
                held[s] -= 1
                if s in wanted:
                    partner[i] = place
                    break
    return partner


def _last_quote(text: str, end: int) -> int:
    i = end - 1
    while text[i] in "*_ \u00a0\u202f":
        i -= 1
    return i


def _after_quotation(text: str, opener: int, stop: bool, follows: int) -> float:
    """How well a sentence ends with a quotation that opens at ``opener`` (-1: unknown) and closes with a full stop or another mark."""
    before = text[max(0, opener - 24) : max(0, opener)].rstrip()
    introduced = INTRODUCES.search(before) is not None
    own = opener >= 0 and (not before or before[-1] in ".!?…。！？．｡।॥؟\"”’»」』)]）】")
    if introduced:
        score = 0.0 if stop else -1.0
    elif own:
        score = -1.0 if stop else -1.5
    else:
        score = -1.5 if stop else -3.5
    if GOES_ON.match(text, follows) or not introduced and SAYS.match(text, follows):
        score -= 4.0
    return score


def _cuts(text: str) -> list[tuple[int, float, int]]:
    """(end, score, closed): candidate ends inside a paragraph. closed: 1 after a closing bracket, 2 after a quotation mark,
    3 after a bracket that only closes a sentence if it also opens it."""
    out, n, openers = [], len(text), None
    for m in MARK.finditer(text):
        body = m.group()
        if body[0] == " ":
            out.append((m.start(), CUT, 0))
            continue
        e = m.end()
        marks = body.rstrip("\"'”’“»)]}」』）】〉》*_ \u00a0\u202f")
        i = e
        while i < n and text[i] in " \t\n\u00a0\u202f\u3000\ufeff\u200b":
            i += 1
        if i >= n:
            continue
        wide = marks[0] in "。！？．｡"
        if i == e and not wide and marks[0] not in "।॥؟":
            continue
        tail = body[len(marks) :].strip()
        closed = 0 if not tail else 2 if tail[-1] in "\"'”’“»」』" else 1 if tail[-1] in ")]}）】〉》" else 0
        c = text[i]
        k = i
        while k < n - 1 and text[k] in "\"'“„«¿¡([（「『*_ ":
            k += 1
        d = text[k]
        score = _closing(text, m.start(), marks, d)
        if marks[0] == "…" or marks.startswith(".."):
            score += -0.5 if d.isupper() or c in "¿¡" else RUNS_ON
        if c in ",;:)]}»”、，；：)）」』" or c in "-–—" and d not in "`":
            score += CALLS_FOR_MORE
        script = _script(d)
        if d.islower() and not wide:
            code = CODE_LIKE.match(text, k)
            score -= 0.5 if code else 1.0
            if closed == 1:
                closed = 3
            elif closed == 2:
                openers = _openers(text) if openers is None else openers
                quoted = _after_quotation(text, openers.get(_last_quote(text, e), -1), marks[-1] in STOPS, k)
                score += quoted if quoted >= 0 or code else quoted + RUNS_ON
            if score < -1 and not code:  # an abbreviation in a running sentence
                score += RUNS_ON
        elif d.isdigit():
            if score <= -1:
                score -= 0.5
        elif script in ("cjk", "arab", "deva", "thai", "other") and not wide:
            score -= 0.2
        if closed == 2 and script != "cased" and not d.isupper():
            openers = _openers(text) if openers is None else openers
            score += _after_quotation(text, openers.get(_last_quote(text, e), -1), marks[-1] in STOPS, k)
        out.append((e, CUT + score, closed))
    return out


def _levels(text: str, ends: list[int]) -> tuple[list[tuple], dict[int, int]]:
    """The open quotation marks and brackets at the start and at each end, and the opening place of each closing bracket."""
    levels, partner, stack, straight, tick, k = [], {}, [], False, False, 0
    state: tuple = ()
    points = [0, *ends, len(text)]
    for m in PAIRS.finditer(text):
        i, c = m.start(), m.group()
        while points[k] <= i:
            levels.append(state)
            k += 1
        if c == "`":
            tick = not tick
        elif tick:
            continue
        elif c == '"':
            straight = not straight
        elif c == "„":
            stack.append(("„", i))
        elif c == "“":
            if stack and stack[-1][0] == "„":
                stack.pop()
            else:
                stack.append(("“", i))
        elif c in "”‟":
            if stack and stack[-1][0] in "“„":
                stack.pop()
        elif c in OPEN:
            stack.append((c, i))
        elif stack and CLOSE[c] in [s for s, _ in stack]:
            while stack:
                s, place = stack.pop()
                if s == CLOSE[c]:
                    partner[i] = place
                    break
        state = (len(stack), straight, tick)
    levels += [state] * (len(points) - len(levels))
    return levels, partner


def split(text: str) -> list[tuple[int, int]]:
    """The (start, end) of each unit of a paragraph."""
    n = len(text.rstrip())
    cuts = [c for c in _cuts(text) if c[0] < n]
    first = len(text) - len(text.lstrip())
    if not cuts:
        return [(first, n)] if n > first else []
    ends = [c[0] for c in cuts]
    levels, partner = _levels(text, ends)
    starts = [first]
    for e in ends:
        while e < n and text[e].isspace():
            e += 1
        starts.append(e)
    places, scores = [*ends, n], [*(c[1] for c in cuts), 0.0]
    flags = [*(c[2] for c in cuts), 0]
    # Starts from which a span may still begin, and the best of all up to each. A start with an earlier one that is ahead
    # by more than a span can lose by its length, its bracket and (unless the balance is the same) its balance is left out:
    # the earlier one gives more to every later end.
    best, back, alive, most = [0.0], [0], [0], [0.0]
    worth = lambda i: best[i] + PER_CHARACTER * starts[i]
    ahead, first_of_all = {levels[0]: worth(0)}, worth(0)
    for j in range(1, len(places) + 1):
        top, arg = -1e18, 0
        e, level, flag = places[j - 1], levels[j], flags[j - 1]
        opener = -1
        if flag in (1, 3):
            i = e - 1
            while i >= 0 and i not in partner and text[i] in "\"'”’“»)]}」』）】〉》*_ ":
                i -= 1
            opener = partner.get(i, -1)
        for k in range(len(alive) - 1, -1, -1):
            i = alive[k]
            s = best[i] + scores[j - 1]
            if level != levels[i]:
                s += UNBALANCED
            length = e - starts[i]
            if length < 4:
                s -= 0.5
            elif length > 400:
                s -= PER_CHARACTER * (length - 400)
            if flag == 1 and opener != starts[i]:
                s -= 2.0 if opener >= starts[i] else 0.0
                if opener > starts[i] and j <= len(ends) and _script(text[min(starts[j], n - 1)]) != "cased":
                    s -= 3.0
            if flag == 3 and (opener < starts[i] or opener - starts[i] > 3 or text[starts[i] : opener].strip("*_")):
                s -= 6.0
            if s > top:
                top, arg = s, i
            # all else that a span is scored by takes points away, so this bounds every longer span
            if k and most[k - 1] + scores[j - 1] - max(0.0, PER_CHARACTER * (e - starts[alive[k - 1]] - 400)) < top:
                break
        best.append(top)
        if j < len(starts) and worth(j) + BRACKET + 0.5 >= max(ahead.get(level, -1e18), first_of_all + UNBALANCED):
            alive.append(j)
            most.append(max(most[-1], top))
            ahead[level], first_of_all = max(ahead.get(level, -1e18), worth(j)), max(first_of_all, worth(j))
        back.append(arg)
    out, j = [], len(places)
    while j:
        i = back[j]
        if places[j - 1] > starts[i]:
            out.append((starts[i], places[j - 1]))
        j = i
    return out[::-1]


def units(text: str, pieces: Pieces) -> list[tuple[int, int]]:
    """The units of a paragraph, as places in the whole text."""
    if len(pieces) == 1:
        a, b = pieces[0]
        return [(a + s, a + e) for s, e in split(text[a:b])]
    joined = "\n".join([text[a:b] for a, b in pieces])
    begins, at = [], 0
    for a, b in pieces:
        begins.append(at)
        at += b - a + 1
    place = lambda i: pieces[k := bisect_right(begins, i) - 1][0] + i - begins[k]
    return [(place(s), place(e - 1) + 1) for s, e in split(joined)]


def sentence_spans(text: str | None, path: str | None = None, prog_lang: str | None = None) -> list[tuple[int, int]]:
    """The (start, end) of every sentence unit of a file, in code points. Null and blank texts have none."""
    if not text or not text.strip(BLANK + "\r\n"):
        return []
    return [u for p in paragraphs(text, path, prog_lang) for u in units(text, p)]


OUT = pa.schema([("doc_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, starts, ends = [], [], []
        for doc_id, text, path, lang in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for a, b in sentence_spans(text, path, lang):
                ids.append(doc_id)
                starts.append(a)
                ends.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ends)], schema=OUT)


def sentences(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str = "path", prog_lang: str = "prog_lang") -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence unit; one narrow pass without a shuffle.

    Null and blank texts give nothing; a null path or language leaves the kind of file to the text; a repeated row
    gives repeated units; a null doc_id is kept; extra columns are ignored; an empty table gives no rows.
    """
    picked = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(path).cast("string").alias("path"), F.col(prog_lang).cast("string").alias("prog_lang"))
    return picked.filter(F.col("text").isNotNull()).mapInArrow(_spans, "doc_id bigint, start_char bigint, end_char bigint")
