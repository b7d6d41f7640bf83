"""Evaluation items that leak into training text.

The n-grams of all items' normalised words form a set of hashes; each document's words are hashed, its windows looked
up, and hits verified word by word. Up to a counted number of n-grams the set is broadcast and one narrow pass over
the documents does all. Beyond it a bit table of fixed size thins the documents' windows, and what is left is joined
with the items' n-grams by shuffle, hash and words both. Either way gives the same rows.

Found passages are places in the text as it is, so spans or whole documents can be removed.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import hot_keys
from tidemark.session import checkpointed

#: A word of the text in the sense of the task: letters and digits, nothing else.
WORD = re.compile(r"[^\W_]+")
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})(?:\\u([dD][c-fC-F][0-9a-fA-F]{2}))?|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|\r?\n|[\s\S])")
#: A tag of any length. A value in quotes may hold ">"; no part may hold "<", so a search never goes back over a tag.
TAG = re.compile(r"""</?([A-Za-z][\w:.-]*+)(?:[\s/](?:[^<>=]++|=\s*+(?:"[^"<]*+"|'[^'<]*+')?+)*+)?>""")
COMMENT, COMMENT_MARKS = re.compile(r"<!--.*?(?:-->|\Z)", re.S), re.compile(r"<!--|-->")
ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
#: Numbers beyond all code points, which Python would refuse to read.
TOO_LARGE = re.compile(r"&#0*[1-9][0-9]{7,};?")
#: Tags that stand inside words.
INLINE = frozenset("a abbr b big bdi bdo cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr".split())


def _unescape(m: re.Match) -> str:
    braced, short, low, long, byte = m.groups()
    if short and low:
        high = int(short, 16)
        if 0xD800 <= high < 0xDC00:
            return chr(0x10000 + ((high - 0xD800) << 10) + int(low, 16) - 0xDC00)
        return _char(high) + " "
    if code := braced or short or long or byte:
        return _char(int(code, 16))
    return "\\" if m.group() == "\\\\" else " "  # line ends, tabs and quotes part words or stand for marks that do


def _char(code: int) -> str:
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else " "


def _reference(m: re.Match) -> str:
    return "\ufffd" if TOO_LARGE.fullmatch(m.group()) else html.unescape(m.group())


def _tag(m: re.Match) -> str:
    return "" if m.group(1).lower() in INLINE else " "


def _invisible() -> dict[int, None]:
    return {c: None for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf" or 0xFE00 <= c < 0xFE10 or 0xE0100 <= c < 0xE01F0 or c == 0x34F}


INVISIBLE = re.compile("[" + "".join(re.escape(chr(c)) for c in _invisible()) + "]")
#: By code point: 1 for the characters of words, 2 for invisible ones.
KINDS = np.zeros(sys.maxunicode + 1, np.uint8)
KINDS[[c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]] = 1
KINDS[list(_invisible())] = 2


def fold(text: str) -> str:
    """A text without differences of case, compatibility forms and invisible characters."""
    if text.isascii():
        return text.lower()
    if (KINDS[codes(text)] == 2).any():
        text = INVISIBLE.sub("", text)
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


#: A stretch without white space that isn't ASCII throughout.
NOT_ASCII = re.compile(r"[^ \t\r\n\x80-\U0010ffff]*[^\x00-\x7f][^ \t\r\n]*")


class Placed:
    """A reading of a text that knows, of each character, the place [start, end) in the text that it stands for."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = self.start + 1 if end is None else end

    def of(self, parts: list[tuple[int, int, str | None]]) -> Placed:
        """A reading of parts [a, b): kept as they are (None) or replaced by a text, which then stands for all of the part, or
        character by character where it is as long."""
        texts, starts, ends = [], [], []
        for a, b, new in parts:
            if new is None or len(new) == b - a:
                texts.append(self.text[a:b] if new is None else new)
                starts.append(self.start[a:b])
                ends.append(self.end[a:b])
            elif new and b > a:
                texts.append(new)
                starts.append(np.full(len(new), self.start[a:b].min()))
                ends.append(np.full(len(new), self.end[a:b].max()))
        none = np.zeros(0, np.int64)
        return Placed("".join(texts), np.concatenate([none, *starts]), np.concatenate([none, *ends]))

    def sub(self, pattern: re.Pattern, new: str | Callable[[re.Match], str]) -> Placed:
        parts, at = [], 0
        for m in pattern.finditer(self.text):
            parts += [(at, m.start(), None), (m.start(), m.end(), new if isinstance(new, str) else new(m))]
            at = m.end()
        return self.of([*parts, (at, len(self.text), None)])

    def fold(self) -> Placed:
        """As ``fold``. White space takes part in no composition, so what lies between is folded on its own, and character by
        character with its marks where that gives the same."""
        if self.text.isascii():
            return Placed(self.text.lower(), self.start, self.end)
        parts, at = [], 0
        for m in NOT_ASCII.finditer(self.text):
            a, b, whole = m.start(), m.end(), fold(m.group())
            parts.append((at, a, self.text[at:a].lower()))
            at = b
            if whole == m.group():
                parts.append((a, b, None))
                continue
            heads = [i for i in range(a, b) if i == a or not unicodedata.combining(self.text[i]) and KINDS[ord(self.text[i])] != 2] + [b]
            each = [(x, y, fold(self.text[x:y])) for x, y in zip(heads, heads[1:])]
            parts += each if "".join(t for _, _, t in each) == whole else [(a, b, whole)]
        return self.of([*parts, (at, len(self.text), self.text[at:].lower())])


class _Plain(str):
    """A reading without places."""

    __slots__ = ()

    @property
    def text(self) -> str:
        return self

    def sub(self, pattern: re.Pattern, new: str | Callable[[re.Match], str]) -> _Plain:
        return _Plain(pattern.sub(new, self))


def _readings(whole):
    """A text's readings: as it is, and with string escapes, entities and markup taken away where it has any."""
    reading = whole
    for again in (True, True, False):  # escapes may be doubled
        yield reading
        yield from _bare(reading)
        if not again or "\\" not in reading.text:
            return
        reading = reading.sub(ESCAPE, _unescape)


def _bare(reading, again: bool = True):
    """A reading without its entities, and without its tags: as if they weren't there, as spaces, or each as it is used. A comment
    goes wholly in one reading and leaves its words in another."""
    s, decoded = reading.text, None
    if "&" in s and ENTITY.search(s):
        decoded = reading.sub(REFERENCE, _reference)
        yield decoded
    if "<" in s:
        commented = "<!--" in s
        if commented or TAG.search(s):
            for r in (reading.sub(COMMENT, " "), reading.sub(COMMENT_MARKS, " ")) if commented else (reading,):
                for new in ("", " ", _tag):
                    bare = r.sub(TAG, new)
                    yield bare.sub(REFERENCE, _reference) if decoded is not None else bare
    if again and decoded is not None and "<" in decoded.text:  # markup that was itself written in entities
        yield from _bare(decoded, False)


def variants(text: str) -> list[str]:
    """The folded readings of a text, each once."""
    if "\\" not in text and "<" not in text and "&" not in text:
        return [fold(text)]
    return list(dict.fromkeys(map(fold, dict.fromkeys(str(r) for r in _readings(_Plain(text))))))


def placed(text: str, reading: str) -> Placed:
    """The reading among ``variants`` that equals ``reading``, with its places in the text."""
    return next(p for r in _readings(Placed(text)) if (p := r.fold()).text == reading)


def words(text: str) -> list[str]:
    """The words of a folded text."""
    return WORD.findall(text)


BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of the windows of n words over many texts at once, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, n: int):
        self.n = n
        self.up = self.down = np.ones(0, np.uint64)

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, start, end) of each window of n words that lies in one text; places count within it."""
        points = codes("\n".join(texts))
        if len(points) > len(self.up):
            size = max(1 << 20, len(points))
            self.up, self.down = _powers(BASE, size), _powers(np.uint64(pow(int(BASE), -1, 2**64)), size)
        inside = np.empty(len(points) + 2, np.int8)
        inside[0] = inside[-1] = 0
        np.equal(KINDS[points], 1, out=inside[1:-1].view(bool))
        edges = np.flatnonzero(np.diff(inside))
        start, end = edges[::2], edges[1::2]
        n, m = self.n, len(start) - self.n + 1
        if m <= 0:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none, none
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(points * self.up[: len(points)], out=sums[1:])
        word = ((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64)) * MIX
        word ^= word >> np.uint64(29)
        window = word[:m].copy()
        for k in range(1, n):
            window = window * BASE + word[k : k + m]
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        text = np.searchsorted(first, start, side="right") - 1
        same = text[:m] == text[n - 1 :]
        text = text[:m][same]
        return window[same] * MIX, text, start[:m][same] - first[text], end[n - 1 :][same] - first[text]


Hit = tuple[int, str, int, int]


class Grams:
    """The n-grams of items: sorted hashes behind a table of bits, and where each lies in which item's text, to verify a hit."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.n = n
        self.texts: list[tuple[str, str]] = []
        hasher, parts = Hasher(n), []
        for item, text in dict.fromkeys(items):
            for reading in variants(text):
                window, _, start, end = hasher.windows([reading])
                parts.append((window, np.full(len(window), len(self.texts)), start, end))
                self.texts.append((item, reading))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]
        order = np.argsort(columns[0], kind="stable")
        self.hashes, self.text, self.start, self.end = (c[order] for c in columns)
        self.shift = np.uint64(64 - min(26, max(16, len(order).bit_length() + 4)))

    def scanner(self) -> Callable[[list[str]], list[Hit]]:
        """A function from folded texts to (number of the text, item, start, end) of each hit."""
        table = np.zeros(1 << (64 - int(self.shift)), bool)
        table[self.hashes >> self.shift] = True
        hasher = Hasher(self.n)

        def scan(texts: list[str]) -> list[Hit]:
            window, text, start, end = hasher.windows(texts)
            maybe = np.flatnonzero(table[window >> self.shift])
            low, high = (np.searchsorted(self.hashes, window[maybe], side) for side in ("left", "right"))
            out = []
            for i, a, b in zip(*(x[high > low].tolist() for x in (maybe, low, high))):
                t, s, e = int(text[i]), int(start[i]), int(end[i])
                said = words(texts[t][s:e])
                for k in range(a, b):  # the words themselves must agree
                    item, source = self.texts[self.text[k]]
                    if words(source[self.start[k] : self.end[k]]) == said:
                        out.append((t, item, s, e))
            return out

        return scan


#: Characters of texts that are hashed together.
CHUNK = 1 << 20


def _hits(texts: list, scan: Callable[[list[str]], list[Hit]]) -> Iterator[tuple[int, str, Hit]]:
    """(row, folded reading, hit) of the texts of a batch, hashed many at once."""
    batch, rows, size = [], [], 0
    for row, text in enumerate([*texts, None]):
        for reading in variants(text) if text is not None else ():
            batch.append(reading)
            rows.append(row)
            size += len(reading)
        if size >= CHUNK or row == len(texts):
            for hit in scan(batch) if batch else ():
                yield rows[hit[0]], batch[hit[0]], hit
            batch, rows, size = [], [], 0


def _places(text: str, hits: list[tuple[str, str, int, int]]) -> list[tuple[str, int, int]]:
    """(item, start, end) in the text of hits (item, folded reading, start, end), overlapping ones of an item merged."""
    spans, maps = [], {}
    for item, reading, a, b in hits:
        p = maps[reading] if reading in maps else maps.setdefault(reading, placed(text, reading))
        spans.append((item, int(p.start[a:b].min()), int(p.end[a:b].max())))
    out: list[tuple[str, int, int]] = []
    for item, a, b in sorted(spans):
        if out and out[-1][0] == item and a <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((item, a, b))
    return out


def _batch_spans(texts: list, scan) -> dict[int, list[tuple[str, int, int]]]:
    by: dict[int, list] = {}
    for row, reading, (_, item, a, b) in _hits(texts, scan):
        by.setdefault(row, []).append((item, reading, a, b))
    return {row: _places(texts[row], hits) for row, hits in by.items()}


PAIRS = "doc_id bigint, item_id string"
SPANS = "doc_id bigint, item_id string, start_char bigint, end_char bigint"


def _table(columns: list[tuple], schema: list[pa.DataType]) -> pa.RecordBatch:
    lists = list(zip(*columns)) if columns else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(lists, schema)], names=[str(i) for i in range(len(schema))])


def _named(batch: pa.RecordBatch, ddl: str) -> pa.RecordBatch:
    return batch.rename_columns([f.split()[0] for f in ddl.split(", ")])


def _pairs_of(shared) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.scanner()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = {(row, item) for row, _, (_, item, _, _) in _hits(batch.column(1).to_pylist(), find)}
            if found:
                yield _named(_table([(ids[row], item) for row, item in sorted(found)], [pa.int64(), pa.string()]), PAIRS)

    return scan


def _spans_of(shared) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.scanner()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = _batch_spans(batch.column(1).to_pylist(), find)
            if found:
                yield _named(_table([(ids[row], *span) for row, spans in sorted(found.items()) for span in spans], [pa.int64(), pa.string(), pa.int64(), pa.int64()]), SPANS)

    return scan


def _sieve(shared, text: str) -> Callable:
    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.scanner()
        for batch in batches:
            leaky = {row for row, _, _ in _hits(batch.column(batch.schema.get_field_index(text)).to_pylist(), find)}
            yield batch.filter(pa.array([row not in leaky for row in range(batch.num_rows)], pa.bool_())) if leaky else batch

    return sieve


def cut(text: str, spans: list[tuple[int, int]], filler: str) -> str:
    """The text with its spans, merged where they overlap, replaced by the filler."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at or not out:
            out += [text[at:a], filler]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _cutter(shared, text: str, filler: str) -> Callable:
    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.scanner()
        for batch in batches:
            i = batch.schema.get_field_index(text)
            texts = batch.column(i).to_pylist()
            for row, spans in _batch_spans(texts, find).items():
                texts[row] = cut(texts[row], [s[1:] for s in spans], filler)
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return cutter


# ---------------------------------------------------------------- items


def _measure(n: int) -> Callable:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(n)
        for batch in batches:
            counts = [sum(len(hasher.windows([r])[0]) for r in variants(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["item_id", "text", "grams"])

    return measure


class Searched:
    """The items, ready to be searched for: ``shared`` holds them as a broadcast if they are few, ``table`` their n-grams else."""

    #: Bits of the table that thins the windows of documents: 8 MB, whatever the items.
    BITS = 26

    def __init__(self, items: DataFrame, n: int, item_id: str, item_text: str, most: int):
        self.n, self.shared, self.table = n, None, None
        picked = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
        counted = picked.mapInArrow(_measure(n), "item_id string, text string, grams bigint").filter("grams > 0")
        total, chars = counted.agg(F.coalesce(F.sum("grams"), F.lit(0)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        context = items.sparkSession.sparkContext
        if total <= most and chars <= 100 * most:  # counted, so what is collected and broadcast is bounded
            rows = counted.select("item_id", "text").collect()
            self.shared = context.broadcast(Grams([(r["item_id"], r["text"]) for r in rows], n))
            return
        self.table = checkpointed(picked.mapInArrow(_item_grams(n), "h bigint, gram string, item_id string").distinct())
        slot = F.shiftrightunsigned("h", 64 - self.BITS)
        bits = self.table.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h >>> %d & 63 as int))" % (64 - self.BITS)).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        table = np.zeros(1 << (self.BITS - 6), np.uint64)
        table[bits.column(0).to_numpy()] = bits.column(1).to_numpy().view(np.uint64)
        self.bits = context.broadcast(table)

    def joined(self, documents: DataFrame, rows_per_task: int) -> DataFrame:
        """(doc_id, digest, item_id, start_char, end_char): hits by a shuffle on hash and words of the windows that the bits let pass."""
        digest = F.struct(F.xxhash64("text").alias("x"), F.crc32(F.col("text").cast("binary")).alias("c"))
        rows = documents.select("doc_id", "text", digest.alias("digest")).select("doc_id", "text", "digest.x", "digest.c")
        windows = checkpointed(rows.mapInArrow(_document_grams(self.bits, self.n, self.BITS), "doc_id bigint, x bigint, c bigint, h bigint, gram string, start_char bigint, end_char bigint").distinct())
        hot = hot_keys(windows, ["h"], rows_per_task)  # a passage that a third of the documents hold
        one = F.lit(1)
        left = windows.join(F.broadcast(hot), "h", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "x"), F.coalesce("n_salts", one)).cast("int")).drop("n_salts")
        right = self.table.join(F.broadcast(hot), "h", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("n_salts", one) - 1))).drop("n_salts")
        return left.join(right, ["h", "salt", "gram"]).select("doc_id", F.struct("x", "c").alias("digest"), "item_id", "start_char", "end_char")


def _item_grams(n: int) -> Callable:
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(n)
        for batch in batches:
            for item, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                out = set()
                for reading in variants(text):
                    window, _, start, end = hasher.windows([reading])
                    out |= {(h, " ".join(words(reading[a:b])), item) for h, a, b in zip(window.view(np.int64).tolist(), start, end)}
                yield _named(_table(sorted(out), [pa.int64(), pa.string(), pa.string()]), "h bigint, gram string, item_id string")

    return grams


def _document_grams(shared, n: int, bits: int) -> Callable:
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hasher, shift = shared.value, Hasher(n), np.uint64(64 - bits)
        for batch in batches:
            for doc_id, text, x, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                out = set()
                for reading in variants(text):
                    window, _, start, end = hasher.windows([reading])
                    slot = window >> shift
                    kept = np.flatnonzero(table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                    if not len(kept):
                        continue
                    p = placed(text, reading)
                    for h, a, b in zip(window[kept].view(np.int64).tolist(), start[kept].tolist(), end[kept].tolist()):
                        out.add((doc_id, x, c, h, " ".join(words(reading[a:b])), int(p.start[a:b].min()), int(p.end[a:b].max())))
                if out:
                    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2
                    yield _named(_table(list(out), kinds), "doc_id b, x b, c b, h b, gram s, start_char b, end_char b")

    return grams


def _merged(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping spans of the same keys as one."""
    order = Window.partitionBy(*keys).orderBy("start_char", "end_char")
    reach = F.max("end_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start_char") > reach), 1).otherwise(0)
    runs = hits.select(*keys, "start_char", "end_char", fresh.alias("__f")).withColumn("__run", F.sum("__f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "__run").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char")).drop("__run")


# ---------------------------------------------------------------- operators

#: N-grams of items, counted over all readings, up to which the set is broadcast.
MOST_BROADCAST = 200_000
ROWS_PER_TASK = 200_000


def _docs(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text is not null")


def leaks(documents: DataFrame, items: DataFrame, *, n: int = 12, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", grams_per_pass: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, item_id): the documents that hold at least ``n`` consecutive words of an item, in its order.

    Words are maximal runs of letters and digits after folding case, compatibility forms, invisible characters,
    string escapes, entities and markup of any length. Null texts and items shorter than n words give nothing; repeated
    items and repeated rows of a document count once; a null doc_id stays one; extra columns are ignored.

    Up to ``grams_per_pass`` n-grams of items are broadcast; more are joined by shuffle.
    """
    docs, searched = _docs(documents, doc_id, text), Searched(items, n, item_id, item_text, grams_per_pass)
    found = docs.mapInArrow(_pairs_of(searched.shared), PAIRS) if searched.shared else searched.joined(docs, ROWS_PER_TASK).select("doc_id", "item_id")
    return found.distinct()


def leak_spans(documents: DataFrame, items: DataFrame, *, n: int = 12, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", grams_per_pass: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, item_id, start_char, end_char): where the passages of ``leaks`` lie in the text as it is, the end exclusive.

    Overlapping passages of an item are one span; escapes, entities, marks and tags between its words lie within it. Rows
    of the same id with different texts each give their spans. All else is as in ``leaks``.
    """
    docs, searched = _docs(documents, doc_id, text), Searched(items, n, item_id, item_text, grams_per_pass)
    if searched.shared:
        return docs.mapInArrow(_spans_of(searched.shared), SPANS).distinct()
    return _merged(searched.joined(docs, ROWS_PER_TASK).distinct(), ["doc_id", "digest", "item_id"]).drop("digest").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, *, n: int = 12, text: str = "text", item_id: str = "item_id", item_text: str = "text", grams_per_pass: int = MOST_BROADCAST) -> DataFrame:
    """The rows of documents, with all their columns, in which ``leaks`` finds nothing; ``text`` is a string column.

    Null texts and null or repeated ids stay as they are.
    """
    searched = Searched(items, n, item_id, item_text, grams_per_pass)
    if searched.shared:
        return documents.mapInArrow(_sieve(searched.shared, text), documents.schema)
    digest, spans = _digested(documents, searched, text)
    leaky = spans.select("digest").distinct()
    return documents.withColumn(digest, _digest(text)).join(leaky.withColumnRenamed("digest", digest), digest, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])


def without_spans(documents: DataFrame, items: DataFrame, *, n: int = 12, text: str = "text", item_id: str = "item_id", item_text: str = "text", filler: str = " [removed] ", grams_per_pass: int = MOST_BROADCAST) -> DataFrame:
    """All rows of documents with all their columns; in ``text``, each leaked span gives way to the ``filler``.

    The filler's word parts what lies before and after, so that the cut makes no new passage of an item. Null texts and
    null or repeated ids stay as they are; an empty filler is allowed.
    """
    searched = Searched(items, n, item_id, item_text, grams_per_pass)
    if searched.shared:
        return documents.mapInArrow(_cutter(searched.shared, text, filler), documents.schema)
    digest, spans = _digested(documents, searched, text)
    cells = f"{digest}_spans"
    merged = _merged(spans.select("digest", "start_char", "end_char").distinct(), ["digest"])
    per_text = merged.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias(cells))  # as many as one text has spans
    joined = documents.withColumn(digest, _digest(text)).join(per_text.withColumnRenamed("digest", digest), digest, "left")
    t = F.col(f"`{text}`")
    piece = lambda acc, s: F.struct(F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start_char"].cast("int") - acc["at"]), F.lit(filler)).alias("out"), s["end_char"].cast("int").alias("at"))
    done = F.aggregate(cells, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), piece, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return joined.withColumn(text, F.when(F.col(cells).isNull(), t).otherwise(done)).select(*[F.col(f"`{c}`") for c in documents.columns])


def _digest(text: str):
    t = F.col(f"`{text}`")
    return F.struct(F.xxhash64(t).alias("x"), F.crc32(t.cast("binary")).alias("c"))


def _digested(documents: DataFrame, searched: Searched, text: str) -> tuple[str, DataFrame]:
    """A column name that documents don't have, and the hits by a digest of the text: equal texts have equal spans."""
    digest = "__digest"
    while any(c.startswith(digest) for c in documents.columns):
        digest += "_"
    docs = documents.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    return digest, searched.joined(docs, ROWS_PER_TASK)
