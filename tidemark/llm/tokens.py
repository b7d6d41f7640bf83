"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Texts are cut into words by the tokenizer's pattern, once. The distinct words of the corpus are encoded once each: a
Spark higher-order fold over the word's bytes applies the ranked merges, looked up in a literal map, until none
applies. A word is the row of its pieces, each a byte or a merge of bytes, as one character that stands for the piece's
id, so that a merge is a replacement; the fold keeps the ranks of the pairs that occur and looks up only those that a
merge has made. Documents lie in blocks by their id; each block gets the ids of its own distinct words and
rewrites its documents with them, so no dictionary of the whole corpus is ever held in one place. Decoding
concatenates the binary pieces of the ids and reads them as UTF-8.

The path of the vocabulary file (the ``tokenizers`` JSON format, byte-level BPE) is a parameter; only the driver
reads it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.skew import hot_keys
from tidemark.session import stored

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: Documents of neighbouring ids that lie in one block.
NEIGHBOURS = 512
#: Fixed: the pattern that splits text before the merges. (?U) gives \s its Unicode meaning, as the tokenizer has it.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A character that hardly any text holds; those that do are handed over as lists of words.
MARK = "\x1e"
BUCKETS = 2_048  # few enough for a processor's cache
#: Text of a block, in bytes.
BLOCK_BYTES = 64 << 20

#: Bytes that stand for themselves as characters in the vocabulary; the others are numbered on from 256.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_MOVED = [b for b in range(256) if b not in set(_PLAIN)]


class Vocabulary:
    """The merges and ids of a byte-level BPE file."""

    def __init__(self, path: str = DEFAULT_PATH):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}


def _literal_map(entries: dict[str, int]) -> Column:
    """A map as one literal: an array of small maps by a hash of the key, since look-ups in a map scan it."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for k, v in entries.items():
        buckets[zlib.crc32(k.encode()) % BUCKETS][k] = v
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,int>>")


def _look_up(literal: Column, key: Column) -> Column:
    bucket = (F.crc32(key.cast("binary")) % BUCKETS).cast("int") + 1
    return F.try_element_at(F.element_at(literal, bucket), key)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text by the tokenizer's pattern; an empty array for null and empty text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def marked_words(text: Column) -> Column:
    """The text with a mark after each word: words cover all of a text, so this says where they end. Null where the text
    holds the mark itself."""
    return F.when(~F.contains(text, F.lit(MARK)), F.regexp_replace(text, F.lit(PATTERN), F.lit("$0" + MARK)))


def _piece(i: int) -> str:
    """The character that stands for an id: none that a regular expression or a surrogate pair would take for something else."""
    return chr(0x200 + i) if i < 0xD000 else chr(0x10000 + i)


def fold_merges(word: Column, vocabulary: Vocabulary) -> Column:
    """The ids of a word.

    The state is the row of pieces and the ranked pairs that may occur in it. A step takes the pair of lowest rank out,
    replaces each of its occurrences from left to right, and adds the ranked pairs of the new piece with its neighbours;
    the fold stands still when no pair is left. A step costs time by the word's length, without look-ups for what it
    leaves as it is, and there are at most as many steps as pairs ever made.
    """
    ids = vocabulary.ids
    pairs = [p.split(" ") for p in sorted(vocabulary.ranks, key=vocabulary.ranks.__getitem__)]
    ranks = _literal_map({_piece(ids[a]) + _piece(ids[b]): vocabulary.ranks[f"{a} {b}"] for a, b in pairs})
    made = F.from_json(F.lit(json.dumps([_piece(ids[a + b]) for a, b in pairs], ensure_ascii=False)), "array<string>")
    letter = dict(zip(_MOVED, (chr(256 + i) for i in range(len(_MOVED))))) | {b: chr(b) for b in _PLAIN}
    row = F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "".join(map(chr, range(256))), "".join(_piece(ids[letter[b]]) for b in range(256)))

    def ranked(found: Column) -> Column:
        rank = lambda p: F.struct(_look_up(ranks, p).alias("rank"), p.alias("pair"))
        return F.filter(F.transform(F.array_distinct(found), rank), lambda x: x["rank"].isNotNull())

    def beside(parts: Column, c: Column) -> Column:
        """The pairs of a piece with its neighbours, of a row that was split at the piece."""
        n = F.size(parts) - 1
        before = lambda x, i: F.when(x != "", F.concat(F.substring(x, -1, 1), c)).when(i > 0, F.concat(c, c))
        after = lambda x, i: F.when(x != "", F.concat(c, F.substring(x, 1, 1))).when(i < n - 1, F.concat(c, c))
        return F.concat(F.transform(F.slice(parts, 1, n), before), F.transform(F.slice(parts, 2, n), after))

    def merged(state: Column, best: Column) -> Column:
        def with_piece(c: Column) -> Column:
            def then(new: Column) -> Column:
                rest = F.filter(state["pairs"], lambda x: x["rank"] != best["rank"])
                more = _let(F.split(new, c), lambda parts: ranked(beside(parts, c)))
                return F.when(new == state["row"], F.struct(new.alias("row"), rest.alias("pairs"))).otherwise(F.struct(new.alias("row"), F.concat(rest, more).alias("pairs")))

            return _let(F.replace(state["row"], best["pair"], c), then)

        return _let(F.element_at(made, best["rank"] + 1), with_piece)

    def start(r: Column) -> Column:
        two = F.lit("(?s)..")
        found = F.concat(F.regexp_extract_all(r, two, F.lit(0)), F.regexp_extract_all(F.substring(r, 2, 2**31 - 1), two, F.lit(0)))
        return F.struct(r.alias("row"), ranked(found).alias("pairs"))

    step = lambda state, _: F.when(F.size(state["pairs"]) == 0, state).otherwise(_let(F.array_min(state["pairs"]), lambda best: merged(state, best)))
    turns = F.sequence(F.lit(1), F.greatest(F.octet_length(word) * 4, F.lit(1)))  # a merge takes a piece away and makes at most two pairs
    over = F.aggregate(turns, _let(row, start), step)
    code = lambda c: F.ascii(c) - F.when(F.ascii(c) < 0x200 + 0xD000, 0x200).otherwise(0x10000)
    return F.when(word == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(over["row"], ""), code))


class Lexicon:
    """The words of a block with their ids."""

    def __init__(self, parts: list[tuple[pa.Array, pa.Array]]):
        self.words = pa.concat_arrays([w for w, _ in parts]) if parts else pa.array([], pa.string())
        lists = pa.concat_arrays([i for _, i in parts]) if parts else pa.array([], pa.list_(pa.int32()))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.counts = np.append(counts, 0)  # the last stands for the empty string
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        self.ids = lists.flatten().to_numpy(zero_copy_only=False)

    def rewrite(self, texts: pa.Array, empty: int) -> pa.Array:
        """The ids of texts given as lists of words, of which exactly ``empty`` are empty strings."""
        found = pc.index_in(texts.flatten(), value_set=self.words)
        if found.null_count != empty:
            raise ValueError("a word has no ids")
        place = found.fill_null(len(self.words)).to_numpy(zero_copy_only=False)
        n = self.counts[place]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.starts[place] - ends[:-1], n) + np.arange(ends[-1])] if ends[-1] else np.zeros(0, np.int32)
        per_text = np.concatenate(([0], np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False))))
        return pa.ListArray.from_arrays(pa.array(ends[per_text].astype(np.int32)), pa.array(ids, pa.int32()))


OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block and kind: a block's words with their ids (0), then its documents as words (1)."""
    at, parts, lexicon = None, [], None
    for batch in batches:
        block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if block[a] != at:
                at, parts, lexicon = block[a], [], None
            if kind[a] == 0:
                parts.append((batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a)))
                continue
            if lexicon is None:
                lexicon, parts = Lexicon(parts), []
            marked, listed = batch.column(5).slice(a, b - a), batch.column(6).slice(a, b - a)
            docs = batch.column(2).slice(a, b - a)
            plain = marked.is_valid()
            if (n := plain.true_count) > 0:  # each ends with a mark, so splitting leaves an empty string at its end
                texts = pc.split_pattern(marked.filter(plain), MARK)
                yield pa.RecordBatch.from_arrays([docs.filter(plain), lexicon.rewrite(texts, n)], schema=OUT)
            if n < b - a:
                rest = pc.invert(plain)
                yield pa.RecordBatch.from_arrays([docs.filter(rest), lexicon.rewrite(listed.filter(rest), 0)], schema=OUT)


def encode(documents: DataFrame, *, path: str = DEFAULT_PATH, doc_id: str = "doc_id", text: str = "text", docs_per_block: int = 20_000, bytes_per_block: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids): the token ids of every document, without special tokens.

    Empty and null texts give an empty list; strings that look like special tokens are ordinary text; a repeated
    row gives a repeated result; a null doc_id is kept. Extra columns are ignored; an empty table gives no rows.

    A block holds at most about ``bytes_per_block`` of text and ``docs_per_block`` documents. Shuffled are the distinct
    words of each block, and each text once to its block. A word costs the fold time by its length times its number of
    distinct merges, once in the corpus.
    """
    spark = documents.sparkSession
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), t.alias("text"))
    sizes = Observation()
    cut = plain.observe(sizes, F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))
    # neighbours by id share blocks, so that most words repeat before the shuffle; without id, the text says where
    near = F.coalesce(F.floor(F.col("doc_id") / F.lit(NEIGHBOURS)), F.xxhash64("text"))
    kept = stored(cut.select("doc_id", near.alias("near"), F.xxhash64("text").alias("hash"), marked_words(F.col("text")).alias("marked"), F.when(F.contains("text", F.lit(MARK)), words_of(F.col("text"))).alias("words")))
    found = sizes.get
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(found["docs"] or 0) // docs_per_block), -(-(found["bytes"] or 0) // bytes_per_block))
    hot = hot_keys(kept, ["near"], max(docs_per_block, NEIGHBOURS))  # an id that is repeated without end
    salt = F.when(F.col("n_salts").isNotNull(), F.pmod(F.col("hash"), F.col("n_salts"))).otherwise(0)
    docs = kept.join(hot, "near", "left").withColumn("block", F.pmod(F.xxhash64("near", salt), F.lit(blocks)).cast("int"))
    each = F.explode(F.array_distinct(F.coalesce("words", F.split("marked", MARK)))).alias("word")
    seen = stored(docs.select("block", each).filter("word != ''").distinct())
    # the adaptive plan parts the distinct words by their bytes: each part has to read the literal maps anew
    lexicon = stored(seen.select("word").distinct().select("word", fold_merges(F.col("word"), Vocabulary(path)).alias("ids")))
    null = F.lit(None)
    known = seen.join(lexicon, "word").select("block", F.lit(0).alias("kind"), null.cast("bigint").alias("doc_id"), "word", "ids", null.cast("string").alias("marked"), null.cast("array<string>").alias("words"))
    every = known.union(docs.select("block", F.lit(1).alias("kind"), "doc_id", null.cast("string").alias("word"), null.cast("array<int>").alias("ids"), "marked", "words"))
    placed = every.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind")
    return placed.mapInArrow(_rewrite, "doc_id bigint, ids array<int>")


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of a list of ids: its binary pieces, concatenated (as hexadecimal digits). Ids outside the vocabulary give null."""
    byte = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(_MOVED)}
    by_id = [""] * (max(vocabulary.ids.values()) + 1)
    for piece, i in vocabulary.ids.items():
        by_id[i] = bytes(byte[c] for c in piece).hex() if all(c in byte for c in piece) else piece.encode().hex()
    pieces = F.from_json(F.lit(json.dumps(by_id)), "array<string>")
    known = F.forall(ids, lambda i: (i >= 0) & (i < len(by_id)))
    digits = F.array_join(F.transform(ids, lambda i: F.try_element_at(pieces, i + 1)), "")
    return F.when(F.size(ids) == 0, F.lit("")).when(known, F.decode(F.unhex(digits), "UTF-8"))
