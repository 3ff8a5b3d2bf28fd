"""Power-of-two packing: each document is cut into pieces of binary lengths.

The tokens of a document are cut into as many pieces of the full length as fit, then
into one piece for each bit that is set in the rest, longest first. Pieces of equal length
form a bucket, and each piece is a sequence of its bucket: no sequence crosses
documents and none needs padding, since every length is a power of two.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlab.llm.common import materialise, ship, text_of

FULL = 4096
#: Words of up to so many characters are remembered, so many at once in a worker.
WORD_CHARS, WORDS_KEPT = 40, 300_000
BUCKETS = 1024

ship(__name__)


class WordTokens:
    """Ids of a text by a tokenizer that never joins across white space, as bytes (uint32).

    The tokenizer's own pattern keeps words apart and drops white space, so the ids of a
    text are those of its words in turn. Words repeat, so their ids are remembered. Of
    a new word the library encodes the letters and the punctuation behind them, which its
    pattern keeps apart as well; a word of another kind is encoded as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.words = re.compile(r"[^ \t\n\x0b\x0c\r]+").findall
        #: str.split() also splits at these four, which are no white space to the pattern.
        self.separators = re.compile("[\x1c-\x1f]").search
        #: Latin letters, then punctuation that begins neither a contraction nor a special token.
        self.plain = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?#*$%&)\"]*)").fullmatch
        #: The byte-level alphabet: bytes without a printable Latin-1 character are moved to 256 and up, in order.
        hidden = [n for n in range(256) if not (0x21 <= n <= 0x7E or 0xA1 <= n <= 0xAC or 0xAE <= n)]
        self.letters = {n: chr(256 + k) for k, n in enumerate(hidden)}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            text = part.lower().encode().decode("latin-1").translate(self.letters)
            found = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(text)])
            if len(self.parts) >= WORDS_KEPT:
                self.parts.clear()
            if len(part) <= WORD_CHARS:
                self.parts[part] = found
        return found

    def _new(self, word: str) -> bytes:
        m = self.plain(word)
        if not m or len(word) > 1000:
            return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids])
        letters, rest = m.groups()
        return self._part(letters) + self._part(rest) if rest else self._part(letters)

    def __call__(self, text: str) -> bytes:
        words = self.words(text) if self.separators(text) else text.split()
        ids = list(map(self.known.get, words))
        if None in ids:
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            for n, found in enumerate(ids):
                if found is None:
                    word = words[n]
                    ids[n] = self.known.get(word) or self._new(word)
                    if len(word) <= WORD_CHARS:
                        self.known[word] = ids[n]
        return b"".join(ids)


def binary_cuts(tokens: int, full: int) -> list[tuple[int, int]]:
    """(start, length) of each piece."""
    cuts = [(at, full) for at in range(0, tokens - full + 1, full)]
    at = len(cuts) * full
    for bit in reversed(range((full - 1).bit_length())):
        if (tokens - at) >> bit & 1:
            cuts.append((at, 1 << bit))
            at += 1 << bit
    return cuts


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, full: int = FULL, crc: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each row of ``docs``: id, start, length, doc_tokens, ids.

    ``ids`` holds the token ids as little-endian unsigned 32-bit numbers; with ``crc``
    there is their CRC-32, ids_crc32, instead. A null text is an empty one, which has
    the closing id only. ``full`` must be a power of two. Rows that repeat an id are
    packed as often as they are there; other columns are not read.
    """
    if full < 1 or full & (full - 1):
        raise ValueError("full must be a power of two")
    end = end_id.to_bytes(4, "little")
    kind = docs.schema[id_col].dataType.simpleString()
    last, last_type = ("ids_crc32", pa.int64()) if crc else ("ids", pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokens(tokenizer)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            held = 0
            for n, text in enumerate(batch.column(1)):
                ids = encode(text.as_py()) + end
                tokens = len(ids) // 4
                for start, length in binary_cuts(tokens, full):
                    own = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (n, start, length, tokens, zlib.crc32(own) if crc else own)):
                        column.append(value)
                held += len(ids)
                if held > 16_000_000:
                    yield packed(batch, *rows)
                    rows, held = ([], [], [], [], []), 0
            yield packed(batch, *rows)

    def packed(batch, source, *columns) -> pa.RecordBatch:
        key = batch.column(0).take(pa.array(source, pa.int64()))
        types = [pa.int64()] * 3 + [last_type]
        return pa.RecordBatch.from_arrays([key, *map(pa.array, columns, types)], [id_col, "start", "length", "doc_tokens", last])

    schema = f"`{id_col}` {kind}, start bigint, length bigint, doc_tokens bigint, {last} {'bigint' if crc else 'binary'}"
    return docs.select(id_col, text_of(text_col).alias("text")).mapInArrow(cut, schema)


def numbered(table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id (0 to n - 1, bucket by bucket, longest first) and offset (always 0).

    Buckets are numbered in slices cut by hash, each sorted in a task of its own; only
    the sizes of the slices, at most 13 * BUCKETS rows for full = 4096, are added up in one.
    """
    slice_of = F.pmod(F.xxhash64(id_col, "start"), F.lit(BUCKETS)).cast("int")
    table = table.withColumn("_slice", slice_of)
    sizes = table.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy(F.col("length").desc(), "_slice")) - F.col("_n")
    sizes = sizes.select("length", "_slice", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_slice").orderBy(id_col, "start", "doc_tokens"))
    table = table.withColumn("_inside", inside).join(F.broadcast(sizes), ["length", "_slice"])
    out = table.withColumn("sequence_id", F.col("_before") + F.col("_inside") - 1).withColumn("offset", F.lit(0).cast("bigint"))
    return out.drop("_slice", "_inside", "_before")


def pack(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Sequences of token ids: the rows of ``pieces``, numbered."""
    return numbered(materialise(pieces(docs, tokenizer, **options), "pieces", compression="zstd"), options.get("id_col", "doc_id"))
