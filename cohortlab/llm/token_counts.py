"""Token counts by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded whole. A longer one is encoded in chunks
that overlap. Within an overlap both encodings cut at some of the same places; a place
is proven stable when no piece of the vocabulary spans it, so no merge of the whole
text could cross it either. The chunks are spliced at the first stable place where both
cut. Where an overlap has none it is widened until one is found or the text ends.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import ship, text_of

SPACE = "▁"  # how the vocabulary writes a space

ship(__name__)


class SplicedCounter:
    """Counts the pieces of a SentencePiece model in texts of any length."""

    def __init__(self, path: str, chunk: int = 32_768, overlap: int = 256):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: No piece has a space behind another character: nothing spans a word's end.
        self.words_part = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def cuts(self, text: str) -> list[int]:
        """Where the pieces of ``text`` begin, in characters.

        A piece in bytes spells out one character; its first byte begins it.
        """
        out, at, more = [], 0, 0
        for n, piece in enumerate(self.model.encode(text, out_type=str)):
            if more:
                more -= 1
                out.append(-1)
                continue
            out.append(at)
            if len(piece) == 6 and piece.startswith("<0x") and piece[5] == ">" and not text.startswith(piece, at):
                first = int(piece[3:5], 16)
                more = (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
                at += 1
            else:
                at += len(piece) - (n == 0)  # the first begins with a space that the text doesn't have
        if at != len(text):
            raise ValueError("the model changes texts; offsets can't be told")
        return out

    def stable(self, text: str, at: int) -> bool:
        """Whether the whole text is surely cut before ``text[at]``."""
        return self.words_part and 0 < at < len(text) and text[at] == " " and text[at - 1] not in (" ", SPACE)

    def __call__(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.model.encode(text))
        total, begin = 0, 0  # begin: the text before it is counted; a stable place
        start = 0  # of the chunk that holds begin
        while True:
            width = self.overlap
            end = start + self.chunk + width
            if end >= len(text):
                return total + self._from(text[start:], begin - start)
            left = self.cuts(text[start:end])
            middle = start + self.chunk
            at = self._splice(text, left, start, middle, end)
            while at is None:
                width *= 2
                self.widened += 1
                end = middle + width
                if end >= len(text):
                    return total + self._from(text[start:], begin - start)
                left = self.cuts(text[start:end])
                at = self._splice(text, left, start, middle, end)
            total += sum(begin - start <= x < at - start for x in self._filled(left))
            begin, start = at, middle

    def _splice(self, text: str, left: list[int], start: int, middle: int, end: int) -> int | None:
        """The first stable place in the overlap where the left chunk and the next one cut."""
        ours = {start + x for x in left if x >= 0}
        theirs = {middle + x for x in self.cuts(text[middle:end]) if x >= 0}
        common = sorted(x for x in ours & theirs if middle < x < end and self.stable(text, x))
        return common[0] if common else None

    @staticmethod
    def _filled(cuts: list[int]) -> list[int]:
        """Bytes within a character count where it begins."""
        out, at = [], 0
        for x in cuts:
            at = x if x >= 0 else at
            out.append(at)
        return out

    def _from(self, text: str, at: int) -> int:
        if at <= 0:
            return len(self.model.encode(text))
        cuts = self._filled(self.cuts(text))
        return len(cuts) - bisect_left(cuts, at)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, chunk: int = 32_768, overlap: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_tokens, over_limit.

    A null text is an empty one and has no tokens. Rows that repeat an id are rows of
    their own; an empty table gives no rows; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = SplicedCounter(model, chunk, overlap)
        for batch in batches:
            counts = [counter(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    text = text_of(text_col)
    rows = docs.select(id_col, F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
