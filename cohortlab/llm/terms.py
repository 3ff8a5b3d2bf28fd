"""Terms of a text: runs of ASCII letters and digits and of anything beyond ASCII, with only
A-Z lower-cased. Works on UTF-8 bytes, where every other ASCII byte parts two terms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab.llm.common import ship, text_of

ship(__name__)


def _byte(b: int) -> int:
    if 0x41 <= b <= 0x5A:
        return b + 0x20
    return b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20


#: Every byte's fate: itself, its lower case, or a space.
FOLD = bytes(_byte(b) for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def utf8(column: str | Column) -> Column:
    """The text as bytes; null counts as empty."""
    return text_of(column).cast("binary")


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]
