"""Importance resampling towards a target distribution, on hashed runs of words.

A head of frequent words and frequent word pairs is counted exactly and broadcast: each
word with the state of its CRC, from which a run goes on, and each pair with its bucket.
What isn't in the head, the tail, takes its CRC directly. Both give the same bucket for
the same run, so the totals of the buckets are exact. A document's weight is the sum of
the log ratios of its buckets; Gumbel noise and a cut at the k-th score draw without
replacement.

The head holds words that make up at least one in ``head`` of all words, so there are at
most ``head`` of them, and likewise pairs, whatever the input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import materialise, ship
from cohortlab.llm.terms import terms, utf8

ship(__name__)

#: Distinct words a task holds before it passes their counts on.
HELD = 500_000
#: Texts of which the words are looked at together.
TEXTS = 256


class Head(dict):
    """From a word to its CRC state, from a pair (two states) to its bucket; what is missing
    is computed and not kept."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


@dataclass(frozen=True)
class Features:
    """Runs of 1 to ``length`` words, and the bucket of each."""

    length: int
    buckets: int
    words: Head
    pairs: dict[tuple[bytes, bytes], int]

    def of(self, found: list[bytes]) -> np.ndarray:
        """The buckets of all runs of a text, repeats included."""
        states = list(map(self.words.__getitem__, found))
        out = [np.array(states, np.int64) % self.buckets]
        if self.length > 1 and len(found) > 1:
            pairs, size = self.pairs, self.buckets
            of_pairs = []
            for state, pair in zip(states, zip(found, found[1:])):
                at = pairs.get(pair)
                of_pairs.append(crc32(b" " + pair[1], state) % size if at is None else at)
            out.append(np.array(of_pairs, np.int64))
        for n in range(3, self.length + 1):
            runs = (crc32(b" " + b" ".join(found[i + 1 : i + n]), states[i]) % self.buckets for i in range(len(found) - n + 1))
            out.append(np.fromiter(runs, np.int64))
        return np.concatenate(out)


def _counted(texts: DataFrame, pairs_of: frozenset[bytes] | None = None) -> DataFrame:
    """(run, n) over all texts: words, or pairs of which both words are in ``pairs_of``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = terms(text)
                if pairs_of is not None:
                    found = [a + b" " + b for a, b in zip(found, found[1:]) if a in pairs_of and b in pairs_of]
                seen.update(found)
                if len(seen) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["run", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["run", "n"])

    return texts.mapInArrow(count, "run binary, n bigint").groupBy("run").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, total: int, head: int) -> list[bytes]:
    """The runs that are at least one in ``head`` of ``total``: at most ``head`` rows."""
    return [bytes(r.run) for r in counts.filter(F.col("n") * head >= total).select("run").collect()]


def features(texts: DataFrame, length: int, buckets: int, head: int) -> Features:
    """Counts the words of all texts, then the pairs of frequent words, and keeps the heads."""
    counts = materialise(_counted(texts), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = _frequent(counts, total, head) if total else []
    pairs: dict[tuple[bytes, bytes], int] = {}
    if length > 1 and words:
        # A pair is no more frequent than either of its words.
        counted = materialise(_counted(texts, frozenset(words)), "pair-counts")
        pairs = {tuple(run.split(b" ")): crc32(run) % buckets for run in _frequent(counted, total, head)}
    return Features(length, buckets, Head((w, crc32(w)) for w in words), pairs)


def _totals(texts: DataFrame, shared, buckets: int) -> np.ndarray:
    """Features per bucket over all texts. A task gives at most a row a bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                found = [own.of(terms(text)) for text in batch.column(0).slice(at, TEXTS).to_pylist()]
                total += np.bincount(np.concatenate(found), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = texts.mapInArrow(add, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of a bucket's shares of the target and the source."""
    size = len(source)
    up = (target + 1).astype(float) * float(source.sum() + size)
    down = (source + 1).astype(float) * float(target.sum() + size)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def noise(id_col: str, seed: str | int) -> Column:
    """Gumbel noise in thousandths, from the id alone; a null id counts as the text ''."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``_place``, from 0 in ``order`` over the whole table: rows are dealt by range,
    numbered within their part, and moved on by the rows of the parts before."""
    nth = F.monotonically_increasing_id()
    sorted_parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = sorted_parts.withColumn("_nth", nth.bitwiseAND((1 << 33) - 1)).withColumn("_part", F.shiftright(nth, 33))
    numbered = materialise(numbered, "ranked")
    before, starts = 0, {}
    for part, n in sorted(tuple(r) for r in numbered.groupBy("_part").count().collect()):  # one row a part
        starts[part], before = before, before + n
    start = rows.sparkSession.createDataFrame(list(starts.items()), "_part bigint, _start bigint")
    return numbered.join(F.broadcast(start), "_part").withColumn("_place", F.col("_nth") + F.col("_start")).drop("_nth", "_start", "_part")


def importance_resample(
    docs: DataFrame, target: DataFrame, length: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20,
    seed: str | int = 2024, head: int = 65_536, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score, rank.

    Of the rows with at least ``least_words`` words, the ``percent`` hundredths (rounded
    down) with the highest scores are drawn and ranked from 1; equal scores go by id, a
    null id last. A null or empty text has no features, weight 0, and is not drawn. Rows
    that repeat an id are rows of their own, with the same noise. An empty table gives no
    rows; an empty target is as likely everywhere. Other columns are not read.
    """
    texts = docs.select(utf8(text_col).alias("_text"))
    wanted = target.select(utf8(target_text).alias("_text"))
    spark = docs.sparkSession
    found = features(texts, length, buckets, head)
    shared = spark.sparkContext.broadcast(found)
    gain = gains(_totals(texts, shared, buckets), _totals(wanted, shared, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            sizes, numbers, weights = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms(text)
                at = own.of(words)
                sizes.append(len(words))
                numbers.append(len(at))
                weights.append(int(gain[at].sum()))
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, numbers, weights))]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, utf8(text_col).alias("_text")).mapInArrow(weigh, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint")
    rows = rows.withColumn("score", F.col("weight") + noise(id_col, seed)).withColumn("_in", F.col("n_words") >= least_words)
    rows = materialise(rows, "weighed")  # dealing by range reads its input twice: not the texts
    ranked = _ranked(rows, [F.col("_in").desc(), F.col("score").desc(), F.col(f"`{id_col}`").asc_nulls_last()])
    drawn = ranked.filter("_in").count() * percent // 100
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1)
    return ranked.select(id_col, "n_words", "n_features", "weight", "score", rank.alias("rank"))
