"""A quality classifier: random Fourier features, ridge by normal equations, isotonic scores.

A document becomes a few statistics of its text. Random Fourier features of the
standardised statistics approximate a Gaussian kernel. Every partition sums its part of
the normal equations, Spark adds the sums cell by cell, and the small system (one row
per feature) is solved on the driver. The raw scores of a part of the labelled documents
that the weights haven't seen are then calibrated by isotonic regression over a fixed grid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import materialise, ship, text_of

#: Statistics of a text, in this order.
STATISTICS = (
    "log_words", "word_length", "word_length_spread", "symbol_share", "digit_share", "upper_share", "punctuation_share",
    "other_share", "distinct_word_share", "repeated_window_share", "repeated_line_share", "log_line_words", "short_line_share",
    "entropy", "top_word_share", "odd_word_share", "bar_share", "stop_share",
)
_DIGITS, _UPPER, _PUNCTUATION = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?'\"()-"
_SYMBOLS, _OTHER = b"#*$%&<>@^_~=+\\/[]{}`", bytes(range(128, 256))

ship(__name__)


def statistics(text: str) -> list[float]:
    """The statistics of a text; all zero for a text without a word."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(raw)
    share = lambda chars: 1 - len(raw.translate(None, chars)) / size
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    windows = list(zip(words, words[1:], words[2:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spread = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    spread = spread[spread > 0] / size
    odd = sum(c for w, c in counts.items() if w.translate(None, _SYMBOLS) != w)
    frequent = sorted(counts.values(), reverse=True)[:10]
    return [
        math.log1p(n), float(lengths.mean()), float(lengths.std()), share(_SYMBOLS), share(_DIGITS), share(_UPPER), share(_PUNCTUATION),
        share(_OTHER), len(counts) / n, 1 - len(set(windows)) / max(1, len(windows)), 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)),
        sum(len(x) < 40 for x in lines) / len(lines), float(-(spread * np.log(spread)).sum()), frequent[0] / n, odd / n, share(b"|"), sum(frequent) / n,
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics ``x`` of each row's text; null counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of("text").alias("_t")).mapInArrow(each, f"doc_id {kind}, x array<double>")


@dataclass
class Model:
    """Everything a score needs; its size depends on the settings alone."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    low: float
    high: float
    grid: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(x), 1)), z, waves])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def cell(self, raw: np.ndarray) -> np.ndarray:
        cells = len(self.grid)
        return np.clip((raw - self.low) / (self.high - self.low) * cells, 0, cells - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a slight slope within steps so that the order of raw scores stays."""
        at = self.cell(self.raw(x))
        return np.clip(0.999 * self.grid[at.astype(int)] + 0.001 * at / len(self.grid), 0, 1)


def isotonic(good: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Non-decreasing means by pooling adjacent violators; cells without rows take their neighbours'."""
    steps: list[list[float]] = []
    for g, n in zip(good, seen):
        if n:
            steps.append([g, n, 1])
        elif steps:
            steps[-1][2] += 1
        else:
            steps.append([0.0, 0.0, 1])
        while len(steps) > 1 and (not steps[-2][1] or (steps[-1][1] and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1])):
            g1, n1, k1 = steps.pop()
            steps[-1] = [steps[-1][0] + g1, steps[-1][1] + n1, steps[-1][2] + k1]
    return np.concatenate([np.full(int(k), g / n if n else 0.5) for g, n, k in steps])


def _batch(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(STATISTICS))


def fit(labelled: DataFrame, waves: int = 128, width: float = 3.0, ridge: float = 1.0, cells: int = 256, seed: int = 7) -> Model:
    """Fit on ``labelled`` (x, y in 0/1, part: 0 for weights, 1 for calibration).

    All labelled rows count. What reaches the driver is one row of moments and one cell
    per pair of features. Without labelled rows every score is one half.
    """
    d = len(STATISTICS)
    moments = labelled.select(*[F.avg(F.col("x")[i]) for i in range(d)], *[F.stddev_pop(F.col("x")[i]) for i in range(d)], F.count("*")).first()
    draw = np.random.default_rng(seed)
    directions, phases = draw.standard_normal((d, waves)) / width, draw.uniform(0, 2 * math.pi, waves)
    if not moments[2 * d]:
        return Model(np.zeros(d), np.ones(d), directions, phases, np.zeros(1 + d + waves), 0.0, 1.0, np.full(cells, 0.5))
    mean, scale = np.array(moments[:d], float), np.maximum(np.array(moments[d : 2 * d], float), 1e-9)
    model = Model(mean, scale, directions, phases, np.zeros(1 + d + waves), 0.0, 1.0, np.zeros(cells))
    size = 1 + d + waves

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = model.features(_batch(part.column(0)))
                total += z.T @ np.hstack([z, part.column(1).to_numpy(zero_copy_only=False)[:, None]])
        if total.any():
            i, j = np.triu_indices(size, 0, size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    own = labelled.filter("part = 0").select("x", F.col("y").cast("double")).mapInArrow(sums, "i int, j int, v double")
    found = own.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # one row per pair of features
    if len(found):
        a = np.zeros((size, size + 1))
        a[found["i"], found["j"]] = found["v"]
        square = a[:, :size] + np.triu(a[:, :size], 1).T
        model.weights = np.linalg.solve(square + ridge * np.eye(size), a[:, size])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = model.cell(model.raw(_batch(batch.column(0)))).astype(np.int32) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["cell", "y"])

    held = labelled.filter("part = 1").select("x", F.col("y").cast("int")).mapInArrow(binned, "cell int, y int")
    counts = held.groupBy("cell").agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()  # one row per cell
    good, seen = np.zeros(cells), np.zeros(cells)
    for row in counts:
        good[row["cell"]], seen[row["cell"]] = row["good"], row["n"]
    model.grid = isotonic(good, seen)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learns from rows of ``labels`` (doc_id, quality) whose crc32(doc_id) mod 5 is not 0:
    4 calibrates, 1 to 3 give the weights. Null labels and ids that ``docs`` hasn't are
    left out; a text with several labels counts with each. Null texts are empty, and
    empty texts get a score too. A null doc_id is held out. Nothing but the text enters a score.
    """
    rows = materialise(described(docs), "statistics")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").alias("y"))
    train = rows.filter(crc > 0).join(known, F.col("doc_id") == F.col("_id"))
    train = materialise(train.select("x", "y", F.when(crc == 4, 1).otherwise(0).alias("part")), "labelled")
    model = fit(train, **options)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(_batch(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(scored, f"doc_id {kind}, score double")
    held = F.coalesce(crc == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
