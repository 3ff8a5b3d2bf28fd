"""Quality rules from cross-document line frequency, with built-in expressions only.

Lines are normalised (words lower-cased A-Z, joined by one space) and hashed. For each
host (the ``source`` column) and line, the distinct documents that hold it are counted.
A line that more documents hold than the limits allow is boilerplate, however long: it
is removed, and a document that loses too many of its words with such lines is rejected.

Documents with the same text count once (by a hash of the whole text), so that copies,
which share all their lines, do not turn each other's lines into boilerplate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import SPACES, ascii_lower, carries_columns, counted_join, materialise, text_of, without_lines, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """A line is boilerplate when more than ``docs`` distinct documents of its host, and
    more than ``percent`` % of them, hold it. A document is depleted when less than
    ``left_percent`` % of its words are left."""

    docs: int = 10
    percent: float = 0.2
    left_percent: float = 50.0
    min_words: int = 50
    repeat_percent: float = 50.0


def _filled(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _line_hash(line_words: Column) -> Column:
    return F.xxhash64(F.transform(line_words, ascii_lower))


def repeated_words(hashes: Column, table: DataFrame, name: str) -> DataFrame:
    """Add ``name``: words in three-word windows that the text holds twice or more.

    Windows are sorted by hash inside the row; equal neighbours are repeats. Windows
    that repeat cover three words each, less their overlap with the next one.
    """
    table = table.withColumn("_h", hashes)
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    table = table.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter("_s", lambda x, i: (F.get(F.col("_s"), i - 1)["h"] == x["h"]) | (F.get(F.col("_s"), i + 1)["h"] == x["h"]))
    table = table.withColumn("_d", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covers = F.transform("_d", lambda p, i: F.coalesce(F.least(F.get(F.col("_d"), i + 1) - p, F.lit(3)), F.lit(3)))
    return table.withColumn(name, F.aggregate(covers, F.lit(0).cast("bigint"), lambda a, x: a + x)).drop("_h", "_s", "_d")


def _measured(docs: DataFrame) -> DataFrame:
    """Per row: its key (id, host, hash of the text), base counts and its lines."""
    t = docs.select("doc_id", "source", text_of("text").alias("_t"))
    numbered = F.transform(F.split("_t", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    t = t.withColumn("_l", F.filter(numbered, lambda x: _filled(x["x"])))
    t = t.withColumn("_lw", F.transform("_l", lambda x: F.struct(x["i"].alias("i"), words(x["x"]).alias("w"))))
    t = t.withColumn("_w", F.flatten(F.transform("_lw", lambda x: x["w"])))
    windows = F.when(
        F.size("_w") > 2,
        F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get(F.col("_w"), i), F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    t = repeated_words(windows, t, "n_repeat_words")
    raw = F.transform("_l", lambda x: x["x"])
    return t.select(
        "doc_id", "source", F.xxhash64("_t").alias("_key"),
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct(raw))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform("_lw", lambda x: F.struct(x["i"].alias("i"), _line_hash(x["w"]).alias("h"), F.size(x["w"]).alias("n"))).alias("_lines"),
    )


def boilerplate(measured: DataFrame, limits: Limits) -> DataFrame:
    """(_host, h, _rows) of the lines above the limits; _host holds the source, null
    included, and _rows counts the lines, those of copies and repeats too."""
    lines = measured.select(F.struct("source").alias("_host"), "_key", F.explode("_lines.h").alias("h"))
    held = lines.groupBy("_host", "h", "_key").agg(F.count("*").alias("_n"))
    held = held.groupBy("_host", "h").agg(F.count("*").alias("_docs"), F.sum("_n").alias("_rows")).filter(F.col("_docs") > limits.docs)
    hosts = measured.select(F.struct("source").alias("_host"), "_key").distinct().groupBy("_host").agg(F.count("*").alias("_of"))
    return held.join(hosts, "_host").filter(F.col("_docs") * 100.0 > F.col("_of") * limits.percent).select("_host", "h", "_rows")


def judged(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts, left_words, base_failed, kept.

    A null text has no words and fails; a null source is a host of its own; rows that
    repeat an id, a source and a text get the same verdict; an empty table gives no
    rows. Also carries source, ``_key``, the hash of the text, and ``_bad``, the numbers
    of the row's boilerplate lines (null: none).
    """
    limits = limits or Limits()
    m = materialise(_measured(docs), "quality").withColumn("_id", F.struct("doc_id", "source", "_key"))
    lines = m.select("_id", F.struct("source").alias("_host"), F.explode("_lines").alias("x")).select("_id", "_host", "x.*")
    total = m.agg(F.sum(F.size("_lines"))).first()[0] or 0
    hit = counted_join(lines, materialise(boilerplate(m, limits), "boilerplate"), ["_host", "h"], F.col("_id"), total)
    # A row that is repeated has each of its lines as often: one of each counts.
    lost = hit.groupBy("_id").agg(F.collect_set(F.struct("i", "n")).alias("_hit"))
    lost = lost.select("_id", F.aggregate("_hit", F.lit(0), lambda a, x: a + x["n"]).alias("_lost"), F.transform("_hit", lambda x: x["i"]).alias("_bad"))
    out = m.drop("_lines").join(lost, "_id", "left")
    left = F.col("n_words") - F.coalesce("_lost", F.lit(0))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    out = out.withColumn("left_words", left).withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & (100.0 * left >= limits.left_percent * F.col("n_words"))).drop("_lost", "_id")


@carries_columns
def quality_rules(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The documents that pass, all columns, boilerplate lines removed from their texts.

    ``n_chars``, where there is one, follows the text. Columns other than doc_id, source
    and text are carried, whatever their names.
    """
    verdict = judged(docs, limits).filter("kept").select(F.struct("doc_id", "source", "_key").alias("__id"), F.col("_bad").alias("__bad")).dropDuplicates(["__id"])
    mine = F.struct(F.col("doc_id"), F.col("source"), F.xxhash64(text_of("text")).alias("_key"))
    good = docs.withColumn("__id", mine).join(verdict, "__id")
    return without_lines(good, "__bad", docs)
