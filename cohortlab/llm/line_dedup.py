"""Repeated runs of lines by winnowing over line hashes, with built-in expressions only.

A window is the shortest run of lines from a given line on, or up to a given line, that
holds ``min_words`` words, so windows of both kinds cover every longer repeated run from
its first line to its last. Of each window the line with the smallest hash is its fingerprint, so any run of
that many words, wherever it stands, has at least one fingerprint and the same one.
Fingerprints that occur once are done with. Around the others the match is extended to
both ends of every window they stand for; of equal windows the first in (doc_id,
position) stays, and the lines of the later ones go. Overlapping windows join into
the longest repeated runs. No pairs of documents are made: each window is compared with
the first of its kind only.

Lines without a word neither break nor lengthen a run; those inside a repeated run go with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlab.llm.common import carries_columns, counted_join, materialise, named, text_of, without_lines, words, xxhash128

MIN_WORDS = 50


def _row_key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id"), F.xxhash64(text_of("text")).alias("_key")]


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every window: (doc_id, _key, first, last, _print, _at, _a, _b); lines count from 0,
    _at is the line of the fingerprint, _a and _b are the hashes of the content."""
    lines = docs.select(*_row_key(docs), F.posexplode(F.split(text_of("text"), "\n", -1)).alias("_at", "_line"))
    lines = lines.withColumn("_n", F.size(words(F.col("_line")))).filter("_n > 0")
    a, b = xxhash128(F.col("_line"))
    # Rows that repeat an id and a text are one document.
    lines = lines.select("doc_id", "_key", "_at", "_n", a.alias("_a"), b.alias("_b")).groupBy("doc_id", "_key", "_at").agg(*[F.first(c).alias(c) for c in ("_n", "_a", "_b")])
    of_doc = W.partitionBy("doc_id", "_key")
    lines = lines.withColumn("_to", F.sum("_n").over(of_doc.orderBy("_at"))).withColumn("_from", F.col("_to") - F.col("_n"))
    ahead = of_doc.orderBy("_from").rangeBetween(0, min_words - 1)
    behind = of_doc.orderBy("_to").rangeBetween(1 - min_words, 0)

    def run(reach) -> Column:
        return F.struct(
            F.min("_at").over(reach).alias("first"), F.max("_at").over(reach).alias("last"),
            (F.max("_to").over(reach) - F.min("_from").over(reach)).alias("_words"),
            F.min(F.struct("_a", "_at")).over(reach).alias("_min"),
            F.collect_list("_a").over(reach).alias("_as"), F.collect_list("_b").over(reach).alias("_bs"),
        )

    # A run back that ends where the run on from its first line ends is that one again.
    out = lines.select("doc_id", "_key", "_n", run(ahead).alias("_on"), run(behind).alias("_back"))
    on = F.when(F.col("_on._words") >= min_words, F.col("_on"))
    back = F.when(F.col("_back._words") - F.col("_n") >= min_words, F.col("_back"))
    out = out.select("doc_id", "_key", F.explode(F.filter(F.array(on, back), lambda x: x.isNotNull())).alias("w")).select("doc_id", "_key", "w.*")
    return out.select("doc_id", "_key", "first", "last", F.col("_min._a").alias("_print"), F.col("_min._at").alias("_at"), F.xxhash64("_as").alias("_a"), F.xxhash64(F.lit("second"), "_bs").alias("_b"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, _key, gone): the sorted numbers of the lines that later runs repeat."""
    w = materialise(windows(docs, min_words), "windows")
    at = F.struct("doc_id", "_key", "_at")
    prints = w.groupBy("_print").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count("*").alias("_rows"))
    prints = materialise(prints.filter("_lo < _hi").select("_print", "_rows"), "prints")
    again = counted_join(w, prints, ["_print"], F.struct("doc_id", "first"), w.count())
    place = F.struct("doc_id", "_key", "first", "last")
    firsts = again.groupBy("_print", "_a", "_b").agg(F.min(place).alias("_first"), F.count("*").alias("_rows")).filter("_rows > 1")
    firsts = materialise(firsts, "first-windows")
    later = counted_join(w, firsts, ["_print", "_a", "_b"], F.struct("doc_id", "first"), w.count())
    first = F.col("_first")
    here = first["doc_id"].eqNullSafe(F.col("doc_id")) & (first["_key"] == F.col("_key"))
    # A run that overlaps its own first occurrence repeats it only beyond that one's end.
    start = F.when(here, F.greatest("first", first["last"] + 1)).otherwise(F.col("first"))
    later = later.filter(~(here & (first["first"] == F.col("first")))).select("doc_id", "_key", start.alias("_s"), "last").filter("_s <= last")
    return later.select("doc_id", "_key", F.explode(F.sequence("_s", "last")).alias("_at")).groupBy("doc_id", "_key").agg(F.array_sort(F.collect_set("_at")).alias("gone"))


@carries_columns
def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with later repeated runs cut from ``text``, and
    ``removed_lines``, the sorted numbers (from 0) of the lines that went.

    Documents are ordered by doc_id (null first), then by a hash of the text. A null
    text stays null; a text of which all goes becomes empty. Rows that repeat an id and
    a text are one document and are treated alike. Columns other than doc_id and
    text are carried, whatever their names; ``n_chars``, where there is one, follows the text.
    """
    gone = repeated_runs(docs, min_words).select(F.struct("doc_id", "_key").alias("__id"), F.col("gone").alias("__gone"))
    here = docs.withColumn("__id", F.struct(*_row_key(docs))).join(gone, "__id", "left")
    here = here.withColumn("removed_lines", F.coalesce("__gone", F.array().cast("array<int>")))
    kept = [c for c in docs.columns if c != "removed_lines"]
    return without_lines(here, "__gone", here.select(*named(kept), "removed_lines"))
