"""Mixing sources to target weights along a curriculum, with built-in expressions only.

Each source has a weight and a schedule of rates over training time 0..1. Targets come
from the weights, capped at a multiple of the source's size. The schedule is integrated
into the source's cumulative demand; a document that begins after c words of its source
is due when the demand has reached c, so its training position is the inverse of the
demand at c. Documents are range-sorted by position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlab.llm.common import carries_columns, materialise, text_of, words

#: Order buckets within a source; each is sorted in a task of its own.
BUCKETS = 4096


@dataclass(frozen=True)
class Mix:
    """``weights`` go round over the sources in code-point order, null last. The mix is
    ``share`` times all words; no source gives more than ``repeats`` times its words.
    ``tilts`` go round as well: a source's rate falls (above 0) or rises (below 0) along a
    straight line from 1 + tilt to 1 - tilt times its mean; -1 <= tilt <= 1."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    tilts: tuple[float, ...] = (0.5, 0.0, -0.5)
    share: float = 1.5
    repeats: int = 2


def _round(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.pmod(rank - 1, F.lit(len(values))).cast("int") + 1)


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """Adds weight, tilt and target to (source, source_size); one row a source.

    Sources fill up in the order of cap / weight. The first that its share of what is
    left doesn't fill, and all behind it, get that share; those before it their cap.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    t = sources.withColumn("_rank", rank)
    t = t.withColumn("weight", _round(mix.weights, F.col("_rank"))).withColumn("tilt", _round(mix.tilts, F.col("_rank")))
    t = t.withColumn("_cap", F.col("source_size") * F.lit(mix.repeats)).withColumn("_level", F.col("_cap") / F.col("weight"))
    order = W.orderBy("_level", "_rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(float(mix.share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    t = t.withColumn("_fill", F.greatest(F.lit(0.0), left) / F.sum("weight").over(from_here))
    t = t.withColumn("_open", F.col("_fill") <= F.col("_level"))
    fill = F.min(F.when(F.col("_open"), F.struct("_level", "_rank", "_fill"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["_fill"]
    capped = F.col("_cap").cast("double")
    target = F.when(fill.isNull(), capped).otherwise(F.least(capped, fill * F.col("weight")))
    return t.select("source", "source_size", "weight", "tilt", target.alias("target"))


def position(words_before: Column, target: Column, tilt: Column) -> Column:
    """When the demand target * (t + tilt * (t - t^2)) reaches ``words_before``: the root in 0..1."""
    share = words_before / target
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + tilt) * (1 + tilt) - 4 * tilt * share))
    return F.least(F.lit(1.0), 2 * share / (1 + tilt + root))


def mixed(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """One row per row of ``docs``: its columns doc_id and source, size, source_size, target,
    taken and ``copies``, an array of (copy, taken, position) without those that take nothing.

    A source goes through its documents in the order of md5(doc_id), as often as its
    target asks; the last document of a source may give part of its words. A null or
    empty text has size 0 and is not taken; a null source is a source of its own; a
    null doc_id is ordered last. Rows that repeat an id are rows of their own. An
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    mix = mix or Mix()
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "source", F.size(words(text_of("text"))).cast("bigint").alias("size"), key.alias("_md5"), F.xxhash64(text_of("text")).alias("_h"))
    rows = materialise(rows.withColumn("_bucket", F.conv(F.substring("_md5", 1, 3), 16, 10).cast("int")).withColumn("_s", F.struct("source")), "sizes")
    buckets = rows.groupBy("_s", "_bucket").agg(F.sum("size").alias("_sum"))
    buckets = materialise(buckets, "buckets")
    sources = targets(buckets.groupBy("_s").agg(F.sum("_sum").alias("source_size")).select(F.col("_s.source").alias("source"), "source_size"), mix)
    sources = sources.select(F.struct("source").alias("_s"), "source_size", "tilt", "target")
    start = F.sum("_sum").over(W.partitionBy("_s").orderBy("_bucket")) - F.col("_sum")
    buckets = buckets.select("_s", "_bucket", start.alias("_start")).join(sources, "_s")
    rows = rows.join(buckets, ["_s", "_bucket"])
    inside = F.sum("size").over(W.partitionBy("_s", "_bucket").orderBy("_md5", "doc_id", "size", "_h").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_begin", F.col("_start") + inside - F.col("size"))
    words_in_all = F.floor(F.col("target") + F.lit(0.5))
    each = []
    for copy in range(mix.repeats):
        begin = F.col("_begin") + F.col("source_size") * copy
        taken = F.greatest(F.lit(0), F.least(F.col("size"), words_in_all - begin)).cast("bigint")
        at = F.when(taken > 0, position(begin, F.col("target"), F.col("tilt")))
        each.append(F.struct(F.lit(copy).alias("copy"), taken.alias("taken"), at.alias("position")))
    rows = rows.withColumn("_each", F.array(*each))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("_each", F.lit(0).cast("bigint"), lambda a, x: a + x["taken"]).alias("taken"),
        F.filter("_each", lambda x: x["taken"] > 0).alias("copies"), "_h",
    )


@carries_columns
def curriculum(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The mix as a training set: all columns of ``docs``, a row for each copy that the mix
    takes, range-sorted by training position, then doc_id and copy. A document of
    which only part of the words are due is given whole. Rows that repeat an id and a
    text count as often as they are there.
    """
    plan = mixed(docs, mix).filter("taken > 0")
    due = plan.select(F.struct("doc_id", "source", "_h").alias("__id"), F.explode("copies").alias("__copy"))
    # A row repeated k times has k plans: each plan goes to one of the rows.
    nth = F.row_number()
    due = due.withColumn("__nth", nth.over(W.partitionBy("__id", F.col("__copy.copy")).orderBy("__copy.position")))
    rows = docs.withColumn("__id", F.struct(F.col("doc_id"), F.col("source"), F.xxhash64(text_of("text")).alias("_h")))
    rows = rows.withColumn("__nth", nth.over(W.partitionBy("__id").orderBy(F.lit(1))))
    out = rows.join(due, ["__id", "__nth"])
    return out.orderBy("__copy.position", "doc_id", "__copy.copy").drop("__id", "__nth", "__copy")
