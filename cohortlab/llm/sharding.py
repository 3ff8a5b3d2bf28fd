"""Balanced label propagation: linked documents move to their neighbours' shards.

Documents are linked when they share a group (here: equal texts). What propagates are
counted cells: how many members a group has in each shard, at most one row a group and
shard however many documents the group has; documents without neighbours take no part. In
each round every cell that isn't where most of its group lies, among the shards with
room, asks to move there, if that gives its members more neighbours. A shard admits
movers up to its quota, in an order fixed by hash: a cell may move in part. Every move
raises the number of neighbours beside each other, so rounds end by themselves, when no
move is admitted. Then rows are placed once, by their rank within their group.

A last pass moves the rows above each shard's exact share, unlinked ones first, to the
shards below theirs, and numbers the rows of each shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlab.llm.common import materialise
from cohortlab.session import Written, rewritten

BUCKETS = 1024
#: A group is hot with more than one in so many rows, so there are fewer hot groups than that.
HOT_SHARE = 1000
#: Parts in which the rows of a hot group are ranked.
PARTS = 64


def _bucket(hashed: Column, n: int = BUCKETS) -> Column:
    return F.pmod(hashed, F.lit(n)).cast("int")


def cells_of(rows: DataFrame, shards: int) -> DataFrame:
    """(_group, _shard, _n) of the groups with two rows or more, each row in the shard of its hash."""
    cells = rows.groupBy("_group", _first_shard(shards).alias("_shard")).agg(F.count("*").alias("_n"))
    # At most ``shards`` cells a group.
    return cells.withColumn("_m", F.sum("_n").over(W.partitionBy("_group"))).filter("_m > 1").drop("_m")


def _first_shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int")


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = {r["_shard"]: r["n"] for r in cells.groupBy("_shard").agg(F.sum("_n").alias("n")).collect()}  # one row a shard
    return [found.get(s, 0) for s in range(shards)]


def propagate(cells: DataFrame, total: int, shards: int, slack: float = 0.02, rounds: int | None = None) -> DataFrame:
    """The cells (_group, _shard, _n) after propagation.

    A shard that linked rows fill to its even share of ``total`` takes no more; while cells
    move it may hold ``slack`` more. ``rounds`` ends the propagation early, if given.
    """
    now = Written.of(cells, "cells")
    cap = int(total / shards * (1 + slack)) + 1
    done = 0
    while rounds is None or done < rounds:
        done += 1
        open_to = [s for s, n in enumerate(_loads(now.rows, shards)) if n < total / shards]
        spot = F.struct("_n", F.xxhash64("_group", "_shard").alias("_tie"), "_shard")
        best = F.max(F.when(F.col("_shard").isin(open_to), spot)).over(W.partitionBy("_group"))
        asks = now.rows.withColumn("_best", best)
        goes = (F.col("_best._shard") != F.col("_shard")) & (F.col("_best._n") >= F.col("_n"))
        asks = asks.withColumn("_to", F.when(goes, F.col("_best._shard"))).drop("_best")
        asks = asks.withColumn("_k", F.xxhash64(F.lit("move"), "_group", "_shard"))
        asks = Written.of(asks.withColumn("_at", _bucket(F.col("_k"))), "asks")
        moving = asks.rows.filter("_to IS NOT NULL")
        free = F.array(*[F.lit(max(0, cap - n)).cast("bigint") for n in _loads(asks.rows.filter("_to IS NULL"), shards)])
        # At most shards * BUCKETS rows: safe to broadcast at any input size.
        queue = moving.groupBy("_to", "_at").agg(F.sum("_n").alias("_q"))
        queue = queue.select("_to", "_at", (F.sum("_q").over(W.partitionBy("_to").orderBy("_at")) - F.col("_q")).alias("_ahead"))
        inside = W.partitionBy("_to", "_at").orderBy("_k", "_group", "_shard").rowsBetween(W.unboundedPreceding, -1)
        moving = moving.join(F.broadcast(queue), ["_to", "_at"])
        left = F.get(free, F.col("_to")) - F.col("_ahead") - F.coalesce(F.sum("_n").over(inside), F.lit(0))
        moving = moving.withColumn("_go", F.greatest(F.lit(0), F.least(F.col("_n"), left)).cast("bigint"))
        stays = asks.rows.filter("_to IS NULL").select("_group", "_shard", "_n", F.lit(0).cast("bigint").alias("_go"))
        parts = F.array(
            F.struct("_shard", (F.col("_n") - F.col("_go")).alias("_n"), F.lit(0).cast("bigint").alias("_go")),
            F.struct(F.col("_to").alias("_shard"), F.col("_go").alias("_n"), "_go"),
        )
        after = stays.unionByName(moving.select("_group", F.explode(parts).alias("c")).select("_group", "c._shard", "c._n", "c._go"))
        after = after.groupBy("_group", "_shard").agg(F.sum("_n").alias("_n"), F.sum("_go").alias("_go")).filter("_n > 0")
        now = rewritten(now, after, "cells")
        asks.drop()
        moved = now.rows.agg(F.sum("_go")).first()[0]
        now = Written(now.path, now.rows.drop("_go"))
        if not moved:
            break
    return now.rows


def placed(rows: DataFrame, cells: DataFrame, total: int, shards: int) -> DataFrame:
    """``rows`` with ``_shard``, and ``_linked``, the neighbours beside the row: a group's rows fill
    its cells in the order of their hash. Hot groups, of which there are fewer than
    ``HOT_SHARE``, are met by broadcast and ranked in parts; the others by their group."""
    lo = F.sum("_n").over(W.partitionBy("_group").orderBy("_shard")) - F.col("_n")
    spans = cells.withColumn("_lo", lo).groupBy("_group").agg(
        F.sum("_n").alias("_members"), F.sort_array(F.collect_list(F.struct("_lo", "_n", "_shard"))).alias("_spans")
    )
    spans = materialise(spans, "spans")
    hot = spans.filter(F.col("_members") * HOT_SHARE > total)
    key = F.xxhash64(F.lit("rank"), "_row")
    order = [F.col("_k"), F.col("_row")]
    rows = rows.withColumn("_k", key)

    busy = rows.join(F.broadcast(hot), "_group").withColumn("_part", _bucket(F.col("_k"), PARTS))
    # At most HOT_SHARE * PARTS rows.
    parts = busy.groupBy("_group", "_part").agg(F.count("*").alias("_c"))
    parts = parts.select("_group", "_part", (F.sum("_c").over(W.partitionBy("_group").orderBy("_part")) - F.col("_c")).alias("_ahead"))
    busy = busy.join(F.broadcast(parts), ["_group", "_part"])
    busy = busy.withColumn("_rank", F.col("_ahead") + F.row_number().over(W.partitionBy("_group", "_part").orderBy(*order)) - 1)

    calm = rows.join(F.broadcast(hot.select("_group")), "_group", "left_anti").join(spans.filter(F.col("_members") * HOT_SHARE <= total), "_group", "left")
    calm = calm.withColumn("_rank", (F.row_number().over(W.partitionBy("_group").orderBy(*order)) - 1).cast("bigint"))
    out = busy.drop("_part", "_ahead").unionByName(calm)
    own = F.get(F.filter("_spans", lambda s: (s["_lo"] <= F.col("_rank")) & (F.col("_rank") < s["_lo"] + s["_n"])), F.lit(0))
    out = out.withColumn("_own", own).withColumn("_shard", F.coalesce("_own._shard", _first_shard(shards)))
    return out.withColumn("_linked", F.coalesce(F.col("_own._n") - 1, F.lit(0))).drop("_own", "_rank", "_k", "_spans", "_members")


def evened(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with shard and slot: counts differ by at most one, slots run from 0 without gaps.

    Rows of a shard are ordered by (unlinked last, hash bucket, hash, row). Those up to
    the shard's share keep their place; the others, counted over all shards, fill the
    gaps of the shards below their share.
    """
    key = F.xxhash64(F.lit("even"), "_row")
    rows = rows.withColumn("_k", key).withColumn("_part", F.when(F.col("_linked") > 0, 0).otherwise(BUCKETS) + _bucket(key))
    rows = materialise(rows, "uneven")
    parts = rows.groupBy("_shard", "_part").agg(F.count("*").alias("_n"))
    parts = parts.withColumn("_ahead", F.sum("_n").over(W.partitionBy("_shard").orderBy("_part")) - F.col("_n"))
    loads = {r["_shard"]: r["n"] for r in rows.groupBy("_shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    total = sum(loads.values())
    # The larger shares go to the fullest shards: fewest moves.
    fullest = sorted(range(shards), key=lambda s: (-loads.get(s, 0), s))
    share = {s: total // shards + (place < total % shards) for place, s in enumerate(fullest)}
    over, gaps, before, room = [], [], 0, 0
    for s in range(shards):
        over.append((s, share[s], before))
        before += max(0, loads.get(s, 0) - share[s])
        if share[s] > loads.get(s, 0):
            gaps.append((room, room + share[s] - loads.get(s, 0), s, loads.get(s, 0)))
            room = gaps[-1][1]
    spark = rows.sparkSession
    over = spark.createDataFrame(over, "_shard int, _share bigint, _before bigint")
    gap = F.array(*[F.struct(F.lit(a).cast("bigint").alias("lo"), F.lit(b).cast("bigint").alias("hi"), F.lit(s).cast("int").alias("s"), F.lit(c).cast("bigint").alias("c")) for a, b, s, c in gaps or [(0, 0, 0, 0)]])
    # Both tables are bounded by the number of shards (times 2 * BUCKETS).
    rows = rows.join(F.broadcast(parts.drop("_n")), ["_shard", "_part"]).join(F.broadcast(over), "_shard")
    place = F.col("_ahead") + F.row_number().over(W.partitionBy("_shard", "_part").orderBy("_k", "_row")) - 1
    rows = rows.withColumn("_p", place).withColumn("_q", F.col("_before") + F.col("_p") - F.col("_share"))
    to = F.get(F.filter(gap, lambda g: (g["lo"] <= F.col("_q")) & (F.col("_q") < g["hi"])), F.lit(0))
    rows = rows.withColumn("_gap", F.when(F.col("_p") >= F.col("_share"), to))
    stays = F.col("_gap").isNull()
    rows = rows.withColumn("shard", F.when(stays, F.col("_shard")).otherwise(F.col("_gap.s")))
    rows = rows.withColumn("slot", F.when(stays, F.col("_p")).otherwise(F.col("_gap.c") + F.col("_q") - F.col("_gap.lo")).cast("bigint"))
    return rows.drop("_k", "_part", "_ahead", "_share", "_before", "_p", "_q", "_gap", "_linked")


def shard_documents(docs: DataFrame, shards: int = 40, group: Column | None = None, carry: dict[str, Column] | None = None, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, shard, slot and the columns of ``carry``.

    ``group``: documents with the same value are linked; by default the SHA-256 of the
    text, so equal texts. Null texts count as empty texts, which link like any other.
    Rows that repeat an id are rows of their own. An empty table gives no rows; other
    columns are not read. The order of rows in files doesn't matter: rows are told
    apart by id, text and, where those repeat, a number among the repeats.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    group = F.unhex(F.sha2(text.cast("binary"), 256)) if group is None else group
    rows = docs.select("doc_id", group.alias("_group"), *[c.alias(n) for n, c in (carry or {}).items()])
    again = W.partitionBy("doc_id", "_group").orderBy(F.lit(0))
    rows = rows.withColumn("_row", F.struct("doc_id", "_group", F.row_number().over(again).alias("_again")))
    rows = rows.withColumn("_row", F.struct(F.xxhash64("_row").alias("h"), F.col("_row.doc_id").alias("d"), F.col("_row._again").alias("n")))
    rows = materialise(rows, "rows")
    total = rows.count()
    cells = propagate(cells_of(rows, shards), total, shards, **options)
    return evened(placed(rows, cells, total, shards), shards).drop("_row", "_group")
