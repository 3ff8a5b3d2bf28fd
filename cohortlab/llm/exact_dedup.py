"""Exact duplicates by deterministic block naming, with built-in expressions only.

A text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted
into integer names. Adjacent names are then paired, distinct pairs are sorted into
names again, and so on until each text has one name. Two texts have the same
(depth, name) if and only if they are equal.

Blocks travel once, as distinct values; every occurrence refers to its block by a
64-bit hash. Where a hash stands for more than one block (counted, not assumed),
those occurrences are joined on the bytes themselves, so no identity rests on a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlab.llm.common import ascii_lower, materialise, salted_join, text_of

BUCKETS = 4096


def _named(distinct: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """An integer from 1 for each row: its rank in its bucket, then the bucket.

    Buckets are cut by hash, so each is an even share of the rows and is sorted in
    a task of its own; rank * BUCKETS + bucket is unique without a global sort.
    """
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    return distinct.withColumn("_bucket", bucket.cast("int")).withColumn("name", rank.cast("bigint") * BUCKETS + F.col("_bucket")).drop("_bucket")


def _block_hash(block: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(block), 64 - bits) if bits < 64 else F.xxhash64(block)


def identities(docs: DataFrame, normalise=ascii_lower, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``_row``, the id, text_sha256, depth, name.

    Equal normalised texts have equal (depth, name) and others differ. A null text is
    an empty text; empty texts equal each other. Rows that repeat an id are rows of
    their own. ``hash_bits`` below 64 serves tests of the path for shared hashes.
    """
    norm = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), normalise(text_of(text_col)).cast("binary").alias("_b"))
    size = F.greatest(F.lit(1), F.ceil(F.length("_b") / block_bytes).cast("int"))
    norm = norm.withColumn("_n", size).withColumn("text_sha256", F.sha2("_b", 256))
    cut = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring(F.col("_b"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = norm.select(id_col, "_row", "_n", "text_sha256", F.posexplode(cut).alias("_i", "_block")).withColumn("_h", _block_hash(F.col("_block"), hash_bits))

    texts = blocks.select("_h", "_block").distinct()
    names = texts.groupBy("_h").agg(F.count("*").cast("int").alias("_texts"))
    names = names.select("_h", F.explode(F.sequence(F.lit(1), F.col("_texts"))).alias("_rank"))
    names = materialise(_named(names, F.pmod(F.col("_h"), F.lit(BUCKETS)), ["_h", "_rank"]), "block-names")

    shared = names.filter("_rank > 1").select("_h").distinct()
    occurrences = blocks.withColumn("_rank", F.lit(1))
    if not shared.isEmpty():
        ranked = texts.join(shared, "_h", "left_semi").withColumn("_r", F.row_number().over(W.partitionBy("_h").orderBy("_block")))
        occurrences = blocks.join(ranked, ["_h", "_block"], "left").withColumn("_rank", F.coalesce("_r", F.lit(1)))
    first = F.when(F.col("_i") == 0, F.col("text_sha256")).alias("text_sha256")
    occurrences = materialise(occurrences.select(id_col, "_row", "_n", first, "_i", "_h", "_rank"), "blocks")

    level = salted_join(occurrences, names, ["_h", "_rank"], F.col("_row"), salts=8).select("_row", "_n", "_i", "name")
    level = materialise(level, "level-0")
    done, depth = [level.filter("_n = 1").select("_row", F.lit(0).alias("depth"), "name")], 0
    most = occurrences.agg(F.max("_n")).first()[0] or 1
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        half = (F.col("_i") / 2).cast("int")
        side = lambda odd: F.max(F.when(F.col("_i") % 2 == odd, F.col("name")))
        pairs = level.filter("_n > 1").groupBy("_row", ((F.col("_n") + 1) / 2).cast("int").alias("_n"), half.alias("_i"))
        pairs = pairs.agg(side(0).alias("_left"), F.coalesce(side(1), F.lit(0)).alias("_right"))
        of_pairs = _named(pairs.select("_left", "_right").distinct(), F.pmod(F.xxhash64("_left", "_right"), F.lit(BUCKETS)), ["_left", "_right"])
        level = salted_join(pairs, of_pairs, ["_left", "_right"], F.col("_row"), salts=8).select("_row", "_n", "_i", "name")
        level = materialise(level, f"level-{depth}")
        done.append(level.filter("_n = 1").select("_row", F.lit(depth).alias("depth"), "name"))
    named = done[0]
    for more in done[1:]:
        named = named.union(more)
    rows = occurrences.filter("_i = 0").select("_row", id_col, "text_sha256")
    return rows.join(named, "_row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of each group of equal texts stays; among rows that
    repeat that id one stays, and a null id is smaller than any other. An empty table
    gives no rows. Other columns of ``docs`` are not read.
    """
    rows = materialise(identities(docs, id_col=id_col, **options), "identities")
    groups = rows.groupBy("depth", "name").agg(F.count("*").alias("group_size"), F.max(F.struct(id_col, "_row")).alias("_keep"))
    groups = groups.filter("group_size > 1")
    out = salted_join(rows, groups, ["depth", "name"], F.col("_row"), "left")
    keep = F.col("_keep")[id_col]
    alone = F.col("group_size").isNull()
    return out.select(
        id_col,
        F.when(alone, F.col(id_col)).otherwise(keep).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("_keep")["_row"] == F.col("_row"))).alias("kept"),
        "text_sha256",
    )
