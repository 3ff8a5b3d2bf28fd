"""Ranked lexical search for many items at once, by shared partial sums.

Items share terms. Terms that stand in the same set of items are one leaf; leaves and
nodes that stand together in two or more items are mined, round by round, as shared
nodes of a DAG, each the sum of two others. For a block of documents every leaf's
accumulator is filled once from the documents' postings, every shared node is added up
once, level by level, and each item is the sum of the few nodes that are left of it.

Scores are whole numbers, so sums don't depend on their order and the DAG changes no
score. Each task keeps the best ``k`` documents of each item; nothing else leaves it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlab.llm.common import materialise, ship
from cohortlab.llm.terms import terms, utf8

ship(__name__)

#: Documents whose accumulators are held together.
BLOCK = 512


@dataclass
class SharingPlan:
    """``leaf_of``: a term's leaf. ``levels``: for each level the new nodes and the two nodes
    each adds up. ``parts``: the nodes of which an item is the sum. Nodes below
    ``n_leaves`` are leaves."""

    leaf_of: np.ndarray
    n_leaves: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    parts: list[np.ndarray]

    @property
    def n_nodes(self) -> int:
        return self.n_leaves + sum(len(new) for new, _, _ in self.levels)

    def additions(self) -> int:
        """Additions a document takes behind the leaves."""
        return sum(len(new) for new, _, _ in self.levels) + sum(max(0, len(p) - 1) for p in self.parts)


def mine(items: Sequence[Sequence[int]], n_terms: int) -> SharingPlan:
    """The sharing plan of items given as lists of distinct terms.

    An item's nodes stand in one order for all items, the most shared first, so that a
    shared set is a run in each of its items. A round counts neighbours over all items
    and makes the most frequent disjoint pairs, of two items or more, nodes of their own.
    Work is in proportion to the items' terms a round.
    """
    holders: dict[int, list[int]] = defaultdict(list)
    for i, item in enumerate(items):
        for t in item:
            holders[t].append(i)
    leaves: dict[tuple[int, ...], int] = {}
    leaf_of = np.full(n_terms, -1, np.int64)
    for t in sorted(holders):
        leaf_of[t] = leaves.setdefault(tuple(holders[t]), len(leaves))
    rank = {leaf: (-len(held), held) for held, leaf in leaves.items()}
    now = [sorted({int(leaf_of[t]) for t in item}, key=rank.__getitem__) for item in items]
    n, levels = len(leaves), []
    while True:
        pairs = Counter(p for item in now for p in zip(item, item[1:]))
        taken: set[int] = set()
        chosen: dict[tuple[int, int], int] = {}
        for (a, b), held in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            if held < 2:
                break
            if a not in taken and b not in taken:
                taken |= {a, b}
                chosen[a, b] = n + len(chosen)
        if not chosen:
            return SharingPlan(leaf_of, len(leaves), levels, [np.array(item, np.int64) for item in now])
        levels.append((np.array(list(chosen.values())), np.array([a for a, _ in chosen]), np.array([b for _, b in chosen])))
        n += len(chosen)
        for i, item in enumerate(now):
            out, at = [], 0
            while at < len(item):
                node = chosen.get(tuple(item[at : at + 2])) if at + 1 < len(item) else None
                out.append(item[at] if node is None else node)
                at += 1 if node is None else 2
            now[i] = out


def postings(docs: DataFrame, wanted: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of every row: all its terms are counted, the wanted ones listed."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            sizes, found, counts = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms(text)
                tf = Counter(map(get, words))
                tf.pop(None, None)
                sizes.append(len(words))
                found.append(list(tf))
                counts.append(list(tf.values()))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n", "terms", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, utf8(text_col).alias("_text")).mapInArrow(look_up, f"`{id_col}` {kind}, n bigint, terms array<int>, counts array<bigint>")


class Best:
    """The best ``k`` rows of each item seen so far, by score, then id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)  # the least score that may still enter
        self.rows: list[list[tuple[int, bool, object]]] = [[] for _ in range(items)]

    def offer(self, scores: np.ndarray, ids: list) -> None:
        """``scores``: items x documents."""
        at, doc = np.nonzero(scores >= self.floor[:, None])
        for item in np.unique(at):
            docs = doc[at == item]
            values = scores[item, docs]
            if len(docs) > 4 * self.k:  # all that tie with the k-th stay
                least = np.partition(values, -self.k)[-self.k]
                docs, values = docs[values >= least], values[values >= least]
            rows = self.rows[item] + [(-int(v), ids[d] is None, ids[d]) for v, d in zip(values, docs)]
            rows.sort(key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))
            self.rows[item] = rows = rows[: self.k]
            if len(rows) == self.k:
                self.floor[item] = -rows[-1][0]


def accumulate(plan: SharingPlan, values: np.ndarray, found: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Scores, items x documents, from the values of the terms ``found`` in documents ``row``."""
    nodes = np.zeros((plan.n_nodes, rows), np.int64)
    np.add.at(nodes, (plan.leaf_of[found], row), values)
    for new, left, right in plan.levels:
        nodes[new] = nodes[left] + nodes[right]
    out = np.zeros((len(plan.parts), rows), np.int64)
    for i, parts in enumerate(plan.parts):
        if len(parts):
            nodes[parts].sum(axis=0, out=out[i])
    return out


def _blocks(items: DataFrame, limit: int, depth: int = 0) -> Iterator[list]:
    """Items (key, terms) in groups of at most ``limit`` terms; an item with more has its own.

    Items are dealt by hash; a group that turns out too large is dealt again by another hash.
    """
    groups = max(1, math.ceil((items.agg(F.sum(F.size("terms"))).first()[0] or 0) / limit)) + (depth > 0)
    dealt = items.withColumn("_block", F.pmod(F.xxhash64(F.lit(depth), "key"), F.lit(groups)))
    sizes = dealt.groupBy("_block").agg(F.sum(F.size("terms")).alias("n"), F.count("*").alias("items"))
    for block, n, count in sorted(tuple(r) for r in sizes.collect()):
        own = dealt.filter(F.col("_block") == block).drop("_block")
        if n <= limit or count == 1:
            yield own.collect()
        else:
            yield from _blocks(own, limit, depth + 1)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, offset: int = 10, slope: int = 90, block_terms: int = 200_000, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item, rank, id, score): the ``k`` best rows of ``docs`` for each item, score above 0.

    A term's weight is floor(1000 ln((2N + 2) / (2df + 1))), a document's length norm
    ``offset + slope * n * N div L``. Items are worked off in blocks of at most
    ``block_terms`` terms, each against all rows. Items that repeat an id are one item
    with the terms of all; an item without terms, and a null text, match nothing. Rows of
    ``docs`` that repeat an id rank as rows of their own. Equal scores go by id, a null id
    last. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(set(terms(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], [item_col, "terms"])

    item_kind = items.schema[item_col].dataType.simpleString()
    parted = items.select(item_col, utf8(item_text).alias("_text")).mapInArrow(split, f"`{item_col}` {item_kind}, terms array<binary>")
    parted = parted.select(F.struct(F.col(f"`{item_col}`").alias("id")).alias("key"), F.explode("terms").alias("term"))
    parted = materialise(parted.groupBy("key").agg(F.collect_set("term").alias("terms")), "items")
    out = None
    for rows in _blocks(parted, block_terms):
        vocabulary: dict[bytes, int] = {}
        lists = [[vocabulary.setdefault(bytes(t), len(vocabulary)) for t in sorted(r.terms)] for r in rows]
        plan = mine(lists, len(vocabulary))
        listed = materialise(postings(docs, vocabulary, id_col, text_col), "postings")
        best = _best(listed, plan, len(vocabulary), k, offset, slope, id_col)
        keys = spark.createDataFrame([(i, r.key) for i, r in enumerate(rows)], f"_item int, key struct<id: {item_kind}>")
        best = materialise(best.join(F.broadcast(keys), "_item").drop("_item"), "best")
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = spark.createDataFrame([], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score bigint, rank int, key struct<id: {item_kind}>")
    return out.select(F.col("key.id").alias(item_col), "rank", id_col, "score")


def _best(listed: DataFrame, plan: SharingPlan, n_terms: int, k: int, offset: int, slope: int, id_col: str) -> DataFrame:
    filled, length = listed.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(n_terms, np.int64)
    for row in listed.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the block
        df[row.t] = row["count"]
    weight = np.array([math.floor(1000 * math.log((2 * filled + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    shared = listed.sparkSession.sparkContext.broadcast((plan, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight = shared.value
        best, kind = Best(len(plan.parts), k), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.column(1).to_numpy(zero_copy_only=False)
                norm = offset + (slope * n * filled) // max(1, length or 0)
                sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), sizes)
                found = part.column(2).flatten().to_numpy(zero_copy_only=False)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False)
                values = weight[found] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[row]))
                best.offer(accumulate(plan, values, found, row, part.num_rows), part.column(0).to_pylist())
        rows = [(i, -r[0], r[2]) for i, kept in enumerate(best.rows) for r in kept]
        if rows:
            item, value, doc = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, kind), pa.array(value, pa.int64())], ["_item", id_col, "score"])

    kind = listed.schema[id_col].dataType.simpleString()
    kept = listed.mapInArrow(score, f"_item int, `{id_col}` {kind}, score bigint")
    # In two steps, so that no task reads an item's rows of every task.
    order = [F.col("score").desc(), F.col(f"`{id_col}`").asc_nulls_last()]
    kept = kept.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    for by in (["_item", "_salt"], ["_item"]):
        kept = kept.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return kept.drop("_salt")
