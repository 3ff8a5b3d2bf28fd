"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. Two fingerprints that differ in at most d bits differ in at most
d // 3 bits of one of three parts of 21, 21 and 22 bits. In each part the words of a
covering code are the anchors: a Hamming code of length 15 (covering radius 1) and, beside
it, every value of the other bits. Each fingerprint goes home to its nearest anchor
and is replicated to every anchor within covering radius plus threshold. If x and y are
within the threshold in a part, y is at x's home, so it is enough to compare, per anchor,
those at home with all that are there.

Distinct fingerprints only are compared; copies cost nothing. Per anchor the links found
are thinned to a spanning forest, so a dense group gives no pairs. An anchor with very
many fingerprints is dealt over tasks by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import carries_columns, materialise, salted_join, ship, text_of
from cohortlab.llm.graph import components

PARTS = ((0, 21), (21, 21), (42, 22))  # (first bit, bits)
CODE = 15
#: Fingerprints at an anchor above which it is dealt out by pairs of blocks of that size.
BLOCK = 20_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

ship(__name__)


def fingerprint(text: str, shingle: int = 4, step: int = 65_536) -> int:
    """SimHash over the word shingles of a text, as an unsigned 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, step):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + step], ends[at : at + step])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``bits``, the fingerprint as a signed bigint."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [id_col, "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_of(text_col).alias("_t")).mapInArrow(each, f"`{id_col}` {kind}, bits bigint")


def _code_table(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit value: its nearest code word; and the code words within ``radius``."""
    values = np.arange(1 << CODE, dtype=np.int64)
    syndrome = np.zeros(1 << CODE, np.int64)
    for bit in range(CODE):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0)
    nearest = np.where(syndrome > 0, values ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0), values)
    ball = [0]
    for r in range(radius):
        ball += [b ^ (1 << i) for b in list(ball) for i in range(CODE)]
    ball = np.array(sorted(b for b in set(ball) if bin(b).count("1") <= radius), np.int64)
    return nearest, ball[np.argsort([bin(b).count("1") for b in ball], kind="stable")]


def anchored(distinct: DataFrame, distance: int) -> DataFrame:
    """(anchor, bits, home) of every fingerprint at every anchor within radius + threshold."""
    slack = distance // len(PARTS)
    reach = 1 + slack

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, ball = _code_table(reach)
        weight = np.array([bin(b).count("1") for b in ball])
        is_word = nearest == np.arange(1 << CODE)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, (first, bits) in enumerate(PARTS):
                part = (x >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)
                code, rest = part & ((1 << CODE) - 1), part >> CODE
                near = code[:, None] ^ ball[None, :]
                row, k = np.nonzero(is_word[near])
                words, spent = near[row, k], weight[k]
                flips = [0]
                for _ in range(reach):
                    flips += [f ^ (1 << i) for f in list(flips) for i in range(bits - CODE)]
                for flip in sorted(set(flips)):
                    far = bin(flip).count("1")
                    ok = spent + far <= reach
                    r, w = row[ok], words[ok]
                    anchor = ((rest[r] ^ flip) << CODE | w) * len(PARTS) + number
                    home = (nearest[code[r]] == w) & (flip == 0)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(x[r].view(np.int64)), pa.array(home)], ["anchor", "bits", "home"])

    return distinct.select("bits").mapInArrow(each, "anchor bigint, bits bigint, home boolean")


def _linked(x: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between those at home and all, by breadth-first search.

    Those already reached are not compared again: a dense group costs little more than
    one pass over it.
    """
    left, out = np.arange(len(x)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            close = np.bitwise_count(x[left] ^ x[at]) <= distance
            if not home[at]:
                close &= home[left]
            found = left[close]
            out += [(at, f) for f in found.tolist()]
            queue += found.tolist()
            left = left[~close]
    return out


def _small_linked(group: np.ndarray, x: np.ndarray, home: np.ndarray, distance: int, step: int = 2_000_000) -> list[tuple[int, int]]:
    """The same for many small groups at once; ``group`` is sorted."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(group)))
    start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    homes = np.flatnonzero(home)
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.get(i, i) != i:
            parent[i] = parent.get(parent[i], parent[i])
            i = parent[i]
        return i

    out, upto = [], np.cumsum(size[homes])
    at = 0
    while at < len(homes):
        until = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step)))
        h = homes[at:until]
        a = np.repeat(h, size[h])
        b = np.arange(len(a)) - np.repeat(np.cumsum(size[h]) - size[h], size[h]) + start[a]
        hit = (a != b) & (np.bitwise_count(x[a] ^ x[b]) <= distance)
        for i, j in zip(a[hit].tolist(), b[hit].tolist()):
            i_root, j_root = root(i), root(j)
            if i_root != j_root:
                parent[max(i_root, j_root)] = min(i_root, j_root)
                out.append((i, j))
        at = until
    return out


def links(distinct: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that join all fingerprints (bits) linked at ``distance`` or fewer bits."""
    rows = materialise(anchored(distinct, distance), "anchors")
    hot = rows.groupBy("anchor").agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
    hot = hot.select("anchor", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    rows = salted_join(rows, hot, ["anchor"], F.col("bits"), "left", salts=4).withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    # An anchor of k blocks becomes the pairs of its blocks, each with the rows of both.
    own = F.pmod(F.xxhash64("bits"), F.col("_blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    rows = rows.select("anchor", "bits", "home", F.explode(pair).alias("_p"))
    rows = rows.select("anchor", "_p.i", "_p.j", "bits", "home")
    rows = rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "bits")

    def edges(x, found) -> pa.RecordBatch:
        a = np.array([i for i, _ in found], np.int64)
        b = np.array([j for _, j in found], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[a].view(np.int64)), pa.array(x[b].view(np.int64))], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("anchor", "i", "j")
        kept: list[pa.RecordBatch] = []  # rows of the group that may go on in the next batch

        def solve(batch_list: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(batch_list)
            x = t["bits"].to_numpy().view(np.uint64)
            home = t["home"].to_numpy()
            changes = np.zeros(len(x), bool)
            for k in keys:
                column = t[k].to_numpy()
                changes[1:] |= column[1:] != column[:-1]
            group = np.cumsum(changes)
            sizes = np.bincount(group)
            large = sizes > 256
            small = ~large[group]
            if small.any():
                where = np.flatnonzero(small)
                yield edges(x, [(where[i], where[j]) for i, j in _small_linked(group[where], x[where], home[where], distance)])
            begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            for g in np.flatnonzero(large):
                s = slice(begins[g], begins[g] + sizes[g])
                yield edges(x[s], _linked(x[s], home[s], distance))

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
            same = np.ones(batch.num_rows, bool)
            for k, v in zip(keys, last):
                same &= batch.column(k).to_numpy(zero_copy_only=False) == v
            tail = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if tail == 0 and kept and all(kept[-1].column(k)[0].as_py() == v for k, v in zip(keys, last)):
                kept.append(batch)
                continue
            yield from solve([*kept, batch.slice(0, tail)]) if kept or tail else ()
            kept = [batch.slice(tail)]
        if kept:
            yield from solve(kept)

    return rows.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` (16 hex digits), component_id.

    Rows whose fingerprints differ in at most ``distance`` (0 to 5) bits are linked;
    component_id is the smallest id that links lead to. A null text is an empty one; texts
    without a word have fingerprint zero and link like any other. Null ids are no
    component's smallest unless it has no other. An empty table gives no rows.
    """
    if not 0 <= distance <= 5:
        raise ValueError("distance must be from 0 to 5: one part must be within 1 bit")
    rows = materialise(fingerprints(docs, shingle, id_col), "fingerprints")
    each = materialise(rows.groupBy("bits").agg(F.min(id_col).alias("_low"), F.count("*").alias("_n")), "distinct")
    roots = components(links(each, distance, **options))
    joined = each.join(roots, each["bits"] == roots["node"], "left").select("bits", "_low", "_n", F.coalesce("root", "bits").alias("_root"), F.col("root").isNotNull().alias("_linked"))
    joined = materialise(joined.filter("_n > 1 OR _linked"), "roots")
    lows = joined.groupBy("_root").agg(F.min("_low").alias("component_id"))
    known = salted_join(joined, lows, ["_root"], F.col("bits"), salts=8).select("bits", "component_id", F.lit(True).alias("_known"))
    out = salted_join(rows, known, ["bits"], F.col(id_col), "left")
    hex_bits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return out.select(id_col, hex_bits.alias("fingerprint"), F.when(F.col("_known"), F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))


@carries_columns
def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, one for each component: that with the smallest id.

    Where rows repeat that id, one of them stays.
    """
    from pyspark.sql import Window as W

    found = near_duplicates(docs, **options)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.struct("doc_id").alias("__id")).distinct()
    kept = docs.withColumn("__id", F.struct("doc_id")).join(stay, "__id")
    first = F.row_number().over(W.partitionBy("__id").orderBy(F.xxhash64(text_of("text"))))
    return kept.withColumn("__first", first).filter("__first = 1").drop("__id", "__first")
