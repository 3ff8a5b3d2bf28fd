"""Exact order statistics and running totals without a global sort in one task.

Values are first cut into buckets at approximate quantiles. Cuts need not be
exact: they only decide which task sees a value. Everything after the cut is
exact. No bucket holds more than about 1/2**bits of the rows, whatever the
distribution, and all copies of one value are collapsed to one row before any
sort, so a value that makes up a third of the table is one row here.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from cohortlab.functions.columns import exprs, lines, quoted
from cohortlab.session import materialise

BUCKET = "_bucket"

#: Sketches meet in groups of so many, level by level; no task sees those of all map tasks.
LEVELS = (512, 16)
#: A table of at most so many rows is one bucket: a task sorts it at once.
ONE_BUCKET = 100_000
#: The largest parameter of a sketch, and so the finest cut: 2**16 buckets.
MOST_BITS, MOST_K = 16, 65_535


def bucket_bits(df: DataFrame, factor: int = 4) -> int:
    """Enough buckets for a few per shuffle partition, 16 or more."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BITS, max(4, math.ceil(math.log2(max(1, partitions * factor)))))


def bits_for(counts: DataFrame) -> int:
    """Bucket bits for a written table, by its number of rows (read from its footers)."""
    return 0 if counts.count() <= ONE_BUCKET else bucket_bits(counts)


def merged_sketches(rows: DataFrame, values: Mapping[str, str], k: int) -> DataFrame:
    """One row with a quantile sketch per value (name: expression), merged in levels.

    Every map task sketches its own rows; the sketches then meet by map task, in groups
    of bounded number, before the last few become one. No row is shuffled.
    """
    cells = [f"cast({text} AS double) AS {name}" for name, text in values.items()]
    out = rows.selectExpr(*cells, f"spark_partition_id() % {LEVELS[0]} AS _at").groupBy("_at").agg(
        *exprs(f"kll_sketch_agg_double({name}, {k}) AS {name}" for name in values)
    )
    merged = exprs(f"kll_merge_agg_double({name}, {k}) AS {name}" for name in values)
    for width in LEVELS[1:]:
        out = out.selectExpr(*values, f"_at % {width} AS _at").groupBy("_at").agg(*merged)
    return out.agg(*merged)


def sketched_cuts(rows: DataFrame, value: str, cuts: int) -> DataFrame:
    """One row: ``cuts`` values that part ``rows`` about evenly; NULL when there is no value."""
    shares = ", ".join(f"{(i + 1) / (cuts + 1)!r}D" for i in range(cuts))
    sketch = merged_sketches(rows, {"_s": value}, min(MOST_K, max(200, 4 * cuts)))
    return sketch.selectExpr(
        f"CASE WHEN kll_sketch_get_n_double(_s) > 0 THEN kll_sketch_get_quantile_double(_s, array({shares})) END AS cuts"
    )


def with_buckets(df: DataFrame, value: str, rows: DataFrame, bits: int) -> DataFrame:
    """Adds the bucket of ``value``, from cuts sketched over ``rows``.

    The cuts reach every task as a scalar subquery of 2**bits - 1 numbers; the lookup is
    a binary search over them.
    """
    cuts = 2**bits - 1
    strides = ", ".join(str(2**i) for i in reversed(range(bits)))
    step = f"CASE WHEN element_at(_cuts, at + stride) <= {value} THEN at + stride ELSE at END"
    # The coalesce also stops the planner from deriving a not-null filter on the search.
    search = f"coalesce(aggregate(array({strides}), 0, (at, stride) -> {step}), 0) AS {BUCKET}"
    names = [f"`{c}`" for c in df.columns]
    return df.withColumn("_cuts", sketched_cuts(rows, value, cuts).scalar()).selectExpr(*names, search)


def running_totals(
    counts: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = True,
    bits: int | None = None,
) -> DataFrame:
    """Running and overall totals of ``sums`` along ``order``, within ``by``.

    ``counts`` has one row per (by, order value). Adds, for every sum s,
    ``cum_s`` (up to and including the row) and ``total_s``, and ``next_s``, the
    value of s on the row after it (NULL on the last). ``by`` must not be NULL.
    ``counts`` is read more than once, so let it be a written table. With 0 ``bits`` it is
    one bucket, for tables that one task can sort.
    """
    by = list(by)
    bits = bucket_bits(counts) if bits is None else bits
    way, edge = ("DESC", "max_by") if descending else ("ASC", "min_by")
    group = f"PARTITION BY {', '.join(by)}" if by else ""
    if bits == 0:
        inside = f"{group} ORDER BY {order} {way}"
        return counts.selectExpr(
            "*",
            *[f"sum({s}) OVER ({inside} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_{s}" for s in sums],
            *[f"sum({s}) OVER ({group}) AS total_{s}" for s in sums],
            *[f"lead({s}) OVER ({inside}) AS next_{s}" for s in sums],
        )
    cut = with_buckets(counts, order, counts, bits)
    keys = [*by, BUCKET]

    # At most 2**bits rows per group from here to ``offsets``.
    sizes = cut.groupBy(*keys).agg(*exprs([
        *[f"sum({s}) AS _in_{s}" for s in sums],
        f"{edge}(struct({', '.join(sums)}), {order}) AS _first",
    ]))
    across = f"{group} ORDER BY {BUCKET} {way}"
    before = f"({across} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = sizes.selectExpr(
        *keys,
        *[f"coalesce(sum(_in_{s}) OVER {before}, 0) AS _before_{s}" for s in sums],
        *[f"sum(_in_{s}) OVER ({group}) AS total_{s}" for s in sums],
        f"lead(_first) OVER ({across}) AS _next",
    )

    inside = f"PARTITION BY {', '.join(keys)} ORDER BY {order} {way}"
    upto = f"({inside} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return cut.join(offsets, keys).selectExpr(
        *counts.columns,
        *[f"_before_{s} + sum({s}) OVER {upto} AS cum_{s}" for s in sums],
        *[f"total_{s}" for s in sums],
        *[f"coalesce(lead({s}) OVER ({inside}), _next.{s}) AS next_{s}" for s in sums],
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    shares: Sequence[float],
    by: Sequence[str] = (),
    groups: int = 1,
    bits: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles of the non-null values, per ``by`` group.

    Returns ``by``, ``n`` and ``quantiles`` (an array in the order of ``shares``).
    ``groups`` is the number of groups, when known: the buckets are shared, so
    more groups need more of them. ``weight`` names a column that says how often a row
    counts; values are then distinct already.

    Copies of a value collapse to one counted row. Bucket sizes then tell which
    buckets hold the wanted ranks, and only those few are sorted.
    """
    by = list(by)
    rows = df.where(f"{value} IS NOT NULL")
    if bits is None:
        bits = min(MOST_BITS, bucket_bits(df) + math.ceil(math.log2(max(1, groups))))
    if weight is None:
        counts = rows.groupBy(*by, value).agg(F.expr("count(*) AS _n"))
    else:
        counts = rows.selectExpr(*by, value, f"{weight} AS _n")
    group = f"PARTITION BY {', '.join(by)}" if by else ""
    spots = [f"({float(s)!r}D * (n - 1))" for s in shares]
    if bits == 0:
        placed = counts.selectExpr(
            *by, value, "_n", f"sum(_n) OVER ({group}) AS n",
            f"sum(_n) OVER ({group} ORDER BY {value} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _end",
        )
        return _interpolated(placed, value, spots, by)
    cut = with_buckets(counts, value, rows, bits)
    keys = [*by, BUCKET]

    before = f"({group} ORDER BY {BUCKET} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sizes = cut.groupBy(*keys).agg(F.expr("sum(_n) AS _in")).selectExpr(
        *keys,
        "_in",
        f"coalesce(sum(_in) OVER {before}, 0) AS _before",
        f"sum(_in) OVER ({group}) AS n",
    )
    ranks = [f"{f}({spot})" for spot in spots for f in ("floor", "ceil")]
    wanted = sizes.where(
        f"exists(array({', '.join(ranks)}), r -> r >= _before AND r < _before + _in)"
    ).select(*keys, "_before", "n")

    upto = f"(PARTITION BY {', '.join(keys)} ORDER BY {value} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    placed = cut.join(wanted, keys).selectExpr(
        *by, value, "_n", "n", f"_before + sum(_n) OVER {upto} AS _end"
    )
    return _interpolated(placed, value, spots, by)


def _interpolated(placed: DataFrame, value: str, spots: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Quantiles from counted values (_n) with the ranks they end at (_end)."""
    ranks = [f"{f}({spot})" for spot in spots for f in ("floor", "ceil")]
    picked = placed.groupBy(*by, "n").agg(*exprs(
        f"max(CASE WHEN {r} >= _end - _n AND {r} < _end THEN cast({value} AS double) END) AS _v{i}"
        for i, r in enumerate(ranks)
    ))
    out = [
        f"_v{2 * i} + (_v{2 * i + 1} - _v{2 * i}) * ({spot} - floor({spot}))" for i, spot in enumerate(spots)
    ]
    return picked.selectExpr(*by, "n", f"array({', '.join(out)}) AS quantiles")


def quantile_cuts(df: DataFrame, columns: Sequence[str], cuts: int) -> dict[str, list[float]]:
    """Per column, the distinct values among ``cuts`` exact quantiles of its non-null values.

    What reaches the driver is ``cuts`` numbers a column.
    """
    pairs = lines({"_name": quoted(c), "_value": f"cast({c} AS double)"} for c in columns)
    shares = [(i + 1) / (cuts + 1) for i in range(cuts)]
    found = exact_quantiles(df.selectExpr(pairs), "_value", shares, by=["_name"], groups=len(columns))
    at = {r["_name"]: sorted(set(r["quantiles"])) for r in found.collect()}
    return {c: at.get(c, []) for c in columns}


def _hashed(df: DataFrame, label: str, key: str, seed: int | str, digits: int) -> DataFrame:
    """Adds the class (_own), the md5 of ``seed:key`` (_hash) and its first hex digits (_slot).

    As a struct, a NULL label is a class like any other: no row is lost by a join.
    """
    return df.selectExpr(
        "*", f"md5(concat({quoted(str(seed))}, ':', coalesce(cast({key} AS string), ''))) AS _hash", f"struct({label}) AS _own"
    ).selectExpr("*", f"substring(_hash, 1, {digits}) AS _slot")


def class_cut(df: DataFrame, label: str, key: str, seed: int | str, share: float, digits: int = 3) -> DataFrame:
    """One row per class: ``_cut``, the hash and key of the last row of its first ``share``.

    The order is that of ``class_rank``. Counts of the slots tell in which slot the
    cut lies; the rows of that slot alone are shuffled and sorted. A class whose share
    rounds to no row has no cut.
    """
    hashed = _hashed(df, label, key, seed, digits).selectExpr("_own", "_slot", "_hash", f"{key} AS _key")
    edge = hashed.groupBy("_own", "_slot").agg(F.expr("count(*) AS _in")).selectExpr(
        "*",
        "sum(_in) OVER (PARTITION BY _own ORDER BY _slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _upto",
        f"floor({float(share)!r}D * sum(_in) OVER (PARTITION BY _own) + 0.5D) AS _take",
    ).where("_take > _upto - _in AND _take <= _upto").selectExpr("_own", "_slot", "_take - _upto + _in AS _rest")
    inside = "(PARTITION BY _own, _slot ORDER BY _hash, _key)"
    placed = hashed.join(materialise(edge, "split-edge"), ["_own", "_slot"]).selectExpr(
        "_own", "_rest", "named_struct('_hash', _hash, '_key', _key) AS _cut", f"row_number() OVER {inside} AS _nth"
    )
    return placed.where("_nth = _rest").select("_own", "_cut")


def first_share(
    df: DataFrame, label: str, key: str, seed: int | str, share: float, name: str, among: str = "true", digits: int = 3
) -> DataFrame:
    """Adds ``name``: whether a row is in the first ``share`` of its class, in seeded order.

    Only rows for which ``among`` holds are counted and can be in. A class with n rows
    gives floor(share * n + 0.5); rows that repeat a key are on one side together, so
    they may add to that. No row is ranked or shuffled but those around the cut; the cuts,
    one row a class, are written, so that Spark broadcasts them by their size.
    """
    cut = materialise(class_cut(df.where(among), label, key, seed, share, digits), "split-cut")
    rows = _hashed(df, label, key, seed, digits).join(cut, "_own", "left")
    upto = f"coalesce(named_struct('_hash', _hash, '_key', {key}) <= _cut, false)"
    return rows.selectExpr(*df.columns, f"coalesce({among}, false) AND {upto} AS {name}")


def class_rank(
    df: DataFrame, label: str, key: str, seed: int | str, digits: int = 3
) -> DataFrame:
    """Exact 1-based rank of each row within its class, in a seeded random order.

    The order is the md5 of ``seed:key``. Its first hex digits are uniform, so
    they are the buckets: a class of any size spreads over 16**digits tasks.
    Adds ``class_rank`` and ``class_size``.
    """
    hashed = _hashed(df, label, key, seed, digits)
    keys = ["_own", "_slot"]
    before = "(PARTITION BY _own ORDER BY _slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = hashed.groupBy(*keys).agg(F.expr("count(*) AS _in")).selectExpr(
        *keys,
        f"coalesce(sum(_in) OVER {before}, 0) AS _before",
        "sum(_in) OVER (PARTITION BY _own) AS class_size",
    )
    inside = f"(PARTITION BY _own, _slot ORDER BY _hash, {key})"
    return hashed.join(offsets, keys).selectExpr(
        *df.columns,
        f"cast(_before + row_number() OVER {inside} AS bigint) AS class_rank",
        "class_size",
    )
