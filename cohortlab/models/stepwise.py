"""Boosting in step: many series of trees, one tree a round, stopped by validation AUC.

A series is a configuration that learns from some rows and is judged on others: one with
a validation part, or one a fold and configuration. All series share one written matrix
of quantised features, packed into blocks of rows with one byte a feature.

Where the bytes of all rows fit a task, a task grows a series, and all series grow side by
side, as far as none can end by ``patience``; then the margins are written. With more rows a
job a level adds up the histograms of all series in the executors and sends the best splits;
the margins are written with the blocks every few rounds and trees since then are added on
the fly.

No tree is kept that is fitted past the stop; the stopped model is the first trees, and needs
no second fit.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortlab.functions.columns import number
from cohortlab.models import growth
from cohortlab.models.growth import Split, Tree
from cohortlab.models.trees import Boosting, in_parallel
from cohortlab.operators.metrics import ranking_quality
from cohortlab.operators.ordered import quantile_cuts
from cohortlab.session import Written, rewritten

BINS = 32
ROWS_PER_TASK = 100_000
#: Features that one task holds of all rows when it grows a series by itself.
TASK_BYTES = 320_000_000
#: Scores that one task ranks; rounds whose trees are added on the fly before margins are written.
RANKED_ROWS, REWRITE = 1_000_000, 4
#: Blocks are written without a codec.
PLAIN = {"compression": "none"}


@dataclass(frozen=True)
class Series:
    """``learns`` and ``judged`` are conditions on the rows."""

    config: Boosting
    learns: str
    judged: str


def fold_series(config: Boosting, folds: int, fold: str = "fold") -> list[Series]:
    return [Series(config, f"{fold} != {i}", f"{fold} = {i}") for i in range(folds)]


@dataclass
class Stop:
    """The best mean AUC so far and when to end; the first of equal rounds counts."""

    limit: int
    patience: int
    best: int = 0
    mean: float = -math.inf
    std: float = 0.0
    round: int = 0

    def see(self, aucs: Sequence[float]) -> bool:
        """Takes the next round's AUCs; whether the round is the best so far."""
        self.round += 1
        if not aucs:
            raise ValueError("no series could be judged: its rows have one class only")
        mean = sum(aucs) / len(aucs)
        if mean <= self.mean:
            return False
        spread = math.sqrt(sum((a - mean) ** 2 for a in aucs) / len(aucs))
        self.best, self.mean, self.std = self.round, mean, spread
        return True

    @property
    def over(self) -> bool:
        return self.round >= self.limit or self.round - self.best >= self.patience


def picked(judged: DataFrame, limit: int, patience: int) -> DataFrame:
    """(n_trees, n_rounds, auc_mean, auc_std) by the stopping rule from (series, round, roc_auc)
    rows; a series without an AUC doesn't count. The driver holds one number a series and round."""
    by_round: dict[int, list[float]] = {}
    for r in judged.where("roc_auc IS NOT NULL").orderBy("round", "series").collect():
        by_round.setdefault(r["round"], []).append(r["roc_auc"])
    stop = Stop(limit, patience)
    for at in sorted(by_round):
        if stop.over:
            break
        stop.see(by_round[at])
    row = [(stop.best, stop.round, stop.mean, stop.std)]
    return judged.sparkSession.createDataFrame(row, "n_trees int, n_rounds int, auc_mean double, auc_std double")


@dataclass
class Grown:
    """``stops`` by configuration, ``history`` (configuration, series, round, AUC), and
    ``rows`` with ``margin_at_best``, an array with one margin a series."""

    stops: dict[str, Stop]
    history: list[tuple[str, int, int, float | None]] = field(default_factory=list)
    rows: DataFrame | None = None


def quantised(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, weight: float, keep: Sequence[str],
    bins: int = BINS, learn: str = "true",
) -> tuple[DataFrame, int]:
    """(keep, features, label, weight) with every number replaced by its bin, and maxBins.

    Bins are cut at quantiles of the rows that ``learn`` selects, equal cuts once; 0 is
    for missing numbers. Categories are indexed over all rows, NULL as one of its own.
    """
    cuts = quantile_cuts(df.where(learn), numeric, bins - 2)
    cells = []
    for c in numeric:
        edges = ", ".join(number(x) for x in cuts[c])
        over = f"size(filter(array({edges}), e -> e < cast({c} AS double)))" if edges else "0"
        cells.append(f"CASE WHEN {c} IS NULL THEN 0D ELSE 1D + {over} END AS n_{c}")
    index = StringIndexer(
        inputCols=list(categorical), outputCols=[f"i_{c}" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"
    ).fit(df.select(*categorical)) if categorical else None
    out = df.selectExpr("*", *cells)
    out = index.transform(out) if index else out
    out = VectorAssembler(inputCols=[f"n_{c}" for c in numeric] + [f"i_{c}" for c in categorical], outputCol="features").transform(out)
    out = out.selectExpr(
        *keep, "features", f"cast({label} AS double) AS label", f"CASE WHEN {label} = 1 THEN {number(weight)} ELSE 1.0D END AS weight"
    )
    most = max((len(x) for x in index.labelsArray), default=0) if index else 0
    return out, max(bins, most + 2)


class _Block:
    """Rows that one task holds at a time, a column of features contiguous."""

    def __init__(self, row: Mapping[str, Any], flags: int):
        self.n = row["n"]
        self.x = np.frombuffer(row["x"], row["kind"]).reshape(-1, self.n)
        self.label = np.frombuffer(row["label"])
        self.weight = np.frombuffer(row["weight"])
        self.flags = np.frombuffer(row["flags"], bool).reshape(flags, self.n)
        self.margins = np.frombuffer(row["margins"] or b"").reshape(-1, self.n)


_BLOCK = "block int, n int, kind string, x binary, label binary, weight binary, flags binary, margins binary"


def _packed(rows: DataFrame, conditions: Sequence[str], bins: int, parts: int) -> DataFrame:
    """One row a partition, its columns as bytes; ``flags`` tell which conditions a row meets."""
    flags = ", ".join(f"coalesce({c}, false)" for c in conditions)
    start = rows.repartition(parts).withColumn("_x", vector_to_array("features")).selectExpr(
        "_x AS x", "cast(label AS double) AS label", "cast(weight AS double) AS weight", f"array({flags}) AS flags"
    )
    kind = np.min_scalar_type(bins - 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {"x": [], "flags": [], "label": [], "weight": []}
        for batch in batches:
            if any(batch.column(name).null_count for name in found):
                raise ValueError("features, labels and weights must not be NULL")
            for name in ("label", "weight"):
                found[name].append(batch.column(name).to_numpy(zero_copy_only=False))
            for name in ("x", "flags"):
                flat = batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))
                if name == "x" and not ((flat >= 0) & (flat < bins) & (flat == np.floor(flat))).all():
                    raise ValueError(f"features must be quantised: whole numbers below {bins}")
                found[name].append(flat.astype(kind if name == "x" else bool).T)
        n = sum(len(x) for x in found["label"])
        if n:
            cells = {name: np.concatenate([x for x in found[name] if x.size], axis=-1).tobytes() for name in found}
            row = {"block": TaskContext.get().partitionId(), "n": n, "kind": kind.str, "margins": b"", **cells}
            yield pa.RecordBatch.from_pylist([row], _arrow(_BLOCK))

    return start.mapInArrow(pack, _BLOCK)


def _arrow(fields: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in fields.split(", "))])


def _width(rows: DataFrame, bins: int) -> int:
    """Bytes of a row's features."""
    first = rows.select(F.size(vector_to_array("features")).alias("n")).first()
    return (first["n"] if first else 0) * np.min_scalar_type(bins - 1).itemsize


def _categories(rows: DataFrame) -> dict[int, int]:
    """The features that are categories, as the assembler noted them, and how many each has."""
    noted = rows.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    found = {x["idx"]: len(x["vals"]) if "vals" in x else x["num_vals"] for x in noted.get("nominal", [])}
    return found | {x["idx"]: 2 for x in noted.get("binary", [])}


@dataclass
class _Search:
    """What the tasks of a search have to know, and the trees so far by series."""

    series: Sequence[Series]
    conditions: list[str]
    bins: int
    categories: dict[int, int]
    trees: list[list[Tree]]

    def learners(self, block: _Block, i: int) -> np.ndarray:
        return np.flatnonzero(block.flags[self.conditions.index(self.series[i].learns)])

    def held(self, block: _Block, i: int) -> np.ndarray:
        return np.flatnonzero(block.flags[self.conditions.index(self.series[i].judged)])


class _Held:
    """All rows of the search as the task of one series holds them."""

    def __init__(self, batches: Iterator[pa.RecordBatch], search: _Search, i: int, sizes: Mapping[int, int]):
        n, starts, at = sum(sizes.values()), {}, 0
        for block, size in sorted(sizes.items()):
            starts[block], at = at, at + size
        self.x: list[Any] = []
        self.label, self.weight, self.margin = np.empty(n), np.empty(n), np.zeros(n)
        learn, held = np.zeros(n, bool), np.zeros(n, bool)
        for row in (r for batch in batches for r in batch.to_pylist()):
            if row["block"] < 0:
                self.margin = np.frombuffer(row["margins"]).copy()
                continue
            block = _Block(row, len(search.conditions))
            part = slice(starts[row["block"]], starts[row["block"]] + block.n)
            self.x = self.x or [np.empty(n, block.x.dtype) for _ in block.x]
            for column, own in zip(self.x, block.x):
                column[part] = own
            self.label[part], self.weight[part] = block.label, block.weight
            learn[part][search.learners(block, i)] = True
            held[part][search.held(block, i)] = True
        self.learn, self.held = np.flatnonzero(learn), np.flatnonzero(held)
        self.others = np.flatnonzero(held & ~learn)

    def grown(self, search: _Search, config: Boosting, exact: bool, start: int, end: int) -> Iterator[tuple[Tree, float | None]]:
        """The trees of rounds ``start`` to ``end``, with the AUC after each; the margins follow."""
        if exact:
            x = np.stack(self.x)
            own, weight = np.ascontiguousarray(x[:, self.learn]), self.weight[self.learn]
        else:
            bundles = growth.Bundles(lambda f: self.x.pop(0), len(self.x), search.bins)
            weight = growth.Weights(self.weight)
        for at in range(start, end):
            left = growth.gradient(self.label, self.margin, at == 0)
            rate = 1.0 if at == 0 else config.learning_rate
            if exact:
                tree = growth.fitted(own, weight, left[self.learn], config.depth, search.bins, search.categories, config.min_rows)
                self.margin = self.margin + rate * tree.values(x)
            else:
                tree, ends = bundles.fitted(self.learn, weight, left, config.depth, search.categories, config.min_rows)
                for node, rows in chain(ends, bundles.ends(tree, self.others)):
                    self.margin[rows] += rate * tree.value[node]
            yield tree, growth.area(self.label[self.held], self.margin[self.held])


def _by_series(
    table: Written, search: _Search, until: Mapping[int, int], sizes: Mapping[int, int], exact: bool, kept: dict[int, Written]
) -> dict[tuple[int, int], float | None]:
    """Grows every series to its round of ``until``, one task a series, and writes its trees and,
    with the last, its margins to ``kept``, in place of those before. (series, round): AUC."""
    bare = replace(search, trees=[])
    fields = "round int, auc double, tree binary, margins binary"

    def one(i: int) -> list:
        start, end, config = len(search.trees[i]), until[i], search.series[i].config

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Held(batches, bare, i, sizes)
            for at, (tree, auc) in enumerate(held.grown(bare, config, exact, start, end), start + 1):
                found = {"round": at, "auc": auc, "tree": pickle.dumps(tree), "margins": held.margin.tobytes() if at == end else None}
                yield pa.RecordBatch.from_pylist([found], _arrow(fields))

        rows = table.rows
        if i in kept:
            own = kept[i].rows.where("margins IS NOT NULL").selectExpr("-1 AS block", "margins")
            rows = own.unionByName(rows.drop("margins"), allowMissingColumns=True)
        out = Written.of(rows.coalesce(1).mapInArrow(run, fields), "grown", **PLAIN)
        if i in kept:
            kept[i].drop()
        kept[i] = out
        return out.rows.select("round", "auc", "tree").orderBy("round").collect()

    # A job a series: as one union, partitions of one task each would become one task.
    found = dict(zip(until, in_parallel(one, until, width=len(until))))
    for i, rounds in found.items():
        search.trees[i] += [pickle.loads(r["tree"]) for r in rounds]
    return {(i, r["round"]): r["auc"] for i, rounds in found.items() for r in rounds}


@dataclass(frozen=True)
class _Task:
    """One series in a pass over the blocks: ``row`` is its place among the margins, if it has
    one, ``pending`` the trees that they lack; it is judged on the scores between ``cuts``
    unless they are None, and ``tree`` is grown by a level unless it is None."""

    i: int
    row: int | None
    pending: list[Tree]
    before: int
    cuts: np.ndarray | None
    tree: Tree | None

    def margin(self, block: _Block, rate: float) -> np.ndarray:
        start = np.zeros(block.n) if self.row is None else block.margins[self.row]
        return growth.added(start, self.pending, block.x, rate, self.before)


def _pass(blocks: DataFrame, search: _Search, tasks: Sequence[_Task], parts: int) -> tuple[dict[int, dict[int, Split]], dict[int, list]]:
    """One job over all blocks: (series: node: best split) of the open nodes, and (series: parts
    of its ranking, from the lowest scores up). Histograms and counts meet in the executors, by
    series and node or part; what reaches the driver is one split a node and 64 scores a part."""
    bare = replace(search, trees=[])
    fields = "series int, node int, part int, block int, data binary"

    def reads(own: Sequence[_Task]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, tuple[int, np.ndarray]] = {}
            for row in (r for batch in batches for r in batch.to_pylist()):
                block = _Block(row, len(bare.conditions))
                for t in own:
                    config = bare.series[t.i].config
                    margin = t.margin(block, config.learning_rate)
                    if t.cuts is not None:
                        held = bare.held(block, t.i)
                        counts = growth.counted(block.label[held], margin[held])
                        part = np.searchsorted(t.cuts, counts[0], side="right")
                        for p in np.unique(part):
                            data = b"".join(np.ascontiguousarray(c[part == p]).tobytes() for c in counts)
                            yield from sent(t.i, -1, int(p), row["block"], data)
                    if t.tree is not None:
                        learn = bare.learners(block, t.i)
                        left = growth.gradient(block.label[learn], margin[learn], t.before + len(t.pending) == 0)
                        x = np.ascontiguousarray(block.x[:, learn])
                        hist = growth.histograms(x, block.weight[learn], left, t.tree.leaves(x), list(t.tree.open), bare.bins)
                        sums[t.i] = (sums[t.i][0], sums[t.i][1] + hist) if t.i in sums else (row["block"], hist)
            for t in own:
                if t.i in sums:
                    first, hist = sums.pop(t.i)
                    for node, part in zip(t.tree.open, hist):
                        yield from sent(t.i, node, 0, first, part.tobytes())

        return run

    def sent(*cells) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, _arrow(fields))], schema=_arrow(fields))

    known = {(t.i, node): own for t in tasks if t.tree is not None for node, own in t.tree.open.items()}

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        i, node, part = (k.as_py() for k in key)
        data = [r["data"] for r in sorted(table.to_pylist(), key=lambda r: r["block"])]
        if node < 0:
            counts = [np.frombuffer(d, np.int64).reshape(3, -1) for d in data]
            found = growth.ranked(np.concatenate([c[0].view(float) for c in counts]), *(np.concatenate([c[k] for c in counts]) for k in (1, 2)))
        else:
            hist = np.frombuffer(data[0]).copy()
            for d in data[1:]:
                hist += np.frombuffer(d)
            found = growth.best_split(hist.reshape(growth.STATS, -1, bare.bins), known[i, node], bare.categories, bare.series[i].config.min_rows)
        return pa.Table.from_pylist([{"series": i, "node": node, "part": part, "block": 0, "data": pickle.dumps(found)}], _arrow(fields))

    # With fewer blocks than cores, the series are dealt over several tasks a block.
    groups = min(len(tasks), math.ceil(blocks.sparkSession.sparkContext.defaultParallelism / parts))
    mapped = [blocks.mapInArrow(reads(tasks[g::groups]), fields) for g in range(groups)]
    rows = reduce(DataFrame.union, mapped).groupBy("series", "node", "part").applyInArrow(meet, fields).collect()
    splits: dict[int, dict[int, Split]] = {}
    ranks: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        if r["node"] < 0:
            ranks.setdefault(r["series"], []).append(pickle.loads(r["data"]))
        else:
            splits.setdefault(r["series"], {})[r["node"]] = pickle.loads(r["data"])
    return splits, ranks


def _area(parts: Sequence[tuple[np.ndarray, float, np.ndarray]]) -> tuple[float | None, np.ndarray]:
    """AUC from the parts of a ranking, the lowest scores first, and cuts for the next one."""
    total, pairs = np.zeros(2, np.int64), 0.0
    for own, inside, _ in reversed(parts):
        pairs += inside + float(own[1]) * total[0]
        total = total + own
    marks = np.unique(np.concatenate([m for _, _, m in parts])) if parts else np.empty(0)
    some = np.linspace(0, len(marks), math.ceil(total.sum() / RANKED_ROWS) + 1)[1:-1].astype(int)
    return (float(pairs / (float(total[0]) * total[1])) if total.all() else None), marks[some]


def _with_margins(table: Written, search: _Search, tasks: Sequence[_Task]) -> Written:
    """The blocks with the margins of ``tasks``, their pending trees added."""
    bare = replace(search, trees=[])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            block = _Block(row, len(bare.conditions))
            margins = b"".join(t.margin(block, bare.series[t.i].config.learning_rate).tobytes() for t in tasks)
            yield pa.RecordBatch.from_pylist([row | {"margins": margins}], _arrow(_BLOCK))

    return rewritten(table, table.rows.mapInArrow(run, _BLOCK), "blocks", **PLAIN)


def grow(rows: DataFrame, series: Sequence[Series], patience: int, max_bins: int = BINS, rows_per_task: int = ROWS_PER_TASK, task_bytes: int = TASK_BYTES) -> Grown:
    """Grows all ``series`` on ``rows`` (quantised features, label 0/1, weight and what conditions read).

    The series of one configuration (by name) stop together, by their mean AUC. Trees
    follow Spark's own boosting: the first is fitted to the labels as -1 and 1, the others
    to the gradient of the log loss and added at the learning rate.
    """
    n = len(series)
    names = [s.config.name for s in series]
    out = Grown({s.config.name: Stop(s.config.rounds, patience) for s in series})
    conditions = list(dict.fromkeys(c for s in series for c in (s.learns, s.judged)))
    search = _Search(series, conditions, max_bins, _categories(rows), [[] for _ in series])
    parts = max(1, math.ceil(rows.count() / rows_per_task))
    table = Written.of(_packed(rows, conditions, max_bins, parts), "blocks", **PLAIN)

    def going() -> list[int]:
        return [i for i in range(n) if not out.stops[names[i]].over]

    def see(live: Sequence[int], at: int, aucs: Mapping[int, float | None]) -> None:
        for name in dict.fromkeys(names[i] for i in live):
            own = {i: aucs.get(i) for i in live if names[i] == name}
            out.history.extend((name, i, at, auc) for i, auc in own.items())
            out.stops[name].see([a for a in own.values() if a is not None])

    sizes = {r["block"]: r["n"] for r in table.rows.select("block", "n").collect()}
    if sum(sizes.values()) * _width(rows, max_bins) <= task_bytes:
        kept: dict[int, Written] = {}
        # No series ends before its best round's patience is over: so far it is grown in one go.
        while live := going():
            until = {i: min(series[i].config.rounds, out.stops[names[i]].best + patience) for i in live}
            aucs = _by_series(table, search, until, sizes, parts == 1, kept)
            for name in dict.fromkeys(names[i] for i in live):
                own = [i for i in live if names[i] == name]
                for at in range(out.stops[name].round + 1, until[own[0]] + 1):
                    see(own, at, {i: aucs[i, at] for i in own})
        for written in kept.values():
            written.drop()
        out.history.sort(key=lambda h: (h[2], names.index(h[0]), h[1]))
    else:
        table = _in_step(table, search, parts, going, see)
    table.drop()
    best = [search.trees[i][: out.stops[names[i]].best] for i in range(n)]
    out.rows = _scored(rows, best, [s.config.learning_rate for s in series], max_bins)
    return out


def _in_step(table: Written, search: _Search, parts: int, going: Callable[[], list[int]], see: Callable[..., None]) -> Written:
    """Grows the series that are ``going`` over any number of blocks: one job a level. The
    first of a round judges the round before it."""
    stored: list[int] = []
    held_rounds = done = 0
    cuts = {i: np.empty(0) for i in range(len(search.series))}

    def task(i: int, judged: bool = False, tree: Tree | None = None) -> _Task:
        row = stored.index(i) if held_rounds else None
        return _Task(i, row, search.trees[i][held_rounds:], held_rounds, cuts[i] if judged else None, tree)

    live = going()
    while live:
        growing = {i: Tree(search.series[i].config.depth, search.bins) for i in live if done < search.series[i].config.rounds}
        splits, ranks = _pass(table.rows, search, [task(i, done > 0, growing.get(i)) for i in live], parts)
        if done:
            aucs = {}
            for i, found in ranks.items():
                aucs[i], cuts[i] = _area(found)
            see(live, done, aucs)
            live = going()
        growing = {i: growing[i] for i in live}
        while splits:
            for i, tree in growing.items():
                if i in splits:
                    tree.take(splits[i])
            still = [task(i, tree=tree) for i, tree in growing.items() if tree.open]
            splits = _pass(table.rows, search, still, parts)[0] if still else {}
        for i, tree in growing.items():
            search.trees[i].append(tree)
        done += 1
        if live and done - held_rounds == REWRITE:
            table = _with_margins(table, search, [task(i) for i in live])
            stored, held_rounds = list(live), done
    return table


def _scored(rows: DataFrame, trees: Sequence[Sequence[Tree]], rates: Sequence[float], bins: int) -> DataFrame:
    """``rows`` with ``margin_at_best``: the trees are added in the order in which they grew."""
    shared = rows.sparkSession.sparkContext.broadcast((list(trees), list(rates)))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, rate = shared.value
        for batch in batches:
            x = np.stack(batch.to_list()).astype(np.min_scalar_type(bins - 1)).T if len(batch) else np.empty((0, 0))
            margins = [growth.added(np.zeros(len(batch)), t, x, r) if len(batch) else np.empty(0) for t, r in zip(own, rate)]
            yield pd.Series(list(np.column_stack(margins)) if len(batch) else [], dtype=object)

    margin = F.pandas_udf(score, "array<double>")
    return rows.withColumn("margin_at_best", margin(vector_to_array("features")))


def early_stopped(rows: DataFrame, config: Boosting, patience: int, max_bins: int = BINS, test: str = "split = 'test'", validation: str = "is_validation") -> DataFrame:
    """(n_trees, validation AUC, sizes, test AUC and average precision) of one stopped series.

    ``rows`` holds train and test rows; the test rows only carry margins.
    """
    learns, judged = f"NOT ({test}) AND NOT {validation}", f"NOT ({test}) AND {validation}"
    found = grow(rows, [Series(config, learns, judged)], patience, max_bins)
    stop = found.stops[config.name]
    scored = found.rows.where(test).selectExpr("label AS y_true", "margin_at_best[0] AS p")
    return ranking_quality(scored).selectExpr(
        f"{stop.best} AS n_trees", f"{stop.round} AS n_rounds", f"{number(stop.mean)} AS validation_roc_auc",
        "n AS n_test", "n_pos AS n_test_deaths", "roc_auc", "average_precision AS pr_auc",
    )


def sweep(rows: DataFrame, configs: Sequence[Boosting], patience: int, max_bins: int = BINS, folds: int = 5, fold: str = "fold") -> DataFrame:
    """(config, n_trees, n_rounds, auc_mean, auc_std, settings, is_best) per configuration, by
    cross-validation in step."""
    series = [s for c in configs for s in fold_series(c, folds, fold)]
    found = grow(rows, series, patience, max_bins)
    stops = found.stops
    table = [
        (c.name, stops[c.name].best, stops[c.name].round, stops[c.name].mean, stops[c.name].std, c.leaves, c.min_rows, c.learning_rate)
        for c in configs
    ]
    best = min(table, key=lambda r: (-r[3], r[0]))[0]
    return rows.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in table],
        "config string, n_trees int, n_rounds int, auc_mean double, auc_std double, num_leaves int, min_child_samples int,"
        " learning_rate double, is_best boolean",
    )
