"""Forests on a 0/1 label, grown tree by tree from binned rows.

Spark's own fit keeps histograms of all nodes for each partition and shuffles them level by
level, which for deep nodes of few rows is far more than the rows. Here rows become small:
one byte for the bin of each feature. A task gets all binned rows of a fit, as long as they take
``GROUP_BYTES`` at most, and grows ``TREES_PER_TASK`` trees from them. Beyond that, the
upper nodes of each tree are split by histograms that are summed over blocks of rows, until
the rows of a node fit into a task; the rest of the tree is grown there. Both ways give the
same trees, since draws depend on seed, tree, block and node alone.

In a search nobody needs the trees themselves, only what they say to held out rows. Those rows
come along, and trees answer in the task that grows them (:func:`accuracies`): nodes of deep
trees, which are many times the rows, are neither written nor moved.

Splits are chosen as Spark chooses them: features drawn for each node, variance, the first
of equally good ones. Borders of bins come from all rows (:func:`~tenuro.plans.bins.borders`).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Sequence
from contextlib import ExitStack
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tenuro.functions.lineage import kept, remove, scratch_path
from tenuro.plans.bins import borders
from tenuro.plans.trees import Tree, tree_answers

#: Binned rows of a task, at most.
GROUP_BYTES = 128 << 20
#: Rows packed together. Bootstrap samples are drawn by block.
BLOCK_ROWS = 1 << 16
#: Trees that a task grows one after the other from the same rows.
TREES_PER_TASK = 8
#: A search has so many tasks for a fold, or fewer; each is sent all binned rows once.
SEARCH_TASKS = 20
#: Nodes whose histograms a task holds at a time.
NODES_AT_A_TIME = 4096
#: Counts of a cell are below this, so that a double holds a count and a count of ones.
_ONES = 1 << 26
_TINY = 2.0**-52

BLOCK = "held boolean, part int, block int, n int, odd boolean, codes binary, labels binary"
_GROWN = "job long, path long, count long, ones long, gain double, feature long, bin long"
_NODES = (
    "fit int, tree int, node int, prediction double, impurity double, rows long, ones long, "
    "gain double, left int, right int, feature int, threshold double"
)
_TOTALS = "fit int, cut int, task int, part int, block int, totals binary, labels binary"


class Spec(NamedTuple):
    """What a forest is grown by."""

    trees: int
    depth: int
    tried: int
    seed: int
    bootstrap: bool
    rate: float
    least_rows: int
    least_gain: float


class Grown(NamedTuple):
    """Nodes of a tree. The root has path 1, and children of p have 2p and 2p + 1."""

    path: np.ndarray
    count: np.ndarray
    ones: np.ndarray
    gain: np.ndarray  # -1 in leaves, like feature and bin
    feature: np.ndarray
    bin: np.ndarray


class Binned(NamedTuple):
    """Rows as blocks of bins: those to fit on (``rows`` of them), and those held out."""

    blocks: DataFrame
    places: list[np.ndarray]
    rows: int

    @property
    def fitted(self) -> DataFrame:
        return self.blocks.where("NOT held")

    @property
    def limit(self) -> int:
        """So many rows to fit on go to a task."""
        return max(1, GROUP_BYTES // (len(self.places) + 1))


class Forest(RandomForestRegressor):
    """Spark's regressor with another way to fit; its model is Spark's own.

    Labels other than 0 and 1, weights and categories are left to Spark's fit.
    """

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        with ExitStack() as stack:
            nodes = grown([self], dataset, stack)
            if nodes is None:
                return super()._fit(dataset)
            return _as_model(self, nodes, _width(self, dataset))


def grown(
    forests: Sequence[Forest], dataset: DataFrame, stack: ExitStack
) -> DataFrame | None:
    """The nodes of ``forests``, all fitted on ``dataset``; ``fit`` is the place in the list.

    None where rows or parameters need Spark's own fit. What is written on the way is
    deleted at the end of ``stack``.
    """
    rows = binned(forests, dataset, stack)
    return None if rows is None else nodes_of(forests, rows, stack)


def binned(
    forests: Sequence[Forest], dataset: DataFrame, stack: ExitStack, held_out: Column | None = None
) -> Binned | None:
    """The rows of ``dataset`` as ``forests`` are grown from them, written until the end of ``stack``.

    Borders of bins come from the rows that aren't ``held_out``. None where rows or parameters
    need Spark's own fit.
    """
    first = forests[0]
    width = _width(first, dataset)
    if width is None or not all(_plain(f) for f in forests):
        return None
    names = [f"f{i}" for i in range(width)]
    values = vector_to_array(F.col(first.getFeaturesCol()))
    fitted = dataset if held_out is None else dataset.where(~held_out)
    apart = fitted.select(*(values[i].alias(n) for i, n in enumerate(names)))
    found = borders(apart, names, first.getMaxBins())
    places = [np.array(found[n]) for n in names]
    label = F.col(first.getLabelCol()).cast("double")
    held = F.lit(False) if held_out is None else held_out
    rows = dataset.select(values.alias("values"), label.alias("label"), held.alias("held"))
    packed = rows.mapInArrow(lambda batches: _pack(batches, places), BLOCK)
    blocks = stack.enter_context(kept(packed, "blocks"))
    n = F.sum(F.when(~F.col("held"), F.col("n"))).alias("n")
    size = blocks.agg(n, F.max("odd").alias("odd")).first()
    return None if not size.n or size.odd else Binned(blocks, places, size.n)


def nodes_of(forests: Sequence[Forest], rows: Binned, stack: ExitStack) -> DataFrame:
    """The nodes of ``forests``, all fitted on ``rows``."""
    specs = [_spec(f, len(rows.places)) for f in forests]
    if rows.rows <= rows.limit:
        return _grown_whole(rows.fitted, specs, rows.places)
    return _grown_from_parts(rows.fitted, specs, rows.places, rows.limit, stack)


def _width(forest: Forest, dataset: DataFrame) -> int | None:
    """How many features there are; None if there are no rows or some are categories."""
    name = forest.getFeaturesCol()
    known = dataset.schema[name].metadata.get("ml_attr", {})
    if {"nominal", "binary"} & known.get("attrs", {}).keys():
        return None
    if "num_attrs" in known:
        return known["num_attrs"]
    if "attrs" in known:
        return sum(map(len, known["attrs"].values()))
    row = dataset.select(F.size(vector_to_array(F.col(name))).alias("n")).first()
    return row and row.n


def _plain(forest: Forest) -> bool:
    weighted = forest.isDefined("weightCol") and forest.getWeightCol()
    return (
        not weighted
        and not forest.getOrDefault("minWeightFractionPerNode")
        and not forest.getOrDefault("leafCol")
        and forest.getMaxBins() <= 256
    )


def _tried(strategy: str, width: int, trees: int) -> int:
    """Features tried at a node, by Spark's names for them."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "onethird"
    named = {
        "all": width,
        "sqrt": math.ceil(math.sqrt(width)),
        "log2": max(1, math.ceil(math.log2(width))),
        "onethird": math.ceil(width / 3),
    }
    if strategy.lower() in named:
        return named[strategy.lower()]
    number = float(strategy)
    return min(width, int(number) if strategy.isdigit() else math.ceil(number * width))


def _spec(forest: Forest, width: int) -> Spec:
    trees = forest.getNumTrees()
    return Spec(
        trees, forest.getMaxDepth(), _tried(forest.getFeatureSubsetStrategy(), width, trees),
        forest.getSeed(), forest.getBootstrap(), forest.getSubsamplingRate(),
        forest.getMinInstancesPerNode(), forest.getMinInfoGain(),
    )


# ---------------------------------------------------------------- rows and draws


def _pack(batches: Iterable[pa.RecordBatch], places: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks of ``BLOCK_ROWS`` rows: a byte for each feature's bin, and one for the label."""
    part = TaskContext.get().partitionId()
    made = {False: 0, True: 0}
    waiting: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}

    def packed(held: bool, codes: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        odd = bool(((labels != 0) & (labels != 1)).any())
        own = (labels == 1).astype(np.uint8)
        block, made[held] = made[held], made[held] + 1
        return _record(
            _PACKED, (held, part, block, len(codes), odd, codes.tobytes(), own.tobytes())
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        values = values.reshape(batch.num_rows, -1)
        codes = np.empty(values.shape, np.uint8)
        for i, own in enumerate(places):
            codes[:, i] = np.searchsorted(own, values[:, i], side="left")
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        is_held = batch.column(2).to_numpy(zero_copy_only=False)
        for held, some in waiting.items():
            chosen = is_held == held
            some.append((codes[chosen], labels[chosen]))
            if sum(len(c) for c, _ in some) >= BLOCK_ROWS:
                full, ends = (np.concatenate(x) for x in zip(*some))
                while len(full) >= BLOCK_ROWS:
                    yield packed(held, full[:BLOCK_ROWS], ends[:BLOCK_ROWS])
                    full, ends = full[BLOCK_ROWS:], ends[BLOCK_ROWS:]
                some[:] = [(full, ends)]
    for held, some in waiting.items():
        if sum(len(c) for c, _ in some):
            yield packed(held, *(np.concatenate(x) for x in zip(*some)))


def _copies(spec: Spec, tree: int, part: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is in the sample of a tree."""
    if not spec.bootstrap and spec.rate >= 1:
        return np.ones(n, np.uint8)
    rng = np.random.default_rng([spec.seed & (2**64 - 1), tree, part, block])
    if spec.bootstrap:
        return np.minimum(rng.poisson(spec.rate, n), 255).astype(np.uint8)
    return (rng.random(n) < spec.rate).astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers that look random (the finisher of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _features(spec: Spec, tree: int, paths: np.ndarray, width: int) -> np.ndarray:
    """The features tried at each node, in ascending order."""
    if spec.tried >= width:
        return np.broadcast_to(np.arange(width), (len(paths), width))
    start = np.random.SeedSequence([spec.seed & (2**64 - 1), tree]).generate_state(1, np.uint64)
    of_node = _mixed(start + paths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys = _mixed(of_node[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.sort(np.argpartition(keys, spec.tried - 1, axis=1)[:, : spec.tried], axis=1)


# ---------------------------------------------------------------- splits


def _variance(count: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones - ones * ones / count) / count


class _Best:
    """The best split found so far for each of some nodes."""

    def __init__(self, count: np.ndarray, ones: np.ndarray):
        n = len(count)
        self.count, self.ones = count.astype(float), ones.astype(float)
        self.impurity = _variance(self.count, self.ones)
        self.gain = np.full(n, -np.inf)
        self.feature, self.bin = np.full(n, -1), np.full(n, -1)
        self.left_count, self.left_ones = np.zeros(n), np.zeros(n)

    def consider(
        self, feature: np.ndarray, count: np.ndarray, ones: np.ndarray, spec: Spec
    ) -> None:
        """Try to split by a feature of each node, given its rows and ones in each bin."""
        left, left_ones = np.cumsum(count[:, :-1], axis=1), np.cumsum(ones[:, :-1], axis=1)
        right, right_ones = self.count[:, None] - left, self.ones[:, None] - left_ones
        least = max(1, spec.least_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (
                self.impurity[:, None]
                - left / self.count[:, None] * _variance(left, left_ones)
                - right / self.count[:, None] * _variance(right, right_ones)
            )
            gain[~((left >= least) & (right >= least) & (gain >= spec.least_gain))] = -np.inf
        gain[feature < 0] = -np.inf
        if not gain.shape[1]:
            return
        at = gain.argmax(axis=1)
        every = np.arange(len(at))
        best = gain[every, at]
        better = np.flatnonzero(best > self.gain)
        self.gain[better] = best[better]
        self.feature[better], self.bin[better] = feature[better], at[better]
        self.left_count[better] = left[better, at[better]]
        self.left_ones[better] = left_ones[better, at[better]]


def _ends(count: np.ndarray, ones: np.ndarray, paths: np.ndarray, depth: int, root: bool = False) -> np.ndarray:
    """Which nodes are leaves whatever the features say."""
    deep = paths >= (1 << depth)
    return deep if root else deep | (np.abs(_variance(count, ones)) < _TINY)


def _grow(
    codes: np.ndarray, labels: np.ndarray, copies: np.ndarray, spec: Spec, tree: int,
    n_bins: int, root: int = 1,
) -> Grown:
    """The tree, or the part of it below the node ``root``, of rows that are all here."""
    width = codes.shape[1]
    drawn = np.flatnonzero(copies)
    n = len(drawn)
    # One feature after the other: neighbouring rows are read together.
    columns = np.ascontiguousarray(codes[drawn].T)
    every = np.arange(n)
    flat, row = columns.ravel(), every
    weight = copies[drawn].astype(float)
    weight += weight * labels[drawn] * _ONES
    node = np.zeros(len(row), np.int64)
    paths = np.array([root], np.int64)
    total = weight.sum()
    ones = np.array([np.floor(total / _ONES)])
    count = np.array([total]) - ones * _ONES
    made: list[tuple] = []
    if not len(row) or _ends(count, ones, paths, spec.depth, root == 1)[0]:
        none = np.full(1, -1)
        return Grown(paths, count.astype(int), ones.astype(int), none.astype(float), none, none)
    while len(paths):
        features = _features(spec, tree, paths, width)
        best = _Best(count, ones)
        if len(paths) > NODES_AT_A_TIME:
            order = np.argsort(node, kind="stable")
            row, weight, node = row[order], weight[order], node[order]
        for start in range(0, len(paths), NODES_AT_A_TIME):
            stop = min(start + NODES_AT_A_TIME, len(paths))
            if stop - start == len(paths):
                own, some, part = node, slice(None), best
            else:
                some = slice(*np.searchsorted(node, [start, stop]))
                own, part = node[some] - start, _Best(count[start:stop], ones[start:stop])
            mass, first = weight[some], own * n_bins
            for here, codes_of in _tries(
                features[start:stop], own, None if row is every else row[some], columns
            ):
                place = first + codes_of
                cells = np.bincount(place, mass, (stop - start) * n_bins).reshape(-1, n_bins)
                in_bin = np.floor(cells / _ONES)
                part.consider(here, cells - in_bin * _ONES, in_bin, spec)
            if part is not best:
                for name in ("gain", "feature", "bin", "left_count", "left_ones"):
                    getattr(best, name)[start:stop] = getattr(part, name)
        split = best.gain > 0
        made.append(_nodes_of(paths, best, split))
        # Children that can be split again go on, others are leaves.
        at = np.flatnonzero(split)
        paths, count, ones = _children(paths, best, at)
        leaf = _ends(count, ones, paths, spec.depth)
        none = np.full(int(leaf.sum()), -1)
        made.append((paths[leaf], count[leaf], ones[leaf], none.astype(float), none, none))
        place = np.full(2 * len(split), -1)
        child = np.empty(2 * len(at), np.int64)
        child[0::2], child[1::2] = 2 * at, 2 * at + 1
        place[child[~leaf]] = np.arange(int((~leaf).sum()))
        high = flat[best.feature[node] * n + row] > best.bin[node]
        node = place[2 * node + high]
        stays = np.flatnonzero(node >= 0)
        if len(stays) < len(node):
            row, weight, node = row[stays], weight[stays], node[stays]
        paths, count, ones = paths[~leaf], count[~leaf], ones[~leaf]
    fields = [np.concatenate(x) for x in zip(*made)]
    return Grown(
        fields[0], fields[1].astype(int), fields[2].astype(int), fields[3],
        fields[4].astype(int), fields[5].astype(int),
    )


def _tries(
    features: np.ndarray, node: np.ndarray, row: np.ndarray | None, columns: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each node a feature to try (-1: none), and each row's bin of its node's feature.

    ``row`` is None for all rows in their order.
    """
    width, n = columns.shape
    if 3 * features.shape[1] < width:
        flat = columns.ravel()
        for tried in np.ascontiguousarray(features.T):
            yield tried, flat.take((tried * n).take(node) + (np.arange(n) if row is None else row))
        return
    # Nearly all nodes try each feature, and a column is read faster than places in it.
    drawn = np.zeros((len(features), width), bool)
    np.put_along_axis(drawn, features, True, axis=1)
    for f in range(width):
        yield np.where(drawn[:, f], f, -1), columns[f] if row is None else columns[f].take(row)


def _nodes_of(paths: np.ndarray, best: _Best, split: np.ndarray) -> tuple:
    return (
        paths, best.count, best.ones, np.where(split, best.gain, -1.0),
        np.where(split, best.feature, -1), np.where(split, best.bin, -1),
    )


def _children(paths: np.ndarray, best: _Best, at: np.ndarray):
    """Paths, rows and ones of the children of nodes ``at``, left and right in turn."""
    two = [
        (2 * paths[at], best.left_count[at], best.left_ones[at]),
        (2 * paths[at] + 1, best.count[at] - best.left_count[at], best.ones[at] - best.left_ones[at]),
    ]
    return (np.stack(pair, axis=1).ravel() for pair in zip(*two))


def _numbered(grown: Grown, fit: int, tree: int, places: Sequence[np.ndarray]) -> pa.Table:
    """The nodes of a whole tree, numbered from the root by level.

    Two leaves that say the same are one, as in Spark's trees.
    """
    order = np.argsort(grown.path)
    path, count, ones, gain, feature, bin_ = (x[order] for x in grown)
    says = ones / np.maximum(count, 1)
    while True:
        inner = np.flatnonzero(feature >= 0)
        left = np.searchsorted(path, 2 * path[inner])
        alike = (feature[left] < 0) & (feature[left + 1] < 0) & (says[left] == says[left + 1])
        if not alike.any():
            break
        gain[inner[alike]], feature[inner[alike]] = -1.0, -1
        keep = np.ones(len(path), bool)
        keep[left[alike]] = keep[left[alike] + 1] = False
        path, count, ones, gain, feature, bin_, says = (
            x[keep] for x in (path, count, ones, gain, feature, bin_, says)
        )
    n = len(path)
    down = np.full(n, -1)
    down[inner] = left
    threshold = np.full(n, np.nan)
    for f in np.unique(feature[inner]):
        own = inner[feature[inner] == f]
        threshold[own] = places[f][bin_[own]]
    return pa.table({
        "fit": np.full(n, fit, np.int32), "tree": np.full(n, tree, np.int32),
        "node": np.arange(n, dtype=np.int32), "prediction": says,
        "impurity": _variance(np.maximum(count, 1), ones), "rows": count, "ones": ones, "gain": gain,
        "left": down.astype(np.int32), "right": np.where(down < 0, -1, down + 1).astype(np.int32),
        "feature": feature.astype(np.int32),
        "threshold": pa.array(threshold, from_pandas=True),
    })


# ---------------------------------------------------------------- jobs


def _bytes(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(b.as_buffer(), np.uint8) for b in column]


def _in_order(blocks: pa.Table) -> pa.Table:
    return blocks.sort_by([("part", "ascending"), ("block", "ascending")])


def _grown_whole(
    blocks: DataFrame, specs: Sequence[Spec], places: Sequence[np.ndarray]
) -> DataFrame:
    """Every tree in a task that has all rows."""
    jobs = [(fit, tree) for fit, spec in enumerate(specs) for tree in range(spec.trees)]
    groups = math.ceil(len(jobs) / TREES_PER_TASK)
    width, n_bins = len(places), max(map(len, places)) + 1

    def grow(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        table = _in_order(table)
        codes = np.concatenate(_bytes(table.column("codes"))).reshape(-1, width)
        labels = np.concatenate(_bytes(table.column("labels")))
        drawn_by = [table.column(c).to_pylist() for c in ("part", "block", "n")]
        out = []
        # Fits differ in cost, so each group has trees of all of them.
        for fit, tree in jobs[group::groups]:
            spec = specs[fit]
            copies = np.concatenate([_copies(spec, tree, *b) for b in zip(*drawn_by)])
            grown = _grow(codes, labels, copies, spec, tree, n_bins)
            out.append(_numbered(grown, fit, tree, places))
        return pa.concat_tables(out)

    group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    sent = blocks.select("part", "block", "n", "codes", "labels", group)
    return sent.repartitionById(groups, "group").groupBy("group").applyInArrow(grow, _NODES)


def accuracies(
    forests: Sequence[Forest], rows: Binned, counts: Sequence[int], depths: Sequence[int | None]
) -> DataFrame:
    """Share of held out rows that each forest gets right: ``fit``, ``depth``, ``count``, ``accuracy``.

    Asked are the first ``count`` trees, cut at ``depth`` (null: not at all). A task grows trees
    that follow each other, and its sums of their answers, a number for each row, depth and
    count, are what is moved. A feature's value is beyond a border just if its bin is.
    """
    width, n_bins = len(rows.places), max(map(len, rows.places)) + 1
    specs = [_spec(f, width) for f in forests]
    cuts = np.array(sorted(set(counts)))
    levels = list(dict.fromkeys(depths))
    # Costly fits go first.
    order = sorted(range(len(specs)), key=lambda fit: -specs[fit].tried)
    jobs = [(fit, tree) for fit in order for tree in range(specs[fit].trees)]
    each = max(TREES_PER_TASK, math.ceil(len(jobs) / SEARCH_TASKS))
    by_bin = [np.arange(n_bins)] * width

    def grow(table: pa.Table) -> pa.Table:
        task = table.column("task")[0].as_py()
        table = _in_order(table)
        fitted, held = (table.filter(pc.equal(table.column("held"), h)) for h in (False, True))
        (codes, labels), (others, _) = (
            [np.concatenate([np.empty(0, np.uint8), *_bytes(x.column(c))]) for c in ("codes", "labels")]
            for x in (fitted, held)
        )
        codes, others = codes.reshape(-1, width), others.reshape(-1, width)
        drawn_by = [fitted.column(c).to_pylist() for c in ("part", "block", "n")]
        sums: dict[tuple[int, int], np.ndarray] = {}
        for fit, tree in jobs[task * each : (task + 1) * each]:
            spec = specs[fit]
            copies = np.concatenate([_copies(spec, tree, *b) for b in zip(*drawn_by)])
            nodes = _numbered(_grow(codes, labels, copies, spec, tree, n_bins), fit, tree, by_bin)
            said = tree_answers(_by_bin(nodes, tree), others, levels)
            # With the least count that the tree is one of.
            place = fit, int(np.searchsorted(cuts, tree, side="right"))
            sums[place] = sums[place] + said if place in sums else said
        blocks = held.select(["part", "block", "n", "labels"]).to_pylist()
        out = []
        for (fit, cut), total in sums.items():
            end = 0
            for b in blocks:
                start, end = end, end + b["n"]
                own = total[:, start:end].tobytes()
                out.append(_record(_SUMMED, (fit, cut, task, b["part"], b["block"], own, b["labels"])))
        return pa.Table.from_batches(out, _SUMMED)

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cut", "ascending"), ("task", "ascending")])
        (labels, *_), totals = (_bytes(table.column(c)) for c in ("labels", "totals"))
        sums = np.zeros((len(levels), len(cuts), len(labels)))
        for cut, total in zip(table.column("cut").to_pylist(), totals):
            sums[:, cut] += total.view(float).reshape(len(levels), -1)
        # Trees give shares, and the mean of them decides.
        guess = np.cumsum(sums, axis=1) > 0.5 * cuts[:, None]
        right = (guess == labels.astype(bool)).sum(axis=2)
        return pa.table({
            "fit": np.full(right.size, table.column("fit")[0].as_py(), np.int32),
            "depth": pa.array([d for d in levels for _ in cuts], pa.int32()),
            "count": np.tile(cuts, len(levels)).astype(np.int32),
            "right": right.ravel(), "rows": np.full(right.size, len(labels)),
        })

    tasks = math.ceil(len(jobs) / each)
    task = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
    sent = rows.blocks.select("held", "part", "block", "n", "codes", "labels", task)
    totals = sent.repartitionById(tasks, "task").groupBy("task").applyInArrow(grow, _TOTALS)
    judged = totals.groupBy("fit", "part", "block").applyInArrow(
        judge, "fit int, depth int, count int, right long, rows long"
    )
    share = F.sum("right") / F.sum("rows")
    return judged.groupBy("fit", "depth", "count").agg(share.alias("accuracy"))


def _by_bin(nodes: pa.Table, number: int) -> Tree:
    """A tree whose thresholds are numbers of bins."""
    field = {name: nodes.column(name).to_numpy() for name in Tree._fields[2:]}
    field["threshold"] = np.nan_to_num(field["threshold"], nan=-1).astype(np.int16)
    return Tree(number, 1.0, **field)


def _grown_from_parts(
    blocks: DataFrame, specs: Sequence[Spec], places: Sequence[np.ndarray], limit: int,
    stack: ExitStack,
) -> DataFrame:
    """Trees whose nodes of more than ``limit`` rows are split by histograms of blocks.

    The driver keeps those upper nodes, about one for each ``limit`` rows of a tree.
    """
    jobs = [(fit, tree) for fit, spec in enumerate(specs) for tree in range(spec.trees)]
    width, n_bins = len(places), max(map(len, places)) + 1
    spark = blocks.sparkSession
    #: Of each job: splits by path, and paths of nodes that are to be split here.
    splits: list[dict[int, tuple[int, int]]] = [{} for _ in jobs]
    upper: list[tuple] = []  # job, path, count, ones, gain, feature, bin
    parts: list[tuple[int, int]] = []  # job, path of nodes that a task finishes
    waiting = [(job, 1) for job in range(len(jobs))]
    while waiting:
        now, waiting = waiting[:NODES_AT_A_TIME], waiting[NODES_AT_A_TIME:]
        found = _upper_splits(blocks, specs, jobs, splits, now, n_bins, width).collect()
        for r in sorted(found, key=lambda r: (r.job, r.path)):
            spec = specs[jobs[r.job][0]]
            n = r["count"]
            upper.append((r.job, r.path, n, r.ones, r.gain, r.feature, r.bin))
            if r.feature < 0:
                continue
            splits[r.job][r.path] = (r.feature, r.bin)
            for path, count, ones in (
                (2 * r.path, r.left_count, r.left_ones),
                (2 * r.path + 1, n - r.left_count, r.ones - r.left_ones),
            ):
                of_one = (np.array([x]) for x in (float(count), float(ones), path))
                if _ends(*of_one, spec.depth)[0]:
                    upper.append((r.job, path, count, ones, -1.0, -1, -1))
                elif count > limit:
                    waiting.append((r.job, path))
                else:
                    parts.append((r.job, path))
    number = {part: i for i, part in enumerate(parts)}

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, dict[int, int]] = {}
        for (job, path), i in number.items():
            own.setdefault(job, {})[path] = i
        for block in _blocks_of(batches, width):
            for job, paths in own.items():
                fit, tree = jobs[job]
                copies = _copies(specs[fit], tree, *block.drawn_by)
                at = _places(block.codes, splits[job])
                for path, i in paths.items():
                    rows = np.flatnonzero((at == path) & (copies > 0))
                    if len(rows):
                        yield _record(
                            _SENT,
                            (i, *block.drawn_by[:2], block.codes[rows].tobytes(),
                             block.labels[rows].tobytes(), copies[rows].tobytes()),
                        )

    def finish(table: pa.Table) -> pa.Table:
        job, path = parts[table.column("piece")[0].as_py()]
        fit, tree = jobs[job]
        table = _in_order(table)
        codes, labels, copies = (
            np.concatenate(_bytes(table.column(c))) for c in ("codes", "labels", "copies")
        )
        grown = _grow(codes.reshape(-1, width), labels, copies, specs[fit], tree, n_bins, path)
        return pa.table({"job": np.full(len(grown.path), job), **grown._asdict()})

    pieces = max(1, len(parts))
    lower = (
        blocks.select("part", "block", "n", "codes", "labels")
        .mapInArrow(send, "piece int, part int, block int, codes binary, labels binary, copies binary")
        .repartitionById(min(pieces, NODES_AT_A_TIME), F.col("piece") % NODES_AT_A_TIME)
        .groupBy("piece")
        .applyInArrow(finish, _GROWN)
    )
    top = spark.createDataFrame(upper, _GROWN)

    def number_nodes(table: pa.Table) -> pa.Table:
        fit, tree = jobs[table.column("job")[0].as_py()]
        fields = (table.column(c).to_numpy() for c in Grown._fields)
        path, count, ones, gain, feature, bin_ = fields
        nodes = Grown(path, count, ones, gain.copy(), feature.astype(int), bin_.astype(int))
        return _numbered(nodes, fit, tree, places)

    return top.unionByName(lower).groupBy("job").applyInArrow(number_nodes, _NODES)


_PACKED = pa.schema(
    [("held", pa.bool_()), ("part", pa.int32()), ("block", pa.int32()), ("n", pa.int32()),
     ("odd", pa.bool_()), ("codes", pa.binary()), ("labels", pa.binary())]
)
_SUMMED = pa.schema(
    [("fit", pa.int32()), ("cut", pa.int32()), ("task", pa.int32()), ("part", pa.int32()),
     ("block", pa.int32()), ("totals", pa.binary()), ("labels", pa.binary())]
)
_SENT = pa.schema(
    [("piece", pa.int32()), ("part", pa.int32()), ("block", pa.int32()),
     ("codes", pa.binary()), ("labels", pa.binary()), ("copies", pa.binary())]
)
_SUMS = pa.schema([("job", pa.int32()), ("path", pa.int64()), ("cells", pa.binary())])


class _Block(NamedTuple):
    drawn_by: tuple[int, int, int]
    codes: np.ndarray
    labels: np.ndarray


def _blocks_of(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[_Block]:
    for batch in batches:
        for row in batch.to_pylist():
            codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, width)
            labels = np.frombuffer(row["labels"], np.uint8)
            yield _Block((row["part"], row["block"], row["n"]), codes, labels)


def _record(schema: pa.Schema, row: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema
    )


def _places(codes: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
    """The path of the node that each row has reached in the upper part of a tree."""
    at = np.ones(len(codes), np.int64)
    for path in sorted(splits):  # parents come before their children
        feature, bin_ = splits[path]
        here = np.flatnonzero(at == path)
        at[here] = 2 * path + (codes[here, feature] > bin_)
    return at


def _upper_splits(
    blocks: DataFrame, specs: Sequence[Spec], jobs: Sequence[tuple[int, int]],
    splits: Sequence[dict], now: Sequence[tuple[int, int]], n_bins: int, width: int,
) -> DataFrame:
    """The best split of each node of ``now``, by histograms summed over all blocks."""
    own: dict[int, list[int]] = {}
    for job, path in now:
        own.setdefault(job, []).append(path)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, int], np.ndarray] = {}
        for block in _blocks_of(batches, width):
            for job, paths in own.items():
                fit, tree = jobs[job]
                spec = specs[fit]
                copies = _copies(spec, tree, *block.drawn_by)
                at = _places(block.codes, splits[job])
                tried = _features(spec, tree, np.array(paths), width)
                for path, features in zip(paths, tried):
                    rows = np.flatnonzero((at == path) & (copies > 0))
                    mass = copies[rows] * (1.0 + block.labels[rows] * float(_ONES))
                    sums = np.stack([np.bincount(block.codes[rows, f], mass, n_bins) for f in features])
                    ones = np.floor(sums / _ONES)
                    both = np.stack([sums - ones * _ONES, ones]).astype(np.int64)
                    cells[job, path] = cells.get((job, path), 0) + both
        for (job, path), sums in cells.items():
            yield _record(_SUMS, (job, path, sums.tobytes()))

    def choose(table: pa.Table) -> pa.Table:
        job, path = table.column("job")[0].as_py(), table.column("path")[0].as_py()
        fit, tree = jobs[job]
        spec = specs[fit]
        sums = sum(np.frombuffer(c.as_buffer(), np.int64) for c in table.column("cells"))
        counts, ones = sums.reshape(2, -1, n_bins).astype(float)
        paths = np.array([path])
        best = _Best(counts[:1].sum(axis=1), ones[:1].sum(axis=1))
        (features,) = _features(spec, tree, paths, width)
        whole = not best.count[0] or _ends(best.count, best.ones, paths, spec.depth, path == 1)[0]
        for f, in_bin, ones_in_bin in () if whole else zip(features, counts, ones):
            best.consider(np.array([f]), in_bin[None], ones_in_bin[None], spec)
        path, n, n_ones, gain, feature, bin_ = _nodes_of(paths, best, best.gain > 0)
        return pa.table({
            "job": [job], "path": path, "count": n.astype(int), "ones": n_ones.astype(int),
            "gain": gain, "feature": feature, "bin": bin_,
            "left_count": best.left_count.astype(int), "left_ones": best.left_ones.astype(int),
        })

    sent = blocks.select("part", "block", "n", "codes", "labels")
    sums = sent.mapInArrow(count, "job int, path long, cells binary")
    schema = f"{_GROWN}, left_count long, left_ones long"
    return sums.groupBy("job", "path").applyInArrow(choose, schema)


# ---------------------------------------------------------------- models


def search_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as :func:`~tenuro.plans.trees.tree_sums` takes them, with their ``fit``."""
    return nodes.drop("impurity", "ones").withColumn("weight", F.lit(1.0))


def _as_model(forest: Forest, nodes: DataFrame, width: int) -> RandomForestRegressionModel:
    """Spark's model of the only fit among ``nodes``, read from a saved one."""
    spark = nodes.sparkSession
    path = scratch_path(spark, "forest")
    params = {"impurity": "variance"} | {p.name: v for p, v in forest._paramMap.items()}
    shared = {"timestamp": 0, "sparkVersion": spark.version, "defaultParamMap": {}}
    of_forest = {
        "class": "org.apache.spark.ml.regression.RandomForestRegressionModel",
        "uid": forest.uid, "paramMap": params, "numFeatures": width,
        "numTrees": forest.getNumTrees(), **shared,
    }
    of_tree = {
        "class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel",
        "uid": f"{forest.uid}_tree", "paramMap": {"impurity": "variance"}, **shared,
    }
    leaf = F.col("left") < 0
    count, ones = F.col("rows").cast("double"), F.col("ones").cast("double")
    nothing = F.array().cast("array<double>")
    data = nodes.select(
        F.col("tree").alias("treeID"),
        F.struct(
            F.col("node").alias("id"),
            "prediction",
            "impurity",
            F.array(count, ones, ones).alias("impurityStats"),
            F.col("rows").alias("rawCount"),
            "gain",
            F.col("left").alias("leftChild"),
            F.col("right").alias("rightChild"),
            F.struct(
                F.col("feature").alias("featureIndex"),
                F.when(leaf, nothing)
                .otherwise(F.array("threshold"))
                .alias("leftCategoriesOrThreshold"),
                F.lit(-1).alias("numCategories"),
            ).alias("split"),
        ).alias("nodeData"),
    )
    try:
        data.write.parquet(f"{path}/data")
        spark.range(1).select(F.lit(json.dumps(of_forest))).write.text(f"{path}/metadata")
        spark.range(forest.getNumTrees()).select(
            F.col("id").cast("int").alias("_1"),
            F.lit(json.dumps(of_tree)).alias("_2"),
            F.lit(1.0).alias("_3"),
        ).write.parquet(f"{path}/treesMetadata")
        return RandomForestRegressionModel.load(path)
    finally:
        remove(spark, path)
