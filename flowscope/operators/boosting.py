"""Gradient boosting over histograms, trees grown best leaf first.

The pool is binned once and lies packed in parts. A leaf's children need one histogram, that of the smaller one; the other is the difference. Where the best leaf's
children are not known yet, those of all leaves that may be split before the tree is full are summed in the same pass over the pool: about as many passes a tree as it
has levels, and the order stays best first; the leaves of a full tree need no histograms. A pass is one job that gives the driver a histogram for each such leaf, of bounded
size. There are many passes and each does little, so parts are kept as arrays and a pass is a job without a query plan. A worker keeps the margins and leaves of the
parts it has seen and only adds what is new; where it has none, it adds all, so lost executors cost time only.

Features of few bins share a code, whose cells are counted at once and then added up for each of them.

A pool of ``ONE_PART`` values at most is one part, and its passes then need no jobs: the part's task makes the same sums and choices by itself.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from . import packed

BINS = 255
ONE_PART = 1_000_000
#: Pools above this many rows hold some back and stop when their loss no longer falls.
EARLY_ROWS, EARLY_SHARE, EARLY_TRIES, EARLY_LEAST = 10_000, 0.1, 10, 1e-7
LEAST_CURVATURE = 1e-3
#: Cells of a code, and rows that are counted at once.
CELLS, ROWS = 256, 65_536


@dataclass
class Options:
    iterations: int = 200
    leaves: int = 31
    rate: float = 0.1
    l2: float = 1.0
    least_rows: int = 20


@dataclass
class Leaf:
    node: int
    whole: np.ndarray  # slope, curvature and rows
    sums: np.ndarray | None = None  # the same of each bin of each feature
    split: tuple[float, int, int] | None = None  # gain, feature, bin
    children: tuple[Leaf, Leaf] | None = None


#: A histogram that is asked for: of the rows at a node, and of these only the ones on a side of a split (feature, bin, right).
Wanted = tuple[int, int, int, bool]


@dataclass
class Tree:
    """Node by node: feature (-1 in a leaf), last bin that goes left, left child (the right one follows), value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[feature[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = left[at] + (x[rows, feature[at]] > cut[at])
        return node


class Codes:
    """Which features share a code; the bin of each feature in each cell, and what adds cells up to bins."""

    def __init__(self, sizes: np.ndarray):
        groups, room = [], 0
        for f in np.argsort(sizes, kind="stable").tolist():
            if room < sizes[f]:
                groups.append([])
                room = CELLS
            groups[-1].append(f)
            room //= int(sizes[f])
        first = np.cumsum(sizes) - sizes
        self.sizes, self.groups, self.group = sizes, groups, np.empty(len(sizes), np.int64)
        self.bins = np.zeros((len(sizes), CELLS), np.uint8)
        self.cells, self.places, self.adds = [], [], []
        for k, group in enumerate(groups):
            n = int(np.prod(sizes[group]))
            for f, bins in zip(group, np.unravel_index(np.arange(n), sizes[group])):
                self.group[f], self.bins[f, :n] = k, bins
            self.cells.append(n)
            self.places.append(np.concatenate([np.arange(first[f], first[f] + sizes[f]) for f in group]))
            self.adds.append(np.concatenate([self.bins[f, :n] == np.arange(sizes[f])[:, None] for f in group]).astype(float) if len(group) > 1 else None)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The codes of rows of bins, a code after the other."""
        return np.stack([np.ravel_multi_index(tuple(x[:, f] for f in group), self.sizes[group]).astype(np.uint8) for group in self.groups])


class Part:
    """Rows of one part of the pool, with the margins that the trees so far give them, and their leaves in the tree that grows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, sizes: np.ndarray, base: float):
        self.codes = Codes(sizes)
        self.x, self.y, self.w, self.own = self.codes.of(x), (y & 1).astype(bool), w, y <= 1
        self.base = base
        self.begin()

    def begin(self) -> None:
        self.done, self.raw, self.node = -1, np.full(len(self.y), self.base), np.zeros(len(self.y), np.int32)

    def __getstate__(self) -> dict:
        """Without what each row starts with: a part travels to a worker in every pass."""
        return {k: v for k, v in self.__dict__.items() if k not in ("done", "raw", "node")}

    def state(self) -> tuple[int, np.ndarray, np.ndarray]:
        return self.done, self.raw, self.node

    def right(self, f: int, cut: int) -> np.ndarray:
        """Whether each cell of the feature's code goes right."""
        return self.codes.bins[f] > cut

    def descend(self, tree: Tree) -> None:
        """Each row goes on from where it is to its leaf."""
        feature, left = np.array(tree.feature), np.array(tree.left, np.int32)
        group, right = self.codes.group[feature], self.codes.bins[feature] > np.array(tree.bin)[:, None]
        rows = np.flatnonzero((feature >= 0)[self.node])
        while len(rows):
            at = self.node[rows]
            at = left[at] + right[at, self.x[group[at], rows]]
            self.node[rows] = at
            rows = rows[(feature >= 0)[at]]

    def advance(self, trees: list[Tree | bytes]) -> None:
        """Adds the trees that are new; they may be pickled."""
        if self.done < len(trees):
            for tree in trees[max(self.done, 0) :]:
                tree = pickle.loads(tree) if isinstance(tree, bytes) else tree
                self.descend(tree)
                self.raw = self.raw + np.array(tree.value)[self.node]
                self.node = np.zeros(len(self.y), np.int32)
            self.done = len(trees)
        p = 1 / (1 + np.exp(-self.raw))
        self.slope, self.curve = self.w * (p - self.y), self.w * p * (1 - p)

    def loss(self) -> float:
        out = np.flatnonzero(~self.own)
        return float(self.w[out] @ np.logaddexp(0.0, np.where(self.y[out], -self.raw[out], self.raw[out])))

    def histograms(self, tree: Tree, wanted: list[Wanted]) -> np.ndarray:
        self.descend(tree)
        out = np.zeros((len(wanted), 3, int(self.codes.sizes.sum())))
        for k, (at, f, cut, right) in enumerate(wanted):
            rows = np.flatnonzero((self.node == at) & self.own)
            if f >= 0:
                rows = rows[self.right(f, cut)[self.x[self.codes.group[f]][rows]] == right]
            cells = [np.zeros((3, n)) for n in self.codes.cells]
            for a in range(0, len(rows), ROWS):
                some = rows[a : a + ROWS]
                slope, curve = self.slope[some], self.curve[some]
                for sums, x, n in zip(cells, self.x, self.codes.cells):
                    code = x[some].astype(np.intp)
                    sums += [np.bincount(code, slope, n), np.bincount(code, curve, n), np.bincount(code, minlength=n)]
            for sums, place, add in zip(cells, self.codes.places, self.codes.adds):
                out[k][:, place] = sums if add is None else sums @ add.T
        return out


class Grower:
    """Chooses the splits of trees from histograms; ``ask`` gives the loss of rows held back and the histograms wanted, summed over all parts."""

    def __init__(self, sizes: np.ndarray, options: Options, ask: Callable[[list[Tree], Tree, list[Wanted]], tuple[float, np.ndarray]]):
        self.sizes, self.options, self.ask, self.trees = sizes, options, ask, []
        self.first = np.cumsum(sizes) - sizes
        self.last = np.zeros(int(sizes.sum()), bool)
        self.last[np.cumsum(sizes) - 1] = True
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    def whole(self, sums: np.ndarray) -> np.ndarray:
        return sums[:, : self.sizes[0]].sum(1)

    def best(self, sums: np.ndarray) -> tuple[float, int, int] | None:
        """The split of the most gain; of those that are equal but for rounding that of the first feature and bin."""
        o, all_ = self.options, self.whole(sums)
        upto = np.cumsum(sums, axis=1)
        left = upto - np.repeat(np.concatenate((np.zeros((3, 1)), upto[:, self.first[1:] - 1]), axis=1), self.sizes, axis=1)
        right = all_[:, None] - left
        fine = ~self.last & (left[2] >= o.least_rows - 0.5) & (right[2] >= o.least_rows - 0.5) & (left[1] >= LEAST_CURVATURE) & (right[1] >= LEAST_CURVATURE)
        if not fine.any():
            return None
        gain = np.where(fine, left[0] ** 2 / (left[1] + o.l2) + right[0] ** 2 / (right[1] + o.l2) - all_[0] ** 2 / (all_[1] + o.l2), -np.inf)
        at = int(np.argmax(gain >= gain.max() - max(1e-9, 1e-12 * gain.max())))
        return (float(gain[at]), int(self.owner[at]), int(at - self.first[self.owner[at]])) if gain[at] > 0 else None

    def last_children(self, leaf: Leaf) -> tuple[Leaf, Leaf]:
        """Children that will not be split: the leaf's own histogram has their sums."""
        _, f, cut = leaf.split
        left = leaf.sums[:, self.first[f] : self.first[f] + cut + 1].sum(1)
        return Leaf(-1, left), Leaf(-1, leaf.whole - left)

    def expand(self, tree: Tree, leaves: list[Leaf]) -> None:
        """Children of ``leaves``, in one pass."""
        wanted = []
        for leaf in leaves:
            _, f, cut = leaf.split
            n = leaf.sums[2, self.first[f] : self.first[f] + self.sizes[f]]
            wanted.append((leaf.node, f, cut, bool(n[: cut + 1].sum() > n[cut + 1 :].sum())))
        for leaf, (_, _, _, right), small in zip(leaves, wanted, self.ask(self.trees, tree, wanted)[1]):
            sums = (leaf.sums - small, small) if right else (small, leaf.sums - small)
            leaf.children = tuple(Leaf(-1, self.whole(s), s, self.best(s)) for s in sums)

    def grow(self) -> tuple[Tree, float]:
        """The next tree, and the loss before it of the rows held back."""
        tree = Tree()
        loss, sums = self.ask(self.trees, tree, [(0, -1, 0, False)])
        root = Leaf(0, self.whole(sums[0]), sums[0], self.best(sums[0]))
        done, queue = ([], [(-root.split[0], 0, root)]) if root.split else ([root], [])
        while queue and len(queue) + len(done) < self.options.leaves:
            _, _, leaf = heapq.heappop(queue)
            if leaf.children is None:
                room = self.options.leaves - len(queue) - len(done) - 2
                if room:
                    self.expand(tree, [leaf, *[x for _, _, x in heapq.nsmallest(room, queue) if x.children is None]])
                else:
                    leaf.children = self.last_children(leaf)
            at = len(tree.feature)
            tree.feature[leaf.node], tree.bin[leaf.node], tree.left[leaf.node] = leaf.split[1], leaf.split[2], at
            for k, child in enumerate(leaf.children):
                child.node = at + k
                for values, empty in ((tree.feature, -1), (tree.bin, 0), (tree.left, 0), (tree.value, 0.0)):
                    values.append(empty)
                if child.split:
                    heapq.heappush(queue, (-child.split[0], child.node, child))
                else:
                    done.append(child)
            leaf.children = leaf.sums = None
        for leaf in done + [x for _, _, x in queue]:
            slope, curve, _ = leaf.whole
            tree.value[leaf.node] = float(-self.options.rate * slope / (curve + self.options.l2))
        return tree, loss


def boost(sizes: np.ndarray, options: Options, early: bool, ask: Callable[[list[Tree], Tree, list[Wanted]], tuple[float, np.ndarray]]) -> list[Tree]:
    grower, losses = Grower(sizes, options, ask), []
    for _ in range(options.iterations):
        tree, loss = grower.grow()
        losses.append(loss)
        if early and len(losses) > EARLY_TRIES and min(losses[-EARLY_TRIES:]) > losses[-EARLY_TRIES - 1] - EARLY_LEAST:
            break
        grower.trees.append(tree)
    return grower.trees


#: Margins and leaves that a worker keeps: of the parts of the last fit it saw.
_KEPT: dict[tuple[str, int], tuple[int, np.ndarray, np.ndarray]] = {}


@dataclass
class Pass:
    """What a task answers for its parts. Workers find this class in their own module, whose ``_KEPT`` lasts; a function made within another would bring an empty copy along."""

    fit: str
    trees: list[bytes]
    tree: Tree
    wanted: list[Wanted]

    def __call__(self, rows: Iterator[tuple[int, Part]]) -> Iterator[np.ndarray]:
        for number, part in rows:
            for old in [k for k in _KEPT if k[0] != self.fit]:
                del _KEPT[old]
            if (self.fit, number) in _KEPT:
                part.done, part.raw, part.node = _KEPT[self.fit, number]
            else:
                part.begin()
            part.advance(self.trees)
            found = part.histograms(self.tree, self.wanted)
            _KEPT[self.fit, number] = part.state()
            yield np.concatenate(([part.loss()], found.ravel()))


def _part(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], sizes: np.ndarray, base: float) -> Part:
    x, y, w = (np.concatenate([r[i] for r in rows]) if rows else np.empty(shape, kind) for i, (shape, kind) in enumerate((((0, len(sizes)), np.uint8), (0, np.uint8), (0, float))))
    return Part(x, y, w, sizes, base)


@dataclass
class Boosted:
    names: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    def scores(self, rows: DataFrame) -> DataFrame:
        """event_id, label, score of rows with features."""
        held = rows.sparkSession.sparkContext.broadcast((self.edges, self.base, self.trees))
        names = self.names

        def run(batches):
            edges, base, trees = held.value
            for b in batches:
                x = binned(np.column_stack([b.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(names))]).astype(float), edges)
                raw = base + sum((np.array(t.value)[t.route(x)] for t in trees), np.zeros(len(x)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-raw)))], names=["event_id", "label", "score"])

        return packed.spread(rows.select("event_id", F.col("ground_truth_label").alias("label"), *names)).mapInArrow(run, f"event_id {dict(rows.dtypes)['event_id']}, label string, score double")


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of the first edge that is at least the value."""
    return np.column_stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)]).astype(np.uint8)


def edges_of(train: DataFrame, names: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of each feature's bins but the last: quantiles of the pool, in one pass."""
    shares = [i / bins for i in range(1, bins)]
    found = packed.known(train).agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 20_000).alias(f"q{i}") for i, c in enumerate(names)]).first()
    return [np.unique(np.array(found[f"q{i}"] or [], float)) for i in range(len(names))]


def fit(train: DataFrame, names: list[str], balanced: bool = False, early: bool | None = None, options: Options | None = None, parts: int | None = None, held: Column | None = None) -> Boosted:
    """Raises unless the known rows of ``train`` are of both classes. ``held`` chooses the rows that are held back, by a hash of the id unless given."""
    options, spark = options or Options(), train.sparkSession
    s = packed.summary(train, names)
    edges = edges_of(train, names)
    sizes = np.array([len(e) + 1 for e in edges])
    if early is None:
        early = s.good + s.bad > EARLY_ROWS
    if early and held is None:
        held = F.pmod(F.xxhash64(F.col("event_id"), F.lit("held")), F.lit(1000)) < int(1000 * EARLY_SHARE)
    values = (s.good + s.bad) * len(names)
    cores = spark.sparkContext.defaultParallelism
    parts = parts or min(-(-values // ONE_PART), -(-packed.parts_of(train, s) // cores) * cores)  # smaller parts would cost more to start than they save; cores end together
    weights = s.weights(balanced)
    base = float(np.log(s.bad * weights[1] / (s.good * weights[0])))
    name, scale = uuid.uuid4().hex, 1.0 / (s.good + s.bad)

    rows = packed.pack(train, names, lambda x: binned(x, edges), weights, parts, held if early else None).rows
    if parts == 1:
        def alone(batches):
            part = _part(list(packed.arrays(batches, len(sizes), np.uint8)), sizes, base)

            def ask(trees: list[Tree], tree: Tree, wanted: list[Wanted]) -> tuple[float, np.ndarray]:
                part.advance(trees)
                return part.loss() * scale, part.histograms(tree, wanted)

            trees = boost(sizes, options, early, ask)
            yield pa.RecordBatch.from_pandas(pd.concat([pd.DataFrame(t.__dict__).assign(tree=i) for i, t in enumerate(trees)]).astype(_TREE), preserve_index=False)

        grown = rows.mapInArrow(alone, "feature int, bin int, left int, value double, tree int").toPandas()  # a row a node, in order
        return Boosted(names, edges, base, [Tree(*[g[c].tolist() for c in ("feature", "bin", "left", "value")]) for _, g in grown.groupby("tree")])

    def made(number: int, found):
        yield number, _part([packed.row(r, len(sizes), np.uint8) for r in found], sizes, base)

    kept = rows.rdd.mapPartitionsWithIndex(made).persist(StorageLevel.MEMORY_AND_DISK)
    sent: list[bytes] = []

    def ask(trees: list[Tree], tree: Tree, wanted: list[Wanted]) -> tuple[float, np.ndarray]:
        sent.extend(map(pickle.dumps, trees[len(sent) :]))
        found = kept.mapPartitions(Pass(name, sent, tree, wanted))
        whole = sum(found.collect()) if parts <= packed.PARTS else found.treeReduce(np.add)
        return whole[0] * scale, whole[1:].reshape(len(wanted), 3, -1)

    try:
        return Boosted(names, edges, base, boost(sizes, options, early, ask))
    finally:
        kept.unpersist()


_TREE = {"feature": "int32", "bin": "int32", "left": "int32", "tree": "int32"}
