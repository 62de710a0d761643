"""A random forest over histograms: all trees grow side by side, a level a pass over a packed pool of bins.

Each tree learns from rows drawn with replacement (a Poisson count a row, by a hash of the row's place in its packed block and of the tree) and tries some random features at
each node. A task counts the drawn rows of each (node, feature tried, bin, class) and sends one array a tree; the best split of each node is chosen on executors, and the driver
gets a few numbers a node. Counts are whole numbers, so a fit doesn't depend on the order in which they are summed.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..store import staged
from . import packed
from .boosting import binned, edges_of

BINS = 32
#: Bytes of bins in a part of a pool at most.
PART_BYTES = 64 << 20
#: The number of times a row is drawn, by 16 random bits.
_DRAWN = np.searchsorted(np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(12)]), (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


@dataclass
class Tree:
    """Arrays over nodes: feature, last bin that goes left, left child (the right one follows), share of malicious weight. A leaf is its own left child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls) -> Tree:
        return cls(np.zeros(1, np.int16), np.full(1, 255, np.uint8), np.zeros(1, np.int32), np.full(1, 0.5))

    def route(self, flat: np.ndarray, first: np.ndarray, levels: int) -> np.ndarray:
        """The node after ``levels`` steps of each row, whose bins begin at ``first`` of ``flat``."""
        node, feature, left = np.zeros(len(first), np.int64), self.feature.astype(np.int64), self.left.astype(np.int64)
        for _ in range(levels):
            node = left.take(node) + (flat.take(first + feature.take(node)) > self.cut.take(node))
        return node


@dataclass
class Level:
    """The nodes of a tree that may be split and the features tried at each (a row a node)."""

    nodes: np.ndarray
    tried: np.ndarray

    def starts(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each feature tried, by turn and node: the number of its bins, and where they begin."""
        wide = sizes[self.tried.T].ravel()
        return wide, np.cumsum(wide) - wide


class Growing:
    """A tree as it grows; its features tried depend on its number alone."""

    def __init__(self, seed: int, number: int, features: int):
        self.rng, self.features, self.tries = np.random.default_rng([seed, number]), features, int(np.ceil(np.sqrt(features)))
        self.tree, self.active = Tree.empty(), np.zeros(1, np.int64)

    def plan(self) -> Level | None:
        if not len(self.active):
            return None
        tried = self.rng.random((len(self.active), self.features)).argsort(axis=1)[:, : self.tries]
        return Level(self.active, tried)

    def split(self, level: Level, best: np.ndarray) -> None:
        """Take the best splits (rows of ``best_splits``)."""
        tree, weigh = self.tree, best[:, 2:].reshape(-1, 2, 2)
        held = weigh.sum((1, 2))
        tree.value[level.nodes] = np.where(held > 0, weigh[:, :, 1].sum(1) / np.maximum(held, 1e-12), 0.5)
        at = np.flatnonzero(best[:, 0] >= 0)
        nodes, n = level.nodes[at], len(tree.feature)
        children = n + 2 * np.arange(len(at))
        tree.feature[nodes], tree.cut[nodes], tree.left[nodes] = best[at, 0], best[at, 1], children
        new = n + np.arange(2 * len(at))
        share = (weigh[at, :, 1] / np.maximum(weigh[at].sum(2), 1e-12)).ravel()
        grow = lambda old, more: np.concatenate((old, more)).astype(old.dtype)
        self.tree = Tree(grow(tree.feature, np.zeros(len(new))), grow(tree.cut, np.full(len(new), 255)), grow(tree.left, new), grow(tree.value, share))
        self.active = new[(share > 0) & (share < 1)]


def keys_of(blocks: list[np.ndarray]) -> np.ndarray:
    """A number for each row, from its block's content and its place there: the same wherever and however often the block is read."""
    return np.concatenate([np.arange(len(b), dtype=np.uint32) * np.uint32(0x9E3779B1) + np.uint32(zlib.crc32(b)) for b in blocks])


def drawn(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row."""
    h = keys ^ np.uint32(zlib.crc32(f"{seed} {tree}".encode()))
    for factor in (0x85EBCA6B, 0xC2B2AE35):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(factor)
    return _DRAWN.take(h >> np.uint32(16))


def counts(tree: Tree, level: Level, depth: int, sizes: np.ndarray, flat: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Drawn rows of each (turn, node, bin, class)."""
    rows = np.flatnonzero(times)
    first = rows * len(sizes)
    place = np.full(len(tree.feature), -1)
    place[level.nodes] = np.arange(len(level.nodes))
    at = place.take(tree.route(flat, first, depth))
    here = np.flatnonzero(at >= 0)
    at, first, rows = at[here], first[here], rows[here]
    weight, side = times.take(rows).astype(float), y.take(rows).astype(np.int64)
    wide, starts = level.starts(sizes)
    out, nodes = np.zeros(2 * int(wide.sum()), np.int32), len(level.nodes)
    for k in range(level.tried.shape[1]):
        own, begin = level.tried[:, k].astype(np.int64), starts[k * nodes : (k + 1) * nodes]
        end = int(begin[-1] + wide[(k + 1) * nodes - 1])
        code = 2 * ((begin - begin[0]).take(at) + flat.take(first + own.take(at))) + side
        out[2 * begin[0] : 2 * end] = np.bincount(code, weight, 2 * (end - int(begin[0])))
    return out


def best_splits(level: Level, sizes: np.ndarray, whole: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """feature (-1 without a gain), bin, and the weights of both classes left and right, of the best split of each node: the first of equal ones."""
    wide, starts = level.starts(sizes)
    sums, nodes = whole.reshape(-1, 2) * np.array(weights), len(level.nodes)
    owner = np.repeat(np.arange(len(wide)), wide)
    upto = np.cumsum(sums, axis=0)
    left = upto - np.where(starts > 0, upto[starts - 1].T, 0.0).T[owner]
    all_ = left[starts + wide - 1]
    right = all_[owner] - left
    square = lambda s: np.square(s).sum(1) / np.maximum(s.sum(1), 1e-12)
    held = np.maximum(all_.sum(1), 1e-12)
    gain = np.round((square(left) + square(right) - square(all_)[owner]) / held[owner], 10)
    n = np.cumsum(whole.reshape(-1, 2).sum(1))  # whole rows tell whether a side is empty
    n = n - np.where(starts > 0, n[starts - 1], 0)[owner]
    gain[(n <= 0) | (n >= n[starts + wide - 1][owner])] = -1.0
    most = np.maximum.reduceat(gain, starts).reshape(-1, nodes)
    turn = most.argmax(0)
    pick = turn * nodes + np.arange(nodes)
    hits = np.flatnonzero(gain == most.ravel()[owner])[::-1]
    place = np.zeros(len(wide), np.int64)
    place[owner[hits]] = hits  # the first hit is written last
    at = place[pick]
    feature = np.where(most[turn, np.arange(nodes)] > 0, level.tried[np.arange(nodes), turn], -1)
    return np.column_stack((feature, at - starts[pick], left[at], right[at]))


@dataclass
class Forest:
    names: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    depth: int

    def scores(self, rows: DataFrame) -> DataFrame:
        """event_id, label, score of rows with features: the mean share of malicious weight in their leaves."""
        held, names, depth = rows.sparkSession.sparkContext.broadcast((self.edges, self.trees)), self.names, self.depth

        def run(batches):
            edges, trees = held.value
            for b in batches:
                x = binned(np.column_stack([b.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(names))]).astype(float), edges)
                flat, first = x.ravel(), np.arange(len(x)) * len(names)
                total = np.zeros(len(x))
                for t in trees:
                    total += t.value.take(t.route(flat, first, depth))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total / len(trees))], names=["event_id", "label", "score"])

        return packed.spread(rows.select("event_id", F.col("ground_truth_label").alias("label"), *names)).mapInArrow(run, f"event_id {dict(rows.dtypes)['event_id']}, label string, score double")


def fit(train: DataFrame, names: list[str], balanced: bool = True, trees: int = 200, depth: int = 12, seed: int = 42, parts: int | None = None) -> Forest:
    """Raises unless the known rows of ``train`` are of both classes."""
    s = packed.summary(train, names)
    edges, weights = edges_of(train, names, BINS), s.weights(balanced)
    sizes = np.array([len(e) + 1 for e in edges])
    cores = train.sparkSession.sparkContext.defaultParallelism
    parts = parts or max(cores, -(-(s.good + s.bad) * len(names) // PART_BYTES))
    pool = packed.pack(train, names, lambda x: binned(x, edges), weights, parts)
    pool.rows = staged(pool.rows, "pool")  # a block that is read again is the same block
    growing = [Growing(seed, t, len(names)) for t in range(trees)]
    with pool:
        for level in range(depth):
            plan = {t: (g.tree, p) for t, g in enumerate(growing) if (p := g.plan()) is not None}
            if not plan:
                break

            def count(batches, level=level, plan=plan):
                blocks = [(x, y) for x, y, _ in packed.arrays(batches, len(sizes), np.uint8)]
                if blocks:
                    keys, flat, y = keys_of([x for x, _ in blocks]), np.concatenate([x.ravel() for x, _ in blocks]), np.concatenate([y for _, y in blocks])
                    for t, (tree, wanted) in plan.items():
                        found = counts(tree, wanted, level, sizes, flat, y, drawn(keys, seed, t))
                        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([found.tobytes()])], names=["t", "x"])

            def choose(key, pdf):  # it runs before the next level is planned
                t = int(key[0])
                whole = sum((np.frombuffer(x, np.int32) for x in pdf["x"]), np.int64(0))
                return pd.DataFrame({"t": [t], "x": [best_splits(plan[t][1], sizes, whole, weights).tobytes()]})

            for t, x in pool.rows.mapInArrow(count, "t int, x binary").groupBy("t").applyInPandas(choose, "t int, x binary").collect():  # a row a tree
                growing[t].split(plan[t][1], np.frombuffer(x).reshape(-1, 6))
    return Forest(names, edges, [g.tree for g in growing], depth)
