"""Detectors that are fitted on known rows of a training pool and score every row.

Tables hold event_id, ground_truth_label and feature columns. Linear models (``linear``), boosting (``boosting``) and the random forest (``forest``) pass
over packed pools, MLlib fits the tree; extra trees and the isolation forest are built by Spark jobs whose partial sums or samples are of bounded size.
"""

from __future__ import annotations

import time
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..ordering import running_sums
from ..store import staged
from ..together import all_together
from . import boosting, contracts, forest, linear, packed

SEED = 42
#: Numbers of a part of a training pool; a fit passes over the pool many times.
PART_VALUES = 4_000_000
BAD = "malicious"


def target() -> Column:
    return (F.col("ground_truth_label") == BAD).cast("double")


def known(rows: DataFrame) -> DataFrame:
    return rows.where("ground_truth_label <> 'unknown'")


def balanced_weights(rows: DataFrame) -> DataFrame:
    """n / (2 n_class) for each label."""
    n = known(rows).groupBy("ground_truth_label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    return n.crossJoin(F.broadcast(total)).select("ground_truth_label", (F.col("all") / (2 * F.col("n"))).alias("weight"))  # two rows


def standardise(rows: DataFrame, names: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Mean 0 and population deviation 1 of the fitting rows; constant columns become 0."""
    s = (rows if fitted_on is None else fitted_on).agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return rows.withColumns({c: (F.col(c) - (s[f"m{i}"] or 0.0)) / (s[f"s{i}"] or 1.0) for i, c in enumerate(names)})


def normalise_range(scores: DataFrame, training: DataFrame, column: str = "score") -> DataFrame:
    """Scores by the range of the training scores, clamped to [0, 1]; 0 where that range is empty."""
    r = training.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if r["a"] is None or r["a"] == r["b"]:
        return scores.withColumn(column, F.lit(0.0))
    return scores.withColumn(column, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - r["a"]) / (r["b"] - r["a"]))))


def make(model: str):
    if model == "decision_tree":
        return DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=20, seed=SEED, featuresCol="x", labelCol="y", weightCol="w")
    raise ValueError(f"no model {model}")


def labelled_scores(records: DataFrame, scores: DataFrame) -> DataFrame:
    """``records`` with their score; fails if one has none."""
    score = F.col("score")
    joined = records.join(scores.select("event_id", "score"), "event_id", "left")
    return joined.where(F.assert_true(score.isNotNull(), F.concat(F.lit("no score for "), F.col("event_id").cast("string"))).isNull())


def _assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="x").transform(rows)


def fit_and_score(train: DataFrame, rows: DataFrame, names: list[str], model: str, balanced: bool | None = None, **options) -> tuple[DataFrame, float]:
    """event_id, label, score of ``rows`` by a model fitted on the known rows of ``train``; and the seconds that fitting took.

    Classes are balanced unless said otherwise, but for boosting, which weighs rows alike. Options: ``c`` of the linear models, those of
    ``boosting.Options`` and ``early``, ``trees`` and ``depth``.
    """
    balanced = model != "gradient_boosting" if balanced is None else balanced
    shown = ["event_id", F.col("ground_truth_label").alias("label")]
    began = time.perf_counter()
    if model == "gradient_boosting":
        fitted = boosting.fit(train, names, balanced, options.pop("early", None), boosting.Options(**options))
        return fitted.scores(rows), time.perf_counter() - began
    if model == "random_forest":
        fitted = forest.fit(train, names, balanced, seed=SEED, **options)
        return fitted.scores(rows), time.perf_counter() - began
    if model == "logistic_regression":
        fitted = linear.fit(train, names, linear.LOGISTIC, balanced=balanced, **options)
        return rows.select(*shown, fitted.probability().alias("score")), time.perf_counter() - began
    if model == "linear_svm":
        fitted = linear.fit(train, names, linear.SQUARED_HINGE, balanced=balanced, **options)
        seconds = time.perf_counter() - began
        return margin_scores(fitted, train, rows)[0], seconds
    pool = contracts.guard_training(known(train))
    weights = balanced_weights(pool) if balanced else pool.select("ground_truth_label", F.lit(1.0).alias("weight")).distinct()
    pool = _assembled(pool.join(F.broadcast(weights), "ground_truth_label"), names).select("x", target().alias("y"), F.col("weight").alias("w"))
    # a fit passes over the pool many times: parts for all cores, and of a bounded size
    cores = rows.sparkSession.sparkContext.defaultParallelism
    pool = pool.repartition(max(cores, -(-pool.count() * len(names) // PART_VALUES))).cache()
    pool.count()
    began = time.perf_counter()
    fitted = make(model, **options).fit(pool)
    seconds = time.perf_counter() - began
    pool.unpersist()
    return fitted.transform(_assembled(rows, names)).select(*shown, vector_to_array("probability")[1].alias("score")), seconds


def margin_scores(fitted: linear.Linear, train: DataFrame, rows: DataFrame) -> tuple[DataFrame, float]:
    """event_id, label, score of ``rows``: margins by the range of the training margins; and the score of margin 0, at which the model decides.

    That range grows with the pool's outliers, so that margin 0 may be far from 0.5.
    """
    margin = fitted.margin().alias("score")
    low, high = known(train).select(margin).agg(F.min("score"), F.max("score")).first()
    scored = rows.select("event_id", F.col("ground_truth_label").alias("label"), margin)
    if low is None or low == high:
        return scored.withColumn("score", F.lit(0.0)), 0.0
    score = lambda z: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (z - low) / (high - low)))
    return scored.withColumn("score", score(F.col("score"))), min(1.0, max(0.0, -low / (high - low)))


def with_folds(pool: DataFrame, folds: int, name: str = "fold") -> DataFrame:
    """``pool`` with a fold for each row: rows of each class are dealt in turn, in the order of a hash of their ids."""
    rows = pool.withColumns({"_one": F.lit(1), "_hash": F.xxhash64("event_id", F.lit(SEED))})
    placed = running_sums(rows, ["ground_truth_label"], {"_hash": False}, {"_place": "_one"})
    return placed.withColumn(name, F.pmod("_place", F.lit(folds)).cast("int")).drop("_one", "_hash", "_place")


def sigmoid(scores: DataFrame, passes: int = 100) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(a * score + b)) by Newton steps over the known rows, with the targets (n+ + 1) / (n+ + 2) and 1 / (n- + 2).

    Each step sums a few numbers in the JVM, the loss at several step lengths among them.
    """
    rows = scores.where("label <> 'unknown' AND score IS NOT NULL").select("score", (F.col("label") == BAD).alias("bad"))
    n = rows.agg(F.count_if("bad").alias("bad"), F.count("*").alias("all")).first()
    bad, good = n["bad"], n["all"] - n["bad"]
    contracts.guard_classes(good, bad)
    x, t = F.col("score"), F.when(F.col("bad"), F.lit((bad + 1) / (bad + 2))).otherwise(F.lit(1 / (good + 2)))
    rows = rows.select(x, t.alias("t")).cache()
    here, step, was = np.array([0.0, np.log((good + 1) / (bad + 1))]), np.zeros(2), np.inf
    shares = [1.0, 0.5, 0.25, 0.1, 0.01, 0.0]
    for _ in range(passes):
        def loss(a: float, b: float) -> Column:  # -(t log p + (1 - t) log(1 - p)), p = 1 / (1 + exp(z))
            z = x * float(a) + float(b)
            return F.sum(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - (1 - F.col("t")) * z)

        at = here + step
        z = x * float(at[0]) + float(at[1])
        p = F.when(z > 0, F.exp(-F.greatest(z, F.lit(0.0))) / (1 + F.exp(-F.greatest(z, F.lit(0.0))))).otherwise(1 / (1 + F.exp(F.least(z, F.lit(0.0)))))
        slope, curve = F.col("t") - p, p * (1 - p)
        r = rows.agg(F.sum(slope * x), F.sum(slope), F.sum(curve * x * x), F.sum(curve * x), F.sum(curve), *[loss(*(here + s * step)) for s in shares]).first()
        values = np.array(r[5:], float)
        taken = int(values.argmin())
        if taken and values[0] > min(values[-1], was):
            if shares[taken] == 0:
                break
            here, step, was = here + shares[taken] * step, np.zeros(2), values[taken]
            continue
        here, was = at, values[0]
        step = -np.linalg.solve(np.array([[r[2], r[3]], [r[3], r[4]]]) + 1e-12 * np.eye(2), np.array(r[:2], float))
        if np.abs(step).max() <= 1e-9 * max(1.0, np.abs(here).max()):
            break
    rows.unpersist()
    return float(here[0]), float(here[1])


def calibrated(train: DataFrame, rows: DataFrame, names: list[str], model: str = "random_forest", folds: int = 3, **options) -> DataFrame:
    """Sigmoid calibration: each fold's model is calibrated on the rows it was not fitted on; probabilities are averaged. Folds are fitted side by side."""
    pool = staged(with_folds(known(train).select("event_id", "ground_truth_label", *names), folds), "folds")
    rows = rows.select("event_id", "ground_truth_label", *names)

    def one(k: int) -> DataFrame:
        rest, held = pool.where(F.col("fold") != k).drop("fold"), pool.where(F.col("fold") == k).drop("fold")
        both = held.withColumn("held", F.lit(True)).unionByName(rows.withColumn("held", F.lit(False))).withColumn("event_id", F.struct("event_id", "held"))
        scored = staged(fit_and_score(rest, both, names, model, **options)[0].select("event_id.*", "label", "score"), "fold-scores")
        a, b = sigmoid(scored.where("held"))
        return scored.where("NOT held").select("event_id", "label", (1 / (1 + F.exp(F.col("score") * a + b))).alias("score"))

    parts = None
    for part in all_together(rows.sparkSession, [lambda k=k: one(k) for k in range(folds)]):
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("event_id", "label").agg(F.avg("score").alias("score"))


# -- extra trees: random thresholds, no bootstrap --


@dataclass
class Tree:
    """Arrays over nodes; a leaf has feature -1; the right child follows the left one."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; ``x`` lies row by row."""
        leaf = self.feature < 0
        feature, cut, left = np.where(leaf, 0, self.feature), np.where(leaf, np.inf, self.threshold), np.where(leaf, np.arange(len(leaf)), self.left)
        flat, first, node = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), np.int64)
        for _ in range(self.levels()):
            node = left.take(node) + (flat.take(first + feature.take(node)) > cut.take(node))
        return node

    def levels(self) -> int:
        """Steps to the deepest leaf."""
        nodes, n = np.zeros(1, np.int64), 0
        while len(inner := nodes[self.feature[nodes] >= 0]):
            nodes, n = np.concatenate((self.left[inner], self.left[inner] + 1)), n + 1
        return n


@dataclass
class Growth:
    """The nodes of a tree that may be split, and their random candidate splits: a row a node, a column a candidate."""

    nodes: np.ndarray
    feature: np.ndarray
    cut: np.ndarray

    def sums(self, tree: Tree, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weight of each (node, candidate, side, class)."""
        place = np.full(len(tree.feature), -1)
        place[self.nodes] = np.arange(len(self.nodes))
        at = place.take(tree.route(x))
        rows = np.flatnonzero(at >= 0)
        at, y, w, flat, first, n = at[rows], y[rows], w[rows], x.ravel(), rows * x.shape[1], len(self.nodes)
        out = np.zeros((n, self.feature.shape[1], 2, 2))
        for c in range(self.feature.shape[1]):
            right = flat.take(first + self.feature[:, c].take(at)) > self.cut[:, c].take(at)
            out[:, c] = np.bincount((at * 2 + right) * 2 + y, weights=w, minlength=4 * n).reshape(n, 2, 2)
        return out

    def best(self, sums: np.ndarray) -> np.ndarray:
        """candidate, l0, l1, r0, r1 of the best split of each node, and -1 for a node without a gain."""
        side, whole = sums.sum(-1), sums[:, 0].sum(1)
        all_ = np.maximum(whole.sum(1), 1e-12)
        # of a node's weight, and rounded, so that equal splits are equal in whatever order their rows are summed: the first counts
        purity = np.round((np.square(sums) / np.maximum(side, 1e-12)[..., None]).sum((-1, -2)) / all_[:, None], 10)
        purity[(side <= 0).any(-1)] = -1.0
        pick = purity.argmax(1)
        rows = np.arange(len(pick))
        gains = purity[rows, pick] > np.square(whole / all_[:, None]).sum(1) + 1e-9
        return np.column_stack((np.where(gains, pick, -1), sums[rows, pick].reshape(-1, 4)))


class Growing:
    """A tree as it grows level by level; its random candidates depend on its number alone, wherever it grows."""

    def __init__(self, seed: int, number: int, low: np.ndarray, high: np.ndarray):
        self.rng, self.tries = np.random.default_rng([seed, number]), max(1, int(np.sqrt(len(low))))
        self.tree = Tree(np.array([-1]), np.zeros(1), np.zeros(1, np.int64), np.full(1, 0.5))
        self.boxes = low[None], high[None]  # of the nodes that may be split: what the splits above leave of each feature's range
        self.active, self.growth = np.zeros(1, np.int64), None

    def plan(self) -> Growth | None:
        """The next level's candidates; none when no node may be split."""
        self.growth = None
        if len(self.active):
            f = self.rng.integers(self.boxes[0].shape[1], size=(len(self.active), self.tries))
            a, b = (np.take_along_axis(x, f, 1) for x in self.boxes)
            self.growth = Growth(self.active, f, a + self.rng.random(f.shape) * (b - a))
        return self.growth

    def split(self, best: np.ndarray) -> None:
        """Take the best splits (rows of ``Growth.best``)."""
        tree, growth = self.tree, self.growth
        weigh = best[:, 1:].reshape(-1, 2, 2)
        held = weigh.sum((1, 2))
        tree.value[growth.nodes] = np.where(held > 0, weigh[:, :, 1].sum(1) / np.maximum(held, 1e-12), 0.5)
        at = np.flatnonzero(best[:, 0] >= 0)
        if not len(at):
            self.active = np.empty(0, np.int64)
            return
        nodes, pick, n = growth.nodes[at], best[at, 0].astype(int), len(tree.feature)
        children = n + 2 * np.arange(len(at))
        tree.feature[nodes], tree.threshold[nodes], tree.left[nodes] = growth.feature[at, pick], growth.cut[at, pick], children
        share = weigh[at, :, 1] / np.maximum(weigh[at].sum(2), 1e-12)
        grow = lambda old, new: np.concatenate((old, new)).astype(old.dtype)
        self.tree = Tree(grow(tree.feature, np.full(2 * len(at), -1)), grow(tree.threshold, np.zeros(2 * len(at))), grow(tree.left, np.zeros(2 * len(at))), grow(tree.value, share.ravel()))
        self.active = n + np.arange(2 * len(at))
        lows, highs = (np.repeat(x[at], 2, axis=0) for x in self.boxes)
        row, f, cut = np.arange(len(at)) * 2, tree.feature[nodes], tree.threshold[nodes]
        highs[row, f], lows[row + 1, f] = cut, cut
        self.boxes = lows, highs


def _forest_of_a_small_pool(pool: DataFrame, names: list[str], growing: list[Growing], depth: int) -> list[Tree]:
    """Each tree grows in a task of its own, on a pool of ``boosting.ONE_PART`` values at most, which is broadcast."""
    spark = pool.sparkSession
    rows = pool.toPandas()
    held = spark.sparkContext.broadcast((np.ascontiguousarray(rows[names].to_numpy(float)), rows["_y"].to_numpy(int), rows["_w"].to_numpy(float), growing))

    def run(batches):
        x, y, w, growing = held.value
        for pdf in batches:
            for t in pdf["id"].tolist():
                own = deepcopy(growing[t])  # a task may run again
                for _ in range(depth):
                    if (growth := own.plan()) is None:
                        break
                    own.split(growth.best(growth.sums(own.tree, x, y, w)))
                yield pd.DataFrame({"id": [t], "f": [own.tree.feature.astype(float)], "c": [own.tree.threshold], "l": [own.tree.left.astype(float)], "v": [own.tree.value]})

    tasks = min(len(growing), 4 * spark.sparkContext.defaultParallelism)
    made = spark.range(0, len(growing), 1, tasks).mapInPandas(run, "id long, f array<double>, c array<double>, l array<double>, v array<double>").collect()  # a row a tree
    return [Tree(np.array(r.f, np.int64), np.array(r.c), np.array(r.l, np.int64), np.array(r.v)) for r in sorted(made, key=lambda r: r.id)]


def _forest_by_levels(pool: packed.Pool, names: list[str], growing: list[Growing], depth: int) -> list[Tree]:
    """Class weights of all (tree, node, candidate split) are summed on executors, which choose the best split of each node.

    A task sends one array of sums a tree and level; the driver gets five numbers a node.
    """
    for _ in range(depth):
        plan = {t: growth for t, g in enumerate(growing) if (growth := g.plan()) is not None}
        forest = [g.tree for g in growing]
        if not plan:
            break

        def sums(batches, forest=forest, plan=plan):
            total = {}
            for x, y, w in packed.arrays(batches, len(names)):
                y = y.astype(np.int64)
                for t, growth in plan.items():
                    part = growth.sums(forest[t], x, y, w)
                    total[t] = total[t] + part if t in total else part
            for t, x in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([x.tobytes()])], names=["t", "x"])

        def choose(key, pdf):  # it runs before the next level is planned
            t = int(key[0])
            whole = sum(np.frombuffer(x) for x in pdf["x"]).reshape(-1, plan[t].feature.shape[1], 2, 2)
            return pd.DataFrame({"t": [t], "x": [plan[t].best(whole).tobytes()]})

        for t, x in pool.rows.mapInArrow(sums, "t int, x binary").groupBy("t").applyInPandas(choose, "t int, x binary").collect():
            growing[t].split(np.frombuffer(x).reshape(-1, 5))
    return [g.tree for g in growing]


def extra_trees(train: DataFrame, rows: DataFrame, names: list[str], trees: int = 200, depth: int = 12, seed: int = SEED, one_part: int = boosting.ONE_PART) -> DataFrame:
    """Trees with random thresholds, without bootstrap. Pools of up to ``one_part`` values grow their trees side by side, larger ones level by level; the trees are the same."""
    s = packed.summary(train, names)
    weights = s.weights(True)
    growing = [Growing(seed, t, s.low, s.high) for t in range(trees)]
    if (s.good + s.bad) * len(names) <= one_part:
        weight = F.when(F.col("ground_truth_label") == BAD, weights[1]).otherwise(weights[0])
        forest = _forest_of_a_small_pool(known(train).select(*names, target().alias("_y"), weight.alias("_w")), names, growing, depth)
    else:
        with packed.pack(train, names, lambda x: x, weights, packed.parts_of(train, s)) as pool:
            forest = _forest_by_levels(pool, names, growing, depth)
    held = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for pdf in batches:
            x = np.ascontiguousarray(pdf[names].to_numpy(float))
            yield pd.DataFrame({"event_id": pdf["event_id"], "label": pdf["ground_truth_label"], "score": np.mean([t.value[t.route(x)] for t in held.value], axis=0)})

    return packed.spread(rows.select("event_id", "ground_truth_label", *names)).mapInPandas(run, f"event_id {dict(rows.dtypes)['event_id']}, label string, score double")


# -- isolation forest: each tree from a bounded random sample --


def _path(n: float) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_forest(train: DataFrame, rows: DataFrame, names: list[str], trees: int = 100, sample: int = 256, seed: int = SEED) -> DataFrame:
    """Scores 2^(-E(h)/c(n)) by trees that are grown from ``sample`` known rows each, then by the training range.

    The trees' rows are drawn from ``trees`` x ``sample`` known rows, the first by a hash of the id.
    """
    pool = known(train)
    drawing = pool.orderBy(F.xxhash64("event_id", F.lit(seed)), "event_id").limit(trees * sample).cache()
    n = max(drawing.count(), 1)
    chance = min(1.0, (sample * 1.3 + 50) / n)
    key = F.xxhash64("event_id", "tree", F.lit(seed))
    drawn = drawing.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("key", key).where(F.pmod("key", F.lit(1 << 30)) < int(chance * (1 << 30)))

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("key").head(sample)[names].to_numpy(float)
        rng = np.random.default_rng([seed, int(key[0])])
        nodes: list[list[float]] = []

        def build(part: np.ndarray, level: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, 0, level + _path(len(part))])
            spread = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 else []
            if level < np.ceil(np.log2(max(sample, 2))) and len(spread):
                f = rng.choice(spread)
                cut = rng.uniform(part[:, f].min(), part[:, f].max())
                left = build(part[part[:, f] <= cut], level + 1)
                right = build(part[part[:, f] > cut], level + 1)
                nodes[me] = [int(f), cut, left, right]
            return me

        build(x, 0)
        return pd.DataFrame(nodes, columns=["f", "cut", "left", "value"]).assign(tree=int(key[0]), node=range(len(nodes)), size=len(x))

    grown = drawn.groupBy("tree").applyInPandas(grow, "f int, cut double, left int, value double, tree int, node int, size int").toPandas()
    drawing.unpersist()
    forest = [g.sort_values("node") for _, g in grown.groupby("tree")]
    held = rows.sparkSession.sparkContext.broadcast([(g["f"].to_numpy(), g["cut"].to_numpy(), g["left"].to_numpy(), g["value"].to_numpy(), int(g["size"].iloc[0])) for g in forest])

    def run(batches):
        for pdf in batches:
            x, total, norm = pdf[names].to_numpy(float), np.zeros(len(pdf)), []
            for f, cut, left, value, size in held.value:
                node = np.zeros(len(x), np.int64)
                while (inner := f[node] >= 0).any():
                    right = x[np.arange(len(x)), np.maximum(f[node], 0)] > cut[node]
                    node = np.where(inner, np.where(right, value[node].astype(np.int64), left[node]), node)
                total += value[node]
                norm.append(_path(size))
            score = 2 ** (-(total / max(len(held.value), 1)) / max(np.mean(norm), 1e-9))
            yield pd.DataFrame({"event_id": pdf["event_id"], "label": pdf["ground_truth_label"], "score": score})

    schema = f"event_id {dict(rows.dtypes)['event_id']}, label string, score double"
    raw = lambda t: packed.spread(t.select("event_id", "ground_truth_label", *names)).mapInPandas(run, schema)
    return normalise_range(raw(rows), raw(pool))
