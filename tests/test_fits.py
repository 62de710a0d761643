"""Fits against dense and naive twins; running sums and adaptive buckets against plain ones."""

import math
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.operators import boosting, evaluate as E, linear, models, packed, windows
from flowscope.ordering import running_sums
from flowscope.plans.flows import flows_from_events

NAMES = ["a", "b", "c"]


def table(n, seed=1, known=True):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(5, 3, n), rng.integers(0, 4, n).astype(float), rng.exponential(2, n)])
    y = (x[:, 0] + 2 * (x[:, 1] == 2) * x[:, 2] + rng.normal(0, 2, n)) > 7
    label = np.where(y, "malicious", "benign")
    if not known:
        label = np.where(rng.random(n) < 0.1, "unknown", label)
    return x, y, label


def frame(spark, x, label):
    return spark.createDataFrame([(i, "s", str(t), *map(float, r)) for i, (t, r) in enumerate(zip(label, x))], "event_id long, scenario_id string, ground_truth_label string, a double, b double, c double")


def dense(x, y, loss, weights, c=1.0):
    """The minimum over standardised features and a constant one, by plain Newton steps on the whole matrix."""
    mean, scale = x.mean(0), x.std(0)
    z = np.column_stack([(x - mean) / np.where(scale > 0, scale, 1), np.ones(len(x))])
    s, w = np.where(y, 1.0, -1.0), np.zeros(x.shape[1] + 1)

    def value(w):
        return w @ w / 2 + c * (weights * linear.losses(loss, z @ w * s)[0]).sum()

    for _ in range(200):
        _, slope, curve = linear.losses(loss, z @ w * s)
        step = -np.linalg.solve(np.eye(len(w)) + c * (z.T * (weights * curve)) @ z, w + c * z.T @ (weights * slope * s))
        t = 1.0
        while value(w + t * step) > value(w) and t > 1e-10:
            t /= 2
        w = w + t * step
    return w[:-1] / np.where(scale > 0, scale, 1), w[-1] - (w[:-1] / np.where(scale > 0, scale, 1)) @ mean


@pytest.mark.parametrize("loss", [linear.SQUARED_HINGE, linear.LOGISTIC])
@pytest.mark.parametrize("balanced", [True, False])
def test_linear_fits_equal_dense_ones(spark, loss, balanced, monkeypatch):
    if balanced:
        monkeypatch.setattr(packed, "PARTS", 2)  # sums of parts are added on executors first
    x, y, label = table(700)
    x[:, 2] = np.where(np.arange(700) % 7 == 0, 3.0, x[:, 2])
    made = linear.fit(frame(spark, x, label), NAMES, loss, balanced=balanced)
    weights = np.where(y, 700 / (2 * y.sum()), 700 / (2 * (~y).sum())) if balanced else np.ones(700)
    want, constant = dense(x, y, loss, weights)
    assert np.abs(made.weights - want).max() < 1e-6 and abs(made.constant - constant) < 1e-6 and made.passes < 25


def test_linear_fits_of_constant_features_and_far_apart_classes(spark):
    x, y, _ = table(300)
    x[:, 1], x[:, 0] = 4.0, np.where(y, 1e6, -1e6)
    df = frame(spark, x, np.where(y, "malicious", "benign"))
    for loss in (linear.SQUARED_HINGE, linear.LOGISTIC):
        made = linear.fit(df, NAMES, loss)
        assert made.weights[1] == 0 and np.isfinite(made.weights).all()
    with pytest.raises(ValueError, match="both classes"):
        linear.fit(df.where("ground_truth_label = 'benign'"), NAMES)


def test_scores_of_the_linear_models(spark):
    x, y, label = table(500, known=False)
    df = frame(spark, x, label)
    svm = models.fit_and_score(df, df, NAMES, "linear_svm")[0].withColumn("detector", F.lit("svm"))
    logistic = models.fit_and_score(df, df, NAMES, "logistic_regression")[0].withColumn("detector", F.lit("logistic"))
    both = svm.unionByName(logistic)
    auc = {r.detector: r.pr_auc for r in E.average_precision(both).collect()}
    share = y[label != "unknown"].mean()
    assert all(auc[d] > 1.4 * share for d in ("svm", "logistic")), (auc, share)
    assert both.where("score NOT BETWEEN 0 AND 1").isEmpty() and both.count() == 1000


def naive_tree(x, g, h, leaves, l2, least):
    """Best-first growth with sums made anew for every split; gives (feature, bin, left rows, right rows) in the order of the splits."""
    def best(rows):
        found, all_ = None, g[rows].sum() ** 2 / (h[rows].sum() + l2)
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(a), len(b)) < least:
                    continue
                gain = g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2) - all_
                if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, f, int(cut), a, b)
        return found

    queue, count, out = [(best(np.arange(len(x))), np.arange(len(x)))], 1, {}
    while count < leaves and any(b for b, _ in queue):
        at = max((i for i, (b, _) in enumerate(queue) if b), key=lambda i: queue[i][0][0])
        (_, f, cut, a, b), rows = queue.pop(at)
        queue += [(best(a), a), (best(b), b)]
        count += 1
    for _, rows in queue:
        out[tuple(rows.tolist())] = -0.1 * g[rows].sum() / (h[rows].sum() + l2)
    return out


def test_boosted_trees_equal_naive_ones():
    x, y, _ = table(500, seed=3)
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0.05, 0.95, 19))) for i in range(3)]
    bins, sizes = boosting.binned(x, edges), np.array([len(e) + 1 for e in edges])
    part, passes = boosting.Part(bins, y.astype(np.uint8), np.ones(500), sizes, 0.0), []

    def ask(trees, tree, wanted):
        passes.append(len(wanted))
        part.advance(trees)
        return part.loss(), part.histograms(tree, wanted)

    grower, raw = boosting.Grower(sizes, boosting.Options(leaves=12, least_rows=10), ask), np.zeros(500)
    for _ in range(4):
        p = 1 / (1 + np.exp(-raw))
        passes.clear()
        tree, _ = grower.grow()
        grower.trees.append(tree)
        node = tree.route(bins)
        got = {tuple(np.flatnonzero(node == k).tolist()): tree.value[k] for k in np.unique(node)}
        want = naive_tree(bins, p - y, p * (1 - p), 12, 1.0, 10)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
        assert len(got) == 12 and len(passes) < 11  # fewer than one a split
        raw += np.array(tree.value)[node]


def test_boosting_in_parts_equals_one_part(spark):
    x, y, label = table(2000, seed=5)
    df = frame(spark, x, label)
    options = boosting.Options(iterations=4)
    one, three = (boosting.fit(df, NAMES, options=options, parts=k) for k in (1, 3))
    assert len(one.trees) == 4 and max(len(t.feature) for t in one.trees) == 61
    assert [(t.feature, t.bin, t.left) for t in one.trees] == [(t.feature, t.bin, t.left) for t in three.trees]
    assert all(a == pytest.approx(b, abs=1e-12) for s, t in zip(one.trees, three.trees) for a, b in zip(s.value, t.value))
    scores = one.scores(df).withColumn("detector", F.lit("b")).cache()
    tree = models.fit_and_score(df, df, NAMES, "decision_tree")[0].withColumn("detector", F.lit("t"))
    auc = {r.detector: r.pr_auc for r in E.average_precision(scores.unionByName(tree)).collect()}
    assert auc["b"] > auc["t"] and scores.where("score NOT BETWEEN 0 AND 1").isEmpty()


def test_boosting_workers_keep_margins(spark):
    """A worker that has seen a part adds only the trees that are new; it formerly added all of them in every pass."""
    x, y, label = table(2000, seed=5)
    boosting.fit(frame(spark, x, label), NAMES, early=False, options=boosting.Options(iterations=4), parts=2)
    kept = spark.sparkContext.parallelize(range(16), 16).mapPartitions(lambda _: [max((k[0] for k in boosting._KEPT.values()), default=-1)]).collect()
    assert max(kept) == 3 and not boosting._KEPT


def test_boosting_codes_hold_all_bins():
    rng = np.random.default_rng(8)
    sizes = np.array([3, 255, 1, 7, 3, 256, 2, 3, 3, 3, 3])
    x = np.column_stack([rng.integers(0, n, 70_000) for n in sizes]).astype(np.uint8)
    x[:256, 5] = np.arange(256)
    y, w = (rng.random(70_000) < 0.4).astype(np.uint8), rng.random(70_000)
    part = boosting.Part(x, y + 2 * (rng.random(70_000) < 0.1), w, sizes, 0.3)
    part.advance([])
    tree = boosting.Tree([1, -1, 8, -1, -1], [90, 0, 1, 0, 0], [1, 0, 3, 0, 0], [0.0, 0.5, 0.0, -0.2, 0.1])
    at = tree.route(x)
    found = part.histograms(tree, [(1, -1, 0, False), (3, 5, 17, True)])
    for got, rows in zip(found, ((at == 1) & part.own, (at == 3) & part.own & (x[:, 5] > 17))):
        for values, sums in zip((part.slope, part.curve, np.ones(70_000)), got):
            want = np.concatenate([np.bincount(x[rows, f], values[rows], n) for f, n in enumerate(sizes)])
            assert sums == pytest.approx(want, abs=1e-8)
    part.advance([tree])
    assert part.raw == pytest.approx(0.3 + np.array(tree.value)[at], abs=1e-12)
    assert len(part.x) < len(sizes)
    sent = pickle.dumps(boosting.Part(x, y, w, sizes, 0.3))
    assert len(sent) < 20 * 70_000 + 100_000  # codes, labels and weights alone travel
    new = pickle.loads(sent)
    new.begin()
    new.advance([pickle.dumps(tree)])
    assert (new.raw == part.raw).all()


def test_boosting_stops_early(spark):
    rng = np.random.default_rng(2)
    x, label = rng.random((1500, 3)), np.where(rng.random(1500) < 0.5, "malicious", "benign")
    made = boosting.fit(frame(spark, x, label), NAMES, early=True, parts=2)
    assert boosting.EARLY_TRIES <= len(made.trees) < 60
    with pytest.raises(ValueError, match="both classes"):
        boosting.fit(frame(spark, x, np.full(1500, "benign")), NAMES)


def test_average_precision_of_all_distinct_scores(spark):
    rng = random.Random(4)
    rows = [(i, "s", "d" if i % 10 else "e", rng.choice(["malicious", "benign", "unknown"]), rng.random()) for i in range(20_000)] + [(-1, "s", None, "benign", 0.5), (-2, "s", "one", "malicious", 0.5)]
    df = spark.createDataFrame(rows, "event_id long, scenario_id string, detector string, label string, score double")
    got = {r.detector: r.pr_auc for r in E.average_precision(df).collect()}
    for d in ("d", "e"):
        mine = sorted((r for r in rows if r[2] == d and r[3] != "unknown"), key=lambda r: -r[4])
        hits, area = 0, 0.0
        for k, r in enumerate(mine, 1):
            if r[3] == "malicious":
                hits += 1
                area += hits / k
        assert got[d] == pytest.approx(area / hits)
    assert got[None] is None and got["one"] is None


def test_running_sums_of_one_large_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([("g" if i % 50 else None, i * 37 % 10_007, i % 5) for i in range(10_000)], "g string, k long, part long")
        out = running_sums(df, ["g"], {"k": True}, {"upto": "part"})
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "SinglePartition" not in plan
    for g in ("g", None):
        total = 0
        for r in sorted((r for r in rows if r.g == g), key=lambda r: -r.k):
            total += r.part
            assert r.upto == total


def test_busy_hosts_are_cut_into_buckets(spark):
    """One host has most flows of an hour; no bucket holds more own flows than the bound and a slot's."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    start = F.expr("timestamp_ntz'2024-01-01 10:00:00'")
    flows = flows_from_events(events).drop("k")
    second = F.col("event_id") * 7919 % 3600
    busy = flows.where("event_id < 4000").withColumns({"observed_at": start + F.make_interval(secs=F.floor(second / 3)), "source_src_address": F.lit("busy"), "scenario_id": F.lit("cap-0")})
    rows = busy.unionByName(flows.where("event_id >= 4000")).cache()
    dealt = windows._dealt(windows._prepared(rows), 3_600_000_000, 300_000_000, 500)
    own = [r["count"] for r in dealt.where("_own").groupBy("scenario_id", "_host", "_bucket").count().collect()]
    slot = rows.where("source_src_address = 'busy'").groupBy("observed_at").count().agg(F.max("count")).first()[0]
    assert sum(own) == rows.where("scenario_id IS NOT NULL").count() and max(own) <= 500 + slot < 600
    plain, cut = windows.prior_features(rows, most=10**9), windows.prior_features(rows, most=500)
    assert plain.exceptAll(cut).isEmpty() and cut.exceptAll(plain).isEmpty()
    assert cut.agg(F.max("prior_source_connections_300s")).first()[0] > 500 and math.isfinite(cut.agg(F.sum("log_seconds_since_prior_source_flow")).first()[0])


def test_extra_trees_of_small_and_large_pools_are_the_same(spark):
    x, y, label = table(600, seed=7, known=False)
    df = frame(spark, x, label)
    small, large = ({r.event_id: r.score for r in models.extra_trees(df, df, NAMES, trees=6, depth=5, one_part=k).collect()} for k in (10**6, 0))
    assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k], abs=1e-12) for k in small)
    assert len(set(small.values())) > 50
    with pytest.raises(ValueError, match="both classes"):
        models.extra_trees(df.where("ground_truth_label <> 'benign'"), df, NAMES, trees=2)


def test_forest_splits_as_brute_force():
    """Counts of drawn rows and the best split of each node, against loops over all splits."""
    from flowscope.operators import forest

    rng = np.random.default_rng(3)
    sizes = np.array([5, 2, 9])
    x = np.column_stack([rng.integers(0, s, 400) for s in sizes]).astype(np.uint8)
    y = ((x[:, 2] > 4) ^ (rng.random(400) < 0.2)).astype(np.uint8)
    keys = forest.keys_of([x[:150], x[150:]])
    times = forest.drawn(keys, 42, 7)
    assert abs(times.mean() - 1) < 0.2 and (times != forest.drawn(keys, 42, 8)).any()
    assert (keys == np.concatenate([forest.keys_of([x[:150]]), forest.keys_of([x[150:]])])).all()
    grown, weights = forest.Growing(42, 7, 3), (0.7, 1.6)
    for depth in range(3):
        level = grown.plan()
        found = forest.counts(grown.tree, level, depth, sizes, x.ravel(), y, times)
        best = forest.best_splits(level, sizes, found.astype(np.int64), weights)
        at = grown.tree.route(x.ravel(), np.arange(400) * 3, depth)
        for node, tried, (feature, cut, *sides) in zip(level.nodes, level.tried, best):
            feature, cut = int(feature), int(cut)

            def gain(f, c):
                parts = [[weights[k] * times[(at == node) & (y == k) & ((x[:, f] > c) == right)].sum() for k in (0, 1)] for right in (False, True)]
                whole = np.sum(parts, axis=0)
                return sum(np.square(p).sum() / max(sum(p), 1e-12) for p in parts) / whole.sum() - np.square(whole).sum() / whole.sum() ** 2, parts
            all_ = {(f, c): gain(f, c)[0] for f in tried for c in range(sizes[f] - 1)}
            if feature < 0:
                assert max(all_.values()) < 1e-9
            else:
                assert np.isclose(all_[feature, cut], max(all_.values())) and np.allclose(np.ravel(gain(feature, cut)[1]), sides)
        grown.split(level, best)


def test_forest_of_many_parts(spark):
    """A fit over several parts is the same each time it runs, and learns."""
    from pyspark.sql import functions as F

    from flowscope.operators import models

    rows = spark.range(4000).select("id", F.col("id").alias("event_id"), ((F.col("id") * 7919) % 101).cast("double").alias("a"), ((F.col("id") * 104729) % 7).cast("double").alias("b"))
    rows = rows.withColumn("ground_truth_label", F.when(F.col("id") % 10 == 0, "unknown").when((F.col("a") > 40) & (F.col("b") > 2), "malicious").otherwise("benign"))
    runs = [{r.event_id: r.score for r in models.fit_and_score(rows, rows, ["a", "b"], "random_forest", trees=12, depth=6)[0].collect()} for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 4000
    right = [(runs[0][r.event_id] >= 0.5) == (r.ground_truth_label == "malicious") for r in rows.where("ground_truth_label <> 'unknown'").collect()]
    assert np.mean(right) > 0.99


def test_window_tasks_grow_with_the_flows(spark, monkeypatch):
    """Buckets are dealt to tasks by the number of flows, and the features and the audit are the same."""
    from pyspark.sql import functions as F

    events = spark.range(3000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 700).alias("ts"), (F.col("id") % 40).alias("user_id"), F.lit("error").alias("event_type"), (F.col("id") % 90 + 0.5).alias("value"), F.concat(F.lit('{"k": '), (F.col("id") % 100).cast("string"), F.lit("}")).alias("props"))
    flows = flows_from_events(events).drop("k")
    made = []
    for most in (100_000, 200):
        monkeypatch.setattr(windows, "TASK_ROWS", most)
        made.append(windows.features(flows, "1.2.0", 86_400, 604_800))
    assert made[0].rdd.getNumPartitions() <= 4 and made[1].rdd.getNumPartitions() >= 15
    assert made[0].exceptAll(made[1]).isEmpty() and made[0].count() == made[1].count() == 3000
    assert windows.audit(flows.limit(500)).isEmpty()
    twice = lambda rows: rows.crossJoin(rows.agg(F.count("*").alias("n"))).select(F.col("event_id"), "n", F.explode(F.array(F.lit(1), F.lit(1))))
    assert windows.audit(flows.limit(5), make=twice).count() == 10  # repeated rows are repeated


def test_margins_beside_outliers(spark):
    """One far training flow moves the range of the margins, not the side on which the support vector machine puts flows."""
    x, y, label = table(400)
    x = np.vstack([x, [[400.0, 0, 2]]])
    rows = frame(spark, x, np.append(label, "malicious"))
    fitted = linear.fit(rows, NAMES)
    scored, at = models.margin_scores(fitted, rows, rows)
    found = {r.event_id: r.score for r in scored.collect()}
    margins = {r.event_id: r.z for r in rows.select("event_id", fitted.margin().alias("z")).collect()}
    assert all((found[i] >= at) == (z >= 0) for i, z in margins.items() if abs(z) > 1e-9)
    assert sum((found[i] >= 0.5) == t for i, t in enumerate(y)) < sum((found[i] >= at) == t for i, t in enumerate(y))
    assert found == {r.event_id: r.score for r in models.fit_and_score(rows, rows, NAMES, "linear_svm")[0].collect()}


def test_scoring_by_trees_is_dealt_to_all_cores(spark):
    """A table of one split would be scored in one task."""
    x, _, label = table(200, seed=11)
    df = frame(spark, x, label).coalesce(1)
    made = [models.extra_trees(df, df, NAMES, trees=2, depth=2), models.isolation_forest(df, df, NAMES, trees=2), *[models.fit_and_score(df, df, NAMES, m, **o)[0] for m, o in (("random_forest", {"trees": 2, "depth": 2}), ("gradient_boosting", {"iterations": 2}))]]
    assert all(m.rdd.getNumPartitions() > 1 for m in made)
