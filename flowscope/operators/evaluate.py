"""Label-aware evaluation. Scores are rows (event_id, scenario_id, detector, label, score); unknown labels are never benign."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..ordering import running_sums
from .contracts import guard_scores

BENIGN, MALICIOUS, UNKNOWN = "benign", "malicious", "unknown"
FLOOR, CAP = 0.95, 200.0
WHOLE = 1_000_000


def known(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("label") != UNKNOWN)


def ratios(rows: DataFrame) -> DataFrame:
    """Counts tp, fp, fn, tn with precision, recall, f1, fpr, fnr; null where a denominator is zero."""
    div = F.try_divide
    rows = rows.withColumns({"precision": div("tp", F.col("tp") + F.col("fp")), "recall": div("tp", F.col("tp") + F.col("fn")), "fpr": div("fp", F.col("fp") + F.col("tn")), "fnr": div("fn", F.col("fn") + F.col("tp"))})
    return rows.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _confusion(threshold: float | Column) -> list[Column]:
    bad, hit = F.col("label") == MALICIOUS, F.col("score") >= threshold
    return [F.count_if(bad & hit).alias("tp"), F.count_if(~bad & hit).alias("fp"), F.count_if(bad & ~hit).alias("fn"), F.count_if(~bad & ~hit).alias("tn")]


def binary_metrics(scores: DataFrame, threshold: float, by: tuple[str, ...] = ("detector",)) -> DataFrame:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    return ratios(known(scores).groupBy(*by).agg(*_confusion(threshold)))


def scenario_metrics(scores: DataFrame, threshold: float | Column) -> DataFrame:
    """For each detector, all scenarios together (scenario_id null) and each alone, in one pass."""
    rows = known(scores).groupingSets([["detector"], ["detector", "scenario_id"]], "detector", "scenario_id")
    return ratios(rows.agg(*_confusion(threshold)))


def average_precision(scores: DataFrame) -> DataFrame:
    """Step-wise area under the precision-recall curve by detector; null with one class only. Equal scores are one step.

    Steps of a detector lie in many parts, in the order of the scores (see ``running_sums``), since continuous scores make as many steps as rows.
    """
    steps = known(scores).groupBy("detector", "score").agg(F.count_if(F.col("label") == MALICIOUS).alias("p"), F.count("*").alias("n"))
    steps = running_sums(steps, ["detector"], {"score": True}, {"tp": "p", "all": "n"})
    return steps.groupBy("detector").agg(F.when((F.sum("p") > 0) & (F.sum("p") < F.sum("n")), F.sum(F.col("p") * F.col("tp") / F.col("all")) / F.sum("p")).alias("pr_auc"))


def threshold_grid(scores: DataFrame, steps: int = 20, first: int = 1, last: int = 19) -> DataFrame:
    """Metrics at thresholds i / steps: scores are binned once, and suffix sums over the bins give every threshold."""
    # the number of thresholds at most the score, on the doubles that are compared
    bin_ = F.floor(F.col("score") * steps + 1e-9)
    bin_ = F.when(bin_ / F.lit(float(steps)) > F.col("score"), bin_ - 1).when((bin_ + 1) / F.lit(float(steps)) <= F.col("score"), bin_ + 1).otherwise(bin_).cast("int")
    bad = F.col("label") == MALICIOUS
    bins = scores.groupBy("detector", bin_.alias("bin")).agg(F.count_if(bad).alias("p"), F.count_if(F.col("label") == BENIGN).alias("n"), F.count("*").alias("all"))
    held = bins.groupBy("detector").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("p", "n", "all")))).alias("m"))  # an entry a bin
    grid = held.select("detector", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("bin"), "m")
    grid = grid.select("detector", "bin", *[F.coalesce(F.col("m")[F.col("bin")][c], F.lit(0)).alias(c) for c in ("p", "n", "all")])
    suffix = Window.partitionBy("detector").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("detector")
    rows = grid.withColumns({"tp": F.sum("p").over(suffix), "fp": F.sum("n").over(suffix), "alerts": F.sum("all").over(suffix), "tot_p": F.sum("p").over(whole), "tot_n": F.sum("n").over(whole)})
    rows = rows.where(F.col("bin").between(first, last)).select("detector", (F.col("bin") / F.lit(float(steps))).alias("threshold"), "tp", "fp", (F.col("tot_p") - F.col("tp")).alias("fn"), (F.col("tot_n") - F.col("fp")).alias("tn"), "alerts")
    return ratios(rows)


def best_threshold(grid: DataFrame) -> DataFrame:
    """Largest F1, then recall, precision, and the lowest threshold; a null ratio counts as -1."""
    z = lambda c: F.coalesce(c, F.lit(-1.0))
    return grid.groupBy("detector").agg(F.max_by(F.struct("threshold", "f1", "recall", "precision"), F.struct(z("f1"), z("recall"), z("precision"), -F.col("threshold"))).alias("b")).select("detector", "b.*")


def operating_point(scores: DataFrame, floor: float = FLOOR, cap: float = CAP, steps: int = 100) -> DataFrame:
    """The threshold that keeps the precision floor and the cap of alerts per 1,000 labelled rows with the most recall.

    Where none does, the one with the least excess over the cap, then the least shortfall of the floor, the most recall, the lowest threshold.
    """
    z = lambda c: F.coalesce(c, F.lit(0.0))
    grid = threshold_grid(scores, steps, 0, steps)
    grid = grid.withColumn("per_1000", z(F.try_divide((F.col("tp") + F.col("fp")) * 1000.0, F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))))
    grid = grid.withColumn("eligible", (z("precision") >= floor) & (F.col("per_1000") <= cap))
    row = F.struct("threshold", "precision", "recall", "per_1000")
    chosen = grid.groupBy("detector").agg(
        F.max_by(row, F.when(F.col("eligible"), F.struct(z("recall"), z("precision"), -F.col("threshold")))).alias("e"),
        F.min_by(row, F.struct(F.greatest(F.col("per_1000") - cap, F.lit(0.0)), F.greatest(floor - z("precision"), F.lit(0.0)), -z("recall"), F.col("threshold"))).alias("f"),
        F.max("eligible").alias("met"),
    )
    return chosen.select("detector", F.when(F.col("met"), "policy_met").otherwise("fallback").alias("status"), F.when(F.col("met"), F.col("e")).otherwise(F.col("f")).alias("b")).select("detector", "status", "b.*")


def each_threshold(thresholds: dict[str, float]) -> Column:
    """The threshold of a row's detector; null for a detector that has none."""
    return F.coalesce(*[F.when(F.col("detector") == n, F.lit(float(t))) for n, t in thresholds.items()], F.lit(None).cast("double"))


def alert_volume(scores: DataFrame, threshold: float | Column) -> DataFrame:
    """Alerts among labelled rows, unlabelled rows, and all; per 1,000 labelled rows."""
    hit, lab = F.col("score") >= threshold, F.col("label") != UNKNOWN
    rows = scores.groupBy("detector").agg(F.count_if(hit & lab).alias("known_alerts"), F.count_if(hit & ~lab).alias("unknown_alerts"), F.count_if(hit).alias("all_alerts"), F.count_if(lab).alias("labelled"))
    return rows.withColumn("alerts_per_1000", F.try_divide(F.col("known_alerts") * 1000.0, "labelled"))


def alert_volumes(scores: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """``alert_volume`` at several thresholds, in one pass."""
    each = scores.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit, lab = F.col("score") >= F.col("threshold"), F.col("label") != UNKNOWN
    rows = each.groupBy("detector", "threshold").agg(F.count_if(hit & lab).alias("known_alerts"), F.count_if(hit & ~lab).alias("unknown_alerts"), F.count_if(hit).alias("all_alerts"), F.count_if(lab).alias("labelled"))
    return rows.withColumn("alerts_per_1000", F.try_divide(F.col("known_alerts") * 1000.0, "labelled"))


def calibration_bins(scores: DataFrame, bins: int = 10) -> DataFrame:
    if bins < 2:
        raise ValueError("two bins at least")
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return known(guard_scores(scores)).groupBy("detector", b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg((F.col("label") == MALICIOUS).cast("double")).alias("positive_rate"))


def calibration_scores(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error."""
    y = (F.col("label") == MALICIOUS).cast("double")
    brier = known(scores).groupBy("detector").agg(F.avg(F.pow(F.col("score") - y, 2)).alias("brier"))
    ece = calibration_bins(scores, bins).groupBy("detector").agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("positive_rate"))) / F.sum("n")).alias("ece"))
    return brier.join(ece, "detector")


def error_summary(features: DataFrame, scores: DataFrame, threshold: float, columns: list[str]) -> DataFrame:
    """Feature means of malicious rows that were caught and of those that were missed."""
    rows = features.join(scores.where(F.col("label") == MALICIOUS).select("event_id", F.when(F.col("score") >= threshold, "true_positive").otherwise("false_negative").alias("outcome")), "event_id")
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def disagreement(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Malicious cases with the detectors that caught and that missed them."""
    names = F.array(*[F.lit(n) for n in sorted(thresholds)])
    limit = F.create_map(*[x for n, t in thresholds.items() for x in (F.lit(n), F.lit(t))])
    hit = F.col("score") >= limit[F.col("detector")]
    cases = scores.where(F.col("label") == MALICIOUS).groupBy("event_id", "scenario_id").agg(F.array_sort(F.collect_set(F.when(hit, F.col("detector")))).alias("caught_by"))
    return cases.withColumn("missed_by", F.array_except(names, "caught_by"))


def coverage_histogram(cases: DataFrame) -> DataFrame:
    return cases.groupBy(F.size("caught_by").alias("detectors")).agg(F.count("*").alias("n"))


def pairwise_overlap(cases: DataFrame, detectors: list[str] | None = None) -> DataFrame:
    """Cases that two detectors both caught (left <= right); with ``detectors``, every pair of them, also where that is none."""
    both = cases.select(F.explode("caught_by").alias("left"), "caught_by").select("left", F.explode("caught_by").alias("right"))
    found = both.where("left <= right").groupBy("left", "right").agg(F.count("*").alias("n"))
    if detectors is None:
        return found
    pairs = [(a, b) for a in detectors for b in detectors if a <= b]
    return cases.sparkSession.createDataFrame(pairs, "left string, right string").join(found, ["left", "right"], "left").fillna(0, ["n"])


def unique_catches(cases: DataFrame) -> DataFrame:
    one = lambda c, name: cases.where(F.size(c) == 1).groupBy(F.col(c)[0].alias("detector")).agg(F.count("*").alias(name))
    return one("caught_by", "only_catch").join(one("missed_by", "only_miss"), "detector", "full").fillna(0)


def residuals(cases: DataFrame) -> DataFrame:
    """Cases that no detector caught, by scenario."""
    return cases.where(F.size("caught_by") == 0).groupBy("scenario_id").agg(F.count("*").alias("n"))


def overlap_class(caught_by: Column, detectors: list[str]) -> Column:
    """Of the detectors named: shared (all caught it), ``<name>_only``, none, or several."""
    caught = F.array_intersect(caught_by, F.array(*[F.lit(d) for d in detectors]))
    return F.when(F.size(caught) == len(detectors), "shared").when(F.size(caught) == 0, "none").when(F.size(caught) == 1, F.concat(caught[0], F.lit("_only"))).otherwise("several")


def residual_profile(cases: DataFrame, features: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """Cases that no detector caught: counts by scenario (0 too), and their features beside those of all cases."""
    missed = F.size("caught_by") == 0
    counts = cases.groupBy("scenario_id").agg(F.count_if(missed).alias("n"))
    rows = features.select("event_id", *columns).join(cases.select("event_id", F.explode(F.when(missed, F.array(F.lit("missed"), F.lit("all"))).otherwise(F.array(F.lit("all")))).alias("side")), "event_id")
    return {"counts": counts, "profile": quartiles(rows, "side", columns)}


def protocol_mix(features: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of each protocol flag, that is the share of flows of each protocol."""
    return features.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("protocol_tcp", "protocol_udp", "protocol_icmp", "protocol_other", "protocol_missing")])


def group_profile(rows: DataFrame, group: str, groups: list[str], columns: list[str]) -> DataFrame:
    """scenario_id (null: all together), group, feature, n, quartiles and mean: a row for every scenario, group and feature, also without values."""
    pooled = rows.select("scenario_id", group, *columns).withColumn("_in", F.explode(F.array(F.col("scenario_id"), F.lit(None).cast("string"))))
    keyed = pooled.withColumn("_key", F.struct(F.col("_in").alias("scenario_id"), F.col(group).alias("group")))
    found = quartiles(keyed, "_key", columns).select("_key.*", "feature", "n", "q1", "median", "q3", "mean")
    spark = rows.sparkSession
    places = rows.select("scenario_id").distinct().union(spark.createDataFrame([(None,)], "scenario_id string"))
    dense = places.join(F.broadcast(spark.createDataFrame([(g, c) for g in groups for c in columns], "g string, f string")))  # the few named groups and features
    same = dense["scenario_id"].eqNullSafe(found["scenario_id"]) & (F.col("g") == F.col("group")) & (F.col("f") == F.col("feature"))
    return dense.join(found, same, "left").select(dense["scenario_id"], F.col("g").alias(group), F.col("f").alias("feature"), F.coalesce("n", F.lit(0)).alias("n"), "q1", "median", "q3", "mean")


def case_changes(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Each case of two feature versions with its change; raises if the versions hold different cases."""
    a = reference.select("event_id", "scenario_id", F.col("caught_by").alias("before"))
    b = candidate.select("event_id", F.col("scenario_id").alias("scenario_b"), F.col("caught_by").alias("after"))
    odd = a.join(b, "event_id", "full").where("before IS NULL OR after IS NULL OR NOT (scenario_id <=> scenario_b)")
    if not odd.isEmpty():
        raise ValueError("the two versions hold different cases")
    was, now = F.size("before") > 0, F.size("after") > 0
    change = F.when(was & now, "both").when(now, "candidate_only").when(was, "reference_only").otherwise("residual")
    return a.join(b.drop("scenario_b"), "event_id").withColumn("change", change)


def transitions(changes: DataFrame) -> DataFrame:
    name = lambda c: F.when(F.size(c) == 0, "none").otherwise(F.array_join(c, "+"))
    return changes.groupBy(F.concat(name("before"), F.lit("->"), name("after")).alias("transition")).agg(F.count("*").alias("n"))


def gains(changes: DataFrame, detectors: list[str]) -> DataFrame:
    """Cases that each detector gained and lost between the versions."""
    rows = changes.select(F.explode(F.array(*[F.lit(d) for d in detectors])).alias("detector"), "before", "after")
    was, now = F.array_contains("before", F.col("detector")), F.array_contains("after", F.col("detector"))
    return rows.groupBy("detector").agg(F.count_if(now & ~was).alias("gained"), F.count_if(was & ~now).alias("lost"))


def exact_quantiles(rows: DataFrame, keys: list[str], column: str, fractions: list[float]) -> DataFrame:
    """keys, fraction, n, lower, value: the value at index floor((n - 1) * fraction), and the one between it and the next.

    A sketch brackets each quantile; then only values inside the bracket are ranked, after a count of all below it, so that no
    task holds a group. Groups of up to ``WHOLE`` values are bracketed by their least and largest. Nulls are left out.
    """
    x, near = F.col(column), 2e-5
    rows = rows.where(x.isNotNull()).select(*keys, x.alias("_x"))
    ends = [min(1.0, max(0.0, f + d)) for f in fractions for d in (-near, near)]
    known_ = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.percentile_approx("_x", ends, 100_000).alias("_p"))
    small = F.col("n") <= WHOLE
    each = F.array(*[F.struct(F.lit(f).alias("fraction"), F.when(small, F.col("_a")).otherwise(F.col("_p")[2 * i]).alias("_lo"), F.when(small, F.col("_b")).otherwise(F.col("_p")[2 * i + 1]).alias("_hi")) for i, f in enumerate(fractions)])
    spans = known_.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", F.explode(each).alias("_s")).select("*", "_s.*").drop("_s")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(F.col(f"_k{i}"))
    group = [*keys, "fraction", "n"]
    steps = rows.join(spans, same & (F.col("_x") <= F.col("_hi"))).groupBy(*group, F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*group).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    at = (F.col("n") - 1) * F.col("fraction")
    pick = lambda i: F.min(F.when(F.col("_u") > i, F.col("_v")))
    found = steps.withColumn("_u", F.sum("_c").over(upto)).groupBy(*group).agg(pick(F.floor(at)).alias("lower"), pick(F.ceil(at)).alias("_next"))
    return found.select(*group, "lower", (F.col("lower") + (F.col("_next") - F.col("lower")) * (at - F.floor(at))).alias("value"))


def _long(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    return rows.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select(group, "v.*")


def quartiles(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Exact inclusive quartiles and mean of each feature, by group; null where a group has no value."""
    long = _long(rows, group, columns)
    means = long.groupBy(F.col(group).alias("_g"), F.col("feature").alias("_f")).agg(F.count("x").alias("_n"), F.avg("x").alias("mean"))
    pick = lambda f: F.max(F.when(F.col("fraction") == f, F.col("value")))
    q = exact_quantiles(long, [group, "feature"], "x", [0.25, 0.5, 0.75]).groupBy(group, "feature").agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"))
    out = means.join(q, F.col("_g").eqNullSafe(q[group]) & (F.col("_f") == q["feature"]), "left")
    return out.select(F.col("_g").alias(group), F.col("_f").alias("feature"), F.col("_n").alias("n"), "q1", "median", "q3", "mean")


def lower_quantile(rows: DataFrame, group: str, column: str, fraction: float) -> DataFrame:
    """The value at index floor((n - 1) * fraction) of the sorted values."""
    return exact_quantiles(rows, [group], column, [fraction]).select(group, F.col("lower").alias("quantile"))


def share_at_or_below(rows: DataFrame, group: str, base: str, columns: list[str], fraction: float = 0.25) -> DataFrame:
    """Share of each group's values that are at most the lower ``fraction`` quantile of group ``base``, by feature; null if that is empty."""
    long = _long(rows, group, columns).where("x IS NOT NULL")
    limits = lower_quantile(long.where(F.col(group) == base), "feature", "x", fraction)
    return long.join(F.broadcast(limits), "feature", "left").groupBy(group, "feature").agg(F.avg((F.col("x") <= F.col("quantile")).cast("double")).alias("share"))  # a limit a feature


def hypothesis(medians: DataFrame, group: str, case: str, base: str, ratios_: dict[str, tuple[str, float]], least_cases: int = 100) -> DataFrame:
    """Whether the medians of ``case`` stand to those of ``base`` as ``ratios_`` (feature: (>= or <=, limit)) say."""
    pick = lambda g, c: F.max(F.when(F.col(group) == g, F.col(c)))
    rows = medians.groupBy("feature").agg(pick(case, "median").alias("a"), pick(base, "median").alias("b"), pick(case, "n").alias("n")).withColumn("ratio", F.try_divide("a", "b"))
    limit = F.lit(None).cast("boolean")
    for f, (sign, value) in ratios_.items():
        limit = F.when(F.col("feature") == f, F.col("ratio") >= value if sign == ">=" else F.col("ratio") <= value).otherwise(limit)
    return rows.where(F.col("feature").isin(list(ratios_))).select("feature", "ratio", F.when(F.col("n").isNull() | (F.col("n") < least_cases) | F.col("ratio").isNull(), "not_testable").when(limit, "supported").otherwise("not_supported").alias("outcome"))


def wilson(successes: Column, trials: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Bounds of a proportion; null without trials. Fails on more successes than trials, or fewer than none."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must be between 0 and 1")
    wrong = (successes < 0) | (trials < 0) | (successes > trials)
    trials = F.when(wrong, F.raise_error(F.lit("successes must be between 0 and the trials")).cast("long")).otherwise(trials)
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    n = F.when(trials > 0, trials.cast("double"))
    p = successes / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), (middle - half) / (1 + z * z / n)), F.least(F.lit(1.0), (middle + half) / (1 + z * z / n))
    return F.when(trials > 0, low), F.when(trials > 0, high)


def intervals(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals of precision, recall, fpr, fnr and alert rate from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    shares = {"precision": (tp, tp + fp), "recall": (tp, tp + fn), "fpr": (fp, fp + tn), "fnr": (fn, fn + tp), "alert_rate": (tp + fp, tp + fp + fn + tn)}
    rows = counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), s.alias("successes"), t.alias("trials")) for k, (s, t) in shares.items()])).alias("m")).select(*keys, "m.*")
    low, high = wilson(F.col("successes"), F.col("trials"))
    return rows.withColumns({"lower": low, "upper": high})


def metric_deltas(reference: DataFrame, candidate: DataFrame, metrics: list[str], key: str = "detector") -> DataFrame:
    """Candidate minus reference; null counts as 0."""
    z = lambda t, c: F.coalesce(t[c], F.lit(0.0))
    return reference.join(candidate, reference[key] == candidate[key]).select(reference[key], *[(z(candidate, c) - z(reference, c)).alias(f"{c}_delta") for c in metrics])
