"""Features of what a source host did before each flow.

A row sees the rows of its (scenario, host) that stand strictly before it by (observed_at, event_id as text) and are
younger than the window: observed_at > t - w. A missing host is a host of its own; an empty address or protocol is missing.

Counts and sums are range frames minus the ties that stand at or after the row. Distinct counts are a sweep: each value
opens an interval that closes when the window has passed its last sighting, and the running sum of openings and closings
is the number of values alive. Both are plain window sums, so nothing grows with the number of rows in a window.

Hosts may be busy for a long time. Rows are therefore dealt into time buckets of ``bucket`` seconds; each bucket also gets a
copy of the rows of the last window before it, and only a bucket's own rows are kept. Hot hosts then spread over tasks. Where a host has more than
``most`` flows in a bucket, the bucket is cut where its flows, counted by slots, fill so many; a slot (a 4,096th of a bucket) is not cut. The
flow before a bucket's first may be older than the window: the last time of each bucket is carried to the host's next one.

The flows are counted, and buckets are dealt to so many tasks that each has about ``TASK_ROWS`` of them, however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.flow_features import asymmetry, flow_features, log_or_zero
from ..schemas import FEATURES
from ..store import staged
from .contracts import guard_one_scenario

SHORT_SECONDS = 1.0
#: Own flows of a bucket before it is cut, and slots in which the flows of a bucket are counted for that.
MOST = 500_000
SLOTS = 4096
#: Rows of a task, about: a task sorts its rows several times, wide as they are.
TASK_ROWS = 100_000


def _spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, about ``n``, dealt by ``keys`` to so many tasks that each has about ``TASK_ROWS``."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *keys)


def _prepared(flows: DataFrame) -> DataFrame:
    src = [F.nullif(F.col(c), F.lit("")) for c in ("source_src_address", "src_ip") if c in flows.columns]
    dst = [F.nullif(F.col(c), F.lit("")) for c in ("source_dst_address", "dst_ip") if c in flows.columns]
    return flows.where(F.col("scenario_id").isNotNull()).withColumns(
        {
            "_id": F.col("event_id").cast("string"),
            "_host": F.coalesce(*src, F.concat(F.lit("missing:"), F.col("event_id").cast("string"))),
            "_us": F.unix_micros(F.col("observed_at").cast("timestamp")),
            "_dst": F.coalesce(*dst, F.lit("missing:")),
            "_proto": F.coalesce(F.nullif(F.lower("protocol"), F.lit("")), F.lit("missing:")),
            "_brief": F.coalesce((F.col("session_duration_seconds") <= SHORT_SECONDS).cast("long"), F.lit(0)),
        }
    )


def _cuts(rows: DataFrame, wide: int, most: int) -> DataFrame | None:
    """Host hours of more than ``most`` flows, with the times at which they are cut; none without such hours (a count over three columns tells)."""
    cell = ["scenario_id", "_host", "_cell"]
    rows = rows.select(*cell[:2], "_us", F.floor(F.col("_us") / wide).alias("_cell"))
    busy = rows.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > most)
    if busy.isEmpty():
        return None
    busy, slot = staged(busy.select(*cell), "busy"), max(1, wide // SLOTS)
    slots = rows.join(busy, cell, "left_semi").groupBy(*cell, (F.floor(F.col("_us") / slot) * slot).alias("_at")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*cell).orderBy("_at")  # at most SLOTS rows and one
    slots = slots.withColumn("full", F.floor(F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / most))
    cuts = slots.withColumn("was", F.lag("full", 1, 0).over(upto)).where((F.col("full") > F.col("was")) & (F.col("_at") > F.col("_cell") * wide))
    return staged(cuts.groupBy(*cell).agg(F.array_sort(F.collect_list("_at")).alias("_cuts")), "cuts")


def _dealt(rows: DataFrame, wide: int, window: int, most: int) -> DataFrame:
    """Each row in its own bucket (``_own``) and in those whose window it stands in; ``_bucket`` is the time at which a bucket begins."""
    us = F.col("_us")
    own, reach = F.floor(us / wide), F.floor((us + window - 1) / wide)
    cuts = _cuts(rows, wide, most)
    rows = rows.withColumn("_cell", F.explode(F.sequence(own, reach)))
    if cuts is None:
        rows = rows.withColumn("_bucket", F.col("_cell") * wide)
    else:
        starts = F.concat(F.array(F.col("_cell") * wide), F.coalesce("_cuts", F.array().cast("array<bigint>")))
        rows = rows.join(cuts, ["scenario_id", "_host", "_cell"], "left").withColumn("_starts", starts)
        end = lambda i: F.coalesce(F.get("_starts", i + 1), (F.col("_cell") + 1) * wide)
        mine = F.filter("_starts", lambda s, i: (s <= us + window - 1) & (end(i) > us))
        rows = rows.withColumn("_bucket", F.explode(mine)).drop("_starts", "_cuts")
    return rows.withColumn("_own", F.when(F.col("_cell") == own, F.col("_bucket") <= us).otherwise(F.lit(False))).drop("_cell")


def prior_features(flows: DataFrame, short: int = 60, long: int = 300, bucket: int = 3600, most: int = MOST) -> DataFrame:
    """``flows`` with all prior features of both windows (seconds); names carry the window."""
    rows = _prepared(flows)
    s, l = f"{short}s", f"{long}s"  # noqa: E741
    micros = {s: short * 1_000_000, l: long * 1_000_000}
    wide = max(bucket, short, long) * 1_000_000
    rows = _dealt(rows, wide, max(micros.values()), most)
    group = ["scenario_id", "_host", "_bucket"]
    # counted over three columns: the copies are among them
    rows = _spread(rows, rows.select(*group).count(), *group)
    ends = rows.where("_own").groupBy(*group).agg(F.max("_us").alias("_end"))  # a row a bucket
    carried = ends.select(*group, F.lag("_end").over(Window.partitionBy(*group[:2]).orderBy("_bucket")).alias("_carried"))
    rows = rows.join(carried, group, "left")
    rows = rows.withColumn("_last", F.coalesce(F.lag("_us").over(Window.partitionBy(*group).orderBy("_us", "_id")), "_carried"))

    def prior(value: Column, name: str, *more: str) -> Column:
        keys = [*group, *more]
        frame = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-(micros[name] - 1), 0)
        ties = Window.partitionBy(*keys, "_us").orderBy("_id").rowsBetween(0, Window.unboundedFollowing)
        return F.coalesce(F.sum(value).over(frame), F.lit(0)) - F.coalesce(F.sum(value).over(ties), F.lit(0))

    one = F.lit(1)
    counted = {f"n_{w}": prior(one, w) for w in (s, l)} | {f"brief_{w}": prior(F.col("_brief"), w) for w in (s, l)}
    for c in ("network_bytes", "packet_count"):
        counted |= {f"{c}_sum": prior(F.coalesce(c, F.lit(0)), l), f"{c}_seen": prior(F.col(c).isNotNull().cast("long"), l)}
    counted |= {"same_dst": prior(one, l, "_dst"), "same_port": F.when(F.col("dst_port").isNull(), 0).otherwise(prior(one, l, "dst_port"))}
    rows = rows.withColumns({f"_{k}": v for k, v in counted.items()})

    sweeps = [("dst", "_dst", s), ("dst", "_dst", l), ("port", "dst_port", s), ("port", "dst_port", l), ("proto", "_proto", l)]
    marks = {}
    for name, column, w in sweeps:
        same = Window.partitionBy(*group, column).orderBy("_us", "_id")
        before, after = F.lag("_us").over(same), F.lead("_us").over(same)
        marks[f"_open_{name}_{w}"] = F.when(F.col(column).isNotNull() & (before.isNull() | (before + micros[w] <= F.col("_us"))), 1).otherwise(0)
        marks[f"_close_{name}_{w}"] = F.when(F.col(column).isNotNull() & (after.isNull() | (after >= F.col("_us") + micros[w])), -1).otherwise(0)
    rows = rows.withColumns(marks)
    names = [f"{n}_{w}" for n, _, w in sweeps]

    def moment(time: Column, kind: int, w: str | None) -> Column:
        """A closing (0) or the row itself (1)."""
        change = [(F.col(f"_open_{n}") if kind else F.col(f"_close_{n}") if n.endswith(f"_{w}") else F.lit(0)).alias(f"d_{n}") for n in names]
        return F.struct(time.alias("at"), F.lit(kind).alias("kind"), *change)

    moments = F.array(moment(F.col("_us"), 1, None), *[moment(F.col("_us") + micros[w], 0, w) for w in dict.fromkeys((s, l))])
    kept = [c for c in rows.columns if not c.startswith(("_open_", "_close_"))]
    swept = rows.withColumn("_m", F.explode(moments)).select("*", "_m.*")
    running = Window.partitionBy(*group).orderBy("at", "kind", "_id").rowsBetween(Window.unboundedPreceding, -1)
    swept = swept.withColumns({f"_alive_{n}": F.coalesce(F.sum(f"d_{n}").over(running), F.lit(0)) for n in names})
    out = swept.where("kind = 1 AND _own").select(*kept, *[f"_alive_{n}" for n in names])

    share, unknown = asymmetry()
    gap = (F.col("_us") - F.col("_last")) / 1e6
    features = {
        f"prior_source_connections_{s}": F.col(f"_n_{s}"),
        f"prior_unique_destinations_{l}": F.col(f"_alive_dst_{l}"),
        f"prior_unique_destination_ports_{l}": F.col(f"_alive_port_{l}"),
        "source_traffic_asymmetry": share,
        "source_traffic_asymmetry_missing": unknown,
        f"prior_repeated_short_connections_{l}": F.col(f"_brief_{l}"),
        f"prior_source_connections_{l}": F.col(f"_n_{l}"),
        f"prior_unique_destinations_{s}": F.col(f"_alive_dst_{s}"),
        f"prior_unique_destination_ports_{s}": F.col(f"_alive_port_{s}"),
        f"prior_unique_protocols_{l}": F.col(f"_alive_proto_{l}"),
        f"prior_destination_reuse_{l}": F.col("_same_dst"),
        f"prior_destination_port_reuse_{l}": F.col("_same_port"),
        f"prior_short_connections_{s}": F.col(f"_brief_{s}"),
        f"log_prior_total_bytes_{l}": F.log1p("_network_bytes_sum"),
        f"prior_total_bytes_{l}_missing": F.col("_network_bytes_seen") == 0,
        f"log_prior_packet_count_{l}": F.log1p("_packet_count_sum"),
        f"prior_packet_count_{l}_missing": F.col("_packet_count_seen") == 0,
        "log_seconds_since_prior_source_flow": log_or_zero(gap),
        "seconds_since_prior_source_flow_missing": F.col("_last").isNull(),
    }
    return out.withColumns({k: v.cast("double") for k, v in features.items()}).select(*flows.columns, *features)


def features(flows: DataFrame, version: str, short: int = 60, long: int = 300, one_scenario: bool = False) -> DataFrame:
    """Metadata and the features of a version: 1.0.0 (flow), 1.1.0 (behavioural) or 1.2.0 (causal).

    Scenarios never see each other's flows; with ``one_scenario``, flows of more than one are an error.
    """
    if one_scenario:
        guard_one_scenario(flows)
    named = [c.replace("_60s", f"_{short}s").replace("_300s", f"_{long}s") for c in FEATURES[version]]
    rows = flows if version == "1.0.0" else prior_features(flows, short, long)
    meta = [c for c in ("event_id", "scenario_id", "source_event_id", "ground_truth_label") if c in flows.columns]
    return rows.withColumns(flow_features()).select(*meta, F.lit(version).alias("feature_version"), *named)


def audit(flows: DataFrame, version: str = "1.2.0", short: int = 60, long: int = 300, make=None) -> DataFrame:
    """Rows whose features change when one later flow is added to each scenario: none, if features look back only.

    ``make`` gives the features of flows (event_id first); those of ``version`` unless it is given.
    """
    make = make or (lambda rows: features(rows, version, short, long))
    latest = flows.where(F.col("scenario_id").isNotNull()).groupBy("scenario_id").agg(F.max_by(F.struct(*flows.columns), F.struct("observed_at", F.col("event_id").cast("string"))).alias("r")).select("r.*")
    future = latest.withColumns({"event_id": (F.lit(-1) - F.col("event_id")) if dict(flows.dtypes)["event_id"] != "string" else F.concat(F.col("event_id"), F.lit("-future")), "observed_at": F.col("observed_at") + F.expr("INTERVAL 1 SECOND")})
    before, after = make(flows), make(flows.unionByName(future))
    # the rows that are there more often before than after, compared in tasks of bounded size
    both = before.withColumn("_more", F.lit(1)).unionByName(after.withColumn("_more", F.lit(-1)))
    more = _spread(both, 2 * flows.count(), "event_id").groupBy(*before.columns).agg(F.sum("_more").alias("_more")).where("_more > 0")
    return more.withColumn("_more", F.explode(F.sequence(F.lit(1), F.col("_more").cast("int")))).drop("_more")
