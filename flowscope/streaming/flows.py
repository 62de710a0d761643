"""Streaming forms of the rules, of duplicate suppression, and of the prior-window features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.flow_features import asymmetry
from ..operators import rules
from ..operators.windows import _prepared


def detect(stream: DataFrame, own_rules: list[rules.Rule] | None = None) -> DataFrame:
    """Detections of a stream of flows: no state."""
    return rules.detections(stream, own_rules)


def first_occurrences(stream: DataFrame, columns: list[str], time: str = "observed_at", delay: str = "10 minutes") -> DataFrame:
    """Rows whose fingerprint over ``columns`` is new within the watermark."""
    mark = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    return stream.withWatermark(time, delay).withColumn("fingerprint", mark).dropDuplicatesWithinWatermark(["fingerprint"]).drop("fingerprint")


def prior_columns(short: int = 60, long: int = 300) -> list[str]:
    """The feature columns, named and ordered as ``windows.prior_features`` has them."""
    s, l = f"{short}s", f"{long}s"  # noqa: E741
    return [
        f"prior_source_connections_{s}", f"prior_unique_destinations_{l}", f"prior_unique_destination_ports_{l}", "source_traffic_asymmetry", "source_traffic_asymmetry_missing",
        f"prior_repeated_short_connections_{l}", f"prior_source_connections_{l}", f"prior_unique_destinations_{s}", f"prior_unique_destination_ports_{s}", f"prior_unique_protocols_{l}",
        f"prior_destination_reuse_{l}", f"prior_destination_port_reuse_{l}", f"prior_short_connections_{s}", f"log_prior_total_bytes_{l}", f"prior_total_bytes_{l}_missing",
        f"log_prior_packet_count_{l}", f"prior_packet_count_{l}_missing", "log_seconds_since_prior_source_flow", "seconds_since_prior_source_flow_missing",
    ]


#: A row of the state: numbers that may be missing stand beside whether they are known, so that no long passes through a double.
_FIELDS = {
    "us": pa.int64(), "id": pa.string(), "scenario_id": pa.string(), "host": pa.string(), "dst": pa.string(), "proto": pa.string(), "brief": pa.int64(), "share": pa.float64(), "unknown": pa.float64(),
    "dst_port": pa.int64(), "dst_port_known": pa.int64(), "network_bytes": pa.int64(), "network_bytes_known": pa.int64(), "packet_count": pa.int64(), "packet_count_known": pa.int64(),
}
_ROWS = pa.schema(list(_FIELDS.items()))
_LASTS = pa.schema([(c, _FIELDS[c]) for c in ("scenario_id", "host", "us")])
#: The state's columns: Arrow streams of rows of fixed types, so that a checkpoint holds data only.
_STATE = "waiting binary, recent binary, lasts binary"


def _packed(rows: pa.Table) -> bytes | None:
    """An Arrow stream of ``rows``."""
    if not len(rows):
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None, schema: pa.Schema) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all() if data is not None else schema.empty_table()


def _codes(rows: pa.Table, column: str) -> np.ndarray:
    """A number for each distinct value."""
    return rows[column].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(rows: pa.Table, column: str) -> np.ndarray:
    return rows[column].to_numpy()


def _order(host: np.ndarray, us: np.ndarray, rows: pa.Table) -> np.ndarray:
    """The order of (host, us, id as text); ids are compared where hosts and times are equal only."""
    order = np.lexsort((us, host))
    same = (host[order][1:] == host[order][:-1]) & (us[order][1:] == us[order][:-1])
    if not same.any():
        return order
    tied = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    rank = np.zeros(len(us), np.int64)
    rank[tied] = np.unique(np.array(["" if i is None else i for i in rows["id"].take(pa.array(tied)).to_pylist()], object), return_inverse=True)[1]
    return np.lexsort((rank, us, host))


def _starts(host: np.ndarray, us: np.ndarray, width: int) -> np.ndarray:
    """For each of the sorted rows, where its window begins: the host's first row younger than ``width``."""
    n = len(us)
    order = np.lexsort((np.repeat([0, 1], n), np.concatenate((us, us - width)), np.concatenate((host, host))))
    begin = np.empty(n, np.int64)
    begin[order[order >= n] - n] = np.cumsum(order < n)[order >= n]
    return begin


class _Values:
    """A column's values in the sorted rows of all hosts: how often the row's own value, and how many values, stand in its window before it."""

    def __init__(self, host: np.ndarray, value: np.ndarray, known: np.ndarray):
        n, self.known = len(host), known
        self.code = pd.factorize(host * (value.max(initial=0) + 1) + value)[0].astype(np.int64)
        order = np.argsort(self.code, kind="stable")
        self.sorted = self.code[order] * n + order
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.next = np.full(n, n, np.int64)  # the value's next row
        again = self.code[order][1:] == self.code[order][:-1]
        self.next[order[:-1][again]] = order[1:][again]

    def own(self, begin: np.ndarray) -> np.ndarray:
        return np.where(self.known, self.rank - np.searchsorted(self.sorted, self.code * len(begin) + begin), 0)

    def distinct(self, begin: np.ndarray) -> np.ndarray:
        """A row stands for its value until the value's next row or the last window that it is in."""
        n = len(begin)
        until = np.minimum(self.next, np.searchsorted(begin, np.arange(n), side="right") - 1)
        change = np.bincount(np.flatnonzero(self.known) + 1, minlength=n + 2) - np.bincount(until[self.known] + 1, minlength=n + 2)
        return np.cumsum(change)[:n]


def _released(flows: pa.Table, old: int, lasts: pa.Table, widths: tuple[int, int], names: list[str]) -> tuple[pd.DataFrame, pa.Table]:
    """Features of all ``flows`` but the first ``old`` ones, which were released before, and each host's last time.

    Hosts stand one after the other in one sorted table, and each window is a range of it, so a flow costs the same however many flows or hosts there are.
    """
    both = pa.concat_tables([flows.select(["scenario_id", "host"]), lasts.select(["scenario_id", "host"])])
    names_ = _codes(both, "host")
    host = pd.factorize(_codes(both, "scenario_id") * (names_.max() + 1) + names_)[0].astype(np.int64)
    host, hosts_before = host[: len(flows)], host[len(flows) :]
    order = _order(host, _numbers(flows, "us"), flows)
    host, flows, new = host[order], flows.take(pa.array(order)), order >= old
    us, n = _numbers(flows, "us"), len(flows)
    begins = np.concatenate(([True], host[1:] != host[:-1]))

    count = int(max(host.max(), hosts_before.max(initial=0))) + 1
    seen, last = np.zeros(count, bool), np.zeros(count, np.int64)
    seen[hosts_before], last[hosts_before] = True, _numbers(lasts, "us")
    before, unseen = np.concatenate(([0], us[:-1])), begins & ~seen[host]
    before[begins] = last[host[begins]]
    ends = np.concatenate((begins[1:], [True]))
    gone = np.ones(count, bool)
    gone[host] = False  # hosts of whom no flow is here
    lasts = pa.concat_tables([lasts.filter(pa.array(gone[hosts_before])), flows.filter(pa.array(ends)).select(_LASTS.names)])

    near, wide = (_starts(host, us, w) for w in widths)
    here = np.arange(n)

    def total(column: str, begin: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(_numbers(flows, column))))
        return upto[:-1] - upto[begin]

    known = _numbers(flows, "dst_port_known") > 0
    ports = pd.factorize(np.where(known, _numbers(flows, "dst_port"), 0))[0].astype(np.int64)
    always = np.ones(n, bool)
    dst, port, proto = _Values(host, _codes(flows, "dst"), always), _Values(host, ports, known), _Values(host, _codes(flows, "proto"), always)
    with np.errstate(invalid="ignore", divide="ignore"):
        values = [
            here - near, dst.distinct(wide), port.distinct(wide), _numbers(flows, "share"), _numbers(flows, "unknown"), total("brief", wide), here - wide, dst.distinct(near), port.distinct(near), proto.distinct(wide),
            dst.own(wide), port.own(wide), total("brief", near), np.log1p(total("network_bytes", wide)), total("network_bytes_known", wide) == 0, np.log1p(total("packet_count", wide)), total("packet_count_known", wide) == 0,
            np.where(unseen, 0.0, np.log1p((us - before) / 1e6)), unseen,
        ]
    out = {"event_id": flows["id"].filter(pa.array(new)).to_pandas(), "scenario_id": flows["scenario_id"].filter(pa.array(new)).to_pandas()}
    return pd.DataFrame(out | {c: v[new].astype(float) for c, v in zip(names, values, strict=True)}), lasts


def late_rows(query: StreamingQuery) -> DataFrame:
    """batch_id, operator, watermark, late: rows that each stateful operator of a query dropped, as they came later than the watermark; a row for each batch that dropped any."""
    found = [
        (p["batchId"], k, p["eventTime"].get("watermark"), o["numRowsDroppedByWatermark"])
        for p in query.recentProgress
        for k, o in enumerate(p["stateOperators"])
        if o["numRowsDroppedByWatermark"]
    ]
    return SparkSession.active().createDataFrame(found, "batch_id long, operator int, watermark string, late long")


def prior_features(stream: DataFrame, short: int = 60, long: int = 300, delay: str = "10 minutes", groups: int | None = None) -> DataFrame:
    """event_id, scenario_id and all prior features of each flow, released in a host's (observed_at, id) order once the watermark has passed it.

    State: flows that wait, flows of the last window, and the last time seen of each (scenario, host). Hosts are dealt to ``groups`` states; without it each
    has its own. A state costs some milliseconds a batch and is written anew whenever a flow of its hosts comes or goes, so own states suit streams of small batches
    and many hosts, and ``groups`` of some thousands of flows large batches. Rows that come later than the watermark are dropped by the engine;
    ``late_rows`` tells how many. Ids may be numbers or text.
    """
    w_short, w_long = short * 1_000_000, long * 1_000_000
    share, unknown = asymmetry()
    host = F.coalesce("_host", F.lit(""))  # no address is empty
    group = F.xxhash64("scenario_id", host)
    measures = [c for name in ("dst_port", "network_bytes", "packet_count") for c in (F.coalesce(F.col(name).cast("long"), F.lit(0)).alias(name), F.col(name).isNotNull().cast("long").alias(f"{name}_known"))]
    rows = _prepared(stream.withWatermark("observed_at", delay)).select(
        (group if groups is None else F.pmod(group, F.lit(groups))).alias("group"), "scenario_id", host.alias("host"), "observed_at", F.col("_us").alias("us"), F.col("_id").alias("id"), F.col("_dst").alias("dst"),
        F.col("_proto").alias("proto"), F.col("_brief").alias("brief"), share.alias("share"), unknown.alias("unknown"), *measures,
    )
    names = prior_columns(short, long)
    schema = "event_id string, scenario_id string, " + ", ".join(f"{c} double" for c in names)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None, None)
        waiting, recent, lasts = (_unpacked(x, kind) for x, kind in zip(held, (_ROWS, _ROWS, _LASTS)))
        waiting = pa.concat_tables([waiting, *(pa.Table.from_pandas(pdf[_ROWS.names], _ROWS, preserve_index=False) for pdf in batches)])
        if waiting["us"].null_count:
            raise ValueError("a flow without a time has no place among the others")
        mark = state.getCurrentWatermarkMs() * 1000
        due = _numbers(waiting, "us") < mark
        flows = pa.concat_tables([recent, waiting.filter(pa.array(due))])
        out = None
        if due.any():
            out, lasts = _released(flows, len(recent), lasts, (w_short, w_long), names)
        waiting, recent = waiting.filter(pa.array(~due)), flows.filter(pa.array(_numbers(flows, "us") > mark - w_long))
        state.update((_packed(waiting), _packed(recent), _packed(lasts)))
        if len(waiting):
            state.setTimeoutTimestamp(max(int(_numbers(waiting, "us").min() // 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if out is not None:
            yield out

    made = rows.groupBy("group").applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return made.withColumn("event_id", F.col("event_id").cast(dict(stream.dtypes)["event_id"]))
