"""The driver's event table as canonical flows, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PORTS = [80, 443, 8080, 53, 22, 6667, 5000]
PROTOCOLS = ["tcp", "udp", "ICMP", "arp"]
DIRECTIONS = ["->", "<-", "<->", "<?>"]
STATES = ["CON", "S_RA", "FSPA_FSPA", "INT"]
MULTIPLIERS = {"a": 37, "b": 53, "c": 71}


def flows_from_events(events: DataFrame, ties: bool = False) -> DataFrame:
    e, k = F.col("event_id"), F.col("k")
    pick = lambda values, i: F.array(*[F.lit(v) for v in values])[i.cast("int")]
    but = lambda n, c: F.when(e % n != 0, c)
    rows = events.withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))
    bytes_ = but(17, (F.col("value") * 100000).cast("long"))
    return rows.select(
        "event_id",
        F.concat(F.lit("cap-"), F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("string")).alias("scenario_id"),
        F.concat(F.lit("line-"), e.cast("string")).alias("source_event_id"),
        (F.date_trunc("hour", "ts") if ties else F.col("ts")).alias("observed_at"),
        but(97, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("source_src_address"),
        but(31, F.concat(F.lit("d"), (k % 20).cast("string"))).alias("source_dst_address"),
        but(11, (k * 379) % 60000).cast("long").alias("src_port"),
        but(13, pick(PORTS, k % 7)).cast("long").alias("dst_port"),
        but(29, pick(PROTOCOLS, e % 4)).alias("protocol"),
        but(37, pick(DIRECTIONS, k % 4)).alias("flow_direction"),
        but(43, pick(STATES, e % 4)).alias("connection_state"),
        bytes_.alias("network_bytes"),
        but(19, F.floor(bytes_ / 3)).alias("orig_bytes"),
        but(23, F.col("value").cast("long")).alias("packet_count"),
        F.when(e % 41 != 0, F.when(e % 5 == 0, 0.5).otherwise(F.col("value") * 2)).alias("session_duration_seconds"),
        F.when(F.col("event_type") == "error", "malicious").when(F.col("event_type").isin("signup", "view"), "benign").otherwise("unknown").alias("ground_truth_label"),
        "k",
    )


def flows(spark: SparkSession, sf_dir: str, ties: bool = False) -> DataFrame:
    return flows_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), ties).drop("k")


def scores(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Three deterministic detectors, one row a flow and detector."""
    rows = flows_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    each = F.array(*[F.struct(F.lit(n).alias("detector"), (((F.col("k") + shift) * m % 101) / 100.0).alias("score")) for n, m in MULTIPLIERS.items()])
    return rows.select("event_id", "scenario_id", F.col("ground_truth_label").alias("label"), F.explode(each).alias("s")).select("event_id", "scenario_id", "label", "s.*")


def flows_sql(ties: bool = False) -> str:
    at = "date_trunc('hour', ts)" if ties else "ts"
    return f"""
ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
flows AS (
  SELECT event_id, 'cap-' || CAST(least((day(ts) - 1) // 10, 2) AS VARCHAR) AS scenario_id, 'line-' || event_id AS source_event_id,
    {at} AS observed_at, epoch_us({at}) AS us,
    CASE WHEN event_id % 97 <> 0 THEN 'u' || user_id END AS source_src_address,
    CASE WHEN event_id % 31 <> 0 THEN 'd' || (k % 20) END AS source_dst_address,
    CASE WHEN event_id % 11 <> 0 THEN CAST((k * 379) % 60000 AS BIGINT) END AS src_port,
    CASE WHEN event_id % 13 <> 0 THEN CAST([80, 443, 8080, 53, 22, 6667, 5000][k % 7 + 1] AS BIGINT) END AS dst_port,
    CASE WHEN event_id % 29 <> 0 THEN ['tcp', 'udp', 'ICMP', 'arp'][event_id % 4 + 1] END AS protocol,
    CASE WHEN event_id % 37 <> 0 THEN ['->', '<-', '<->', '<?>'][k % 4 + 1] END AS flow_direction,
    CASE WHEN event_id % 43 <> 0 THEN ['CON', 'S_RA', 'FSPA_FSPA', 'INT'][event_id % 4 + 1] END AS connection_state,
    CASE WHEN event_id % 17 <> 0 THEN CAST(trunc(value * 100000) AS BIGINT) END AS network_bytes,
    CASE WHEN event_id % 17 <> 0 AND event_id % 19 <> 0 THEN CAST(trunc(value * 100000) AS BIGINT) // 3 END AS orig_bytes,
    CASE WHEN event_id % 23 <> 0 THEN CAST(trunc(value) AS BIGINT) END AS packet_count,
    CASE WHEN event_id % 41 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE value * 2 END END AS session_duration_seconds,
    CASE WHEN event_type = 'error' THEN 'malicious' WHEN event_type IN ('signup', 'view') THEN 'benign' ELSE 'unknown' END AS ground_truth_label,
    k
  FROM ev)"""


def scores_sql(name: str = "scores", shift: int = 0) -> str:
    each = " UNION ALL ".join(f"SELECT event_id, scenario_id, ground_truth_label AS label, '{n}' AS detector, ((k + {shift}) * {m} % 101) / 100.0::DOUBLE AS score FROM flows" for n, m in MULTIPLIERS.items())
    return f"{name} AS ({each})"
