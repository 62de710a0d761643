import pytest
from flowscope.operators import rules, windows
from flowscope.plans.flows import flows_from_events
from flowscope.streaming import flows as S
from pyspark.sql import functions as F


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df = flows_from_events(events).drop("k").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert run(spark, S.detect(stream), "hits").count() == rules.detections(df).count()
    assert run(spark, S.first_occurrences(stream, ["event_id"]), "firsts").count() == df.count()
    # a last file moves the watermark past all rows
    late = df.limit(1).withColumn("observed_at", F.expr("timestamp'2025-01-01'")).withColumn("event_id", F.lit(-1).cast("long"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.event_id: r for r in run(spark, S.prior_features(stream, 86400, 604800), "prior").collect() if r.event_id >= 0}
    want = {r.event_id: r for r in windows.prior_features(df, 86400, 604800).collect()}
    assert set(got) == set(want)
    for column in S.prior_columns(86400, 604800):
        assert all(got[k][column] == pytest.approx(want[k][column]) for k in want), column


def test_stream_of_text_ids_with_ties(spark, tmp_path):
    """Ids as both sources make them, several flows at one time, short windows, and a host without an address."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df = flows_from_events(events, ties=True).drop("k").withColumns({"event_id": F.sha1(F.col("event_id").cast("string")), "observed_at": F.col("observed_at").cast("timestamp")})
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    df.limit(1).withColumns({"observed_at": F.expr("timestamp'2030-01-01'"), "event_id": F.lit("last")}).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.event_id: r for r in run(spark, S.prior_features(stream, 7200, 86400), "ties").collect() if r.event_id != "last"}
    want = {r.event_id: r for r in windows.prior_features(df, 7200, 86400).collect()}
    assert set(got) == set(want)
    for column in S.prior_columns(7200, 86400):
        assert all(got[k][column] == pytest.approx(want[k][column]) for k in want), column


def test_late_rows_are_counted(spark, tmp_path):
    """Rows that come after the watermark has passed them are dropped, and how many is told; state is typed and lives over batches."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df = flows_from_events(events).drop("k").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    source = tmp_path / "in"
    df.repartition(1).write.parquet(str(source))
    for k, (stamp, rows) in enumerate([("2025-01-01", 1), ("2000-01-01", 7), ("2030-01-01", 1)]):
        more = df.limit(rows).withColumns({"observed_at": F.expr(f"timestamp'{stamp}'"), "event_id": -1 - F.col("event_id") - 1000 * k})
        more.repartition(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = S.prior_features(stream, 3600, 86400).writeStream.format("memory").queryName("late").start()
    q.processAllAvailable()
    late = S.late_rows(q).collect()
    q.stop()
    assert sum(r.late for r in late) == 7 and all(r.watermark >= "2024" for r in late)
    assert spark.table("late").where("event_id < -1000 AND event_id > -2000").isEmpty()
    assert {r.event_id for r in spark.table("late").where("event_id >= 0").collect()} == {r.event_id for r in df.collect()}


def test_states_of_many_hosts(spark, tmp_path):
    """Hosts that share a few states, in batches that leave flows waiting and windows open: the same features, and no more states than groups."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df = flows_from_events(events, ties=True).drop("k").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    df = df.withColumn("network_bytes", F.when(F.col("network_bytes").isNotNull(), F.col("network_bytes") + F.lit(2**53)))  # no double holds these
    low, high = (r.timestamp() for r in df.agg(F.min("observed_at"), F.max("observed_at")).first())
    part = F.least(F.floor((F.col("observed_at").cast("double") - low) / (high - low + 1) * 3), F.lit(2))
    for k in range(3):
        df.where(part == k).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    df.limit(1).withColumns({"observed_at": F.expr("timestamp'2030-01-01'"), "event_id": F.lit(-1).cast("long")}).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.prior_features(stream, 7200, 86400, groups=5).writeStream.format("memory").queryName("grouped").start()
    q.processAllAvailable()
    states = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    q.stop()
    assert max(states) <= 5
    got = {r.event_id: r for r in spark.table("grouped").where("event_id >= 0").collect()}
    want = {r.event_id: r for r in windows.prior_features(df, 7200, 86400).collect()}
    assert set(got) == set(want)
    for column in S.prior_columns(7200, 86400):
        assert all(got[k][column] == pytest.approx(want[k][column], rel=1e-12) for k in want), column
