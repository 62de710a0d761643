import hashlib

from pyspark.sql import functions as F

from flowscope.functions import ids, parsing as P
from flowscope.operators import contracts, sinks
from flowscope.schemas import BINETFLOW_EVENTS
from flowscope.sources import binetflow, lines, zeek

HEAD = "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,sTos,dTos,TotPkts,TotBytes,SrcBytes,Label"
ROW = "2011/08/18 15:39:35.087798,1.5,tcp,192.0.2.1,1025,  ->,198.51.100.2,80,S_,0,,3,300,200,flow=From-Botnet-1"
OTHER = "2011/08/18 15:39:36,0.5,udp,00:11:22:33:44:55,0x35,  <?>,198.51.100.3,53,CON,0,0,2,120,-1,flow=From-Normal-1"


def parsed(spark, tmp_path, *rows, head=HEAD, **kw):
    p = tmp_path / "a.binetflow"
    p.write_text("\n".join([head, *rows]) + "\n")
    e, i, r = binetflow.parse(spark, str(p), "s1", "2024-01-01 00:00:00", **kw)
    return e.collect(), i.orderBy("line_no").collect(), (e, i, r)


def test_rows_labels_and_zone(spark, tmp_path):
    e, issues, (df, _, rows) = parsed(spark, tmp_path, ROW, OTHER)
    assert not issues and df.columns == [c.split()[0] for c in BINETFLOW_EVENTS.split(", ")]
    a = next(x for x in e if x.source_event_id == "line-2")
    b = next(x for x in e if x.source_event_id == "line-3")
    assert str(a.observed_at) == "2011-08-18 13:39:35.087798" or a.observed_at.minute == 39
    assert (a.ground_truth_label, b.ground_truth_label) == ("malicious", "benign")
    assert b.src_ip is None and b.source_src_address == "00:11:22:33:44:55" and b.src_port == 53 and b.orig_bytes is None
    missing = {r.field: r.missing for r in binetflow.missing_counts(rows).collect()}
    assert missing["dTos"] == 1 and missing["SrcBytes"] == 1


def test_rejects(spark, tmp_path):
    e, issues, (_, i, rows) = parsed(spark, tmp_path, ROW, ROW, "bad,csv", '"unterminated', ROW.replace("flow=From-Botnet-1", "-"), "")
    assert [x.issue_type for x in issues] == ["duplicate_source_record", "malformed_row", "malformed_row", "invalid_record"]
    assert len(e) == 1 and all("unterminated" not in x.message for x in issues)
    q = binetflow.quality(rows, i).first()
    assert (q.rows_seen, q.accepted, q.rejected, q.duplicates) == (5, 1, 4, 1)


def test_bad_header(spark, tmp_path):
    e, issues, _ = parsed(spark, tmp_path, ROW, head="not,a,flow,header")
    assert not e and len(issues) == 2


def test_quoted_fields(spark):
    rows = {'a,"b,c",d': ["a", "b,c", "d"], '"x""y",z': ['x"y', "z"], '"open,z': None, "a,,": ["a", "", ""]}
    got = {r.v: r.f for r in spark.createDataFrame([(k,) for k in rows], "v string").withColumn("f", binetflow.split_csv(F.col("v"))).collect()}
    assert got == rows


ZEEK = "#separator \\x09\n#set_separator\t,\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\tduration\torig_bytes\tresp_bytes\tconn_state\tlocal_orig\tlocal_resp\tmissed_bytes\thistory\torig_pkts\torig_ip_bytes\tresp_pkts\tresp_ip_bytes\ttunnel_parents\tlabel\tdetailed-label\n"


def zrow(ts="1.5", uid="C1", label="Benign", detail="-", host="192.0.2.1"):
    return f"{ts}\t{uid}\t{host}\t1\t2001:DB8::1\t80\ttcp\t-\t-\t100\t200\tSF\t-\t-\t0\tS\t2\t1\t3\t1\t(empty)\t{label}\t{detail}\n"


def test_zeek(spark, tmp_path):
    p = tmp_path / "conn.log"
    p.write_text(ZEEK + zrow() + zrow(uid="C2", label="Malicious", detail="C&C") + zrow(uid="C3", label="-") + zrow(ts="x", uid="C4") + zrow() + zrow(uid="C5", host="nohost") + "short\n#close\n")
    e, i, _ = zeek.parse(spark, str(p), "z", "2024-01-01 00:00:00")
    by = {r.source_event_id: r for r in e.collect()}
    assert [by[k].ground_truth_label for k in ("C1", "C2", "C3")] == ["benign", "malicious", "unknown"]
    assert by["C1"].network_bytes == 300 and by["C1"].packet_count == 5 and by["C1"].dst_ip == "2001:db8::1" and by["C2"].attack_category == "C&C"
    assert [r.issue_type for r in i.orderBy("line_no").collect()] == ["invalid_record", "duplicate_source_record", "invalid_record", "malformed_row"]


def test_zeek_without_fields(spark, tmp_path):
    p = tmp_path / "x.log"
    p.write_text("#separator \\x09\n" + zrow())
    e, i, _ = zeek.parse(spark, str(p), "z", "2024-01-01 00:00:00")
    assert e.count() == 0 and i.count() == 2


def test_uuid_and_digests(spark, tmp_path):
    import uuid

    r = spark.createDataFrame([("a é",), ("",)], "x string").select("x", ids.uuid5(F.col("x"), ids.EVENTS).alias("u")).collect()
    assert all(x.u == str(uuid.uuid5(ids.EVENTS, x.x)) for x in r)
    (tmp_path / "f").write_bytes(b"abc")
    assert lines.file_digests(spark, str(tmp_path / "f")).first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_times_and_numbers(spark):
    rows = spark.createDataFrame([("2011/08/18 15:00:00",), ("2011-08-18T15:00:00+00:00",), ("no",)], "t string").select(F.unix_seconds(P.to_utc(F.col("t"), "Europe/Prague")).alias("s")).collect()
    assert rows[1].s - rows[0].s == 7200 and rows[2].s is None
    n = spark.createDataFrame([("1.0",), ("7",), ("1_0",)], "t string").select(P.to_int(F.col("t")).alias("i"), P.to_float(F.col("t")).alias("f")).collect()
    assert [x.i for x in n] == [None, 7, None] and [x.f for x in n] == [1.0, 7.0, None]


def test_contracts_and_manifest(spark, tmp_path):
    e, _, (df, _, _) = parsed(spark, tmp_path, ROW, OTHER)
    assert contracts.violations(df, contracts.event_checks() | contracts.label_checks()).where("size(violations) > 0").count() == 0
    bad = df.withColumn("src_port", F.lit(70000).cast("long")).withColumn("label_source", F.lit(None).cast("string"))
    v = contracts.violations(bad, contracts.event_checks() | contracts.label_checks()).first().violations
    assert set(v) == {"src_port_range", "known_label_without_source"}
    m = sinks.manifest(lines.file_digests(spark, str(tmp_path / "a.binetflow")), df, "flows", "1", "test")
    assert contracts.violations(m, contracts.manifest_checks()).first().violations == [] and m.first().record_count == 2
    sinks.write_events(df, BINETFLOW_EVENTS, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_directives_change_across_splits(spark, tmp_path):
    """Separator and fields change inside a file that is read in many splits; each line obeys what is in force, and lines are not shuffled."""
    blocks = [("\\x09", "\t", ["ts", "uid", "proto"]), (",", ",", ["uid", "ts", "proto", "service"]), ("\\x09", "\t", ["proto", "uid", "ts"])]
    lines, want, n = [], {}, 0
    for k, (shown, sep, fields) in enumerate(blocks * 3):
        lines += [f"#separator {shown}", sep.join(["#fields", *fields]) if sep == "\t" else "#fields " + sep.join(fields)]
        for _ in range(200):
            n += 1
            cells = {"ts": f"{n}.5", "uid": f"C{n}", "proto": f"p{k}", "service": f"s{n}"}
            lines.append(sep.join(cells[f] for f in fields))
            want[f"C{n}"] = (f"p{k}", f"s{n}" if "service" in fields else None)
    (tmp_path / "conn.log").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        events, issues, _ = zeek.parse(spark, str(tmp_path), "z", "2024-01-01 00:00:00")
        got = {r.source_event_id: (r.protocol, r.service) for r in events.collect()}
        plan = events._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and issues.isEmpty()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_zeek_columns_are_made_once(spark, tmp_path):
    """Each step's columns stand behind a barrier, so that the plan doesn't make a field again wherever it is read."""
    from flowscope.sources import zeek

    (tmp_path / "conn.log").write_text("#separator \\x09\n#fields\tts\tuid\tid.orig_p\n1.0\tC1\t80\n")
    rows = zeek.parse(spark, str(tmp_path / "conn.log"), "z", "2024-01-01 00:00:00")[2]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(array(struct(") >= 3
    assert rows.select("src_port", "source_event_id").first() == (80, "C1")
