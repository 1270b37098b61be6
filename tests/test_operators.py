import numpy as np
from pyspark.sql import functions as F

from fleetlens.functions.exprs import lsn_to_long, sanitize
from fleetlens.functions.graph import lock_tree, root_of
from fleetlens.functions.windows import with_shares
from fleetlens.operators import health, hot, logs, maintenance, workload
from fleetlens.sources import snapshots
from fleetlens.streaming import incidents
from fleetlens.streaming.segments import Carry, SpikeConfig, Stretch, events_in
from fleetlens.streaming.triggers import spike_events, spike_stream

CFG = SpikeConfig(window_s=1800, percent=50, duration_s=120, coverage=0.7)


def replay(values, every=30):
    t = np.arange(len(values)) * float(every)
    return [{"onset": e[1], "at": e[2], "peak": e[3], "coverage": e[4]} for e in events_in(Stretch(t, np.array(values, float), 0, CFG), Carry())]


def test_sustained_spike_fires_once():
    events = replay([10] * 60 + [20] * 12)
    assert len(events) == 1
    assert (events[0]["peak"], events[0]["coverage"]) == (20, 1.0)


def test_flapping_never_fires():
    assert replay([10] * 60 + [20, 5, 5, 5] * 10) == []


def test_stream_and_batch_agree(spark, tmp_path):
    samples = [("a", 1_700_000_000 + 30 * i, v) for i, v in enumerate([10] * 60 + [20] * 12)]
    df = spark.createDataFrame(samples, "instance string, t long, active long").select("instance", F.timestamp_seconds("t").alias("ts"), "active")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spike_events(df, CFG).collect()
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = spike_stream(stream, CFG).writeStream.format("memory").queryName("spikes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("spikes").collect() == batch != []


def test_spikes_against_a_plain_replay(spark):
    import random

    dice = random.Random(3)
    values = [dice.choice([8, 10, 12] if i // 40 % 2 else [10, 14, 15, 16, 21, 30]) for i in range(400)]
    cfg = SpikeConfig(window_s=900, percent=30, duration_s=120, coverage=0.6, floor=9, min_gap_s=1000)
    want, onset, last, highs = [], None, None, []
    for i, v in enumerate(values):
        before = [values[j] for j in range(max(0, i - 30), i)]
        if not before:
            continue
        mean = sum(before) / len(before)
        if mean < 9:
            onset, highs = None, []
            continue
        if onset is not None and 30 * (i - onset) > 480:
            onset, highs = None, []
        if v >= mean * 130 / 100:
            onset, highs = (i if onset is None else onset), [*highs, i]
        elif onset is None or 30 * (i - highs[-1]) > 60:
            onset, highs = None, []
            continue
        share = len(highs) / (i - onset + 1)
        if 30 * (i - onset) >= 120 and share >= 0.6 and (last is None or 30 * (i - last) >= 1000):
            want.append((30 * onset, 30 * i, max(values[j] for j in highs), share))
            onset, highs, last = None, [], i
    df = spark.createDataFrame([("a", 30 * i, v) for i, v in enumerate(values)], "instance string, t long, active long").select("instance", F.timestamp_seconds("t").alias("ts"), "active")
    assert len(want) >= 3 and [(r.onset, r.at, r.peak, r.coverage) for r in spike_events(df, cfg).orderBy("at").collect()] == want


def test_templates_and_severities_of_logs(spark):
    rows = [(1, "LOG", "duration: 656ms  of 2E/28E36B88"), (2, "log", "duration:\u00a0698ms of 2E/1"), (3, None, "deadbeef 'a b' 0xFF x1"), (4, "weird", "deadbeef 'c' 0x0 x2"), (5, "fatal", "duration: 1.5ms of 0/0")]
    got = logs.log_groups(spark.createDataFrame(rows, "t long, severity string, text string").withColumn("ts", F.timestamp_seconds("t")))
    assert {(r.template, r.n, r.severity) for r in got.collect()} == {("duration: <*>ms of <*>", 3, "fatal"), ("deadbeef <*> <*> x<*>", 2, "weird")}


def test_pages_of_events_lose_nothing(spark):
    events = spark.createDataFrame([(i, 100 + i // 4, "c", "k", "ok") for i in range(20)], "event_id long, t long, cluster string, kind string, outcome string").withColumn("ts", F.timestamp_seconds("t"))
    seen, last = [], None
    while page := snapshots.trigger_events(events, 3, after=last).select("event_id", F.col("ts").cast("string").alias("ts")).collect():
        seen, last = seen + [r.event_id for r in page], (page[-1].ts, page[-1].event_id)
    assert seen == list(range(19, -1, -1))


def test_anchors_of_equal_times(spark):
    old = spark.createDataFrame([("a", 5, 1), ("b", 9, 2)], "k string, captured_at int, v int")
    new = spark.createDataFrame([("a", 5, 3), ("a", 5, 2), ("b", 8, 9)], "k string, captured_at int, v int")
    assert {tuple(r) for r in snapshots.upsert_anchors(old, new, ["k"]).collect()} == {("a", 5, 3), ("b", 9, 2)}


def test_shares_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 30), (None, 2, 10), ("x", 1, 60), ("y", 1, 0)], "d string, q int, m int")
    got = {(r.d, r.q): (r.m_pct, r.m_total_pct) for r in with_shares(df, ["m"], ["d"], []).collect()}
    assert got == {(None, 1): (75.0, 30.0), (None, 2): (25.0, 10.0), ("x", 1): (100.0, 60.0), ("y", 1): (None, 0.0)}


def test_sanitize(spark):
    got = spark.range(1).select(sanitize(F.lit("create role a password 'secret'; postgres://u:pw@h/db")).alias("x")).first().x
    assert "secret" not in got and "pw@" not in got


def test_lsn(spark):
    assert spark.range(1).select(lsn_to_long(F.lit("1/A")).alias("x")).first().x == (1 << 32) + 10


def test_root_of_and_cycle(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1)], "child int, parent int")
    assert {(r.child, r.root, r.level) for r in root_of(edges).collect()} == {(5, 1, 4), (4, 1, 3), (3, 1, 2), (2, 1, 1)}
    waits = spark.createDataFrame([(0, 2, 1), (0, 3, 2), (0, 7, 8), (0, 8, 7)], "k int, pid int, blocker int")
    assert {(r.pid, r.root, r.level) for r in lock_tree(waits, ["k"]).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2)}


def test_forests_and_trees_of_any_depth(spark):
    chain = spark.createDataFrame([(0, i + 1, i) for i in range(1, 151)], "k int, pid int, blocker int")
    edges = chain.selectExpr("pid as child", "blocker as parent")
    assert {(r.child, r.root, r.level) for r in root_of(edges).collect()} == {(i + 1, 1, i) for i in range(1, 151)}
    short = chain.where("pid <= 31")
    assert {(r.pid, r.root, r.level) for r in lock_tree(short, ["k"]).collect()} == {(i, 1, i - 1) for i in range(1, 32)}
    cycle = root_of(spark.createDataFrame([(1, 2), (2, 1), (3, 1), (5, 6)], "child int, parent int"))
    assert {tuple(r) for r in cycle.collect()} == {(1, None, None), (2, None, None), (3, None, None), (5, 6, 1)}
    assert {(r.pid, r.blocked) for r in lock_tree(short, ["k"]).collect()} == {(i, 31 - i) for i in range(1, 32)}
    assert root_of(chain.limit(0).selectExpr("pid as child", "blocker as parent")).count() == 0


def test_a_chain_of_a_thousand(spark):
    edges = spark.range(1, 1001).selectExpr("cast(id + 1 as int) as child", "cast(id as int) as parent")
    assert root_of(edges).where("root <> 1 or level <> child - 1").count() == 0


def test_blocked_pairs_keeps_unmatched(spark):
    schema = "k int, pid int, locktype string, relation int, transactionid int, lock_database int, granted boolean"
    locks = spark.createDataFrame([(0, 1, "r", 9, None, None, True), (0, 2, "r", 9, None, None, False), (0, 3, "r", 8, None, None, False)], schema)
    assert {tuple(r) for r in workload.blocked_pairs(locks, ["k"]).collect()} == {(0, 2, 1), (0, 3, None)}


def test_snapshot_round_trip(spark, tmp_path):
    report = spark.createDataFrame([("s1", "2024-01-01", 1, "select 1"), ("s1", "2024-01-01", 2, "select 1")], "snapshot_id string, dt string, queryid int, query string")
    path = str(tmp_path / "snap")
    snapshots.write_snapshot(report, path)
    snapshots.write_snapshot(report.withColumn("snapshot_id", F.lit("s2")), path)
    assert spark.read.parquet(f"{path}/texts").count() == 1
    assert {r["query"] for r in snapshots.read_snapshot(spark, path, "s2").collect()} == {"select 1"}


def test_score_of_a_healthy_and_a_critical_host(spark):
    names = ["conn_total", "conn_max", "idle_in_tx", "longest_tx_s", "cache_hit_pct", "cache_sample", "dead_max_pct", "dead_avg_pct", "bloated_tables", "newpage_ratio", "replicas", "replica_lag_s", "replica_lag_mb", "replicas_lost", "xid_age", "vacuum_overdue_h", "vacuum_backlog", "never_vacuumed", "autovac_off_tables", "stale_stats", "horizon_age", "checkpoints_timed", "checkpoints_req", "lock_waiters", "lock_wait_s", "ungranted", "lock_pool", "deadlocks", "latency_ratio", "seqscan_ratio", "disk_used", "load_per_cpu", "pooler_used", "checksum_failures"]
    base = {n: 0.0 for n in names} | {"conn_max": 100.0, "cache_hit_pct": 99.0, "hot_ratio": 0.9, "xid_age": 1e6}
    flags = {"autovacuum_off": False, "track_counts_off": False, "io_timing_off": False, "in_recovery": False}
    raw = spark.createDataFrame([{"host": "good", **base, **flags}, {"host": "bad", **base, **flags, "xid_age": 2e9}])
    assert {r.host: (r.critical, r.score) for r in health.health_score(raw, ["host"]).collect()} == {"good": (False, 100.0), "bad": (True, 30.0)}


def test_event_log_keeps_errors_and_comes_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ok"), (2, None), (3, "error: no answer"), (4, "empty")], "event_id long, outcome string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart from the checkpoint adds nothing
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        incidents.event_log(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "ok"), (2, "ok"), (3, "error: no answer"), (4, "empty")}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_live_percentile_leaves_broken_hosts_out(spark):
    day = lambda n: F.timestamp_seconds(F.lit(86400 * n))
    was = spark.createDataFrame([("c", "o", "h1", 100, 1, "s"), ("c", "o", "h2", 100, 1, "s"), ("c", "o", "h3", 100, 1, "s"), ("c", "o", "h4", 500, 1, "s")], "class string, object string, host string, value long, stats_reset int, part_sig string").withColumn("captured_at", day(0))
    now = spark.createDataFrame([("c", "o", "h1", 300, 1, "s"), ("c", "o", "h2", 900, 2, "s"), ("c", "o", "h3", 900, 1, "t"), ("c", "o", "h4", 400, 1, "s")], "class string, object string, host string, value long, stats_reset int, part_sig string").withColumn("captured_at", day(2))
    windows = spark.createDataFrame([("c", True), ("c", False)], "class string, complete boolean").withColumns({"from_ts": day(0), "to_ts": F.when(F.col("complete"), day(3)).otherwise(day(9))})
    ladder = spark.createDataFrame([("c", [float(10 * i) for i in range(1, 10)], [95.0, 99.0], 400.0)], "class string, deciles array<double>, upper array<double>, top double")
    row = hot.live_percentile(was, now, windows, ladder, ["class"]).first()
    assert row.per_day == 100.0 and abs(row.percentile - (0.99 + 0.01 * (300 - 99) / (400 - 99))) < 1e-12


def test_settings_of_replication(spark):
    rows = spark.createDataFrame([("synchronous_commit", "on"), ("work_mem", "4MB")], "name string, setting string")
    assert [r.setting for r in maintenance.settings_subset(rows, maintenance.REPLICATION).collect()] == ["on"]


def test_blocked_pairs_are_equi_joins(spark):
    schema = "k int, pid int, locktype string, relation int, transactionid int, lock_database int, granted boolean"
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = workload.blocked_pairs(spark.createDataFrame([], schema), ["k"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
