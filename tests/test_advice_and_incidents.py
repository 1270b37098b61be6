import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import advisor, health_inputs, maintenance, schema_checks, signals
from fleetlens.sources import snapshots
from fleetlens.streaming import incidents
from fleetlens.streaming.segments import Carry, SpikeConfig, Stretch, events_in

SPIKE = SpikeConfig(window_s=1800, percent=50, duration_s=120, coverage=0.7)
USAGE = "db string, fingerprint string, schema string, table string, column string, role string, desc boolean, seq int"


def play(values, cfg, every=30):
    t = np.arange(len(values)) * float(every)
    return [(e[0], e[2]) for e in events_in(Stretch(t, np.array(values, float), 0, SPIKE), Carry(), cfg)]


def test_recovery_cancels_the_follow_up():
    cfg = incidents.IncidentConfig(recovery_s=120, deferred_s=900, min_gap_s=600)
    kinds = [k for k, _ in play([10] * 60 + [20] * 8 + [10] * 40, cfg)]
    assert kinds == ["activity_spike", "activity_drop"]


def test_follow_up_comes_without_recovery():
    cfg = incidents.IncidentConfig(recovery_s=120, deferred_s=300, min_gap_s=3600)
    assert [k for k, _ in play([10] * 60 + [20] * 20, cfg)] == ["activity_spike", "deferred"]


def test_incident_stream_and_batch_agree(spark, tmp_path):
    values = [10] * 60 + [20] * 8 + [10] * 40
    df = spark.createDataFrame([("a", 1_700_000_000 + 30 * i, v) for i, v in enumerate(values)], "instance string, t long, active long").select("instance", F.timestamp_seconds("t").alias("ts"), "active")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    cfg = incidents.IncidentConfig(120, 900, 600)
    stream = incidents.incident_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), SPIKE, cfg)
    q = stream.writeStream.format("memory").queryName("incidents").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("incidents").collect()) == sorted(incidents.incident_events(df, SPIKE, cfg).collect()) != []


def test_debounce_counts_from_the_last_accepted(spark):
    rows = spark.createDataFrame([("h", t, "k") for t in (0, 50, 100, 149, 200, 260)], "h string, t long, kind string").select("h", F.timestamp_seconds("t").alias("ts"), "kind")
    assert sorted(r.ts.timestamp() for r in incidents.debounce(rows, ["h"], 100).select("ts").collect()) == [0, 100, 200]


def test_hot_commit_is_seen_whole(spark, tmp_path):
    a, path = spark.createDataFrame([(1,)], "x int"), str(tmp_path / "hot")
    assert snapshots.newest_version(spark, path) is None
    snapshots.commit_hot(a, a, path, 1)
    a.withColumn("x", F.lit(9)).write.parquet(f"{path}/snapshot/v=2")  # a commit that broke off
    assert snapshots.read_hot(spark, path, "snapshot").first().x == 1
    pinned = snapshots.newest_version(spark, path)
    snapshots.commit_hot(a.withColumn("x", F.lit(2)), a, path, 2)
    assert snapshots.read_hot(spark, path, "snapshot").first().x == 2 and snapshots.read_hot(spark, path, "snapshot", pinned).first().x == 1


def test_a_stream_of_commits_survives_a_kill_between_its_writes(spark, tmp_path, monkeypatch):
    schema = "k string, captured_at timestamp, v long"
    row = lambda k, t, v: (k, t, v)

    def arrive(name, rows):
        frame = spark.createDataFrame(rows, "k string, t long, v long").select("k", F.timestamp_seconds("t").alias("captured_at"), "v")
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / name))

    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    grown = lambda batch, anchors: batch.join(anchors.select("k", F.col("v").alias("was")), "k", "left").selectExpr("k", "v - coalesce(was, 0) as grown")

    def go():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        q = snapshots.commit_stream(stream, ["k"], path, checkpoint, grown).trigger(availableNow=True).start()
        q.awaitTermination(120)

    arrive("a", [row("x", 10, 5), row("y", 10, 1)])
    go()
    arrive("b", [row("x", 20, 9)])
    whole = snapshots.commit_hot

    def broken(snapshot, anchors, to, version):  # the snapshot is written, then the driver is gone
        snapshot.write.mode("overwrite").parquet(f"{to}/snapshot/v={version}")
        raise RuntimeError("killed")

    monkeypatch.setattr(snapshots, "commit_hot", broken)
    with pytest.raises(Exception):
        go()
    assert snapshots.newest_version(spark, path) == 0 and {(r.k, r.v) for r in snapshots.read_hot(spark, path, "anchors").collect()} == {("x", 5), ("y", 1)}
    monkeypatch.setattr(snapshots, "commit_hot", whole)
    go()
    assert {(r.k, r.v) for r in snapshots.read_hot(spark, path, "anchors").collect()} == {("x", 9), ("y", 1)}
    assert {(r.k, r.grown) for r in spark.read.parquet(f"{path}/report/v=1").collect()} == {("x", 4)}  # against the anchors before, once
    assert sorted((r.version, r.outcome) for r in snapshots.read_outcomes(spark, path).collect()) == [(0, "ok"), (1, "ok")]


def test_outcomes_of_errors_and_empty_reports(spark, tmp_path):
    spark.createDataFrame([("x", 1)], "k string, v long").select("k", F.timestamp_seconds("v").alias("captured_at"), "v").write.parquet(str(tmp_path / "in"))
    schema = "k string, captured_at timestamp, v long"
    for name, report in (("empty", lambda b, a: b.where("v > 5")), ("error", lambda b, a: b.select("nowhere"))):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        snapshots.commit_stream(stream, ["k"], str(tmp_path / name), str(tmp_path / f"cp-{name}"), report).trigger(availableNow=True).start().awaitTermination(120)
        got = snapshots.read_outcomes(spark, str(tmp_path / name)).collect()
        assert [r.outcome for r in got] == [name] and bool(got[0].error) == (name == "error")


def test_read_logs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"ts": "2024-01-01T00:00:00", "severity": "ERROR", "text": "x", "fields": {"a": "b"}}) + "\nbroken\n")
    assert sorted(str(r.severity) for r in snapshots.read_logs(spark, str(tmp_path)).collect()) == ["ERROR", "None"]


def advisor_tables(spark):
    relations = spark.createDataFrame([("d", 1, "public", "orders", 1_000_000, "r"), ("d", 2, "public", "small", 10, "r"), ("d", 3, "a", "twice", 50_000, "r"), ("d", 4, "b", "twice", 50_000, "r")], "db string, relid long, schema string, table string, rows long, relkind string")
    columns = spark.createDataFrame([("d", 1, "id", 0.0, -1.0, True), ("d", 1, "user_id", 0.0, 5000.0, True), ("d", 1, "status", 0.0, 4.0, True), ("d", 1, "at", 0.0, -0.5, True), ("d", 1, "gone", 0.3, 2.0, True), ("d", 1, "doc", 0.0, 9.0, False)], "db string, relid long, column string, null_frac double, n_distinct double, indexable boolean")
    edges = spark.createDataFrame([], "db string, child long, parent long")
    return relations, columns, edges


def test_advice(spark):
    relations, columns, edges = advisor_tables(spark)
    use = lambda f, *cols, t="orders", s=None: [("d", f, s, t, c, r, False, i) for i, (c, r) in enumerate(cols)]
    usages = spark.createDataFrame(
        use("q1", ("status", "equality"), ("user_id", "equality"), ("at", "range")) + use("q2", ("user_id", "equality"), ("gone", "is_null")) + use("q3", ("id", "equality"), ("status", "equality"))
        + use("q4", ("user_id", "join")) + use("q5", ("x", "equality"), t="small", s="public") + use("q6", ("x", "equality"), t="twice") + use("q7", ("doc", "equality")), USAGE)
    bound = advisor.resolve_tables(usages, relations, edges, ["db"])
    assert {r.reason for r in bound.where("fingerprint = 'q6'").collect()} == {"ambiguous_table"}
    drafts = advisor.draft_keys(advisor.with_column_facts(advisor.split_roles(bound.where("reason is null"), ["db"]), relations, columns, ["db"]))
    got = {r.fingerprint: (r.columns, r.predicate, r.reason) for r in drafts.collect()}
    assert got["q1"] == (["user_id", "status", "at"], [], None)  # the more distinct column first, then the range
    assert got["q2"] == (["user_id"], ["gone"], None)
    assert got["q3"] == (["id"], [], None)  # nothing after a unique column
    assert got["q5"][2] == "table_too_small" and got["q7"][2] == "unsupported_type"
    indexes = spark.createDataFrame([("d", 1, "pk", ["id"], True, True, "btree", [])], "db string, relid long, name string, columns array<string>, unique boolean, valid boolean, method string, predicate array<string>")
    left = advisor.covered(drafts, indexes, ["db"])
    assert {r.fingerprint for r in left.collect()} == {"q1", "q2", "q4"}
    merged = advisor.merge_prefixes(left, ["db"])
    assert {(tuple(r.columns), r.predicate, tuple(r.fingerprints)) for r in merged.collect()} == {(("user_id", "status", "at"), "", ("q1", "q4")), (("user_id",), "gone", ("q2",))}
    work = spark.createDataFrame([("d", "q1", 60, 1), ("d", "q2", 20, 1), ("d", "q4", 20, 1)], "db string, fingerprint string, exec_ms long, calls long")
    ranked = advisor.rank_candidates(advisor.weights(merged, work, ["db"]), ["db"])
    assert [(r.weight_pct, r.rn) for r in ranked.orderBy("rn").collect()] == [(80.0, 1), (20.0, 2)]
    text = {r.predicate: r.ddl for r in advisor.ddl_text(merged, relations, edges, ["db"]).collect()}
    assert text["gone"] == 'CREATE INDEX CONCURRENTLY "orders_user_id_idx" ON "public"."orders" ("user_id") WHERE "gone" IS NULL;'


def test_partition_script_of_nested_partitions(spark):
    names = {1: ("orders", "p"), 2: ("orders_b", "r"), 3: ("orders_a", "p"), 4: ("orders_a_2", "r"), 5: ("orders_a_1", "r"), 6: ("hollow", "p"), 7: ("plain", "r")}
    relations = spark.createDataFrame([("d", i, "public", t, k) for i, (t, k) in names.items()], "db string, relid long, schema string, table string, relkind string")
    edges = spark.createDataFrame([("d", 2, 1), ("d", 3, 1), ("d", 4, 3), ("d", 5, 3)], "db string, child long, parent long")
    cand = spark.createDataFrame([("d", i, "", ["at"]) for i in (1, 6, 7)], "db string, relid long, predicate string, columns array<string>")
    text = {r.relid: r.ddl for r in advisor.ddl_text(cand, relations, edges, ["db"]).collect()}
    only = lambda t: f'CREATE INDEX "{t}_at_idx" ON ONLY "public"."{t}" ("at");'
    leaf = lambda t: f'CREATE INDEX CONCURRENTLY "{t}_at_idx" ON "public"."{t}" ("at");'
    attach = lambda up, t: f'ALTER INDEX "public"."{up}_at_idx" ATTACH PARTITION "public"."{t}_at_idx";'
    assert text[1].split("\n") == [
        only("orders"), only("orders_a"), leaf("orders_a_1"), attach("orders_a", "orders_a_1"), leaf("orders_a_2"), attach("orders_a", "orders_a_2"), attach("orders", "orders_a"), leaf("orders_b"), attach("orders", "orders_b"),
    ]
    assert text[6] == 'CREATE INDEX "hollow_at_idx" ON "public"."hollow" ("at");' and text[7].startswith("CREATE INDEX CONCURRENTLY")
    short = {r.relid: r.ddl for r in advisor.ddl_text(cand, relations, edges, ["db"], most=2).collect()}[1].split("\n")
    assert short[-1] == "-- 2 more partitions are built and attached the same way" and short[-2] == attach("orders", "orders_a")


def test_suppression_by_mask(spark):
    rows = spark.createDataFrame([("a_b", "x"), ("axb", "x"), ("tenant1", "x")], "schema string, code string")
    assert [r.schema for r in schema_checks.suppress(rows, ["a_b", "tenant*"]).collect()] == ["axb"]


def test_raw_metrics_of_a_silent_host_are_neutral(spark):
    empty = lambda s: spark.createDataFrame([], "h string, " + s)
    stamps = ", ".join(f"{c} timestamp" for c in ("last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze", "captured_at"))
    views = {
        "hosts": spark.createDataFrame([("a", False)], "h string, in_recovery boolean"),
        "activity": empty("database string, state string, wait_event_type string, xact_start timestamp, state_change timestamp, captured_at timestamp, backend_xmin_age long"),
        "stat_tables": empty(f"n_live_tup long, n_dead_tup long, n_tup_upd long, n_tup_hot_upd long, n_tup_newpage_upd long, reltuples double, vacuum_due boolean, analyze_due boolean, {stamps}"),
        "statio": empty("heap_blks_hit long, heap_blks_read long"), "replication": empty("state string, replay_lag_s double, replay_lag_bytes long"),
        "classes": empty("relkind string, reloptions map<string,string>, xid_age long"), "settings": empty("name string, setting string"), "checkpoints": empty("timed long, requested long"),
        "locks": empty("granted boolean"), "database_stats": empty("deadlocks long, checksum_failures long"),
    }
    row = health_inputs.raw_metrics(views, ["h"]).first()
    assert (row.cache_hit_pct, row.hot_ratio, row.replicas, row.dead_max_pct, row.conn_total) == (100.0, 1.0, 0, 0.0, 0)


def test_signals_after_a_reset_count_from_zero(spark):
    rows = [("a", "statements_calls", "all", "s", 10 * i, v) for i, v in enumerate([100.0, 110.0, 5.0, 8.0])]
    df = spark.createDataFrame(rows, "h string, metric string, label string, series string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    got = signals.derive_signals(df, ["h"], 60, [("calls", "increase", "statements_calls", "all", 1.0), ("rate", "rate", "statements_calls", "all", 1.0)]).collect()
    assert {r.signal: r.value for r in got} == {"calls": 18.0, "rate": 18.0 / 30}


def test_target_mapping_prefers_the_given(spark):
    hosts = spark.createDataFrame([("c", "a", "static", "e", "p"), ("c", "b", "cloud", "e", "p"), ("c", "x", "cloud", "e", "p")], "cluster string, instance string, source string, env_label string, provider_id string")
    mapping = spark.createDataFrame([("c", "x", "prod", "svc", "h")], "cluster string, instance string, env string, service string, host string")
    assert {r.instance: (r.service, r.service_id, r.host) for r in signals.map_targets(hosts, mapping, ["cluster", "instance"]).collect()} == {"a": (None, None, None), "b": ("c", "p", "b"), "x": ("svc", "svc", "h")}


def test_replication_status_ranks_unknown_last(spark):
    rep = spark.createDataFrame([("k", 1, False, "0/FF", "0/F0"), ("k", 2, True, "0/FF", "0/0"), ("k", 3, False, "0/FF", "0/1")], "k string, pid int, in_recovery boolean, current_lsn string, replay_lsn string")
    slots = spark.createDataFrame([("k", 3, "s3")], "k string, active_pid int, slot_name string")
    got = {r.pid: (r.lag_rank, r.replay_lag_bytes, r.slot_name) for r in maintenance.repl_status(rep, slots, ["k"]).collect()}
    assert got == {3: (1, 254, "s3"), 1: (2, 15, ""), 2: (3, None, "")}


def test_raw_metrics_take_one_exchange(spark):
    from fleetlens.plans.queries import QUERIES

    plan = QUERIES["h1_raw_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    grouped = plan.split("Union")[0]
    assert grouped.count("Exchange hashpartitioning") == 1 and "Join" not in grouped and plan.count("Union") == 1
