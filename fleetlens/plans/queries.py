"""Registered queries: each operator over a binding of the driver's tables, with DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.graph import lock_tree, root_of
from fleetlens.operators import health, indexes, logs, series, workload
from fleetlens.plans.bindings import bind, with_views
from fleetlens.plans.registry import QUERIES, SQL, query
from fleetlens.sources import snapshots
from fleetlens.streaming import triggers

METRICS = ["calls", "exec_ms", "n_rows", "wal_bytes"]

_S = ", ".join(f"sum({m}) as {m}" for m in METRICS)
_P = ", ".join(f"100.0::double * {m} / nullif(sum({m}) over (partition by database), 0) as {m}_pct, 100.0::double * {m} / nullif(sum({m}) over (), 0) as {m}_total_pct" for m in METRICS)
_REPORT = f"select database, queryid, {', '.join(f'cast({m} as bigint) as {m}' for m in METRICS)}, {_P} from (select database, queryid, {_S} from statements group by database, queryid)"


@query("w1_contribution_report", with_views("statements", _REPORT))
def w1(spark, d):
    return workload.contribution_report(bind(spark, d, "statements"), METRICS, ["database"])


@query("w2_derive_times", with_views("statements", "select *, plan_ms + exec_ms as total_ms, case when plan_ms + exec_ms >= io_ms then plan_ms + exec_ms - io_ms end as cpu_ms, 100.0::double * blks_hit / nullif(blks_hit + blks_read, 0) as hit_pct from statements"))
def w2(spark, d):
    return workload.derive_times(bind(spark, d, "statements"))


_ANY = " or ".join(f"row_number() over (partition by database order by {m} desc, queryid) <= 10" for m in METRICS)


@query("w3_report_tops", with_views("statements", f"select database, queryid, calls, exec_ms, n_rows, wal_bytes from statements qualify {_ANY} or queryid = 77"))
def w3(spark, d):
    return workload.report_tops(bind(spark, d, "statements").select("database", "queryid", *METRICS), METRICS, ["database"], 10, F.col("queryid") == 77)


_ALL = ["calls", "exec_ms", "io_ms", "plan_ms", "n_rows", "wal_bytes", "blks_hit", "blks_read"]
_TOP = "select queryid, " + ", ".join(f"cast(sum({m}) as bigint) as {m}" for m in _ALL) + " from statements group by queryid order by {} desc, queryid limit 10"


@query("w4_top_by_time", with_views("statements", _TOP.format("exec_ms")))
def w4(spark, d):
    return workload.top_by(bind(spark, d, "statements"), "exec_ms")


@query("w5_top_by_wal", with_views("statements", _TOP.format("wal_bytes")))
def w5(spark, d):
    return workload.top_by(bind(spark, d, "statements"), "wal_bytes")


@query("w6_top_chart", with_views("statements", " union all ".join(f"(select '{m}' as metric, queryid, row_number() over (order by v desc, queryid) as rn, v::double as value, 100.0::double * v::double / sum(v::double) over () as pct from (select queryid, sum({m}) as v from statements group by queryid) qualify rn <= 10)" for m in METRICS)))
def w6(spark, d):
    return workload.top_chart(bind(spark, d, "statements"), METRICS)


@query("w8_exclude_solely", with_views("user_statements", "select queryid, count(*) as n from user_statements group by queryid having count(distinct case when user_name not in ('A') then user_name end) > 0"))
def w8(spark, d):
    rows = bind(spark, d, "user_statements").groupBy("queryid").agg(F.collect_set("user_name").alias("usernames"), F.count("*").alias("n"))
    return workload.exclude_solely(rows, ["A"]).select("queryid", "n")


_CMP = "select coalesce(a.queryid, b.queryid) as queryid, coalesce(a.database, b.database) as database, a.calls as a_calls, a.n_rows as a_n_rows, b.calls as b_calls, b.n_rows as b_n_rows, case when a.queryid is null then 'only_b' when b.queryid is null then 'only_a' else 'both' end as present from snap_a a full join snap_b b on a.queryid = b.queryid and a.database = b.database"


@query("w10_compare", with_views("snap_a snap_b", _CMP))
def w10(spark, d):
    return workload.compare(bind(spark, d, "snap_a"), bind(spark, d, "snap_b"), ["calls", "n_rows"], ["queryid", "database"])


@query("w11_compare_counts", with_views("snap_a snap_b", f"select present, count(*) as n from ({_CMP}) group by present"))
def w11(spark, d):
    return workload.compare_counts(w10(spark, d))


@query("w14_blocked_pairs", with_views("locks", "select distinct w.cluster, w.pid, o.pid as blocker from locks w left join locks o on w.cluster = o.cluster and w.pid <> o.pid and (w.transactionid = o.transactionid or w.relation = o.relation) where not w.granted"))
def w14(spark, d):
    rows = bind(spark, d, "locks").withColumns({"locktype": F.lit("relation"), "lock_database": F.lit(None).cast("long")})
    return workload.blocked_pairs(rows, ["cluster"])


@query("w16_fold_workload", with_views("entries", "select case when fingerprint = '' then concat('#', host, '#', queryid) else fingerprint end as fold, cast(sum(calls) as bigint) as calls, cast(sum(exec_ms) as bigint) as exec_ms, count(distinct host) as hosts, count(distinct queryid) as ids, max_by(query, {'l': length(query), 'q': query}) as query from entries group by 1"))
def w16(spark, d):
    return workload.fold_workload(bind(spark, d, "entries"))


@query("w17_advisor_workload", with_views("user_statements", "select queryid, cast(sum(calls) as bigint) as calls, cast(sum(exec_ms) as bigint) as exec_ms, max(query) as query from user_statements where user_name is null or user_name <> 'A' group by queryid order by exec_ms desc, queryid limit 500"))
def w17(spark, d):
    return workload.advisor_workload(bind(spark, d, "user_statements").withColumnRenamed("user_name", "user"), ["A"])


@query("s6_list_snapshots", with_views("stat_indexes", "select index_id as snapshot_id, string_agg(distinct cast(host as varchar), ',' order by cast(host as varchar)) as databases, count(*) as n from stat_indexes group by index_id"))
def s6(spark, d):
    return snapshots.list_snapshots(bind(spark, d, "stat_indexes").select(F.col("index_id").alias("snapshot_id"), F.col("host").alias("database")))


@query("s9_asof", with_views("samples", "select e.event_id as probe_id, e.user_id, e.ts, s.writes from events e asof left join (select user_id, day::timestamp as ts, writes from samples) s on e.user_id = s.user_id and e.ts >= s.ts"))
def s9(spark, d):
    snaps = bind(spark, d, "samples").select("user_id", F.col("day").cast("timestamp").alias("ts"), "writes")
    probes = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("probe_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return snapshots.asof(probes, snaps, ["user_id"], "ts", "writes")


@query("s10_previous", with_views("samples", "select user_id, strftime(day, '%Y-%m-%d') as day, strftime(lag(day) over (partition by user_id order by day), '%Y-%m-%d') as previous_at from samples"))
def s10(spark, d):
    return snapshots.previous(bind(spark, d, "samples").select("user_id", "day"), ["user_id"], "day").withColumns({c: F.col(c).cast("string") for c in ("day", "previous_at")})


@query("s11_retention", with_views("storage_days", "select cluster, strftime(dt, '%Y-%m-%d') as dt, cast(held as bigint) as held from (select *, sum(bytes) over (partition by cluster order by dt desc) as held, row_number() over (partition by cluster order by dt desc) as age from storage_days) where held > 900000 and age > 7"))
def s11(spark, d):
    return snapshots.retention_by_bytes(bind(spark, d, "storage_days"), ["cluster"], 900_000, 7).withColumn("dt", F.col("dt").cast("string"))


@query("s14_trigger_summary", with_views("trigger_log", "select cluster, kind, count(*) as n, count(*) filter (outcome = 'ok') as n_ok, count(*) filter (outcome <> 'ok') as n_failed, max(ts) as last_at from trigger_log group by cluster, kind"))
def s14(spark, d):
    return snapshots.trigger_summary(bind(spark, d, "trigger_log"), ["cluster", "kind"])


@query("i3_index_caching", with_views("stat_indexes", "select host, index_id, coalesce(1.0::double * idx_blks_hit / nullif(idx_blks_hit + idx_blks_read, 0), 0.0) as hit from stat_indexes"))
def i3(spark, d):
    return indexes.index_caching(bind(spark, d, "stat_indexes")).select("host", "index_id", "hit")


@query("i4_index_hit_rate", with_views("stat_indexes", "select host, 1.0::double * sum(idx_blks_hit) / nullif(sum(idx_blks_hit) + sum(idx_blks_read), 0) as hit_rate from stat_indexes group by host"))
def i4(spark, d):
    return indexes.hit_rate(bind(spark, d, "stat_indexes"), ["host"], "idx_blks_hit", "idx_blks_read")


@query("i6_missing_indexes", with_views("stat_tables", "select relid, cast(100 * idx_scan // (seq_scan + idx_scan) as bigint) as idx_pct from stat_tables where seq_scan + idx_scan > 0 and 100 * idx_scan // (seq_scan + idx_scan) < 70 and n_live_tup >= 10000"))
def i6(spark, d):
    return indexes.missing_indexes(bind(spark, d, "stat_tables"), 70).select("relid", "idx_pct")


@query("i11_unused", with_views("stat_indexes", "select host, index_id, idx_scan from stat_indexes where idx_scan <= 0 and not is_unique and index_id not in (select o_custkey from orders where o_orderstatus = 'P')"))
def i11(spark, d):
    locks = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("index_id"), F.lit("AccessExclusiveLock").alias("mode"), F.lit(True).alias("granted"))
    return indexes.unused(bind(spark, d, "stat_indexes").withColumnRenamed("is_unique", "unique"), 0, locks, ["index_id"]).select("host", "index_id", "idx_scan")


@query("i12_unused_cluster", with_views("stat_indexes", "select index_id, max(idx_scan) as idx_scan, cast(max(size_bytes) as bigint) as size_bytes from stat_indexes group by index_id having max(idx_scan) <= 2"))
def i12(spark, d):
    return indexes.unused_cluster(bind(spark, d, "stat_indexes"), 2, ["index_id"])


@query("i13_unused_verdict", with_views("index_windows edges", f"""
  select index_id as "index", cast(scans as bigint) as scans, per_day, days, hosts,
    case when per_day >= 2.5 then 'used' when hosts < 25 then 'unknown' when days < 3.0 then 'insufficient_data' when scans > 0 then 'stale_evidence' else 'drop_candidate' end as verdict
  from (select index_id, max(scans / greatest(days, 1 / 24)) as per_day, sum(scans) as scans, min(days) as days, count(distinct host) as hosts
    from (select coalesce(r.root, w.index_id) as index_id, w.host, sum(w.idx_scan) as scans, min(cast(w.span as double)) as days
      from index_windows w left join (select child, cast(floor(child / pow(10, length(cast(child as varchar)) - 1)) as bigint) as root from edges) r on r.child = w.index_id group by 1, 2) group by index_id)"""))
def i13(spark, d):
    group = lambda c: F.substring(F.col(c).cast("string"), 1, 1).alias("k")  # noqa: E731  (an index and its root begin with the same digit)
    rows = bind(spark, d, "index_windows").select(group("index_id"), F.col("index_id").alias("index"), "host", "idx_scan", F.datediff(F.date_add(F.lit("1992-01-01").cast("date"), F.expr("extract(day from span)").cast("int")), F.lit("1992-01-01").cast("date")).cast("double").alias("window_days"))
    groups = F.array(*(F.lit(str(k)) for k in range(10)))
    expected = spark.read.parquet(f"{d}/nation.parquet").select(F.explode(groups).alias("k"), F.col("n_nationkey").alias("host"))
    edges = bind(spark, d, "edges").withColumn("k", group("child"))
    return indexes.unused_verdict(rows, edges, expected, ["k"], 3.0, 2.5).drop("k")


@query("i14_index_usage", with_views("stat_tables", "select relid, 100.0::double * idx_scan / nullif(seq_scan + idx_scan, 0) as idx_pct from stat_tables"))
def i14(spark, d):
    return indexes.index_usage(bind(spark, d, "stat_tables")).select("relid", "idx_pct")


@query("i15_root_of", with_views("edges", "select child, root, level from (with recursive up as (select child, parent as root, 1 as level from edges union all select up.child, e.parent, up.level + 1 from up join edges e on e.child = up.root) select child, arg_max(root, level) as root, max(level) as level from up group by child)"))
def i15(spark, d):
    return root_of(bind(spark, d, "edges"))


_PCT = lambda a, b, n: f"100.0::double * {a} / nullif({b}, 0) as {n}"
_W = "n_tup_ins + n_tup_upd + n_tup_del"


@query("t2_stat_info", with_views("stat_tables", f"select relid, {_PCT('n_tup_ins', _W, 'ins_pct')}, {_PCT('n_tup_upd', _W, 'upd_pct')}, {_PCT('n_tup_del', _W, 'del_pct')}, {_PCT('n_tup_hot_upd', 'n_tup_upd', 'hot_pct')}, {_PCT('seq_scan', 'seq_scan + idx_scan', 'seq_pct')}, {_PCT('idx_scan', 'seq_scan + idx_scan', 'idx_pct')} from stat_tables"))
def t2(spark, d):
    return indexes.stat_info(bind(spark, d, "stat_tables")).select("relid", "ins_pct", "upd_pct", "del_pct", "hot_pct", "seq_pct", "idx_pct")


@query("t5_partition_sizes", with_views("edges", "select parent, count(*) as children, cast(sum(p_size) as bigint) as total_bytes, avg(p_size) as avg_bytes from edges join part on child = p_partkey group by parent"))
def t5(spark, d):
    sizes = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("oid"), F.col("p_size").cast("long").alias("size_bytes"))
    return indexes.partition_sizes(bind(spark, d, "edges"), sizes)


_DUE = "select *, n_dead_tup > 50 + 0.2e0 * least(reltuples, n_live_tup) or n_ins_since_vacuum > 1000 + 0.2e0 * least(reltuples, n_live_tup) as v, n_mod_since_analyze > 50 + 0.1e0 * least(reltuples, n_live_tup) as a from stat_tables"


@query("m2_autovac_summary", with_views("stat_tables", f"select database, count(*) filter (v and not a) as vacuum_only, count(*) filter (a and not v) as analyze_only, count(*) filter (v and a) as both, count(*) filter (v or a) as total from ({_DUE}) group by database"))
def m2(spark, d):
    settings = {"vacuum_base": 50.0, "vacuum_factor": 0.2, "insert_base": 1000.0, "insert_factor": 0.2, "analyze_base": 50.0, "analyze_factor": 0.1}
    rows = bind(spark, d, "stat_tables").withColumns({k: F.lit(v) for k, v in settings.items()})
    return indexes.autovac_summary(indexes.autovac_due(rows), ["database"])


@query("c2_connection_states", with_views("sessions", "select state, count(*) as n from sessions group by state"))
def c2(spark, d):
    return indexes.count_by(bind(spark, d, "sessions"), ["state"])


@query("c4_wait_events", with_views("sessions", "select wait_event, count(*) as n from sessions where state <> 'idle' group by wait_event"))
def c4(spark, d):
    return indexes.count_by(bind(spark, d, "sessions"), ["wait_event"], F.col("state") != "idle")


@query("c5_lock_tree", with_views("waits", """
  , tree as (with recursive t as (
      select distinct cluster, blocker as pid, blocker as root, 0 as level, [blocker] as path from waits w where not exists (select 1 from waits x where x.cluster = w.cluster and x.pid = w.blocker)
      union all select w.cluster, w.pid, t.root, t.level + 1, list_append(t.path, w.pid) from t join waits w on w.cluster = t.cluster and w.blocker = t.pid where not list_contains(t.path, w.pid)) select * from t),
  below as (select cluster, up as pid, count(distinct pid) as blocked from (select cluster, pid, unnest(path) as up from tree) where up <> pid group by 1, 2)
  select t.cluster, t.pid, root, level, array_to_string(path, '>') as path, coalesce(blocked, 0) as blocked from tree t left join below b on b.cluster = t.cluster and b.pid = t.pid"""))
def c5(spark, d):
    return lock_tree(bind(spark, d, "waits"), ["cluster"]).withColumn("path", F.array_join("path", ">"))


_BASE = "(select target, signal, extract(dow from ts) * 24 + extract(hour from ts) as how, median(value) as median, count(*) as n from series where concat(target, signal) in (select concat(target, signal) from series group by target, signal having count(*) >= {}) group by target, signal, how)"
_AT = "s.target = b.target and s.signal = b.signal and extract(dow from s.ts) * 24 + extract(hour from s.ts) = b.how"


@query("x4_seasonal_baseline", with_views("series", f"select * from {_BASE.format(100)}"))
def x4(spark, d):
    return series.seasonal_baseline(bind(spark, d, "series"), 100)


@query("x7_dips", with_views("series", f"select s.target, s.signal, s.ts, s.value, b.median as baseline from series s join {_BASE.format(50)} b on {_AT} where b.median - s.value > 2"))
def x7(spark, d):
    rows = bind(spark, d, "series")
    return series.dips(rows, series.seasonal_baseline(rows, 50), 2.0)


@query("x2_pivot_signals", with_views("series", "select target, ts, " + ", ".join(f"max(case when signal = '{s}' then value end) as \"{s}\"" for s in ("click", "error", "purchase", "signup", "view")) + " from series group by target, ts"))
def x2(spark, d):
    return series.pivot_signals(bind(spark, d, "series"), ["click", "error", "purchase", "signup", "view"])


@query("k3_counter_delta", with_views("samples", "select user_id, strftime(day, '%Y-%m-%d') as day, cast(reads - r as bigint) as d_reads, cast(writes - w as bigint) as d_writes, reads >= r and writes >= w as valid from (select *, coalesce(lag(reads) over o, 0) as r, coalesce(lag(writes) over o, 0) as w from samples window o as (partition by user_id order by day))"))
def k3(spark, d):
    return series.counter_delta(bind(spark, d, "samples"), ["user_id"], "day", ["reads", "writes"]).withColumn("day", F.col("day").cast("string"))


@query("k7_top_objects", with_views("objects", "select class, object, cast(value as bigint) as value, row_number() over (partition by class order by value desc, object) as rn from objects where value > 0 qualify rn <= 20"))
def k7(spark, d):
    return series.top_objects(bind(spark, d, "objects"), ["class"], 20)


@query("k8_tail_histogram", with_views("objects", "select class, q::double as q, value from (select class, cast(value as bigint) as value, row_number() over (partition by class order by value) as r, count(*) over (partition by class) as n from (select *, row_number() over (partition by class order by value desc, object) as rn from objects) where rn > 20) join (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]) as q) on r = greatest(1, ceil(q::double * n - 1e-9))"))
def k8(spark, d):
    return series.tail_histogram(bind(spark, d, "objects"), ["class"], 20)


@query("k9_coverage", with_views("objects", "select class, case when sum(value) > 0 then sum(case when rn <= 20 then value else 0 end)::double / sum(value)::double else 1.0 end as coverage from (select *, row_number() over (partition by class order by value desc, object) as rn from objects) group by class"))
def k9(spark, d):
    return series.coverage(bind(spark, d, "objects"), ["class"], 20)


@query("z1_activity_baseline", with_views("activity", "select instance, ts, active, case when n >= 2 then (total - active)::double / (n - 1) end as baseline from (select *, count(*) over w as n, sum(active) over w as total from activity window w as (partition by instance order by ts range between interval 6 hours preceding and current row))"))
def z1(spark, d):
    return triggers.with_activity_baseline(bind(spark, d, "activity"), ["instance"], 6 * 3600)


@query("z2_spike_events")
def z2(spark, d):
    return triggers.spike_events(bind(spark, d, "activity"), triggers.SpikeConfig(6 * 3600, 20, 3600, 0.5))


@query("z4_role_changes", with_views("roles", "select instance, pos, ts, in_recovery, direction from (select *, case when was and not in_recovery then 'promoted' when not was and in_recovery then 'demoted' end as direction from (select *, lag(in_recovery) over (partition by instance order by ts, pos) as was from roles)) where direction is not null"))
def z4(spark, d):
    return triggers.role_changes(bind(spark, d, "roles"), ["instance"], ["ts", "pos"])


# what a template masks, said in the order and the words of the SQL
_MASK = "trim(regexp_replace(text, '[\\s\\x{85}\\p{Z}]+', ' ', 'g'))"
for _p in ("''[^'']*''|\"[^\"]*\"", "\\b[[:xdigit:]]+/[[:xdigit:]]+\\b", "\\b0x[[:xdigit:]]+\\b", "[0-9]+([.][0-9]+)?"):
    _MASK = f"regexp_replace({_MASK}, '{_p}', '<*>', 'g')"


@query("e1_log_search", with_views("logs", "select event_id from logs where severity in ('ERROR', 'WARNING') and text ilike '%user 1%' and text not ilike '%\"k\": 2%'"))
def e1(spark, d):
    return logs.log_search(bind(spark, d, "logs"), ["User 1"], ['"k": 2'], ["ERROR", "WARNING"]).select("event_id")


@query("e3_log_groups", with_views("logs", f"""
  select template, count(*) as n, min(ts) as first_seen, max(ts) as last_seen, max_by(text, {{'t': ts, 'x': text}}) as latest, max_by(severity, {{'r': rank, 's': severity}}) as severity
  from (select *, {_MASK} as template, case upper(severity) when 'PANIC' then 8 when 'FATAL' then 7 when 'ERROR' then 6 when 'WARNING' then 5 when 'NOTICE' then 4 when 'LOG' then 3 when 'INFO' then 2 when 'DEBUG' then 1 else 0 end as rank from logs) group by template"""))
def e3(spark, d):
    return logs.log_groups(bind(spark, d, "logs"))


@query("e4_log_histogram", with_views("logs", "select cast(floor((epoch(date_trunc('second', ts)) - t0) / w) as bigint) as bucket, severity, count(*) as n from logs, (select t0, greatest(1, ceil((t1 - t0 + 1) / 40)) as w from (select min(epoch(date_trunc('second', ts))) as t0, max(epoch(date_trunc('second', ts))) as t1 from logs)) group by all"))
def e4(spark, d):
    return logs.log_histogram(bind(spark, d, "logs"))


@query("h14_health_score")
def h14(spark, d):
    return health.health_score(bind(spark, d, "raw"), ["instance", "mon"])


_AT_LEAST = "case when {0} >= {1} then 'HIGH' when {0} >= {2} then 'MEDIUM' when {0} >= {3} then 'LOW' end"
_BELOW = _AT_LEAST.replace(">=", "<")
_POINTS = "(checkpoints_timed + checkpoints_req)"
# (rule, category, condition, shown value, severity), written apart from the operator's table
_RULES = [
    ("high_connection_ratio", "connections", "conn_max > 0", "conn_total::double / conn_max", _AT_LEAST.format("conn_total::double / conn_max", 0.95, 0.80, 0.60)),
    ("idle_in_transaction", "connections", "true", "idle_in_tx", _AT_LEAST.format("idle_in_tx", 10, 5, 2)),
    ("long_running_transaction", "connections", "true", "longest_tx_s", _AT_LEAST.format("longest_tx_s", 1800, 600, 300)),
    ("low_cache_hit_ratio", "performance", "cache_sample = 0 or cache_sample >= 50000", "cache_hit_pct", _BELOW.format("cache_hit_pct", 85, 90, 95)),
    ("high_max_dead_ratio", "storage", "true", "dead_max_pct", _AT_LEAST.format("dead_max_pct", 30, 20, 10)),
    ("high_avg_dead_ratio", "storage", "true", "dead_avg_pct", _AT_LEAST.format("dead_avg_pct", 25, 15, 5)),
    ("many_bloated_tables", "storage", "true", "bloated_tables", _AT_LEAST.format("bloated_tables", 20, 10, 5)),
    ("replication_lag_time", "replication", "replicas <> 0", "replica_lag_s", _AT_LEAST.format("replica_lag_s", 30, 5, 1)),
    ("replication_lag_bytes", "replication", "replicas <> 0", "replica_lag_mb * 1048576", _AT_LEAST.format("replica_lag_mb", 1024, 100, 10)),
    ("disconnected_replicas", "replication", "true", "replicas_lost", "case when replicas_lost >= 2 then 'HIGH' when replicas_lost > 0 then 'MEDIUM' end"),
    ("xid_wraparound_risk", "maintenance", "not in_recovery", "xid_age", _AT_LEAST.format("xid_age", 1600000000, 200000000, 150000000)),
    ("stale_vacuum", "maintenance", "not in_recovery", "vacuum_overdue_h", _AT_LEAST.format("vacuum_overdue_h / 24e0", 60, 21, 7)),
    ("vacuum_backlog", "maintenance", "not in_recovery", "vacuum_backlog", _AT_LEAST.format("vacuum_backlog", 30, 15, 6)),
    ("tables_never_vacuumed", "maintenance", "not in_recovery", "never_vacuumed", _AT_LEAST.format("never_vacuumed", 5, 2, 1)),
    ("autovacuum_disabled", "maintenance", "not in_recovery and autovacuum_off", "0", "'HIGH'"),
    ("track_counts_disabled", "maintenance", "not in_recovery and track_counts_off", "0", "'HIGH'"),
    ("tables_with_autovacuum_off", "maintenance", "not in_recovery and autovac_off_tables > 0", "autovac_off_tables", "'LOW'"),
    ("relfrozenxid_age_outlier", "maintenance", "not in_recovery", "relfrozenxid_age", _AT_LEAST.format("relfrozenxid_age", 1600000000, 200000000, 150000000)),
    ("horizon_lag_xids", "horizon", "true", "horizon_age", _AT_LEAST.format("horizon_age", 100000000, 10000000, 1000000)),
    ("requested_checkpoint_ratio", "wal_checkpoint", f"{_POINTS} >= 10", f"checkpoints_req::double / {_POINTS}", _AT_LEAST.format(f"checkpoints_req::double / {_POINTS}", 0.2, 0.1, 0.05)),
    ("track_io_timing_disabled", "performance", "io_timing_off", "0", "'LOW'"),
    ("active_lock_waiters", "locks", "true", "lock_waiters", _AT_LEAST.format("lock_waiters", 10, 3, 1)),
    ("longest_lock_wait_seconds", "locks", "true", "lock_wait_s", _AT_LEAST.format("lock_wait_s", 60, 30, 10)),
    ("ungranted_locks", "locks", "true", "ungranted", _AT_LEAST.format("ungranted", 15, 5, 2)),
    ("deadlocks_rate", "locks", "deadlocks > 0", "deadlocks", "'LOW'"),
    ("lock_pool_saturation", "locks", "true", "lock_pool", _AT_LEAST.format("lock_pool", 0.8, 0.6, 0.5)),
    ("low_hot_update_ratio", "storage", "true", "hot_ratio", _BELOW.format("hot_ratio", 0.5, 0.65, 0.8)),
    ("high_newpage_update_ratio", "storage", "true", "newpage_ratio", _AT_LEAST.format("newpage_ratio", 0.2, 0.1, 0.05)),
    ("stale_planner_stats", "maintenance", "not in_recovery", "stale_stats", _AT_LEAST.format("stale_stats", 10, 5, 3)),
    ("wal_level_minimal_with_replicas", "wal_checkpoint", "wal_level = 'minimal' and replicas <> 0", "replicas", "'HIGH'"),
    ("wal_level_logical_without_publications", "wal_checkpoint", "wal_level = 'logical' and logical_slots = 0 and not wal_level_managed", "0", "'LOW'"),
    ("checksum_failures", "storage", "checksum_failures > 0", "checksum_failures", "'HIGH'"),
    ("host_cpu_saturation", "connections", "true", "load_per_cpu", _AT_LEAST.format("load_per_cpu", 4, 2, 1)),
    ("pooler_saturation", "connections", "true", "pooler_used", _AT_LEAST.format("pooler_used", 0.8, 0.6, 0.5)),
    ("sequence_exhaustion", "storage", "true", "sequence_used", _BELOW.format("100 * (1 - sequence_used)", 5, 10, 20)),
    ("latency_regression", "performance", "true", "latency_ratio", _AT_LEAST.format("latency_ratio", 6, 3, 1.5)),
    ("seq_scan_regression", "performance", "true", "seqscan_ratio", _AT_LEAST.format("seqscan_ratio", 6, 3, 1.5)),
    ("host_disk_space", "storage", "true", "disk_used", _AT_LEAST.format("disk_used", 0.9, 0.8, 0.7)),
]
_FINDINGS = " union all ".join(f"select instance, mon, '{r}' as rule, '{c}' as category, ({v})::double as value, {s} as severity from raw where ({w}) and {s} is not null" for r, c, w, v, s in _RULES)


@query("h16_rules", with_views("raw", f"select *, row_number() over (partition by instance, mon order by case severity when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, rule) as rn from ({_FINDINGS})"))
def h16(spark, d):
    return health.worst_first(health.evaluate_rules(bind(spark, d, "raw"), ["instance", "mon"]), ["instance", "mon"])


@query("h22_fleet_rank")
def h22(spark, d):
    return health.fleet_rank(h14(spark, d), 20)


from fleetlens.plans import catalog_queries, fleet_queries, late_queries, more_queries  # noqa: E402,F401  (they register themselves)
