"""Registered queries over health inputs, hot objects, signals and activity events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import health, health_inputs, hot, indexes, series, signals, workload
from fleetlens.plans.bindings import bind, with_views
from fleetlens.plans.queries import _AT, _BASE, _FINDINGS
from fleetlens.plans.registry import SQL, query
from fleetlens.sources import snapshots
from fleetlens.streaming import incidents, triggers


def _tables(spark, d):
    settings = {"vacuum_base": 50.0, "vacuum_factor": 0.2, "insert_base": 1000.0, "insert_factor": 0.2, "analyze_base": 50.0, "analyze_factor": 0.1}
    return indexes.autovac_due(bind(spark, d, "stat_tables").withColumns({k: F.lit(v) for k, v in settings.items()}))


@query("h2_raw_per_db", with_views("stat_tables", """
  select database, coalesce(max(dead), 0.0) as dead_max_pct, count(*) filter (dead > 20) as bloated_tables, coalesce(cast(sum(hot) as double) / sum(upd), 1.0) as hot_ratio, count(*) filter (v) as vacuum_backlog,
    count(*) filter (live > 10000) as never_vacuumed, count(*) filter (a and reltuples > 0) as stale_stats, 100.0::double as cache_hit_pct
  from (select *, n_live_tup + n_dead_tup as live, case when n_live_tup + n_dead_tup > 10000 then round(100.0::double * n_dead_tup / (n_live_tup + n_dead_tup), 2) end as dead, case when n_tup_upd * 500 > 1000 then n_tup_hot_upd * 500 end as hot, case when n_tup_upd * 500 > 1000 then n_tup_upd * 500 end as upd,
    n_dead_tup > 50 + 0.2e0 * least(reltuples, n_live_tup) or n_ins_since_vacuum > 1000 + 0.2e0 * least(reltuples, n_live_tup) as v, n_mod_since_analyze > 50 + 0.1e0 * least(reltuples, n_live_tup) as a from stat_tables) group by database"""))
def h2(spark, d):
    never = {c: F.lit(None).cast("timestamp") for c in ("last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze")}
    rows = _tables(spark, d).withColumns({**never, "captured_at": F.lit("2024-01-01").cast("timestamp"), "n_tup_upd": F.col("n_tup_upd") * 500, "n_tup_hot_upd": F.col("n_tup_hot_upd") * 500, "n_tup_newpage_upd": F.lit(0)})
    io = rows.select("database", F.lit(0).alias("heap_blks_hit"), F.lit(0).alias("heap_blks_read"))
    return health_inputs.raw_per_db(rows, io, ["database"]).select("database", "dead_max_pct", "bloated_tables", "hot_ratio", "vacuum_backlog", "never_vacuumed", "stale_stats", "cache_hit_pct")


_WHOLE = "category in ('connections', 'replication', 'horizon', 'wal_checkpoint', 'locks') or rule = 'sequence_exhaustion'"


@query("h17_attribution", with_views("raw", f"select rule, database, count(*) as n from (select rule, case when {_WHOLE} then null else cast(mon as varchar) end as database from ({_FINDINGS})) group by rule, database"))
def h17(spark, d):
    rows = health.evaluate_rules(bind(spark, d, "raw"), ["instance", "mon"]).withColumns({"database": F.col("mon").cast("string"), "hit_database": F.lit(None).cast("string")})
    return health_inputs.attribute(rows).groupBy("rule", "database").agg(F.count("*").alias("n"))


# the penalties of each category, as the oracle has them
_PENALTIES = """
  pen as (select instance, mon, in_recovery, replicas, xid_age, hot_ratio, checksum_failures, disk_used, autovacuum_off, track_counts_off, io_timing_off, latency_ratio, seqscan_ratio, load_per_cpu, pooler_used,
    round(least(100, case when r > 0.95 then 70 + (r - 0.95) / 0.05 * 30 when r > 0.8 then 30 + (r - 0.8) / 0.15 * 40 when r > 0.6 then (r - 0.6) / 0.2 * 30 else 0 end + least(5 * idle_in_tx, 30) + case when longest_tx_s > 300 then least((longest_tx_s - 300) / 60 * 5, 20) else 0 end), 1) as connections,
    round(least(100, case when cache_sample > 0 and cache_sample < 50000 then 0 when c >= 95 then 0 when c >= 90 then (95 - c) / 5 * 20 when c >= 85 then 20 + (90 - c) / 5 * 30 else 50 + (85 - c) / 10 * 50 end), 1) as performance,
    round(least(100, case when dead_max_pct > 30 then 40 when dead_max_pct > 20 then 20 + (dead_max_pct - 20) / 10 * 20 else dead_max_pct end + case when dead_avg_pct > 15 then least((dead_avg_pct - 15) * 2, 30) else 0 end + case when bloated_tables > 5 then least(3 * bloated_tables, 30) else 0 end
      + case when newpage_ratio > 0.2 then 20 when newpage_ratio > 0.1 then 10 when newpage_ratio > 0.05 then 5 else 0 end), 1) as storage,
    case when replicas <= 0 then 0 else round(least(100, case when replica_lag_s > 30 then 50 when replica_lag_s > 5 then 10 + (replica_lag_s - 5) / 25 * 40 when replica_lag_s > 1 then (replica_lag_s - 1) / 4 * 10 else 0 end
      + case when replica_lag_mb > 100 then least(replica_lag_mb / 10, 30) else 0 end + least(30 * replicas_lost, 60)), 1) end as replication,
    round(least(100, case when x > 1.6e9 then 80 + least((x - 1.6e9) / 5e8 * 20, 20) when x > 2e8 then (x - 2e8) / 1.4e9 * 80 else 0 end + case when h > 1440 then 30 when h > 504 then least(15 + (h - 504) / 24 * 0.5, 30) when h > 168 then (h - 168) / 24 else 0 end
      + case when vacuum_backlog > 5 then least((vacuum_backlog - 5) * 1.5, 15) else 0 end + least(5 * never_vacuumed, 20) + least(3 * autovac_off_tables, 15) + least(2 * stale_stats, 15)), 1) as maintenance,
    round(least(100, case when z > 1e8 then 70 + least((z - 1e8) / 1e8 * 30, 30) when z > 1e7 then 30 + (z - 1e7) / 9e7 * 40 when z > 1e6 then (z - 1e6) / 9e6 * 30 else 0 end), 1) as horizon,
    case when checkpoints_timed + checkpoints_req < 10 then 0 else round(least(100, case when q > 0.2 then 70 + least((q - 0.2) / 0.3 * 30, 30) when q > 0.1 then 30 + (q - 0.1) / 0.1 * 40 when q > 0.05 then (q - 0.05) / 0.05 * 30 else 0 end), 1) end as wal_checkpoint,
    round(least(100, case when lock_waiters >= 10 then 60 when lock_waiters >= 3 then 30 when lock_waiters >= 1 then 10 else 0 end + case when lock_wait_s > 60 then 40 when lock_wait_s > 30 then 20 when lock_wait_s > 10 then 5 else 0 end + case when ungranted >= 15 then 30 when ungranted >= 5 then 15 when ungranted >= 2 then 5 else 0 end
      + case when lock_pool > 0.8 then 30 when lock_pool > 0.6 then 15 when lock_pool > 0.5 then 5 else 0 end + case when deadlocks >= 100 then 20 when deadlocks >= 10 then 10 when deadlocks >= 1 then 3 else 0 end), 1) as locks
  from (select *, conn_total::double / conn_max as r, cache_hit_pct::double as c, xid_age::double as x, vacuum_overdue_h::double as h, horizon_age::double as z, checkpoints_req::double / nullif(checkpoints_timed + checkpoints_req, 0) as q from raw))"""
_HOT = "case when hot_ratio < 0.5 then 30 when hot_ratio < 0.65 then 15 when hot_ratio < 0.8 then 5 else 0 end"
_STEP = "case when {0} >= {1} then {2} when {0} >= {3} then {4} when {0} >= {5} then {6} else 0 end"
_ADJUSTED = f"""
  adj as (select * replace (
    least(least(maintenance + case when autovacuum_off then 100 else 0 end, 100) + case when track_counts_off then 100 else 0 end, 100) as maintenance,
    round(least(least(least(performance + case when io_timing_off then 5 else 0 end, 100) + {_STEP.format('latency_ratio', 6, 50, 3, 30, 1.5, 10)}, 100) + {_STEP.format('seqscan_ratio', 6, 40, 3, 25, 1.5, 10)}, 100), 1) as performance,
    round(least(least(storage + {_HOT}, 100) + {_STEP.format('disk_used', 0.9, 80, 0.8, 30, 0.7, 10)}, 100), 1) as storage,
    round(least(least(connections + {_STEP.format('load_per_cpu', 4, 60, 2, 30, 1, 10)}, 100) + {_STEP.format('pooler_used', 0.8, 30, 0.6, 15, 0.5, 5)}, 100), 1) as connections) from pen)"""
_SCORES = """
  select instance, mon, critical, case when critical then least(score, 30) else score end as score from (select instance, mon, checksum_failures > 0 or disk_used >= 0.9 or (not in_recovery and (xid_age >= 1600000000 or autovacuum_off or track_counts_off)) as critical,
    round(round(greatest(0, least(100, 100 - (0.15 * connections + 0.15 * performance + 0.1 * storage + case when replicas > 0 then 0.15 * replication else 0 end + case when in_recovery then 0 else 0.15 * maintenance end + 0.1 * horizon + 0.1 * wal_checkpoint + 0.1 * locks)
      / (1.0 - case when replicas > 0 then 0 else 0.15 end - case when in_recovery then 0.15 else 0 end))), 6), 1) as score from adj)"""
SQL["h14_health_score"] = with_views("raw", "") + "," + _PENALTIES + "," + _ADJUSTED + _SCORES
SQL["h22_fleet_rank"] = with_views("raw", "") + "," + _PENALTIES + "," + _ADJUSTED + " select * from (" + _SCORES + ") order by score, instance, mon limit 20"


@query("h18_score_per_db", with_views("raw", "") + "," + _PENALTIES + f"""
  select instance, mon, round(round(case when not in_recovery and xid_age >= 1600000000 then least(s, 30) else s end, 6), 1) as score from (select *, greatest(0, least(100, 100 - case when in_recovery then 0.6 * performance + 0.4 * st else 0.375 * performance + 0.25 * st + 0.375 * maintenance end)) as s
    from (select *, round(least(100, storage + {_HOT}), 1) as st from pen))""")
def h18(spark, d):
    return health_inputs.score_per_db(bind(spark, d, "raw"), ["instance", "mon"])


@query("h20_drill_low_hot", with_views("raw", "select instance, mon, hot_ratio, row_number() over (partition by instance order by hot_ratio, mon) as rn from raw qualify rn <= 3"))
def h20(spark, d):
    rows = bind(spark, d, "raw").withColumn("n_tup_upd", F.lit(5000))
    return health_inputs.drill(rows, "low_hot", ["instance"], "mon", 3).select("instance", "mon", "hot_ratio", "rn")


@query("h21_overlay", with_views("samples", """
  select e.event_id as probe_id, e.user_id, coalesce(case when mod(e.event_id, 3) = 0 then e.event_id end, s.reads) as reads, s.writes, case when mod(e.event_id, 3) <> 0 and s.reads is not null then 'reads' else '' end as backed
  from events e asof left join (select user_id, day::timestamp as ts, reads, writes from samples) s on e.user_id = s.user_id and e.ts >= s.ts"""))
def h21(spark, d):
    probes = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("probe_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), F.expr("case when mod(event_id, 3) = 0 then event_id end").alias("reads"))
    snaps = bind(spark, d, "samples").select("user_id", F.col("day").cast("timestamp").alias("ts"), "reads", "writes")
    return health_inputs.overlay(probes, snaps, ["user_id"], ["reads"], ["writes"]).drop("ts")


@query("k1_rollup_hash", with_views("edges samples", """
  select target, cast(sum(writes) as bigint) as writes, md5(string_agg(cast(user_id as varchar), ',' order by user_id)) as part_sig from (
    select user_id, max(writes) as writes, coalesce(any_value(r.root), user_id) as target from samples left join (select child, cast(floor(child / pow(10, length(cast(child as varchar)) - 1)) as bigint) as root from edges) r on r.child = user_id group by user_id) group by target"""))
def k1(spark, d):
    counters = bind(spark, d, "samples").groupBy(F.col("user_id").alias("relid")).agg(F.max("writes").alias("writes"))
    return hot.rollup_hash(bind(spark, d, "edges").withColumn("parent_strategy", F.lit("h")), counters, [], ["writes"])


@query("k4_epoch_ok", with_views("samples", """
  select s.user_id, coalesce(a.r is not distinct from s.r and a.user_id is not null, false) as complete from (select user_id, case when mod(user_id, 3) = 0 then null else max(day) end as r from samples group by 1) s
  left join (select user_id, case when mod(user_id, 3) = 0 then null else max(day) filter (mod(extract(day from day), 2) = 0) end as r from samples where reads > 3 group by 1) a on a.user_id = s.user_id"""))
def k4(spark, d):
    rows = bind(spark, d, "samples")
    reset = lambda c: F.when(F.col("user_id") % 3 == 0, None).otherwise(F.max(c)).alias("stats_reset")
    anchors = rows.where("reads > 3").groupBy("user_id").agg(reset(F.when(F.day("day") % 2 == 0, F.col("day"))))
    return hot.epoch_ok(anchors, rows.groupBy("user_id").agg(reset("day")), ["user_id"])


def _histograms(spark, d):
    rows = bind(spark, d, "objects")
    tops = series.tail(rows, ["class"], 20).groupBy("class").agg(F.max("value").alias("top"))
    return hot.histogram_row(series.tail_histogram(rows, ["class"], 20), tops, ["class"])


@query("k10_percentile", with_views("objects", """
  , t as (select * from objects qualify row_number() over (partition by class order by value desc, object) > 20),
  q as (select class, q::double as q, value from (select class, value::double as value, row_number() over (partition by class order by value) as r, count(*) over (partition by class) as n from t) join (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]) as q) on r = greatest(1, ceil(q * n - 1e-9))),
  l as (select class, 0::double as q, 0::double as value from (select distinct class from t) union all select * from q union all select class, 1::double, m from (select class, max(value)::double as m from t group by 1) x where m > (select max(value) from q where q.class = x.class)),
  s as (select class, q as p0, value as v0, lead(q) over w as p1, lead(value) over w as v1 from l window w as (partition by class order by q))
  select o.class, object, cast(o.value as bigint) as value, case when o.value <= 0 then 0 else coalesce(max(p0 + (p1 - p0) * (o.value - v0) / (v1 - v0)) filter (v1 > o.value and v0 <= o.value and v1 > v0), max(p0), 0) end as percentile
  from objects o left join s on s.class = o.class group by o.class, object, o.value"""))
def k10(spark, d):
    return hot.project_percentile(bind(spark, d, "objects"), _histograms(spark, d), ["class"])


@query("k12_rate_per_day", with_views("objects", "select class, object, cast(value as bigint) as value, value::double / days as per_day from objects join (select event_type, max(epoch(date_trunc('second', mx)) - epoch(date_trunc('second', mn))) / 86400.0::double as days from (select event_type, user_id, max(ts) as mx, min(ts) as mn from events where mod(user_id, 2) = 0 group by 1, 2) group by 1) on event_type = class"))
def k12(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    windows = events.groupBy(F.col("event_type").alias("class"), "user_id").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts")).withColumn("complete", F.col("user_id") % 2 == 0)
    return hot.rate_per_day(bind(spark, d, "objects"), windows, ["class"])


@query("k11_previous_rank", with_views("samples", "select user_id, strftime(day, '%Y-%m-%d') as day, rn, lag(rn) over (partition by user_id order by day) as previous_rank from (select user_id, day, row_number() over (partition by day order by reads desc, user_id) as rn from samples qualify rn <= 10)"))
def k11(spark, d):
    rows = bind(spark, d, "samples").select("user_id", "day", F.col("user_id").alias("object"), F.col("reads").alias("value"))
    return series.previous_rank(series.top_objects(rows, ["day"], 10), ["user_id"], "day").select("user_id", F.col("day").cast("string").alias("day"), "rn", "previous_rank")


@query("x1_derive_signals", with_views("metrics", """
  select instance, ts, signal, value from (select instance, to_timestamp(floor(epoch(ts) / 86400) * 86400)::timestamp as ts, coalesce(sum(value), 0) as value, 'grown' as signal from (
    select instance, series, ts, case when lag(value) over w is null then null when value < lag(value) over w then value else value - lag(value) over w end as value from metrics window w as (partition by instance, series order by ts)) group by 1, 2) where value is not null"""))
def x1(spark, d):
    rows = bind(spark, d, "metrics")
    return signals.derive_signals(rows, ["instance"], 86400, [("grown", "increase", "statements_calls", "all", 1.0)])


@query("x3_signals_to_raw", with_views("series", """
  select target, ts, coalesce(max(case when signal = 'click' then value end), 0)::double as conn_total, coalesce(max(case when signal = 'error' then value end), 100)::double as cache_hit_pct, case when count(*) filter (signal = 'view') > 0 then 1 else 0 end as replicas,
    coalesce(greatest(2147483648 - max(case when signal = 'signup' then value end), 0), 0)::double as xid_age from series group by target, ts"""))
def x3(spark, d):
    names = {"click": "conn_total", "error": "cache_hit_pct", "view": "replica_lag_s", "signup": "xacts_left"}
    wide = series.pivot_signals(bind(spark, d, "series"), list(names)).withColumnsRenamed(names)
    return signals.signals_to_raw(wide).select("target", "ts", "conn_total", "cache_hit_pct", "replicas", "xid_age")


@query("x5_with_baseline", with_views("series", f"select s.target, s.signal, s.ts, s.value, b.median as baseline, case when s.value > 0 and b.median > 0 then s.value / b.median end as ratio from series s left join {_BASE.format(100)} b on {_AT}"))
def x5(spark, d):
    rows = bind(spark, d, "series")
    return series.with_baseline(rows, series.seasonal_baseline(rows, 100)).select("target", "signal", "ts", "value", "baseline", "ratio")


@query("x8_score_history")
def x8(spark, d):
    names = {"click": "conn_total", "error": "idle_in_tx", "purchase": "latency_ms", "signup": "seq_scan_rate", "view": "lock_waiters"}
    pick = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("signal"))
    rows = bind(spark, d, "series").withColumn("signal", pick)
    return signals.score_history(rows, list(names.values()), "2024-01-10", "2024-01-20", 100)


@query("x10_mapping_check", with_views("roles", "select instance, case when in_recovery then 'host' else 'core' end as role, count(*) as matched, count(*) = 1 as ok from roles group by 1, 2"))
def x10(spark, d):
    rows = bind(spark, d, "roles").withColumn("role", F.when(F.col("in_recovery"), "host").otherwise("core")).select("instance", "role")
    return signals.mapping_check(rows.distinct(), rows, ["instance"])


@query("z3_incidents")
def z3(spark, d):
    return incidents.incident_events(bind(spark, d, "activity"), triggers.SpikeConfig(6 * 3600, 20, 3600, 0.5), incidents.IncidentConfig(3600, 7200, 6 * 3600))


@query("z5_debounce", with_views("triggers", """
  , f as (select instance, epoch(date_trunc('second', ts))::bigint as t, min_by(kind, {'ts': ts, 'kind': kind}) as kind from triggers group by 1, 2),
  g as (select *, (select min(y.t) from f y where y.instance = f.instance and y.t >= f.t + 21600) as nxt from f)
  select instance, to_timestamp(t)::timestamp as ts, kind from (with recursive r as (select g.* from g join (select instance, min(t) as t from f group by 1) m using (instance, t) union all select g.* from r join g on g.instance = r.instance and g.t = r.nxt) select * from r)"""))
def z5(spark, d):
    return incidents.debounce(bind(spark, d, "triggers"), ["instance"], 21600)


@query("z7_lock_peak", with_views("roles", """
  select e.user_id as instance, e.event_id, max(b.event_id) as lock_peak from (select *, lead(ts) over (partition by user_id order by ts) as nxt from events where event_type = 'error') e
  left join events b on b.user_id = e.user_id and b.ts >= e.ts and (e.nxt is null or b.ts < e.nxt) and b.ts <= e.ts + interval 2 hours group by all"""))
def z7(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("user_id").alias("instance"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    spikes = rows.where("event_type = 'error'").select("instance", "event_id", F.col("ts").alias("onset_ts"), F.expr("ts + interval 2 hours").alias("at_ts"))
    return incidents.lock_peak(spikes, rows.select(F.col("event_id").alias("probe_id"), "instance", "ts", F.col("event_id").alias("blocked")), ["instance"]).select("instance", "event_id", "lock_peak")


@query("z10_effective_config", with_views("activity", "select a.instance, a.ts, case when a.instance in ('click', 'view') then 60 else 3600 end as min_gap_s from activity a"))
def z10(spark, d):
    rows = bind(spark, d, "activity").select("instance", "ts")
    overrides = rows.where("instance in ('click', 'view')").select("instance").distinct().withColumn("min_gap_s", F.lit(60))
    return incidents.effective_config(rows, overrides, {"min_gap_s": 3600}, ["instance"])


@query("s7_anchors", with_views("samples", "select user_id, strftime(day, '%Y-%m-%d') as captured_at, writes from samples qualify row_number() over (partition by user_id order by day desc) = 1"))
def s7(spark, d):
    rows = bind(spark, d, "samples").select("user_id", F.col("day").alias("captured_at"), "writes")
    old, new = rows.where("captured_at < date '2024-01-15'"), rows.where("captured_at >= date '2024-01-15'")
    return snapshots.upsert_anchors(old, new, ["user_id"]).withColumn("captured_at", F.col("captured_at").cast("string"))


@query("s12_retention_by_age", with_views("storage_days", "select cluster, strftime(dt, '%Y-%m-%d') as dt, bytes from storage_days where dt < date '2024-01-10'"))
def s12(spark, d):
    return snapshots.retention_by_age(bind(spark, d, "storage_days"), "2024-01-10").withColumn("dt", F.col("dt").cast("string"))


@query("s13_trigger_events", with_views("trigger_log", "select event_id, kind, ts, cluster, outcome from trigger_log where ts < timestamp '2024-01-20 00:00:00' and ts >= timestamp '2024-01-02 00:00:00' and cluster ilike '%c3%' and outcome = 'ok' and kind = 'view' order by ts desc, event_id desc limit 50"))
def s13(spark, d):
    return snapshots.trigger_events(bind(spark, d, "trigger_log"), 50, "c3", "view", "ok", "2024-01-02 00:00:00", "2024-01-20 00:00:00").select("event_id", "kind", "ts", "cluster", "outcome")


@query("t4_table_hit_rate", with_views("stat_indexes", "select index_id, 1.0::double * sum(idx_blks_hit) / nullif(sum(idx_blks_hit) + sum(idx_blks_read), 0) as hit_rate from stat_indexes group by index_id"))
def t4(spark, d):
    return indexes.hit_rate(bind(spark, d, "stat_indexes"), ["index_id"], "idx_blks_hit", "idx_blks_read")


@query("w9_scope_report", with_views("statements", "select queryid, database, cast(sum(calls) as bigint) as calls, 100.0::double * sum(calls) / sum(sum(calls)) over () as calls_share from statements group by 1, 2 qualify database < 12").replace("over ()", "over (partition by database)"))
def w9(spark, d):
    report = workload.contribution_report(bind(spark, d, "statements"), ["calls"], ["database"])
    return workload.scope_report(report, ["calls"], F.col("database") < 12)


_KINDS4 = {"heap": "idx_blks_hit, idx_blks_read", "idx": "idx_scan, size_bytes", "toast": "idx_blks_read, idx_scan", "tidx": "size_bytes, idx_blks_hit"}
_RATIOS = ", ".join(f"1.0::double * {h} / nullif({h} + {r}, 0) as {k}_ratio" for k, v in _KINDS4.items() for h, r in [v.split(", ")])


@query("t3_table_caching", with_views("stat_indexes", f"select host, index_id, {_RATIOS} from stat_indexes where idx_blks_hit + idx_blks_read + idx_scan + size_bytes > 0"))
def t3(spark, d):
    counters = {f"{k}_blks_{x}": F.col(c) for k, v in _KINDS4.items() for x, c in zip(("hit", "read"), v.split(", "))}
    rows = bind(spark, d, "stat_indexes")
    rows = rows.select("host", "index_id", *(c.alias(n) for n, c in counters.items()))
    return indexes.table_caching(rows).select("host", "index_id", *(f"{k}_ratio" for k in _KINDS4))


@query("t7_vacuum_thresholds", with_views("stat_tables", "select relid, 50 + (case when n_tup_del > 0 then 0.05e0 else 0.2e0 end) * reltuples as vacuum_at, 1000 + 0.2e0 * reltuples as insert_at, 50 + 0.1e0 * reltuples as analyze_at from stat_tables"))
def t7(spark, d):
    option = F.when(F.col("n_tup_del") > 0, F.create_map(F.lit("autovacuum_vacuum_scale_factor"), F.lit("0.05"))).otherwise(F.create_map().cast("map<string,string>"))
    return indexes.vacuum_thresholds(_tables(spark, d).withColumn("reloptions", option)).select("relid", "vacuum_at", "insert_at", "analyze_at")


@query("k5_aggregate_hosts", with_views("stat_indexes", """
  select index_id, cast(sum(idx_scan) filter (not is_unique) as bigint) as idx_scan, count(*) filter (not is_unique) as hosts, cast(max(size_bytes) as bigint) as size_bytes,
    coalesce(string_agg(concat(host, '=', idx_scan), ',' order by host) filter (not is_unique), '') as by_host,
    coalesce((select string_agg(cast(n_nationkey as varchar), ',' order by n_nationkey) from nation where n_nationkey not in (select host from stat_indexes)), '') as missing from stat_indexes group by index_id"""))
def k5(spark, d):
    expected = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("host"))
    rows = series.aggregate_hosts(bind(spark, d, "stat_indexes").withColumn("valid", ~F.col("is_unique")), ["index_id"], "idx_scan", "size_bytes", expected)
    entries = F.transform(F.map_entries("by_host"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return rows.withColumns({"by_host": F.array_join(entries, ","), "missing": F.array_join(F.transform("missing", lambda h: h.cast("string")), ",")})


@query("k8_tail_summary", with_views("objects", "select class, count(*) as count, cast(sum(value) as bigint) as sum, cast(max(value) as bigint) as max from (select *, row_number() over (partition by class order by value desc, object) as rn from objects) where rn > 20 or value <= 0 group by class"))
def k8_summary(spark, d):
    return series.tail_summary(bind(spark, d, "objects"), ["class"], 20)
