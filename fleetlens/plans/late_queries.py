"""Registered queries of range evaluation, raw metrics, live percentiles, score history, targets, stored snapshots, index scripts, more findings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetlens.functions.store import scratch_root
from fleetlens.operators import advisor, health_inputs, hot, schema_checks, signals, sizes
from fleetlens.plans import catalog_queries as catalog
from fleetlens.plans import fleet_queries as fleet
from fleetlens.plans.bindings import bind, with_views
from fleetlens.plans.more_queries import NO_KEY
from fleetlens.plans.queries import _BASE
from fleetlens.plans.registry import SQL, query
from fleetlens.sources import snapshots

_GRID = """
  , grid as (select unnest(range({first}, {last} + 1, {step})) as t), keys as (select distinct instance as target, series as signal from metrics {near}),
  cells as (select k.target, k.signal, g.t from keys k, grid g)
  select c.target, c.signal, make_timestamp(c.t * 1000000) as ts, case when epoch_us(m.ts) > (c.t - {back}) * 1000000 then m.value end as value
  from cells c asof left join (select * from metrics qualify row_number() over (partition by instance, series, ts order by event_id desc) = 1) m on m.instance = c.target and m.series = c.signal and m.ts <= make_timestamp(c.t * 1000000)"""


def _metrics(spark, d):
    return bind(spark, d, "metrics").select(F.col("instance").alias("target"), F.col("series").alias("signal"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("tie"))


@query("s2_range", with_views("metrics", "select * from (" + with_views("metrics", _GRID.format(first=1704844800, last=1705449600, step=10800, back=43200, near="")) + ") where value is not null"))
def s2_range(spark, d):
    return snapshots.range_evaluation(_metrics(spark, d), "2024-01-10", "2024-01-17", 10800, 43200, "tie")


@query("s2_range_filled", with_views("metrics", _GRID.format(first=1704844800, last=1705017600, step=7200, back=7200, near="where ts > timestamp '2024-01-09 22:00:00' and ts <= timestamp '2024-01-12'")))
def s2_filled(spark, d):
    return snapshots.range_evaluation(_metrics(spark, d), "2024-01-10", "2024-01-12", 7200, 7200, "tie", fill=True)


@query("s2_instant", with_views("metrics", "select instance as target, series as signal, timestamp '2024-01-15' as ts, arg_max(value, {'t': ts, 'e': event_id}) as value from metrics where ts > timestamp '2024-01-13' and ts <= timestamp '2024-01-15' group by 1, 2"))
def s2_instant(spark, d):
    return snapshots.instant_evaluation(_metrics(spark, d), "2024-01-15", 172_800, "tie")


# the newest counters of each host at two times; every second host was reset in between, some fell
_LIVE = """
  select event_type as class, user_id as object, mod(event_id, 3) as host, cast(sum(case when ts < timestamp '2024-01-11' then round(value * 100) else 0 end) as bigint) as was,
    cast(sum(round(value * 100)) as bigint) - case when mod(user_id, 13) = 0 then 100000 else 0 end as now, min(ts) as from_ts, max(ts) as to_ts
  from events group by event_type, user_id, mod(event_id, 3)"""
_WINDOWS = "select event_type, max(epoch(date_trunc('second', mx)) - epoch(date_trunc('second', mn))) / 86400.0::double as days from (select event_type, user_id, max(ts) as mx, min(ts) as mn from events where mod(user_id, 2) = 0 group by 1, 2) group by 1"


@query("k14_live_percentile", SQL["k10_percentile"].split("select o.class, object")[0] + f""",
  live as ({_LIVE}),
  rates as (select class, object, sum((now - was) / (case host when 0 then 10.0 when 1 then 5.0 else 2.0 end)::double) as per_day from live where now >= was and not (host = 1 and mod(object, 5) = 0) and not (host = 2 and mod(object, 7) = 0) group by 1, 2),
  scaled as (select r.*, per_day * coalesce(days, 1) as value from rates r left join ({_WINDOWS}) w on w.event_type = r.class)
  select o.class, object, per_day, case when o.value <= 0 then 0 else coalesce(max(p0 + (p1 - p0) * (o.value - v0) / (v1 - v0)) filter (v1 > o.value and v0 <= o.value and v1 > v0), max(p0), 0) end as percentile
  from scaled o left join s on s.class = o.class group by o.class, object, per_day, o.value""")
def k14(spark, d):
    live = spark.sql(_LIVE.replace("from events", "from {events}"), events=spark.read.parquet(f"{d}/events.parquet"))
    days = F.when(F.col("host") == 0, 10).when(F.col("host") == 1, 5).otherwise(2)
    now = F.lit("2024-01-31").cast("timestamp")
    anchors = live.select("class", "object", "host", F.col("was").alias("value"), F.lit("2024-01-01").cast("timestamp").alias("stats_reset"), F.lit("a").alias("part_sig"), F.timestamp_seconds(F.unix_timestamp(now) - days * 86400).alias("captured_at"))
    reset = F.when((F.col("host") == 1) & (F.col("object") % 5 == 0), F.lit("2024-01-20")).otherwise("2024-01-01").cast("timestamp")
    sig = F.when((F.col("host") == 2) & (F.col("object") % 7 == 0), "b").otherwise("a")
    sample = live.select("class", "object", "host", F.col("now").alias("value"), reset.alias("stats_reset"), sig.alias("part_sig"), now.alias("captured_at"))
    events = spark.read.parquet(f"{d}/events.parquet")
    windows = events.groupBy(F.col("event_type").alias("class"), "user_id").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts")).withColumn("complete", F.col("user_id") % 2 == 0)
    return hot.live_percentile(anchors, sample, windows, fleet._histograms(spark, d), ["class"]).select("class", "object", "per_day", "percentile")


_HOW = "extract(dow from ts) * 24 + extract(hour from ts)"
_NAMED = "select target, case signal when 'click' then 'conn_total' when 'error' then 'idle_in_tx' when 'purchase' then 'latency_ms' when 'signup' then 'seq_scan_rate' else 'lock_waiters' end as signal, ts, value from series"
_MEDIANS = "(select target, signal, " + _HOW + " as how, median(value) as median from {0} where (target, signal) in (select (target, signal) from {0} group by target, signal having count(value) >= 100) group by all)"
_ZERO = ["longest_tx_s", "dead_max_pct", "dead_avg_pct", "bloated_tables", "newpage_ratio", "replica_lag_s", "replica_lag_mb", "replicas", "replicas_lost", "vacuum_overdue_h", "vacuum_backlog", "never_vacuumed", "autovac_off_tables", "stale_stats", "horizon_age", "checkpoints_timed", "checkpoints_req", "lock_wait_s", "ungranted", "lock_pool", "deadlocks", "disk_used", "checksum_failures", "xid_age", "cache_sample", "load_per_cpu", "pooler_used"]
SQL["x8_score_history"] = with_views("series", f"""
  , named as ({_NAMED}),
  ratios as (select s.target, s.ts, max(case when s.signal = 'latency_ms' then s.value / m.median end) as latency_ratio, max(case when s.signal = 'seq_scan_rate' then s.value / m.median end) as seqscan_ratio
    from named s join {_MEDIANS.format('named')} m on m.target = s.target and m.signal = s.signal and m.how = extract(dow from s.ts) * 24 + extract(hour from s.ts) where s.value > 0 and m.median > 0 group by all),
  wide as (select target, ts, max(case when signal = 'conn_total' then value end) as conn_total, max(case when signal = 'idle_in_tx' then value end) as idle_in_tx, max(case when signal = 'lock_waiters' then value end) as lock_waiters from named group by all),
  raw as (select w.target as instance, w.ts as mon, coalesce(conn_total, 0) as conn_total, null::double as conn_max, coalesce(idle_in_tx, 0) as idle_in_tx, coalesce(lock_waiters, 0) as lock_waiters, 100 as cache_hit_pct, 1.0 as hot_ratio, false as in_recovery, false as autovacuum_off, false as track_counts_off,
    false as io_timing_off, coalesce(latency_ratio, 0) as latency_ratio, coalesce(seqscan_ratio, 0) as seqscan_ratio, {', '.join(f'0 as {z}' for z in _ZERO)} from wide w left join ratios r on r.target = w.target and r.ts = w.ts),
""" + fleet._PENALTIES.strip() + "," + fleet._ADJUSTED.strip() + ", scores as (" + fleet._SCORES.strip() + f"), history as (select instance as target, 'score' as signal, mon as ts, score as value from scores), base as {_MEDIANS.format('history')}" + """
  select h.target, h.ts, h.value as score, b.median as baseline, coalesce(b.median - h.value > 10, false) as dip from history h left join base b on b.target = h.target and b.how = extract(dow from h.ts) * 24 + extract(hour from h.ts)
  where h.ts between timestamp '2024-01-10' and timestamp '2024-01-20'""")


_HOSTS = "select cast(c_nationkey as varchar) as cluster, cast(c_custkey as varchar) as instance, case when mod(c_custkey, 3) = 0 then 'static' when mod(c_custkey, 3) = 1 then 'cloud' else '' end as source, c_mktsegment as env_label, concat('p', cast(c_custkey as varchar(20))) as provider_id from customer"


@query("x9_map_targets", f"""
  with hosts as ({_HOSTS}), given as (select cast(s_nationkey as varchar) as cluster, cast(s_suppkey as varchar) as instance, 'prod' as env, s_name as service, concat('h', cast(s_suppkey as varchar(20))) as host from supplier)
  select h.cluster, h.instance, case when g.service is not null then g.env when h.source = 'cloud' then h.env_label end as env, case when g.service is not null then g.service when h.source = 'cloud' then cast(h.cluster as varchar) end as service,
    case when g.service is not null then g.service when h.source = 'cloud' then h.provider_id end as service_id, case when g.service is not null then g.host when h.source = 'cloud' then cast(h.instance as varchar) end as host
  from hosts h left join given g on g.cluster = h.cluster and g.instance = h.instance""")
def x9(spark, d):
    customers, suppliers = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "supplier"))
    source = F.element_at(F.array(F.lit("static"), F.lit("cloud"), F.lit("")), (F.col("c_custkey") % 3 + 1).cast("int"))
    hosts = customers.select(F.col("c_nationkey").cast("string").alias("cluster"), F.col("c_custkey").cast("string").alias("instance"), source.alias("source"), F.col("c_mktsegment").alias("env_label"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("provider_id"))
    given = suppliers.select(F.col("s_nationkey").cast("string").alias("cluster"), F.col("s_suppkey").cast("string").alias("instance"), F.lit("prod").alias("env"), F.col("s_name").alias("service"), F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("host"))
    return signals.map_targets(hosts, given, ["cluster", "instance"])


@query("s5_stored_snapshot", """
  select l_partkey as queryid, concat('s', cast(l_linenumber as varchar)) as snapshot_id, strftime(l_shipdate, '%Y-%m') as dt, count(*) as n, sum(cast(round(l_extendedprice * 100) as bigint))::bigint as exec_ms, concat('select ', p_name, ' from t') as query
  from lineitem join part on l_partkey = p_partkey where l_linenumber <= 2 group by all""")
def s5(spark, d):
    """Two snapshots stored one after the other, their texts once for each month, and read back."""
    lines, parts = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "part"))
    rows = lines.where("l_linenumber <= 2").join(parts, lines["l_partkey"] == parts["p_partkey"])
    report = rows.groupBy(F.col("l_partkey").alias("queryid"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("snapshot_id"), F.date_format("l_shipdate", "yyyy-MM").alias("dt"), F.concat(F.lit("select "), "p_name", F.lit(" from t")).alias("query"))
    report = report.agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("exec_ms"))
    path = f"{scratch_root(spark)}/snapshots-{uuid.uuid4().hex}"
    out = None
    for name in ("s1", "s2"):
        snapshots.write_snapshot(report.where(F.col("snapshot_id") == name), path)
    for name in ("s1", "s2"):
        part = snapshots.read_snapshot(spark, path, name).select("queryid", "snapshot_id", F.date_format(F.col("dt").cast("timestamp"), "yyyy-MM").alias("dt"), "n", "exec_ms", "query")
        out = part if out is None else out.unionByName(part)
    return out


# a relation is a part, its parent the part with the last digit gone
_TREE = "select p_partkey as relid, 'public' as schema, concat('t', cast(p_partkey as varchar(20))) as name, case when exists (select 1 from part x where x.p_partkey >= 10 and cast(floor(x.p_partkey / 10) as bigint) = p.p_partkey) then 'p' else 'r' end as relkind from part p"


@query("v13_ddl_text", f"""
  with recursive tree as ({_TREE}), cand as (select relid, name, relkind, case when mod(relid, 2) = 0 then ' WHERE "gone" IS NULL' else '' end as w from tree where relid < 10),
  down as (select c.relid as top, c.w, c.relid, c.name, c.relkind, '' as up, [c.name] as path from cand c where relkind = 'p'
    union all select d.top, d.w, t.relid, t.name, t.relkind, d.name, list_append(d.path, concat('public.', t.name)) from down d join tree t on t.relid >= 10 and cast(floor(t.relid / 10) as bigint) = d.relid),
  ranked as (select *, row_number() over (partition by top order by path) - 1 as rn from down),
  lines as (select top, path as place, case when relkind = 'p' then concat('CREATE INDEX "', name, '_at_id_idx" ON ONLY "public"."', name, '" ("at", "id")', w, ';') else concat('CREATE INDEX CONCURRENTLY "', name, '_at_id_idx" ON "public"."', name, '" ("at", "id")', w, ';') end as line from ranked where rn <= 20
    union all select top, list_append(path, chr(1114111)), concat('ALTER INDEX "public"."', up, '_at_id_idx" ATTACH PARTITION "public"."', name, '_at_id_idx";') from ranked where rn between 1 and 20),
  script as (select top, string_agg(line, chr(10) order by place) as text from lines group by top),
  skipped as (select top, count(*) as n from ranked where rn > 20 and relkind <> 'p' group by top)
  select c.relid, case when s.text is null then concat('CREATE INDEX CONCURRENTLY "', c.name, '_at_id_idx" ON "public"."', c.name, '" ("at", "id")', c.w, ';') else concat(s.text, case when k.n > 0 then concat(chr(10), '-- ', cast(k.n as varchar), ' more partitions are built and attached the same way') else '' end) end as ddl
  from cand c left join script s on s.top = c.relid left join skipped k on k.top = c.relid""")
def v13(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("relid"))
    edges = parts.where("relid >= 10").select(F.col("relid").alias("child"), F.floor(F.col("relid") / 10).alias("parent"))
    inner = edges.select(F.col("parent").alias("relid"), F.lit("p").alias("relkind")).distinct()
    relations = parts.join(inner, "relid", "left").select("relid", F.lit("public").alias("schema"), F.concat(F.lit("t"), F.col("relid").cast("string")).alias("table"), F.coalesce("relkind", F.lit("r")).alias("relkind"))
    candidates = parts.where("relid < 10").select("relid", F.when(F.col("relid") % 2 == 0, "gone").otherwise("").alias("predicate"), F.array(F.lit("at"), F.lit("id")).alias("columns"))
    return advisor.ddl_text(candidates, relations, edges, NO_KEY).select("relid", "ddl")


_NAMES = "n as (select c_custkey as relid, c_nationkey as schema, case when mod(c_custkey, 17) = 0 then 'user' when mod(c_custkey, 17) = 1 then concat('t-', cast(c_custkey as varchar(20))) else concat('t', cast(c_custkey as varchar(20))) end as object from customer)"


@query("l16_findings", with_views("idx attributes", f"""
  , {_NAMES}, alike as ({SQL['i9_similar_loose'].split('select a.indrelid, a.indexrelid, b.indexrelid as indexrelid2')[1].join(['select a.indrelid, b.indexrelid', ''])}),
  arrays as (select distinct i.indrelid, i.indexrelid from (select *, k1 as k from idx union all select *, k2 as k from idx where nkeyatts = 2) i join attributes a on a.attrelid = i.indrelid and a.attnum = i.k and a.is_array where method = 'btree' and not is_unique)
  select code, 'notice' as level, schema, object, within from (select 'index_similar' as code, indrelid, cast(indexrelid as varchar) as within from alike union all select 'btree_on_array', indrelid, cast(indexrelid as varchar) from arrays) f join n on n.relid = f.indrelid"""))
def l16(spark, d):
    """Similar indexes and trees over arrays as findings, with the owning relation's name."""
    named = bind(spark, d, "classes").select(F.col("relid").alias("indrelid"), "schema", "object")
    idx = catalog._indexes(spark, d)
    similar = sizes.similar_loose(idx, NO_KEY).select("indrelid", F.col("indexrelid2").cast("string").alias("within"))
    arrays = sizes.btree_on_array(idx, bind(spark, d, "attributes"), NO_KEY).select("indrelid", F.col("indexrelid").cast("string").alias("within"))
    parts = [schema_checks.from_rows(rows.join(named, "indrelid"), NO_KEY, code, "within") for code, rows in (("index_similar", similar), ("btree_on_array", arrays))]
    return parts[0].unionByName(parts[1]).select("code", "level", "schema", "object", "within")


# a host is a nation; its sessions and locks are orders, its tables customers, its replicas suppliers, its counters nations and regions
_H1 = """
  with c as (select o.*, c_nationkey as h from orders o join customer on o_custkey = c_custkey),
  s as (select h, o_orderpriority as database, o_orderkey as k, case o_orderstatus when 'F' then 'idle in transaction' when 'O' then 'active' else 'idle' end as state, case when mod(o_orderkey, 3) = 0 then 'Lock' end as wait, date_diff('second', o_orderdate::timestamp, timestamp '1998-12-31') as age, o_orderdate as since, mod(o_orderkey, 1000) * 1000 as xmin from c),
  a as (select h, count(*) as conn_total, count(*) filter (state = 'idle in transaction' and age > 30) as idle_in_tx, max(age) as longest_tx_s, arg_min(database, {'a': since, 'b': database}) as longest_tx_database, max(xmin) as horizon_age, arg_max(database, {'a': xmin, 'b': database}) as horizon_database,
    count(*) filter (wait = 'Lock' and state = 'active') as lock_waiters, coalesce(max(case when wait = 'Lock' then age end), 0) as lock_wait_s from s group by h),
  i as (select h, arg_min(database, {'n': -n, 's': since, 'd': database}) as idle_in_tx_database from (select h, database, count(*) as n, min(since) as since from s where state = 'idle in transaction' and age > 30 group by all) group by h),
  t as (select c_nationkey as h, mod(c_custkey * 7919, 50000) as live, mod(c_custkey * 104729, 20000) as dead, mod(c_custkey * 31, 5000) as upd, mod(c_custkey, 900) as hot, mod(c_custkey, 70) as page, mod(c_custkey, 4) = 0 as v, mod(c_custkey, 5) = 0 as an, case when mod(c_custkey, 7) > 0 then mod(c_custkey, 400) end as vac_h, case when mod(c_custkey, 11) > 0 then mod(c_custkey, 9) end as an_h from customer),
  tn as (select h, coalesce(max(pct), 0) as dead_max_pct, coalesce(avg(pct), 0) as dead_avg_pct, count(*) filter (pct > 20) as bloated_tables, coalesce(sum(case when upd > 1000 then hot end)::double / sum(case when upd > 1000 then upd end), 1) as hot_ratio, coalesce(sum(case when upd > 1000 then page end)::double / sum(case when upd > 1000 then upd end), 0) as newpage_ratio,
    count(*) filter (v) as vacuum_backlog, coalesce(max(case when v then vac_h end), 0)::double as vacuum_overdue_h, count(*) filter (live + dead > 10000 and vac_h is null) as never_vacuumed, count(*) filter (an and (an_h is null or an_h > 3)) as stale_stats, round(100.0 * sum(live) / nullif(sum(live) + sum(dead), 0), 2) as cache_hit_pct, sum(live) + sum(dead) as cache_sample,
    count(*) filter (off) as autovac_off_tables, max(xid) as xid_age from (select *, case when live + dead > 10000 then round(100.0 * dead / (live + dead), 2) end as pct, mod(live, 13) = 0 as off, live * 1000 as xid from t) group by h),
  r as (select s_nationkey as h, count(*) as replicas, max(mod(s_suppkey, 40))::double as replica_lag_s, max(s_suppkey * 100000)::double / 1048576 as replica_lag_mb, count(*) filter (mod(s_suppkey, 4) = 0) as replicas_lost from supplier group by 1),
  l as (select h, count(*) filter (mod(o_orderkey, 6) = 0) as ungranted, count(*) as held from c group by h)
  select n_nationkey as h, mod(n_nationkey, 4) = 0 as in_recovery, coalesce(conn_total, 0) as conn_total, coalesce(idle_in_tx, 0) as idle_in_tx, coalesce(longest_tx_s, 0) as longest_tx_s, longest_tx_database, idle_in_tx_database, coalesce(horizon_age, 0) as horizon_age, horizon_database, coalesce(lock_waiters, 0) as lock_waiters, coalesce(lock_wait_s, 0) as lock_wait_s,
    coalesce(dead_max_pct, 0) as dead_max_pct, coalesce(dead_avg_pct, 0) as dead_avg_pct, coalesce(bloated_tables, 0) as bloated_tables, coalesce(hot_ratio, 1) as hot_ratio, coalesce(newpage_ratio, 0) as newpage_ratio, coalesce(vacuum_backlog, 0) as vacuum_backlog, coalesce(vacuum_overdue_h, 0) as vacuum_overdue_h, coalesce(never_vacuumed, 0) as never_vacuumed, coalesce(stale_stats, 0) as stale_stats,
    coalesce(cache_hit_pct, 100) as cache_hit_pct, coalesce(cache_sample, 0) as cache_sample, coalesce(replicas, 0) as replicas, coalesce(replica_lag_s, 0) as replica_lag_s, coalesce(replica_lag_mb, 0) as replica_lag_mb, coalesce(replicas_lost, 0) as replicas_lost, coalesce(autovac_off_tables, 0) as autovac_off_tables, coalesce(xid_age, 0) as xid_age,
    case when mod(n_nationkey, 5) = 4 then 0 else 100 + n_nationkey end::double as conn_max, case when mod(n_nationkey, 5) < 4 then 'replica' end as wal_level, mod(n_nationkey, 5) < 4 and mod(n_nationkey, 3) = 0 as autovacuum_off, mod(n_nationkey, 5) < 4 as track_counts_off, mod(n_nationkey, 5) < 4 and mod(n_nationkey, 2) = 0 as io_timing_off,
    n_nationkey * 3 as checkpoints_timed, n_nationkey as checkpoints_req, coalesce(ungranted, 0) as ungranted, n_nationkey * 2 as deadlocks, mod(n_nationkey, 2) as checksum_failures, case when mod(n_nationkey, 5) < 4 and held > 0 then held / (64.0 * (100 + n_nationkey)) else 0 end as lock_pool
  from nation left join a on a.h = n_nationkey left join i on i.h = n_nationkey left join tn on tn.h = n_nationkey left join r on r.h = n_nationkey left join l on l.h = n_nationkey"""


@query("h1_raw_metrics", _H1)
def h1(spark, d):
    orders, customer, supplier, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer", "supplier", "nation"))
    at = F.lit("1998-12-31").cast("timestamp")
    c = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).withColumn("h", F.col("c_nationkey"))
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    state = F.when(F.col("o_orderstatus") == "F", "idle in transaction").when(F.col("o_orderstatus") == "O", "active").otherwise("idle")
    hours = lambda n: F.timestamp_seconds(F.unix_timestamp(at) - n * 3600)
    own = F.col("c_custkey")
    live = own * 7919 % 50000
    tables = customer.select(F.col("c_nationkey").alias("h"), live.alias("n_live_tup"), (own * 104729 % 20000).alias("n_dead_tup"), (own * 31 % 5000).alias("n_tup_upd"), (own % 900).alias("n_tup_hot_upd"), (own % 70).alias("n_tup_newpage_upd"), F.lit(1.0).alias("reltuples"), (own % 4 == 0).alias("vacuum_due"), (own % 5 == 0).alias("analyze_due"),
        F.when(own % 7 > 0, hours(own % 400)).alias("last_vacuum"), F.lit(None).cast("timestamp").alias("last_autovacuum"), F.when(own % 11 > 0, hours(own % 9)).alias("last_analyze"), F.lit(None).cast("timestamp").alias("last_autoanalyze"), at.alias("captured_at"))
    host = F.col("n_nationkey").alias("h")
    n = F.col("n_nationkey")
    said = F.create_map(*map(F.lit, ("track_counts", "off", "wal_level", "replica", "max_locks_per_transaction", "64")), F.lit("max_connections"), (100 + n).cast("string"), F.lit("autovacuum"), F.when(n % 3 == 0, "off").otherwise("on"), F.lit("track_io_timing"), F.when(n % 2 == 0, "off").otherwise("on"))
    views = {
        "hosts": nation.select(host, (n % 4 == 0).alias("in_recovery")),
        "activity": c.select("h", F.col("o_orderpriority").alias("database"), state.alias("state"), F.when(key % 3 == 0, "Lock").alias("wait_event_type"), day.alias("xact_start"), day.alias("state_change"), at.alias("captured_at"), (key % 1000 * 1000).alias("backend_xmin_age")),
        "stat_tables": tables, "statio": tables.select("h", F.col("n_live_tup").alias("heap_blks_hit"), F.col("n_dead_tup").alias("heap_blks_read")),
        "replication": supplier.select(F.col("s_nationkey").alias("h"), F.when(F.col("s_suppkey") % 4 == 0, "catchup").otherwise("streaming").alias("state"), (F.col("s_suppkey") % 40).cast("double").alias("replay_lag_s"), (F.col("s_suppkey") * 100000).alias("replay_lag_bytes")),
        "classes": customer.select(F.col("c_nationkey").alias("h"), F.lit("r").alias("relkind"), F.when(live % 13 == 0, F.create_map(F.lit("autovacuum_enabled"), F.lit("OFF"))).alias("reloptions"), (live * 1000).alias("xid_age")),
        "settings": nation.where(n % 5 < 4).select(host, F.explode(said).alias("name", "setting")), "checkpoints": nation.select(host, (n * 3).alias("timed"), n.alias("requested")),
        "locks": c.select("h", (key % 6 != 0).alias("granted")), "database_stats": nation.select(host, (n * 2).alias("deadlocks"), (n % 2).alias("checksum_failures")),
    }
    return health_inputs.raw_metrics(views, ["h"])


@query("s3_log_records", with_views("logs", "select date_trunc('second', ts) as ts, severity, concat('h', cast(mod(event_id, 7) as varchar(2))) as host, text, concat('e', cast(event_id as varchar(20))) as event from logs"))
def s3(spark, d):
    """S3: the log records written as JSON lines, then scanned."""
    rows = bind(spark, d, "logs").select(F.date_trunc("second", "ts").alias("ts"), "severity", F.concat(F.lit("h"), (F.col("event_id") % 7).cast("string")).alias("host"), "text", F.create_map(F.lit("event"), F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("fields"))
    path = f"{scratch_root(spark)}/logs-{uuid.uuid4().hex}"
    rows.write.json(path)
    return snapshots.read_logs(spark, path).select("ts", "severity", "host", "text", F.col("fields")["event"].alias("event"))


@query("s8_streamed_anchors", with_views("samples", "select user_id, strftime(day, '%Y-%m-%d') as day, reads, writes, 'ok' as outcome from samples qualify row_number() over (partition by user_id order by day desc) = 1"))
def s8(spark, d):
    """Samples as a stream of committed versions; the anchors of the newest one, and how its batches ended."""
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    samples = bind(spark, d, "samples").select("user_id", F.col("day").cast("timestamp").alias("captured_at"), F.col("reads").cast("long").alias("reads"), F.col("writes").cast("long").alias("writes"))
    samples.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 64).parquet(f"{root}/in")
    snapshots.commit_stream(stream, ["user_id"], f"{root}/out", f"{root}/checkpoint", lambda batch, anchors: batch.groupBy("user_id").agg(F.sum("reads").alias("reads"))).trigger(availableNow=True).start().awaitTermination()
    outcome = snapshots.read_outcomes(spark, f"{root}/out").agg(F.array_join(F.sort_array(F.collect_set("outcome")), ",").alias("outcome"))
    anchors = snapshots.read_hot(spark, f"{root}/out", "anchors").withColumn("outcome", outcome.scalar())
    return anchors.select("user_id", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), "reads", "writes", "outcome")
