"""Registered queries of the smaller operators: sessions, replication, maintenance, drill-downs, schema findings, table resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.exprs import mask_template
from fleetlens.functions.store import settled
from fleetlens.operators import advisor, health, health_inputs, hot, indexes, keys, logs, maintenance, schema_checks, series, sizes, workload
from fleetlens.plans import catalog_queries as catalog
from fleetlens.plans import fleet_queries as fleet
from fleetlens.plans.bindings import bind, with_views
from fleetlens.plans.queries import _DUE, _MASK
from fleetlens.plans.registry import SQL, query
from fleetlens.sources import snapshots

NO_KEY: list[str] = []
_EPOCH = "epoch(date_trunc('second', {}))"


@query("w7_exclude_users", with_views("user_statements", "select queryid, count(*) as n, cast(sum(exec_ms) as bigint) as exec_ms from user_statements where user_name is distinct from 'A' group by queryid"))
def w7(spark, d):
    rows = workload.exclude_users(bind(spark, d, "user_statements").withColumnRenamed("user_name", "user"), ["A"])
    return rows.groupBy("queryid").agg(F.count("*").alias("n"), F.sum("exec_ms").alias("exec_ms"))


@query("w11_compare_views", with_views("snap_a snap_b", """
  select coalesce(a.queryid, b.queryid) as queryid, coalesce(a.database, b.database) as database, a.calls as a_calls, b.calls as b_calls, row_number() over (order by coalesce(a.calls, 0) desc, coalesce(a.queryid, b.queryid), coalesce(a.database, b.database)) as rn
  from snap_a a full join snap_b b on a.queryid = b.queryid and a.database = b.database where a.queryid is not null qualify rn <= 200"""))
def w11_views(spark, d):
    compared = workload.compare(bind(spark, d, "snap_a"), bind(spark, d, "snap_b"), ["calls"], ["queryid", "database"])
    return workload.compare_view(compared, "calls", ["queryid", "database"], hide_absent_a=True, n=200).select("queryid", "database", "a_calls", "b_calls", "rn")


@query("w12_stats_window", with_views("captures", f"select event_id, cast({_EPOCH.format('captured_at')} - {_EPOCH.format('stats_reset')} as bigint) as window_s from captures"))
def w12(spark, d):
    return workload.stats_window(bind(spark, d, "captures")).select("event_id", "window_s")


@query("w13_running", with_views("running", "select pid, running_ms, wait_event is not null as waiting from running where running_ms >= 100000 and query ilike '%URGENT%'"))
def w13(spark, d):
    return workload.running(bind(spark, d, "running"), 100_000, "%URGENT%").select("pid", "running_ms", "waiting")


@query("w15_sanitised", with_views("ddl_texts", "select queryid, 'alter role r password ''***''; postgres://u:***@h/db password=*** tail' as query from ddl_texts"))
def w15(spark, d):
    return workload.sanitised(bind(spark, d, "ddl_texts"))


@query("w18_search_report", with_views("user_statements", "select queryid, query, share, share > 60 as high from (select queryid, query, sum(exec_ms) / 1e6 as share from user_statements group by queryid, query) where lower(query) like '%1%' or cast(queryid as varchar) like '%1%'"))
def w18(spark, d):
    report = bind(spark, d, "user_statements").groupBy("queryid", "query").agg((F.sum("exec_ms") / 1e6).alias("share"))
    return workload.search_report(report, "1", "share", 60.0)


@query("m1_autovac_due", with_views("stat_tables", f"select relid, v as vacuum_due, a as analyze_due from ({_DUE})"))
def m1(spark, d):
    return fleet._tables(spark, d).select("relid", "vacuum_due", "analyze_due")


@query("m4_maintenance_info", with_views("vacuums", "select relid, greatest(last_vacuum, last_autovacuum) as vacuumed_at, greatest(last_analyze, last_autoanalyze) as analyzed_at from vacuums where contains(lower(relname), 't_1')"))
def m4(spark, d):
    return maintenance.maintenance_info(bind(spark, d, "vacuums"), "T_1").select("relid", "vacuumed_at", "analyzed_at")


@query("d2_db_size", with_views("stat_db", "select database, cast(size_bytes as bigint) as size_bytes from stat_db"))
def d2(spark, d):
    return maintenance.db_size(bind(spark, d, "stat_db"), ["database"])


@query("d3_stats_reset", with_views("stat_db", "select database, stats_reset, greatest(1, date_diff('day', stats_reset, captured_at)) as days from stat_db"))
def d3(spark, d):
    return maintenance.stats_reset(bind(spark, d, "stat_db"), ["database"])


@query("r1_repl_lag", with_views("replicas", f"select pid, cast(case when not in_recovery or behind = 0 then 0 else {_EPOCH.format('captured_at')} - {_EPOCH.format('last_replay_at')} end as bigint) as lag_s from replicas"))
def r1(spark, d):
    return maintenance.repl_lag(bind(spark, d, "replicas")).select("pid", "lag_s")


@query("r2_slot_backlog", with_views("replicas", "select pid, backlog as backlog_bytes from replicas"))
def r2(spark, d):
    return maintenance.slot_backlog(bind(spark, d, "replicas")).select("pid", "backlog_bytes")


@query("r3_repl_status", with_views("replicas", """
  select host, pid, lag as replay_lag_bytes, case when mod(pid, 4) = 0 then concat('slot', pid) else '' end as slot_name, row_number() over (partition by host order by lag desc nulls last, pid) as lag_rank
  from (select *, case when not in_recovery then behind end as lag from replicas)"""))
def r3(spark, d):
    rows = bind(spark, d, "replicas")
    slots = rows.where("mod(pid, 4) = 0").select("host", F.col("pid").alias("active_pid"), F.concat(F.lit("slot"), F.col("pid").cast("string")).alias("slot_name"))
    return maintenance.repl_status(rows, slots, ["host"]).select("host", "pid", "replay_lag_bytes", "slot_name", "lag_rank")


@query("g2_settings_subset", with_views("settings", "select host, name, setting from settings where name in ('maintenance_work_mem', 'autovacuum_naptime')"))
def g2(spark, d):
    return maintenance.settings_subset(bind(spark, d, "settings"), ["maintenance_work_mem", "autovacuum_naptime"]).select("host", "name", "setting")


_PER_DB, _WORST = SQL["h18_score_per_db"], "select instance, arg_min(mon, {'s': score, 'd': mon}) as database, min(score) as score from (select instance, mon, round(round("


@query("h19_worst_database", _PER_DB.replace("select instance, mon, round(round(case", _WORST + "case") + ") group by instance")
def h19(spark, d):
    return health.worst_database(fleet.h18(spark, d).withColumnRenamed("mon", "database"), ["instance"])


def _drill(kind: str, where: str, by: str) -> None:
    @query(f"h20_drill_{kind}", with_views("raw", f"select instance, mon, row_number() over (partition by instance order by {by} desc nulls last, mon) as rn from raw where {where} qualify rn <= 4"))
    def run(spark, d):
        facts = {"n_dead_tup": F.col("dead_max_pct"), "n_live_tup": F.col("conn_total") * 1000, "dead_pct": F.col("dead_avg_pct").cast("double"), "backend_xmin_age": F.when(F.col("horizon_age") > 10_000_000, F.col("horizon_age"))}
        return health_inputs.drill(bind(spark, d, "raw").withColumns(facts), kind, ["instance"], "mon", 4).select("instance", "mon", "rn")


_drill("wraparound", "xid_age > 0", "xid_age")
_drill("autovacuum_off", "autovacuum_off", "dead_max_pct")
_drill("high_dead", "conn_total * 1000 + dead_max_pct > 10000", "dead_avg_pct")
_drill("horizon", "horizon_age > 10000000", "horizon_age")


@query("k6_rank_value", with_views("samples", """
  select class, object, cast(value as bigint) as value, row_number() over (partition by class order by value desc, object) as rn from (
    select user_id as object, 'reads' as class, max(reads) as value from samples group by 1 union all select user_id, 'writes', max(writes) from samples group by 1 union all select user_id, 'io', max(reads + writes) from samples group by 1) where value > 0 qualify rn <= 15"""))
def k6(spark, d):
    rows = bind(spark, d, "samples").groupBy(F.col("user_id").alias("object")).agg(F.max("reads").alias("reads"), F.max("writes").alias("writes"), F.max(F.col("reads") + F.col("writes")).alias("io"))
    return series.top_objects(rows.unpivot("object", ["reads", "writes", "io"], "class", "value"), ["class"], 15).select("class", "object", "value", "rn")


@query("k13_object_history", with_views("samples", "select strftime(day, '%Y-%m-%d') as day, rn, cast(reads as bigint) as value from (select *, row_number() over (partition by day order by reads desc, user_id) as rn from samples qualify rn <= 10) where user_id = (select arg_max(user_id, {'r': reads, 'u': -user_id}) from samples) and day >= date '2024-01-05'"))
def k13(spark, d):
    rows = bind(spark, d, "samples")
    tops = series.top_objects(rows.select(F.col("day").alias("captured_at"), F.col("user_id").alias("object"), F.col("reads").alias("value")), ["captured_at"], 10).withColumns({"kind": F.lit("table"), "class": F.lit("reads")})
    most = rows.agg(F.max_by("user_id", F.struct("reads", -F.col("user_id")))).first()[0]
    return hot.object_history(tops, "table", most, "2024-01-05").select(F.col("captured_at").cast("string").alias("day"), "rn", "value")


@query("z8_harshest", with_views("probes", """
  select host, probe_at, blocked, longest_s from (select host, probe_at, count(distinct pid) as blocked, max(wait_s) as longest_s from probes group by 1, 2) qualify row_number() over (partition by host order by blocked desc, longest_s desc, probe_at desc) = 1"""))
def z8(spark, d):
    return workload.harshest(bind(spark, d, "probes"), ["host"])


@query("i16_exclude_locked", with_views("stat_indexes", "select host, index_id from stat_indexes where index_id not in (select o_custkey from orders where o_orderstatus = 'P')"))
def i16(spark, d):
    locks = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("index_id"), F.when(F.col("o_orderstatus") == "P", "AccessExclusiveLock").otherwise("RowShareLock").alias("mode"), F.lit(True).alias("granted"))
    return indexes.exclude_locked(bind(spark, d, "stat_indexes"), locks, ["index_id"]).select("host", "index_id")


@query("t9_measured_bloat", with_views("tuples", "select relid, 100.0::double * dead_bytes / nullif(table_bytes, 0) as dead_pct, 100.0::double * free_bytes / nullif(table_bytes, 0) as free_pct from tuples"))
def t9(spark, d):
    return sizes.measured_bloat(bind(spark, d, "tuples")).select("relid", "dead_pct", "free_pct")


@query("e2_mask_template", with_views("logs", f"select {_MASK} as template, count(*) as n from logs group by 1"))
def e2(spark, d):
    return bind(spark, d, "logs").groupBy(mask_template(F.col("text")).alias("template")).agg(F.count("*").alias("n"))


@query("e5_exclude_by_template", with_views("logs", f"select event_id from logs where lower(text) like '%did%' and not contains(lower({_MASK}), 'did view in <*>ms')"))
def e5(spark, d):
    return logs.log_search(bind(spark, d, "logs"), ["DID"], ["did view in <*>ms"]).select("event_id")


@query("s1_harmonise", with_views("storage_days", "select cluster, cast(null as bigint) as wal_bytes, cast(bytes as double) as bytes from storage_days"))
def s1(spark, d):
    schema = spark.createDataFrame([], "cluster string, wal_bytes long, bytes double").schema
    return snapshots.harmonise(bind(spark, d, "storage_days"), schema)


@query("s2_last_per_step", with_views("metrics", "select instance as target, series as signal, to_timestamp(floor(epoch(ts) / 21600) * 21600)::timestamp as ts, arg_max(value, {'t': ts, 'e': event_id}) as value from metrics group by 1, 2, 3"))
def s2(spark, d):
    rows = bind(spark, d, "metrics").select(F.col("instance").alias("target"), F.col("series").alias("signal"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("tie"))
    return snapshots.last_per_step(rows, "6 hours", "tie")


@query("l4_public_create", with_views("grants versions", "select distinct g.schema, case when v.version_num < 150000 then 'warning' else 'error' end as level from grants g join versions v on v.host = g.host where grantee = 'public' and privilege = 'CREATE'"))
def l4(spark, d):
    return schema_checks.public_create(bind(spark, d, "grants"), bind(spark, d, "versions"), ["host"]).select("schema", "level")


def _findings(spark, d):
    """Reports as findings, with the owning relation's name."""
    named = bind(spark, d, "classes").select(F.col("relid").alias("conrelid"), "schema", "object")
    # four reports read the pairs, which read the columns twice: each is written once
    columns = settled(bind(spark, d, "attributes").select("attrelid", "attnum", "attname", "type", "typmod", "notnull"), "columns")
    pairs = settled(keys.fk_columns(catalog._constraints(spark, d), columns, NO_KEY).drop("to_attname", "to_notnull", "from_num", "to_num"), "pairs")
    parts = [
        ("invalid_constraint", bind(spark, d, "constraints").where("not validated").select("conrelid", F.col("name").cast("string").alias("within"))),
        ("fk_type_mismatch", keys.fk_type_mismatch(pairs, NO_KEY).select("conrelid", F.col("name").cast("string").alias("within"))),
        ("fk_nullable", keys.fk_nullable(pairs, NO_KEY).select("conrelid", F.col("columns").alias("within"))),
        ("fk_similar", keys.fk_similar(pairs, NO_KEY).select("conrelid", F.col("name2").cast("string").alias("within"))),
    ]
    out = None
    for code, rows in parts:
        part = schema_checks.from_rows(rows.join(named, "conrelid"), NO_KEY, code, "within")
        out = part if out is None else out.unionByName(part)
    return out


_FOUND = catalog._pairs_sql("").rstrip() + """, e as (select name, conrelid, confrelid, string_agg(coalesce(from_attname, '?'), ',' order by pos) as columns from p group by all), n as (select c_custkey as relid, c_nationkey as schema,
  case when mod(c_custkey, 17) = 0 then 'user' when mod(c_custkey, 17) = 1 then concat('t-', cast(c_custkey as varchar(20))) else concat('t', cast(c_custkey as varchar(20))) end as object from customer),
  f as (select 'invalid_constraint' as code, 'warning' as level, conrelid, cast(name as varchar) as within from constraints where not validated
  union all select distinct 'fk_type_mismatch', 'warning', conrelid, cast(name as varchar) from p where from_type <> to_type or from_typmod <> to_typmod
  union all select 'fk_nullable', 'notice', conrelid, string_agg(coalesce(from_attname, '?'), ',' order by pos) from p where matchtype <> 'f' and not from_notnull group by name, conrelid, confrelid
  union all select 'fk_similar', 'notice', a.conrelid, cast(b.name as varchar) from e a join e b on a.conrelid = b.conrelid and a.confrelid = b.confrelid and a.columns = b.columns and a.name < b.name)"""


@query("l12_findings", _FOUND + " select code, level, schema, object, within from f join n on n.relid = f.conrelid")
def l12(spark, d):
    return _findings(spark, d).select("code", "level", "schema", "object", "within")


@query("l20_suppress", _FOUND + " select code, schema, object, within from f join n on n.relid = f.conrelid where code <> 'fk_similar' and cast(schema as varchar) not like '1%'")
def l20(spark, d):
    rows = _findings(spark, d).withColumn("schema", F.col("schema").cast("string"))
    return schema_checks.suppress(rows, ["1*"], ["fk_similar"]).select("code", F.col("schema").cast("long").alias("schema"), "object", "within")


@query("l21_first_page", _FOUND + " select code, level, schema, object, within from f join n on n.relid = f.conrelid order by case level when 'error' then 0 when 'warning' then 1 else 2 end, code, object, within, schema limit 60")
def l21(spark, d):
    return schema_checks.order_findings(_findings(spark, d)).limit(60).select("code", "level", "schema", "object", "within")


_ROOTS = "r as (select child, cast(floor(child / pow(10, length(cast(child as varchar)) - 1)) as bigint) as root from edges)"


@query("v1_advisor_catalog", with_views("edges stat_tables", f"""
  , leaf as (select p_partkey as relid, cast(p_size as bigint) * 100 as n_rows from part), {_ROOTS}
  select l.relid, t.n_rows as rows, t.reads, t.writes from leaf l join (select coalesce(r.root, leaf.relid) as relid, cast(sum(n_rows) as bigint) as n_rows, cast(coalesce(sum(reads), 0) as bigint) as reads, cast(coalesce(sum(writes), 0) as bigint) as writes from leaf
    left join r on r.child = leaf.relid left join (select relid, sum(seq_scan) as reads, sum(n_tup_upd) as writes from stat_tables group by relid) c on c.relid = leaf.relid group by 1) t on t.relid = l.relid"""))
def v1(spark, d):
    relations = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("relid"), (F.col("p_size").cast("long") * 100).alias("rows"))
    counters = bind(spark, d, "stat_tables").select("relid", F.col("seq_scan").alias("reads"), F.col("n_tup_upd").alias("writes"))
    return advisor.advisor_catalog(relations, bind(spark, d, "edges"), counters, NO_KEY)


@query("v2_resolve_tables", with_views("relations mentions edges", f"""
  , {_ROOTS}, b as (select name, count(*) as n, min(relid) as relid from relations group by name)
  select h.fingerprint, h.seq, coalesce(r.root, h.found) as relid, h.reason from (select m.fingerprint, m.seq, case when m.schema is not null then f.relid when b.n = 1 then b.relid end as found,
      case when m.schema = 'pg_catalog' then 'system_relation' when (m.schema is not null and f.relid is not null) or (m.schema is null and b.n = 1) then null when m.schema is null and b.n > 1 then 'ambiguous_table' else 'unknown_relation' end as reason
    from mentions m left join relations f on f.schema = m.schema and f.name = m.name left join b on b.name = m.name) h left join r on r.child = h.found"""))
def v2(spark, d):
    relations = bind(spark, d, "relations").withColumnRenamed("name", "table")
    return advisor.resolve_tables(bind(spark, d, "mentions").withColumnRenamed("name", "table"), relations, bind(spark, d, "edges"), NO_KEY).select("fingerprint", "seq", "relid", "reason")


@query("v3_bind_usages", with_views("usages attributes", """
  , c as (select fingerprint, relid from usages union select fingerprint, relid + 1 from usages), o as (select c.fingerprint, concat('c', a.attnum) as col, count(*) as n, min(c.relid) as relid from c join attributes a on a.attrelid = c.relid group by all)
  select u.fingerprint, u.seq, u.col as "column", case when o.n = 1 then o.relid end as relid, case when o.n > 1 then 'ambiguous_column' when o.n is null then 'unknown_column' end as reason from usages u left join o on o.fingerprint = u.fingerprint and o.col = u.col"""))
def v3(spark, d):
    used = bind(spark, d, "usages")
    candidates = used.select("fingerprint", F.explode(F.array("relid", F.col("relid") + 1)).alias("relid")).distinct()
    return advisor.bind_usages(used.select("fingerprint", "seq", F.col("col").alias("column")), candidates, catalog._columns(spark, d), NO_KEY).select("fingerprint", "seq", "column", "relid", "reason")


_LIVE = f"""
  , drafts as (select fingerprint, relid, string_split(columns, ',') as cols from ({catalog._DRAFTS}) x where reason is null), eqs as (select fingerprint, relid, list(distinct col) as eq from usages where role = 'equality' group by all),
  live as (select indrelid as relid, case when nkeyatts = 1 or k1 = k2 then [concat('c', k1)] else [concat('c', k1), concat('c', k2)] end as has, is_unique from idx where valid and method = 'btree'),
  heads as (select d.*, coalesce(e.eq, []) as eq from drafts d left join eqs e on e.fingerprint = d.fingerprint and e.relid = d.relid),
  cut as (select *, coalesce(list_position(list_transform(cols, lambda c: list_contains(eq, c)), false) - 1, len(cols)) as h from heads)"""
_COVERED = "select c.fingerprint, c.relid, array_to_string(cols, ',') as columns from cut c where not exists (select 1 from live i where i.relid = c.relid and ((len(has) >= len(cols) and list_sort(has[1:h]) = list_sort(cols[1:h]) and has[h + 1:len(cols)] = cols[h + 1:len(cols)]) or (is_unique and len(list_filter(has, lambda x: not list_contains(eq, x))) = 0)))"


@query("v8_covered", with_views("usages classes attributes idx", catalog._KEYS + _LIVE + " " + _COVERED))
def v8(spark, d):
    return advisor.covered(catalog._drafts(spark, d), catalog._live_indexes(spark, d), NO_KEY).select("fingerprint", "relid", F.array_join("columns", ",").alias("columns"))


_CANDIDATES = f"""
  , cov as ({_COVERED}), flags as (select fingerprint, relid, bool_or(missing) as stats_missing from e group by all), widths as (select fingerprint, relid, count(*) filter (stop = 0) > 3 as wide from n group by all),
  pred as (select u.fingerprint, u.relid, string_agg(distinct u.col, ',' order by u.col) as predicate from usages u join attributes a on a.attrelid = u.relid and concat('c', a.attnum) = u.col where u.role = 'is_null' and a.null_frac > 0 and a.null_frac <= 0.5
    and not exists (select 1 from usages x where x.fingerprint = u.fingerprint and x.relid = u.relid and x.col = u.col and x.role in ('equality', 'range', 'order')) group by all),
  whole as (select cov.*, coalesce(predicate, '') as predicate, stats_missing, wide from cov left join pred using (fingerprint, relid) left join flags using (fingerprint, relid) left join widths using (fingerprint, relid)),
  names as (select distinct relid, predicate, columns from whole),
  target as (select k.relid, k.predicate, k.columns, arg_min(w.columns, {{'n': -len(string_split(w.columns, ',')), 'c': w.columns}}) as longest from names k join names w on k.relid = w.relid and k.predicate = w.predicate and (w.columns = k.columns or starts_with(w.columns, k.columns || ',')) group by all),
  cand as (select relid, predicate, longest as columns, list(distinct fingerprint) as fps, bool_or(stats_missing) as stats_missing, bool_or(wide) as wide from whole join target using (relid, predicate, columns) group by 1, 2, 3)"""


@query("v9_merge_prefixes", with_views("usages classes attributes idx", catalog._KEYS + _LIVE + _CANDIDATES + " select relid, predicate, columns, len(fps) as statements, stats_missing, wide from cand"))
def v9(spark, d):
    merged = advisor.merge_prefixes(advisor.covered(catalog._drafts(spark, d), catalog._live_indexes(spark, d), NO_KEY), NO_KEY)
    return merged.select("relid", "predicate", F.array_join("columns", ",").alias("columns"), F.size("fingerprints").alias("statements"), "stats_missing", "wide")


SQL["v12_candidates"] = with_views("usages classes attributes idx load", catalog._KEYS + _LIVE + _CANDIDATES + """
  , sums as (select c.relid, c.predicate, c.columns, sum(l.exec_ms) as ms, sum(l.calls) as calls from (select *, unnest(fps) as f from cand) c join load l on l.fingerprint = c.f group by all),
  rated as (select c.*, s.calls, case when t.total > 0 then 100.0::double * coalesce(s.ms, 0) / t.total else 0.0 end as weight_pct from cand c left join sums s using (relid, predicate, columns), (select sum(exec_ms) as total from load) t),
  told as (select r.*, k.relkind, k.reltuples, (select count(*) from idx i where i.indrelid = r.relid) as indexes, exists (select 1 from live i where i.relid = r.relid and len(list_filter(string_split(r.columns, ','), lambda x: not list_contains(i.has, x))) = 0) as alike from rated r left join classes k using (relid))
  select relid, predicate, columns, len(fps) as statements, cast(calls as bigint) as calls, weight_pct, concat_ws(',', case when alike then 'similar_index' end, case when indexes >= 10 then 'many_indexes' end, case when stats_missing then 'stats_missing' end, case when wide then 'wide_index' end,
    case when relkind = 'p' then 'partition_root' end, case when relkind = 'm' then 'materialized_view' end, case when reltuples >= 1000 and reltuples > 100 then 'write_heavy' end, case when weight_pct < 1 then 'low_weight' end) as warnings,
    row_number() over (partition by relid order by weight_pct desc, columns, predicate) as rn from told qualify rn <= 5""")

# One sample of each host a step; what a state becomes is said once, for spikes alone and for whole incidents.
_PROBES = """
  , a as (select instance, epoch(ts)::double as t, active::double as active, row_number() over (partition by instance order by ts) as rn,
    avg(active) over (partition by instance order by ts range between interval 6 hours preceding and interval 1 second preceding) as base from activity),
  walk as (with recursive s as (
    select distinct instance, 0::bigint as rn, null::double as since, null::double as high_at, 0 as high, 0 as seen, 0::double as peak, null::double as last, false as inside, null::double as bar, null::double as below, null::double as due,
      null::double as onset, null::double as fired, null::double as top, null::double as share, null::double as dropped, null::double as followed, null::double as seen_value from a
    union all
    select instance, rn, case when fire then null else since end, case when fire then null else high_at end, case when fire then 0 else high end, case when fire then 0 else seen end, case when fire then 0 else peak end, case when fire or fall then t else last end,
      case when fire then true when fall then false else inside end, bar, case when fall then null else below end, case when due <= t then null else due end,
      case when fire then since end, case when fire then t end, case when fire then peak end, case when fire then high::double / seen end, case when fall then t end, case when due <= t then due end, active
    from (select * replace (case when fire then t + 7200 when fall then null else due end as due) from (
      select *, kind in ('started', 'forming') and t - since >= 3600 and high::double / seen >= 0.5 and (last is null or t - last >= {gap}) as fire,
        kind in ('floor', 'aborted') and inside and active < bar and below_before is not null and t - below_before >= 3600 as fall
      from (select instance, rn, t, active, last, inside, due, kind, below as below_before,
          case when kind = 'none' then since when kind in ('floor', 'aborted') then null when kind = 'started' then t else since2 end as since,
          case when kind = 'none' then high_at when kind in ('floor', 'aborted') then null when up then t else high_at2 end as high_at,
          case when kind = 'none' then high when kind in ('floor', 'aborted') then 0 else high2 + up::int end as high, case when kind = 'none' then seen when kind in ('floor', 'aborted') then 0 else seen2 + 1 end as seen,
          case when kind = 'none' then peak when kind in ('floor', 'aborted') then 0 when up then greatest(peak2, active) else peak2 end as peak,
          case when kind = 'started' and not inside then base * 120 / 100 else bar end as bar,
          case when kind = 'none' then below when kind in ('started', 'forming') then null when not inside or active >= bar then null when below is null then t else below end as below
        from (select *, case when base is null then 'none' when base < 1 then 'floor' when not up and (since2 is null or t - high_at2 > 1800) then 'aborted' when up and since2 is null then 'started' else 'forming' end as kind
          from (select s.*, a.rn as rn2, a.t, a.active, a.base, coalesce(a.active >= a.base * 120 / 100, false) as up, case when old then null else since end as since2, case when old then null else high_at end as high_at2, case when old then 0 else high end as high2,
              case when old then 0 else seen end as seen2, case when old then 0 else peak end as peak2 from (select s.* replace (s.rn + 1 as rn) from s) s join a on a.instance = s.instance and a.rn = s.rn, lateral (select coalesce(a.base >= 1 and a.t - s.since > 14400, false) as old))))))
  ) select * from s)"""
SQL["z2_spike_events"] = with_views("activity", _PROBES.replace("{gap}", "3600") + " select instance, onset, fired as at, top as peak, share as coverage from walk where fired is not null")
SQL["z3_incidents"] = with_views("activity", _PROBES.replace("{gap}", "21600") + """
  select instance, 'activity_spike' as kind, fired as at, top as value from walk where fired is not null union all select instance, 'activity_drop', dropped, seen_value from walk where dropped is not null
  union all select instance, 'deferred', followed, seen_value from walk where followed is not null""")
