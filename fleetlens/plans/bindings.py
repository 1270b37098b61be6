"""Telemetry views over the driver's tables, in SQL that Spark and DuckDB read alike.

Money and other fractions are summed as whole numbers, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"]

VIEWS = {
    # a statement is a part, a database the supplier's nation, a user the ship flag
    "statements": """
        select l_partkey as queryid, s_nationkey as database, count(*) as calls, sum(cast(round(l_extendedprice * 100) as bigint)) as exec_ms,
          sum(cast(round(l_discount * 100) as bigint) * 100000) as io_ms, sum(cast(round(l_tax * 100) as bigint)) as plan_ms,
          sum(cast(round(l_quantity) as bigint)) as n_rows, sum(l_linenumber) as wal_bytes, sum(cast(round(l_quantity) as bigint) * l_linenumber) as blks_hit, sum(l_linenumber * 3) as blks_read
        from lineitem join supplier on l_suppkey = s_suppkey group by l_partkey, s_nationkey""",
    "user_statements": """
        select l_partkey as queryid, case when l_returnflag = 'R' then null else l_returnflag end as user_name, concat('select ', p_name) as query, 1 as calls,
          cast(round(l_extendedprice * 100) as bigint) as exec_ms
        from lineitem join part on l_partkey = p_partkey""",
    "snap_a": "select l_partkey as queryid, l_suppkey as database, count(*) as calls, sum(cast(round(l_quantity) as bigint)) as n_rows from lineitem where l_shipdate < timestamp '1995-06-17 00:00:00' group by l_partkey, l_suppkey",
    "snap_b": "select l_partkey as queryid, l_suppkey as database, count(*) as calls, sum(cast(round(l_quantity) as bigint)) as n_rows from lineitem where l_shipdate >= timestamp '1995-06-17 00:00:00' group by l_partkey, l_suppkey",
    "entries": """
        select cast(s_nationkey as varchar(10)) as host, l_partkey as queryid, case when l_linenumber = 7 then '' else p_type end as fingerprint,
          p_name as query, 1 as calls, cast(round(l_extendedprice * 100) as bigint) as exec_ms
        from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey""",
    # an index is a part, a host a supplier's nation, scans are lines
    "stat_indexes": """
        select s_nationkey as host, l_partkey as index_id, count(*) - 1 as idx_scan, sum(cast(round(l_quantity) as bigint)) as size_bytes, max(l_linenumber) >= 7 as is_unique,
          sum(l_linenumber) as idx_blks_hit, sum(case when l_returnflag = 'R' then 1 else 0 end) as idx_blks_read
        from lineitem join supplier on l_suppkey = s_suppkey group by s_nationkey, l_partkey""",
    "index_windows": """
        select s_nationkey as host, l_partkey as index_id, count(*) - 1 as idx_scan, (max(cast(l_shipdate as date)) - date '1992-01-01') as span
        from lineitem join supplier on l_suppkey = s_suppkey group by s_nationkey, l_partkey""",
    "edges": "select p_partkey as child, cast(floor(p_partkey / 10) as bigint) as parent from part where p_partkey >= 10",
    # a table is a customer
    "stat_tables": """
        select o_custkey as relid, c_nationkey as database, sum(case when o_orderstatus = 'F' then 1 else 0 end) as seq_scan, sum(case when o_orderstatus <> 'F' then 3 else 0 end) as idx_scan,
          count(*) * 1000 as n_live_tup, sum(case when o_orderpriority like '1%' then 400 else 10 end) as n_dead_tup, sum(case when o_orderstatus = 'O' then 1 else 0 end) as n_tup_ins,
          sum(case when o_orderstatus = 'F' then 1 else 0 end) as n_tup_upd, sum(case when o_orderstatus = 'P' then 1 else 0 end) as n_tup_del, sum(case when o_orderpriority like '2%' then 1 else 0 end) as n_tup_hot_upd,
          sum(case when o_orderpriority like '3%' then 900 else 0 end) as n_ins_since_vacuum, sum(case when o_orderpriority like '4%' then 300 else 0 end) as n_mod_since_analyze,
          cast(count(*) * 900 as double) as reltuples
        from orders join customer on o_custkey = c_custkey group by o_custkey, c_nationkey""",
    # an instance is a nation and a month of orders
    "raw_counts": """
        select c_nationkey as instance, extract(month from o_orderdate) as mon, count(*) as n, sum(case when o_orderpriority like '1%' then 1 else 0 end) as p1,
          sum(case when o_orderpriority like '2%' then 1 else 0 end) as p2, sum(case when o_orderpriority like '3%' then 1 else 0 end) as p3, sum(case when o_orderstatus = 'F' then 1 else 0 end) as f,
          sum(case when o_orderstatus = 'P' then 1 else 0 end) as p, max(cast(floor(o_totalprice) as bigint)) as top, min(cast(floor(o_totalprice) as bigint)) as low, sum(mod(o_custkey, 7)) as s
        from orders join customer on o_custkey = c_custkey group by c_nationkey, extract(month from o_orderdate)""",
    "raw": """
        select instance, mon, n as conn_total, n + p1 as conn_max, mod(p1, 8) as idle_in_tx, mod(top, 900) as longest_tx_s, 80 + mod(s, 21) as cache_hit_pct, n * 5000 as cache_sample,
          mod(p2, 37) as dead_max_pct, mod(p3, 22) as dead_avg_pct, mod(f, 9) as bloated_tables, mod(p, 5) / 16e0 as newpage_ratio, mod(s, 3) as replicas, mod(top, 41) as replica_lag_s, mod(low, 700) as replica_lag_mb,
          case when mod(s, 11) = 0 then 1 else 0 end as replicas_lost, mod(top, 37) * 50000000 as xid_age, mod(low, 1700) as vacuum_overdue_h, mod(p1, 19) as vacuum_backlog, mod(p2, 4) as never_vacuumed,
          mod(p3, 6) as autovac_off_tables, mod(f, 7) as stale_stats, mod(low, 29) * 5000000 as horizon_age, 8 + mod(p2, 40) as checkpoints_timed, mod(p, 9) as checkpoints_req, mod(f, 13) as lock_waiters,
          mod(top, 71) as lock_wait_s, mod(p2, 17) as ungranted, mod(p3, 8) / 8e0 as lock_pool, mod(low, 120) as deadlocks, mod(s, 17) = 3 as autovacuum_off, mod(s, 19) = 5 as track_counts_off, mod(s, 5) = 1 as io_timing_off,
          mod(p1, 8) / 1e0 as latency_ratio, mod(p2, 8) / 1e0 as seqscan_ratio, mod(f, 9) / 8e0 as hot_ratio, mod(p, 16) / 16e0 as disk_used, mod(p3, 5) / 1e0 as load_per_cpu, mod(f, 8) / 8e0 as pooler_used,
          case when mod(s, 23) = 7 then 1 else 0 end as checksum_failures, mod(s, 4) = 2 as in_recovery,
          mod(low, 37) * 50000000 as relfrozenxid_age, case mod(s, 3) when 0 then 'minimal' when 1 then 'logical' else 'replica' end as wal_level, mod(p1, 2) as logical_slots, mod(f, 4) = 0 as wal_level_managed, mod(top, 64) / 64e0 as sequence_used
        from raw_counts""",
    # a signal is an event type's hourly value
    "series": "select concat('t', cast(mod(user_id, 2) as varchar(2))) as target, event_type as signal, date_trunc('hour', ts) as ts, count(*) as value, sum(cast(round(value * 100) as bigint)) as total from events group by concat('t', cast(mod(user_id, 2) as varchar(2))), event_type, date_trunc('hour', ts)",
    "objects": "select event_type as class, user_id as object, sum(cast(round(value * 100) as bigint)) as value from events group by event_type, user_id",
    "samples": """
        select user_id, day, sum(n) over (partition by user_id order by day) - case when mod(user_id, 17) = 0 and day >= date '2024-01-15' then 40 else 0 end as reads,
          sum(v) over (partition by user_id order by day) as writes
        from (select user_id, cast(ts as date) as day, count(*) as n, sum(cast(round(value * 100) as bigint)) as v from events group by user_id, cast(ts as date)) x""",
    "roles": "select o_custkey as instance, o_orderkey as pos, o_orderdate as ts, o_orderstatus = 'F' as in_recovery from orders",
    "activity": "select event_type as instance, date_trunc('hour', ts) as ts, count(*) as active from events group by event_type, date_trunc('hour', ts)",
    "sessions": "select o_orderkey as pid, o_custkey as database, case when o_orderstatus = 'O' then 'active' when o_orderstatus = 'F' then 'idle' else 'idle in transaction' end as state, o_orderpriority as wait_event from orders",
    "locks": """
        select c_nationkey as cluster, o_custkey as relation, o_orderkey as pid, o_orderstatus <> 'O' as granted,
          case when mod(o_orderkey, 5) = 0 then o_custkey else null end as transactionid
        from orders join customer on o_custkey = c_custkey""",
    "waits": "select cust as cluster, pid, blocker from (select o_custkey as cust, o_orderkey as pid, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as blocker, o_orderdate from orders) x where blocker is not null",
    "logs": """
        select event_id, ts, case when event_type = 'error' then 'ERROR' when event_type = 'view' then 'WARNING' when event_type = 'purchase' then 'LOG' when event_type = 'signup' then (case when mod(event_id, 2) = 0 then 'fatal' else 'odd' end) else 'INFO' end as severity,
          concat('user ', cast(user_id as varchar(20)), ' did ', event_type, ' in ', cast(mod(event_id, 700) as varchar(4)), 'ms  at 0/1A', cast(mod(event_id, 10) as varchar(2)), ' of 0xdeadBEEF in deadbeef with ', props) as text
        from events""",
    "storage_days": "select event_type as cluster, cast(ts as date) as dt, count(*) * 1000 as bytes from events group by event_type, cast(ts as date)",
    "trigger_log": "select event_id, ts, event_type as kind, concat('C', cast(mod(user_id, 10) as varchar(2))) as cluster, case when mod(event_id, 7) = 0 then 'empty' else 'ok' end as outcome from events",
    "sequences": "select p_partkey as seq_id, mod(p_partkey, 3) = 0 as is_int4, cast(floor(p_retailprice * 1000000) as bigint) as last_value, cast(2147483647 as bigint) as max_value from part",
    # a table is a customer, a column of it a line number, an index or a foreign key an order
    "attributes": """
        select o_custkey as attrelid, l_linenumber as attnum, concat('c', cast(l_linenumber as varchar(2)), case when mod(sum(l_suppkey), 5) = 0 then '_id' else '' end) as attname,
          case when mod(sum(l_partkey), 4) = 0 then 'varchar' when mod(sum(l_partkey), 4) = 1 then 'int' else 'uuid' end as type, case when mod(sum(l_suppkey), 3) = 0 then 40 else -1 end as typmod,
          mod(sum(l_orderkey), 2) = 0 as notnull, cast(mod(sum(l_partkey), 16) as double) / 16e0 as null_frac, case when mod(sum(l_suppkey), 13) = 0 then null else 4 + mod(sum(l_partkey), 60) end as avg_width,
          case when mod(sum(l_suppkey), 6) = 0 then null when mod(sum(l_suppkey), 6) = 1 then -1e0 when mod(sum(l_suppkey), 6) = 2 then -0.5e0 else cast(mod(sum(l_partkey), 900) as double) end as n_distinct,
          mod(sum(l_suppkey), 7) = 0 as is_array, case when mod(sum(l_partkey), 3) = 0 then 'x' else 'p' end as storage
        from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_linenumber""",
    "constraints": """
        select o_orderkey as name, o_custkey as conrelid, cast(floor(o_custkey / 2) as bigint) as confrelid, mod(o_orderkey, 7) + 1 as k1, mod(o_orderkey, 5) + 1 as k2, mod(o_orderkey, 3) + 1 as f1, mod(o_orderkey, 3) + 4 as f2,
          case when mod(o_orderkey, 6) = 0 then 'f' else 's' end as matchtype, o_orderstatus <> 'P' as validated, o_orderkey + mod(o_orderkey, 2) as indexrelid
        from orders""",
    "idx": """
        select o_orderkey as indexrelid, o_custkey as indrelid, mod(o_orderkey, 7) + 1 as k1, mod(cast(floor(o_totalprice) as bigint), 6) + 1 as k2, case when mod(o_orderkey, 4) = 0 then 1 else 2 end as nkeyatts,
          o_orderstatus = 'F' as is_unique, mod(o_orderkey, 11) <> 0 as valid, mod(o_orderkey, 13) <> 0 as ready, case when mod(o_orderkey, 9) = 0 then 'hash' else 'btree' end as method,
          cast(floor(o_totalprice) as bigint) as reltuples, mod(cast(floor(o_totalprice) as bigint), 997) + 1 as relpages, cast(floor(o_totalprice) as bigint) as size_bytes,
          concat('CREATE ', case when o_orderstatus = 'F' then 'UNIQUE ' else '' end, 'INDEX i', cast(o_orderkey as varchar(20)), ' ON t USING btree (c', cast(mod(o_orderkey, 2) as varchar(2)), case when mod(o_orderkey, 3) = 0 then ' DESC' else '' end,
            case when mod(o_orderkey, 5) = 0 then ' NULLS LAST' else '' end, ', c', cast(mod(o_custkey, 2) as varchar(2)), ')', case when mod(o_orderkey, 8) = 0 then ' WHERE x' else '' end) as definition
        from orders""",
    "classes": """
        select c_custkey as relid, c_nationkey as schema, case when mod(c_custkey, 17) = 0 then 'user' when mod(c_custkey, 17) = 1 then concat('t-', cast(c_custkey as varchar(20))) else concat('t', cast(c_custkey as varchar(20))) end as object,
          case when mod(c_custkey, 10) = 1 then 'p' when mod(c_custkey, 10) = 2 then 'm' when mod(c_custkey, 10) = 3 then 'S' else 'r' end as relkind, case when mod(c_custkey, 9) = 0 then 'u' else 'p' end as relpersistence,
          mod(c_custkey * 37, 5000) + 1 as relpages, mod(c_custkey * 7919, 900000) as reltuples, (mod(c_custkey * 37, 5000) + 1) * 16384 as total_bytes, mod(c_custkey, 50) as toast_pages, mod(c_custkey, 900) as toast_tuples,
          case when mod(c_custkey, 2) = 1 then c_custkey + 1 else null end as reltoastrelid, mod(c_custkey * 7919, 2000) * 1000000 as xid_age
        from customer""",
    "progress": "select user_id as host, event_type as kind, mod(user_id, 7) as pid, ts, cast(round(value * 100) as bigint) as done, 100000 as total, event_id from events",
    "clients": """
        select o_custkey as host, o_orderkey as pid, case when o_orderpriority like '5%' then null else o_orderpriority end as database, case when o_orderstatus = 'F' then null else concat('u', cast(mod(o_orderkey, 5) as varchar(2))) end as user_name,
          case when o_orderstatus = 'O' then 'active' when o_orderstatus = 'F' then 'idle in transaction' else 'strange' end as state, case when mod(o_orderkey, 3) = 0 then 'client backend' else 'walwriter' end as backend_type
        from orders""",
    "stat_db": "select c_nationkey as database, sum(case when o_orderstatus = 'F' then 1 else 0 end) as xact_commit, sum(case when o_orderstatus = 'P' then 1 else 0 end) as xact_rollback, sum(mod(o_orderkey, 3)) as deadlocks, sum(mod(o_custkey, 5)) as conflicts, sum(mod(o_orderkey, 2)) as checksum_failures, sum(cast(floor(o_totalprice) as bigint)) as size_bytes, min(o_orderdate) as stats_reset, max(o_orderdate) as captured_at from orders join customer on o_custkey = c_custkey group by c_nationkey",
    "settings": """
        select host, name, max(setting) as setting, max(source) as source from (select o_custkey as host,
          case mod(o_orderkey, 8) when 0 then 'log_min_duration_statement' when 1 then 'from_collapse_limit' when 2 then 'huge_pages' when 3 then 'wal_compression' when 4 then 'autovacuum' when 5 then 'autovacuum_naptime' when 6 then 'vacuum_cost_limit' else 'maintenance_work_mem' end as name,
          case mod(o_orderkey, 8) when 2 then (case when o_orderstatus = 'F' then 'off' else 'on' end) when 3 then (case when o_orderstatus = 'F' then 'pglz' else 'lz4' end) when 4 then (case when o_orderstatus = 'F' then 'off' else 'on' end)
            else cast(mod(cast(floor(o_totalprice) as bigint), 12) as varchar(20)) end as setting,
          case when o_orderstatus = 'F' then 'default' else 'file' end as source from orders) x group by host, name""",
    "writer": "select c_custkey as host, mod(c_custkey, 90) as req, mod(c_custkey, 50) as timed, c_custkey * 10 as maxwritten_clean, mod(c_custkey, 5) as days from customer",
    "seqs": """
        select p_partkey as object, mod(p_partkey, 20) as schema, cast(floor(p_retailprice * 100000) as bigint) * (mod(p_partkey, 15) + 8) as last_value, 1 as start, case when mod(p_partkey, 3) = 0 then 9223372036854775807 else 2147483647 end as max_value, 1 as min_value,
          1 as increment, mod(p_partkey, 11) = 0 as cycle, mod(p_partkey, 13) <> 0 as last_value_known, case when mod(p_partkey, 3) = 0 then 'integer' else 'bigint' end as owned_column_type
        from part""",
    # a statement's usages are an order's lines, its table the customer
    "usages": """
        select l_orderkey as fingerprint, o_custkey as relid, l_linenumber as seq, concat('c', cast(mod(l_partkey, 7) + 1 as varchar(2))) as col, case l_returnflag when 'R' then 'equality' when 'A' then 'range' else (case when mod(l_suppkey, 3) = 0 then 'is_null' when mod(l_suppkey, 3) = 1 then 'order' else 'equality' end) end as role
        from lineitem join orders on l_orderkey = o_orderkey""",
    "load": "select l_orderkey as fingerprint, sum(cast(round(l_extendedprice * 100) as bigint)) as exec_ms, count(*) as calls from lineitem group by l_orderkey",
    "triggers": "select event_id, user_id as instance, ts, event_type as kind from events",
    "metrics": "select event_type as instance, 'statements_calls' as metric, 'all' as label, user_id as series, ts, cast(round(value * 100) as double) as value, event_id from events",
}

VIEWS |= {
    # a capture is an event, statistics were reset at the start of its day
    "captures": "select event_id, user_id, ts as captured_at, date_trunc('day', ts) as stats_reset from events",
    # a running session is an order
    "running": """
        select o_custkey as host, o_orderkey as pid, cast(floor(o_totalprice) as bigint) as running_ms, case when o_orderstatus = 'O' then null else o_orderpriority end as wait_event,
          concat('select ', o_orderpriority, ' from t', cast(mod(o_orderkey, 9) as varchar(2))) as query from orders""",
    "ddl_texts": """
        select c_custkey as queryid, concat('alter role r password ', chr(39), c_name, chr(39), '; postgres://u:', cast(c_custkey as varchar(20)), '@h/db password=', c_mktsegment, ' tail') as query from customer""",
    "vacuums": """
        select o_custkey as relid, concat('T_', cast(o_custkey as varchar(20))) as relname, max(case when o_orderstatus = 'F' then o_orderdate end) as last_vacuum, max(case when o_orderstatus = 'O' then o_orderdate end) as last_autovacuum,
          min(case when o_orderstatus = 'P' then o_orderdate end) as last_analyze, min(case when o_orderpriority like '1%' then o_orderdate end) as last_autoanalyze from orders group by o_custkey""",
    # a replica is an event, its positions are made of its numbers
    "replicas": """
        select event_id as pid, user_id as host, mod(event_id, 3) <> 0 as in_recovery, ts as last_replay_at, date_trunc('day', ts) + interval '1' day as captured_at, concat('2/', hex(event_id * 4096 + 4096)) as current_lsn,
          concat('2/', hex(event_id * 4096 + 4096 - mod(user_id, 5) * 100)) as replay_lsn, concat('2/', hex(event_id * 4096 + 4096)) as receive_lsn, concat('1/', hex(event_id)) as restart_lsn,
          mod(user_id, 5) * 100 as behind, 4294967296 + event_id * 4095 + 4096 as backlog from events""",
    "grants": "select c_custkey as schema, case when mod(c_custkey, 3) = 0 then 'public' else 'app' end as grantee, case when mod(c_custkey, 2) = 0 then 'CREATE' else 'USAGE' end as privilege, c_nationkey as host from customer",
    "versions": "select n_nationkey as host, 140000 + 10000 * mod(n_nationkey, 3) as version_num from nation",
    # a lock probe is a date of orders
    "probes": "select mod(o_custkey, 50) as host, o_orderdate as probe_at, o_orderkey as pid, cast(floor(o_totalprice) as bigint) as wait_s from orders",
    "tuples": "select c_custkey as relid, mod(c_custkey * 7919, 5000) as dead_bytes, mod(c_custkey * 104729, 9000) as free_bytes, case when mod(c_custkey, 7) = 0 then 0 else c_custkey * 8192 end as table_bytes from customer",
    # statements name tables; some names are in two schemas, some in none
    "relations": "select p_partkey as relid, concat('s', cast(mod(p_partkey, 2) as varchar(2))) as schema, concat('t', cast(mod(p_partkey, 151) as varchar(20)), '_', cast(floor(p_partkey / 302) as varchar(20))) as name from part",
    "mentions": """
        select l_orderkey as fingerprint, case when mod(l_linenumber, 3) = 0 then 'pg_catalog' when mod(l_linenumber, 3) = 1 then concat('s', cast(mod(l_suppkey, 2) as varchar(2))) end as schema,
          concat('t', cast(mod(l_partkey, 160) as varchar(20)), '_', cast(floor(l_partkey / 302) as varchar(20))) as name, l_linenumber as seq from lineitem""",
}

NEEDS = {"raw": ["raw_counts"]}


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A telemetry view over the tables of sf_dir; nothing is registered under a name that outlives the call."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if _uses(name, t)}
    sql = with_views(name, f"select * from {name}")
    for t in frames:
        sql = _replace(sql, t, "{" + t + "}")
    return spark.sql(sql, **frames)


def _uses(name: str, table: str) -> bool:
    import re

    return any(re.search(rf"\b(from|join) {table}\b", VIEWS[v]) for v in [name, *NEEDS.get(name, [])])


def _replace(sql: str, table: str, to: str) -> str:
    import re

    return re.sub(rf"\b(from|join) {table}\b", lambda m: f"{m[1]} {to}", sql)


def with_views(names: str, select: str) -> str:
    """``select`` behind the definitions of the views that it names (space-separated), as the oracle runs it."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in wanted) + " " + select
