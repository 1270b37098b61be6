"""Registered queries over catalog facts: keys, indexes, tables, sessions, settings, schema checks, index advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.graph import root_of
from fleetlens.operators import advisor, keys, maintenance, schema_checks, sizes
from fleetlens.plans.bindings import bind, with_views
from fleetlens.plans.registry import query

NO_KEY: list[str] = []
# pairs of foreign-key columns with both sides' facts, as the oracle has them
_PAIRS = """p as (select c.name, c.conrelid, c.confrelid, c.matchtype, c.pos, a.attname as from_attname, a.type as from_type, a.typmod as from_typmod, a.notnull as from_notnull, b.attname as to_attname, b.type as to_type, b.typmod as to_typmod
  from (select name, conrelid, confrelid, matchtype, 0 as pos, k1 as k, f1 as f from constraints union all select name, conrelid, confrelid, matchtype, 1, k2, f2 from constraints) c
  left join attributes a on a.attrelid = c.conrelid and a.attnum = c.k left join attributes b on b.attrelid = c.confrelid and b.attnum = c.f)"""


def _pairs_sql(select: str) -> str:
    return with_views("constraints attributes", "").rstrip() + ", " + _PAIRS + " " + select


def _constraints(spark, d):
    return bind(spark, d, "constraints").withColumns({"conkey": F.array("k1", "k2"), "confkey": F.array("f1", "f2")})


def _pairs(spark, d):
    return keys.fk_columns(_constraints(spark, d), bind(spark, d, "attributes"), NO_KEY)


def _indexes(spark, d):
    return bind(spark, d, "idx").withColumnRenamed("is_unique", "unique").withColumn("indkey", F.array("k1", "k2"))


@query("f1_fk_columns", _pairs_sql("select name, pos, from_attname, to_attname, from_type, to_type from p"))
def f1(spark, d):
    return _pairs(spark, d).select("name", "pos", "from_attname", "to_attname", "from_type", "to_type")


_LIST = "string_agg(coalesce(from_attname, '?'), ',' order by pos) as columns"


@query("f2_fk_nullable", _pairs_sql(f"select name, conrelid, confrelid, {_LIST} from p where matchtype <> 'f' and not from_notnull group by name, conrelid, confrelid"))
def f2(spark, d):
    return keys.fk_nullable(_pairs(spark, d), NO_KEY)


@query("f3_fk_similar", _pairs_sql(f"select a.conrelid, a.confrelid, a.name, b.name as name2 from (select name, conrelid, confrelid, {_LIST} from p group by all) a join (select name, conrelid, confrelid, {_LIST} from p group by all) b on a.conrelid = b.conrelid and a.confrelid = b.confrelid and a.columns = b.columns and a.name < b.name"))
def f3(spark, d):
    return keys.fk_similar(_pairs(spark, d), NO_KEY)


@query("f3_fk_overlap", _pairs_sql("select distinct a.conrelid, a.confrelid, a.name, b.name as name2 from p a join p b on a.conrelid = b.conrelid and a.confrelid = b.confrelid and a.from_attname = b.from_attname and a.name < b.name"))
def f3_overlap(spark, d):
    return keys.fk_similar(_pairs(spark, d), NO_KEY, "overlap")


@query("f4_fk_type_mismatch", _pairs_sql(f"select name, conrelid, confrelid, {_LIST} from p where from_type <> to_type or from_typmod <> to_typmod group by name, conrelid, confrelid"))
def f4(spark, d):
    return keys.fk_type_mismatch(_pairs(spark, d), NO_KEY)


@query("f5_invalid_constraints", with_views("constraints classes", "select schema, object as relname, name from constraints join classes on conrelid = relid where not validated"))
def f5(spark, d):
    return keys.invalid_constraints(_constraints(spark, d), bind(spark, d, "classes").withColumnRenamed("object", "relname"), NO_KEY)


_PAD = "mod(8 - mod({0}, 8), 8)"


@query("i1_index_bloat", with_views("idx attributes", f"""
  select indrelid, indexrelid, cast(greatest(relpages - (ceil(reltuples * (4 + 2 + {_PAD.format('h')} + w + {_PAD.format('cast(round_even(w, 0) as bigint)')}) / 8168) + 1), 0) * 8192 as bigint) as bloat_bytes, cast(relpages * 8192 as bigint) as index_bytes
  from (select i.indrelid, i.indexrelid, i.reltuples, i.relpages, case when max(null_frac) = 0 then 2 else 6 end as h, sum((1 - null_frac) * avg_width) as w
    from (select *, k1 as k from idx union all select *, k2 as k from idx) i join attributes a on a.attrelid = i.indrelid and a.attnum = i.k and a.avg_width is not null where method = 'btree' group by all)"""))
def i1(spark, d):
    return sizes.index_bloat(_indexes(spark, d), bind(spark, d, "attributes"), NO_KEY)


@query("i2_btree_on_array", with_views("idx attributes", "select distinct i.indrelid, i.indexrelid from (select *, k1 as k from idx union all select *, k2 as k from idx where nkeyatts = 2) i join attributes a on a.attrelid = i.indrelid and a.attnum = i.k and a.is_array where method = 'btree' and not is_unique"))
def i2(spark, d):
    return sizes.btree_on_array(_indexes(spark, d), bind(spark, d, "attributes"), NO_KEY)


@query("i5_invalid_indexes", with_views("idx constraints", "select indrelid, i.indexrelid, c.constraints from idx i left join (select indexrelid, string_agg(cast(name as varchar), ',' order by name) as constraints from constraints group by 1) c on c.indexrelid = i.indexrelid where not valid or not ready"))
def i5(spark, d):
    return sizes.invalid_indexes(_indexes(spark, d), _constraints(spark, d), NO_KEY)


_SIMPLE = "regexp_replace(regexp_replace(regexp_replace(definition, ' INDEX .* ON ', ' INDEX ON ', 'g'), ' NULLS LAST([,)])', '\\1', 'g'), ' DESC([,)])', '\\1', 'g')"


@query("i7_similar_unique", with_views("idx", f"select a.indrelid, a.indexrelid as unique_index, b.indexrelid as \"index\" from (select *, replace({_SIMPLE}, ' UNIQUE ', ' ') as s from idx where is_unique) a join (select *, {_SIMPLE} as s from idx where not is_unique) b on a.indrelid = b.indrelid and a.s = b.s"))
def i7(spark, d):
    return sizes.similar_unique(_indexes(spark, d), NO_KEY)


@query("i9_similar_loose", with_views("idx", f"select a.indrelid, a.indexrelid, b.indexrelid as indexrelid2 from (select *, regexp_replace(replace({_SIMPLE}, ' UNIQUE ', ' '), ' WHERE .*$', '') as s from idx) a join (select *, regexp_replace(replace({_SIMPLE}, ' UNIQUE ', ' '), ' WHERE .*$', '') as s from idx) b on a.indrelid = b.indrelid and a.s = b.s and a.indexrelid < b.indexrelid"))
def i9(spark, d):
    return sizes.similar_loose(_indexes(spark, d), NO_KEY)


@query("i10_index_top_size", with_views("idx", "select indrelid, indexrelid, size_bytes, row_number() over (partition by indrelid order by size_bytes desc, indexrelid) as rn from idx qualify rn <= 3"))
def i10(spark, d):
    return sizes.index_top_size(_indexes(spark, d), ["indrelid"], 3)


@query("t1_table_top_size", with_views("classes attributes idx", f"""
  , c as (select c.*, coalesce(p.pages, 0) + relpages + toast_pages as approx from classes c left join (select indrelid, sum(relpages) as pages from idx group by 1) p on p.indrelid = c.relid where relkind in ('r', 'p', 'm')),
  cut as (select * from c qualify row_number() over (partition by schema order by approx desc, relid) <= 50), top as (select *, row_number() over (partition by schema order by total_bytes desc, relid) as rn from cut where total_bytes > 512000 qualify rn <= 10),
  st as (select attrelid, count(*) filter (avg_width is null) as missing, sum((1 - null_frac) * avg_width) as data, max(null_frac) as nulls, 24 + floor(count(*) filter (null_frac <> 0) / 8) as nh from attributes group by 1),
  est as (select schema, relid, rn, total_bytes, (relpages + toast_pages) * 8192 as table_bytes, case when missing = 0 and relkind = 'r' then (ceil(reltuples * (data + 24 + nulls * (nh + {_PAD.format('nh')}) + 4 + {_PAD.format('data + 24')}) / 8172) + ceil(toast_tuples / 4)) * 8192 end as e from top left join st on attrelid = relid)
  select schema, relid, rn, total_bytes, table_bytes, cast(case when e > 0 then e end as bigint) as expected_bytes, cast(case when e > 0 then (case when e <= table_bytes then table_bytes - e else 0 end) end as bigint) as bloat_bytes from est"""))
def t1(spark, d):
    pages = bind(spark, d, "idx").groupBy("indrelid").agg(F.sum("relpages").alias("pages"))
    classes = bind(spark, d, "classes")
    schema = classes.select(F.col("relid").alias("indrelid"), "schema")
    columns = bind(spark, d, "attributes").join(schema.withColumnRenamed("indrelid", "attrelid"), "attrelid")
    return sizes.table_top_size(classes, pages.join(schema, "indrelid"), columns, ["schema"], 10)


@query("t6_row_estimate", with_views("attributes classes", """
  select relid, n as columns_total, m as columns_with_stats, s as sum_avg_width, b as row_bytes, b > 2048 as will_toast, 8168 // (b + 4) as rows_per_page, cand as toast_candidates
  from (select attrelid as relid, count(*) as n, count(avg_width) as m, cast(coalesce(sum(avg_width), 0) as bigint) as s, 23 + (count(*) + 7) // 8 + cast(coalesce(sum(avg_width), 0) as bigint) as b,
    coalesce(string_agg(attname, ',' order by avg_width desc, attname) filter (storage = 'x' and avg_width is not null), '') as cand from attributes group by 1) join classes using (relid)"""))
def t6(spark, d):
    rows = sizes.row_estimate(bind(spark, d, "attributes"), bind(spark, d, "classes"), NO_KEY)
    return rows.select("relid", "columns_total", "columns_with_stats", "sum_avg_width", "row_bytes", "will_toast", "rows_per_page", "toast_candidates")


@query("t8_summary", with_views("classes", "select schema, case relkind when 'r' then 'Tables' when 'm' then 'Mat Views' when 'S' then 'Sequences' else 'Partitioned table' end as kind, cast(sum(relpages) * 8192 as bigint) as approx_bytes, count(*) as amount from classes group by all having sum(relpages) > 10"))
def t8(spark, d):
    return sizes.summary(bind(spark, d, "classes"), NO_KEY)


@query("m3_xid_danger", with_views("classes", "select c.relid, 2146483648 - greatest(c.xid_age, t.xid_age) as transactions_left from classes c left join classes t on t.relid = c.reltoastrelid where c.relkind = 'r' and 2146483648 - greatest(c.xid_age, t.xid_age) < 1000000000"))
def m3(spark, d):
    return maintenance.xid_danger(bind(spark, d, "classes"), NO_KEY, 2146483648, 1000000000)


@query("m5_progress", with_views("progress", """
  select event_id, pct, rate, case when rate > 0 then (total - done) / rate end as seconds_left from (select event_id, total, done, 100.0::double * done / total as pct,
    case when done - lag(done) over w >= 0 and epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) over w)) > 0 then (done - lag(done) over w)::double / (epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) over w))) end as rate
    from progress window w as (partition by host, kind, pid order by ts))"""))
def m5(spark, d):
    return maintenance.progress(bind(spark, d, "progress"), ["host"]).select("event_id", "pct", "rate", "seconds_left")


@query("c1_connection_sources", with_views("clients", "select coalesce(database, backend_type) as database, coalesce(user_name, backend_type) as \"user\", state as app, backend_type as client_addr, count(*) as n from clients group by all"))
def c1(spark, d):
    rows = bind(spark, d, "clients").withColumnsRenamed({"user_name": "user", "state": "app"}).withColumn("client_addr", F.lit(None).cast("string"))
    return maintenance.connection_sources(rows, NO_KEY)


@query("c3_sessions", with_views("clients", """
  select host, pid, coalesce(database like '1%', false) as ssl, row_number() over (partition by host order by case when backend_type = 'client backend' then 0 else 1 end, case state when 'idle in transaction' then 0 when 'active' then 2 else 6 end, pid) as state_order from clients"""))
def c3(spark, d):
    rows = bind(spark, d, "clients")
    ssl = rows.select("host", "pid", F.coalesce(F.col("database").startswith("1"), F.lit(False)).alias("ssl"))
    return maintenance.sessions(rows, ssl, ["host"]).select("host", "pid", "ssl", "state_order")


@query("d1_db_health", with_views("stat_db", "select database, 100.0::double * xact_rollback / nullif(xact_commit + xact_rollback, 0) as rollback_pct, cast(deadlocks as bigint) as deadlocks, cast(conflicts as bigint) as conflicts, cast(checksum_failures as bigint) as checksum_failures from stat_db"))
def d1(spark, d):
    return maintenance.db_health(bind(spark, d, "stat_db")).select("database", "rollback_pct", "deadlocks", "conflicts", "checksum_failures")


@query("g1_settings_advice", with_views("settings writer", """
  select * from (select host, 'logMinDurationTooLow' as rule, name, setting as value from settings where name = 'log_min_duration_statement' and cast(setting as double) between 0 and 10
  union all select host, 'collapseLimitDiffer', name, setting from settings where name = 'from_collapse_limit' and setting <> '8'
  union all select host, 'hugePagesDisabled', name, setting from settings where name = 'huge_pages' and setting not in ('on', 'try')
  union all select host, 'suboptimalCompression', name, setting from settings where name = 'wal_compression' and setting = 'pglz'
  union all select host, 'autovacuumDisabled', name, setting from settings where name = 'autovacuum' and setting <> 'on'
  union all select host, 'tuneParameter', name, setting from settings where name in ('autovacuum_naptime', 'vacuum_cost_limit') and source = 'default'
  union all select host, 'tuneCostLimit', 'autovacuum_vacuum_cost_limit', setting from settings where name = 'vacuum_cost_limit' and try_cast(setting as double) < 1000
  union all select host, 'tuneWorkMem', 'autovacuum_work_mem', setting from settings where name = 'maintenance_work_mem' and try_cast(setting as double) <= 65536
  union all select host, 'tooManyCheckpoints', 'checkpoints', concat(req, '/', timed) from writer where req > 0.3::double * timed and req // greatest(days, 1) > 20 and host in (select host from settings)
  union all select host, 'highMaxwrittenClean', 'bgwriter', cast(maxwritten_clean // greatest(days, 1) as varchar) from writer where maxwritten_clean // greatest(days, 1) > 1000 and host in (select host from settings))"""))
def g1(spark, d):
    return maintenance.settings_advice(bind(spark, d, "settings"), bind(spark, d, "writer"), ["host"])


_FREE = "case when owned_column_type = 'integer' and max_value > 2147483647 then greatest(100.0::double * (2147483647 - last_value)::double / 2147483646::double, 0) else 100.0::double * (max_value::hugeint - last_value)::double / (max_value::hugeint - min_value)::double end"


@query("l1_sequence_exhaustion", with_views("seqs", f"""
  select schema, object, case greatest(case when free < 5 then 0 when free < 10 then 1 else 2 end - case when owned_column_type = 'integer' then 1 else 0 end, 0) when 0 then 'error' when 1 then 'warning' else 'notice' end as level, 100 - free as used_pct
  from (select *, {_FREE} as free from seqs where not cycle and last_value_known) where free < 20"""))
def l1(spark, d):
    return schema_checks.sequence_exhaustion(bind(spark, d, "seqs"), NO_KEY).select("schema", "object", "level", "used_pct")


@query("l23_sequence_skips", with_views("seqs", "select schema, count(*) as skipped, 'sequence_exhaustion' as code from seqs where not last_value_known group by schema"))
def l23(spark, d):
    return schema_checks.sequence_skips(bind(spark, d, "seqs"), ["schema"])


@query("l24_worst_sequence", with_views("seqs", f"select schema, greatest(max((100 - {_FREE}) / 100), 0.0) as worst_used from seqs where not cycle and last_value_known group by schema"))
def l24(spark, d):
    return schema_checks.worst_sequence(bind(spark, d, "seqs"), ["schema"])


@query("l2_relation_keys", with_views("classes idx attributes", """
  select schema, object, case when s is not null then 'no_primary_key' else 'no_unique_key' end as code, coalesce(not s, false) as unique_nullable from classes left join
    (select indrelid, bool_or(strict) as s, bool_or(prim) as p from (select i.indexrelid, i.indrelid, mod(i.indexrelid, 4) = 1 as prim, bool_and(coalesce(a.notnull, false)) as strict
      from (select *, k1 as k from idx union all select *, k2 from idx where nkeyatts = 2) i left join attributes a on a.attrelid = i.indrelid and a.attnum = i.k where is_unique and valid and mod(i.indexrelid, 6) <> 0 group by 1, 2, 3) group by 1) on indrelid = relid
  where relkind in ('r', 'p') and (p is null or not p)"""))
def l2(spark, d):
    rows = _indexes(spark, d).withColumns({"predicate": F.expr("case when mod(indexrelid, 6) = 0 then 'x' end"), "primary": F.expr("mod(indexrelid, 4) = 1")})
    return schema_checks.relation_keys(bind(spark, d, "classes"), rows, bind(spark, d, "attributes"), NO_KEY).select("schema", "object", "code", F.coalesce("unique_nullable", F.lit(False)).alias("unique_nullable"))


@query("l5_unlogged", with_views("classes", "select schema, object, case relkind when 'S' then 'unlogged_sequence' else 'unlogged_relation' end as code from classes where relpersistence = 'u'"))
def l5(spark, d):
    return schema_checks.unlogged(bind(spark, d, "classes"), NO_KEY).select("schema", "object", "code")


@query("l7_uuid_like", with_views("classes attributes", "select schema, object, attname as within from classes join attributes on attrelid = relid where relkind in ('r', 'p') and type = 'varchar' and typmod in (36, 40) and (attname like '%uid%' or attname like '%\\_id' escape '\\' or attname = 'id')"))
def l7(spark, d):
    return schema_checks.uuid_like(bind(spark, d, "classes"), bind(spark, d, "attributes"), NO_KEY).select("schema", "object", "within")


@query("l8_without_fk", with_views("classes constraints", "select schema, object, code from (select schema, object, 'relation_without_fk' as code, relid from classes where relkind in ('r', 'p')) c where not exists (select 1 from constraints f where f.conrelid = c.relid) and not exists (select 1 from constraints f where f.confrelid = c.relid)"))
def l8(spark, d):
    return schema_checks.without_fk(bind(spark, d, "classes"), _constraints(spark, d), NO_KEY).select("schema", "object", "code")


@query("l9_without_columns", with_views("classes attributes", "select schema, object, 'relation_without_columns' as code from classes c where relkind in ('r', 'p') and not exists (select 1 from attributes a where a.attrelid = c.relid)"))
def l9(spark, d):
    return schema_checks.without_columns(bind(spark, d, "classes"), bind(spark, d, "attributes"), NO_KEY).select("schema", "object", "code")


@query("l10_unsafe_names", with_views("classes", "select schema, object, case when object = 'user' then 'reserved_word_in_name' else 'unsafe_chars_in_name' end as code from classes where object = 'user' or regexp_matches(object, '[^A-Za-z0-9_]')"))
def l10(spark, d):
    return schema_checks.unsafe_names(bind(spark, d, "classes"), NO_KEY).select("schema", "object", "code")


def _lint(spark, d):
    findings = schema_checks.sequence_exhaustion(bind(spark, d, "seqs"), NO_KEY)
    return findings.withColumns({"code": F.lit("unlogged_relation"), "child": F.col("object")})


@query("l19_collapse_partitions", with_views("seqs edges", f"""
  select root as object, case min(lv) when 0 then 'error' when 1 then 'warning' else 'notice' end as level, min_by(used, {{'l': lv, 'u': -used}}) as used_pct, cast(sum(is_child) as bigint) as partitions from (
    select concat('s.', coalesce(cast(floor(object / pow(10, length(cast(object as varchar)) - 1)) as bigint), object)) as root, case when object >= 10 then 1 else 0 end as is_child, 100 - free as used,
      greatest(case when free < 5 then 0 when free < 10 then 1 else 2 end - case when owned_column_type = 'integer' then 1 else 0 end, 0) as lv from (select *, {_FREE} as free from seqs where not cycle and last_value_known) where free < 20) group by root"""))
def l19(spark, d):
    findings = _lint(spark, d).drop("child").withColumn("schema", F.lit("s"))
    roots = root_of(bind(spark, d, "edges")).select(*(F.concat(F.lit("s."), F.col(c)).alias(c) for c in ("child", "root")))
    return schema_checks.collapse_partitions(findings, roots, NO_KEY).select("object", "level", "used_pct", "partitions")


@query("l22_lint_summary", with_views("seqs", f"""
  select schema, count(*) filter (lv = 0) as error, count(*) filter (lv = 1) as warning, count(*) filter (lv = 2) as notice from (select schema, greatest(case when free < 5 then 0 when free < 10 then 1 else 2 end - case when owned_column_type = 'integer' then 1 else 0 end, 0) as lv
    from (select *, {_FREE} as free from seqs where not cycle and last_value_known) where free < 20) group by schema"""))
def l22(spark, d):
    return schema_checks.lint_summary(schema_checks.sequence_exhaustion(bind(spark, d, "seqs"), NO_KEY), ["schema"])


def _usages(spark, d):
    return bind(spark, d, "usages").withColumnRenamed("col", "column").withColumn("desc", F.lit(False))


def _named(role: str) -> str:
    return f"coalesce(string_agg(col, ',' order by s, col) filter (role = '{role}'), '')"


_ROLES = f"select fingerprint, relid, {_named('equality')} as equality, {_named('range')} as ranges, {_named('is_null')} as nulls, {_named('order')} as ordering from (select fingerprint, relid, role, col, min(seq) as s from usages group by all) group by all"


@query("v4_split_roles", with_views("usages", _ROLES))
def v4(spark, d):
    rows = advisor.split_roles(_usages(spark, d), NO_KEY)
    return rows.select("fingerprint", "relid", *(F.array_join(c, ",").alias(c) for c in ("equality", "ranges", "nulls", "ordering")))


def _relations(spark, d):
    return bind(spark, d, "classes").select("relid", "relkind", F.col("schema").cast("string").alias("schema"), F.col("object").alias("table"), F.col("reltuples").alias("rows"))


def _columns(spark, d):
    return bind(spark, d, "attributes").select(F.col("attrelid").alias("relid"), F.concat(F.lit("c"), "attnum").alias("column"), "null_frac", "n_distinct", (~F.col("is_array")).alias("indexable"))


def _drafts(spark, d):
    roles = advisor.split_roles(_usages(spark, d), NO_KEY)
    return advisor.draft_keys(advisor.with_column_facts(roles, _relations(spark, d), _columns(spark, d), NO_KEY))


_KEYS = """
  , r as (select fingerprint, relid, role, col, min(seq) as s from usages group by all),
  e as (select r.*, a.attnum is not null as known, a.is_array, a.n_distinct as nd, case when a.n_distinct < 0 then -a.n_distinct * c.reltuples else a.n_distinct end as dist, bool_or(role = 'range') over w as ranged, row_number() over (partition by fingerprint, r.relid, role order by s, col) as rr,
    bool_or(role = 'equality' and a.n_distinct is null) over w as missing from r left join attributes a on a.attrelid = r.relid and concat('c', a.attnum) = r.col left join classes c on c.relid = r.relid window w as (partition by fingerprint, r.relid)),
  o as (select *, case role when 'equality' then 0 else 1 end as g, case when role = 'equality' and not missing then -dist end as g2 from e where role = 'equality' or (role = 'range' and rr = 1) or (role = 'order' and not ranged)),
  u as (select * from o qualify row_number() over (partition by fingerprint, relid, col order by g, g2, s, col) = 1), k as (select * from u where known and not is_array),
  n as (select *, row_number() over w as i, coalesce(sum(case when g = 0 and nd <= -1 then 1 else 0 end) over (partition by fingerprint, relid order by g, g2, s, col rows between unbounded preceding and 1 preceding), 0) as stop from k window w as (partition by fingerprint, relid order by g, g2, s, col))"""
_DRAFTS = """select fingerprint, f.relid, case when c.relid is null then 'unknown_relation' when reltuples < 10000 then 'table_too_small' when cols is null and arr then 'unsupported_type' when cols is null and wants > 0 then 'unknown_column' when cols is null then 'no_indexable_predicate' end as reason, coalesce(cols, '') as columns
  from (select distinct fingerprint, relid from usages) f left join classes c using (relid)
  left join (select fingerprint, relid, string_agg(col, ',' order by i) as cols from n where stop = 0 and i <= 3 group by all) using (fingerprint, relid)
  left join (select fingerprint, relid, count(*) as wants, bool_or(is_array) as arr from u group by all) using (fingerprint, relid)"""


@query("v7_draft_keys", with_views("usages classes attributes", _KEYS + " " + _DRAFTS))
def v7(spark, d):
    return _drafts(spark, d).select("fingerprint", "relid", "reason", F.array_join("columns", ",").alias("columns"))


def _live_indexes(spark, d):
    rows = _indexes(spark, d)
    names = F.transform(F.array_distinct(F.slice("indkey", F.lit(1), F.col("nkeyatts"))), lambda x: F.concat(F.lit("c"), x))
    return rows.select(F.col("indrelid").alias("relid"), F.col("indexrelid").cast("string").alias("name"), names.alias("columns"), "unique", "valid", "method", F.array().cast("array<string>").alias("predicate"))


@query("v12_candidates")
def v12(spark, d):
    open_ = advisor.covered(_drafts(spark, d), _live_indexes(spark, d), NO_KEY)
    weighed = advisor.weights(advisor.merge_prefixes(open_, NO_KEY), bind(spark, d, "load"), NO_KEY)
    catalog = _relations(spark, d).withColumns({"reads": F.lit(10), "writes": F.col("rows")})
    rows = advisor.warnings(weighed, catalog, _live_indexes(spark, d), NO_KEY)
    return advisor.rank_candidates(rows, ["relid"], 5).select("relid", "predicate", F.array_join("columns", ",").alias("columns"), F.size("fingerprints").alias("statements"), "calls", "weight_pct", F.array_join("warnings", ",").alias("warnings"), "rn")


@query("v14_not_analysed", with_views("usages classes attributes", f"{_KEYS} select reason, count(distinct fingerprint) as n from ({_DRAFTS}) where reason is not null group by reason"))
def v14(spark, d):
    return advisor.not_analysed(_drafts(spark, d), NO_KEY)
