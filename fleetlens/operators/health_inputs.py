"""Inputs of the health score, scores of single databases, attribution and drill-downs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.windows import top_n
from fleetlens.operators.health import WEIGHTS, penalties
from fleetlens.sources.snapshots import asof

# The rows a table needs before its dead rows count, and the updates before its in-page share does.
MIN_TUPLES, MIN_UPDATES = 10_000, 1_000
# Categories that concern the instance only, and rules whose metric a data source sums over all databases.
INSTANCE_ONLY = ["connections", "replication", "horizon", "wal_checkpoint", "locks"]
INSTANCE_WIDE = ["low_cache_hit_ratio", "high_max_dead_ratio", "high_avg_dead_ratio", "low_hot_update_ratio", "xid_wraparound_risk", "checksum_failures", "host_disk_space", "latency_regression", "seq_scan_regression"]
PER_DATABASE = ["performance", "storage", "maintenance"]


def _age(ts: str | Column) -> Column:
    return F.unix_timestamp("captured_at") - F.unix_timestamp(ts)


def _of(name: str) -> Column:
    return F.max(F.when(F.col("name") == name, F.col("setting")))


def _table_numbers() -> list[Column]:
    """What H2 tells of a key's tables; rows without their columns add nothing."""
    live = F.col("n_live_tup") + F.col("n_dead_tup")
    dead = F.when(live > MIN_TUPLES, F.round(100.0 * F.col("n_dead_tup") / live, 2))
    busy = F.col("n_tup_upd") > MIN_UPDATES
    updates = F.sum(F.when(busy, F.col("n_tup_upd")))
    vacuumed, analyzed = F.greatest("last_vacuum", "last_autovacuum"), F.greatest("last_analyze", "last_autoanalyze")
    stale = F.col("analyze_due") & (F.col("reltuples") > 0) & (analyzed.isNull() | (_age(analyzed) > 3 * 3600))
    return [
        F.coalesce(F.max(dead), F.lit(0.0)).alias("dead_max_pct"), F.coalesce(F.avg(dead), F.lit(0.0)).alias("dead_avg_pct"), F.count_if(dead > 20).alias("bloated_tables"),
        F.coalesce(F.sum(F.when(busy, F.col("n_tup_hot_upd"))) / updates, F.lit(1.0)).alias("hot_ratio"),
        F.coalesce(F.sum(F.when(busy, F.col("n_tup_newpage_upd"))) / updates, F.lit(0.0)).alias("newpage_ratio"),
        F.count_if("vacuum_due").alias("vacuum_backlog"), F.coalesce(F.max(F.when(F.col("vacuum_due"), _age(vacuumed) / 3600)), F.lit(0.0)).alias("vacuum_overdue_h"),
        F.count_if((live > MIN_TUPLES) & vacuumed.isNull()).alias("never_vacuumed"), F.count_if(stale).alias("stale_stats"),
    ]


def _cache_numbers() -> list[Column]:
    hit, read = F.sum("heap_blks_hit"), F.sum("heap_blks_read")
    return [F.coalesce(F.round(100.0 * hit / F.nullif(hit + read, F.lit(0)), 2), F.lit(100.0)).alias("cache_hit_pct"), F.coalesce(hit + read, F.lit(0)).alias("cache_sample")]


def raw_per_db(stat_tables: DataFrame, statio: DataFrame, key: list[str]) -> DataFrame:
    """H2: cache, dead rows, in-page updates and the vacuum queue of each key, one grouping for each view.

    ``stat_tables`` carries vacuum_due and analyze_due (M1) and captured_at. Absent activity reads as healthy.
    """
    tables, cache = stat_tables.groupBy(*key).agg(*_table_numbers()), statio.groupBy(*key).agg(*_cache_numbers())
    return tables.join(cache, key, "full").fillna({"cache_hit_pct": 100.0, "hot_ratio": 1.0}).fillna(0)


def raw_metrics(views: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """H1: one row for each host of ``hosts`` (key, in_recovery) with all inputs of the score.

    The views activity, stat_tables, statio, replication, classes, settings, checkpoints, locks and database_stats are put
    below each other, each row with its own columns only, and grouped once by key: one exchange for all of them, and no join.
    Sessions are first added up by database, since the database at fault is named for long and idle transactions (most
    offenders first, then the oldest). A view without rows of a host leaves neutral values.
    """
    idle = F.coalesce((F.col("state") == "idle in transaction") & (_age("xact_start") > 30), F.lit(False))
    waits = F.col("wait_event_type") == "Lock"
    sessions = views["activity"].groupBy(*key, "database").agg(
        F.count("state").alias("a_sessions"), F.count_if(idle).alias("a_idle"), F.min(F.when(idle, F.col("xact_start"))).alias("a_idle_since"), F.max(_age("xact_start")).alias("a_longest"), F.min("xact_start").alias("a_since"),
        F.max("backend_xmin_age").alias("a_horizon"), F.count_if(waits & (F.col("state") == "active")).alias("a_waiters"), F.max(F.when(waits, _age("state_change"))).alias("a_wait_s"))
    off = F.coalesce(F.lower(F.try_element_at("reloptions", F.lit("autovacuum_enabled"))).isin("off", "0", "f", "false", "n", "no"), F.lit(False))
    columns = {
        "hosts": ["in_recovery"], "statio": ["heap_blks_hit", "heap_blks_read"], "settings": ["name", "setting"], "checkpoints": ["timed", "requested"], "locks": ["granted"], "database_stats": ["deadlocks", "checksum_failures"],
        "stat_tables": ["n_live_tup", "n_dead_tup", "n_tup_upd", "n_tup_hot_upd", "n_tup_newpage_upd", "reltuples", "vacuum_due", "analyze_due", "last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze", "captured_at"],
    }
    parts = {n: views[n].select(*key, *c) for n, c in columns.items()} | {"sessions": sessions}
    parts["replication"] = views["replication"].select(*key, F.col("state").alias("r_state"), "replay_lag_s", "replay_lag_bytes")
    parts["classes"] = views["classes"].where("relkind in ('r', 'm', 't')").select(*key, off.alias("c_off"), "xid_age")
    every = None
    for name, part in parts.items():
        part = part.withColumn("_from", F.lit(name))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    of = lambda n: F.col("_from") == n
    offender = F.struct((-F.col("a_idle")).alias("n"), "a_idle_since", "database")
    grouped = every.groupBy(*key).agg(
        F.bool_or("in_recovery").alias("in_recovery"), F.count_if(of("hosts")).alias("_hosts"), F.sum("a_sessions").alias("conn_total"), F.sum("a_idle").alias("idle_in_tx"), F.coalesce(F.max("a_longest"), F.lit(0)).alias("longest_tx_s"),
        F.min_by("database", F.when(F.col("a_since").isNotNull(), F.struct("a_since", "database"))).alias("longest_tx_database"), F.coalesce(F.max("a_horizon"), F.lit(0)).alias("horizon_age"),
        F.max_by("database", F.when(of("sessions"), F.struct("a_horizon", "database"))).alias("horizon_database"), F.sum("a_waiters").alias("lock_waiters"), F.coalesce(F.max("a_wait_s"), F.lit(0)).alias("lock_wait_s"),
        F.min_by("database", F.when(F.col("a_idle") > 0, offender)).alias("idle_in_tx_database"), *_table_numbers(), *_cache_numbers(),
        F.count_if(of("replication")).alias("replicas"), F.coalesce(F.max("replay_lag_s"), F.lit(0.0)).alias("replica_lag_s"), F.coalesce(F.max("replay_lag_bytes") / (1 << 20), F.lit(0.0)).alias("replica_lag_mb"), F.count_if(F.col("r_state") != "streaming").alias("replicas_lost"),
        F.count_if("c_off").alias("autovac_off_tables"), F.coalesce(F.max("xid_age"), F.lit(0)).alias("xid_age"),
        _of("max_connections").cast("double").alias("conn_max"), _of("max_locks_per_transaction").cast("double").alias("_locks"), _of("wal_level").alias("wal_level"), F.count_if(of("settings")).alias("_settings"),
        *(F.coalesce(_of(n) != "on", F.lit(True)).alias(c) for n, c in (("autovacuum", "autovacuum_off"), ("track_counts", "track_counts_off"), ("track_io_timing", "io_timing_off"))),
        F.max("timed").alias("checkpoints_timed"), F.max("requested").alias("checkpoints_req"), F.count_if(~F.col("granted")).alias("ungranted"), F.count_if(of("locks")).alias("_held"),
        F.coalesce(F.sum("deadlocks"), F.lit(0)).alias("deadlocks"), F.coalesce(F.sum("checksum_failures"), F.lit(0)).alias("checksum_failures"),
    )
    room = F.col("_locks") * F.col("conn_max")
    out = grouped.where("_hosts > 0").withColumn("lock_pool", F.when((room > 0) & (F.col("_held") > 0), F.col("_held") / room))
    # without settings nothing says that something is off
    out = out.withColumns({c: F.col(c) & (F.col("_settings") > 0) for c in ("autovacuum_off", "track_counts_off", "io_timing_off")})
    return out.drop("_locks", "_held", "_hosts", "_settings").fillna({"cache_hit_pct": 100.0, "hot_ratio": 1.0}).fillna(0)


def attribute(findings: DataFrame, database_scoped: bool = False, metrics_backed: bool = False, backed: list[str] | None = None) -> DataFrame:
    """The database that a finding (rule, category, database, hit_database) points at, null where it concerns the whole instance.

    A rule's own offender goes first. ``backed`` lists rules whose value came from a snapshot although metrics are there.
    """
    whole = F.col("category").isin(INSTANCE_ONLY)
    if not database_scoped:
        whole = whole | (F.col("rule") == "sequence_exhaustion")
    if metrics_backed:
        whole = whole | (F.col("rule").isin(INSTANCE_WIDE) & ~F.col("rule").isin(backed or []))
    return findings.withColumn("database", F.coalesce("hit_database", F.when(~whole, F.col("database"))))


def score_per_db(raw_db: DataFrame, key: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """The score of each database on performance, storage and maintenance.

    Their weights are brought to 1; a standby has no maintenance; an age of 1.6 billion caps a primary's database at 30.
    """
    given = WEIGHTS | (weights or {})
    normal = [{c: w[c] for c in PER_DATABASE} for w in (given, WEIGHTS)]

    def share(cats: list[str]) -> dict[str, float]:
        use = next(w for w in normal if sum(w[c] for c in cats) > 0)
        return {c: use[c] / sum(use[x] for x in cats) for c in cats}

    rows = penalties(raw_db)
    hot = F.col("hot_ratio").cast("double")
    storage = F.round(F.least(F.lit(100.0), F.col("storage") + F.when(hot < 0.5, 30.0).when(hot < 0.65, 15.0).when(hot < 0.8, 5.0).otherwise(0.0)), 1)
    rows = rows.withColumn("storage", storage)
    lost = lambda cats: sum((F.col(c) * w for c, w in share(cats).items()), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.when(F.col("in_recovery"), lost(PER_DATABASE[:2])).otherwise(lost(PER_DATABASE))))
    capped = F.when(~F.col("in_recovery") & (F.col("xid_age") >= 1.6e9), F.least(score, F.lit(30.0))).otherwise(score)
    return rows.select(*key, F.round(F.round(capped, 6), 1).alias("score"))


# What a drill-down lists, and its order.
DRILLS = {
    "wraparound": ("xid_age > 0", "xid_age", True), "autovacuum_off": ("autovacuum_off", "n_dead_tup", True), "low_hot": (f"n_tup_upd > {MIN_UPDATES}", "hot_ratio", False),
    "high_dead": (f"n_live_tup + n_dead_tup > {MIN_TUPLES}", "dead_pct", True), "horizon": ("backend_xmin_age is not null", "backend_xmin_age", True),
}


def drill(rows: DataFrame, kind: str, key: list[str], ident: str, n: int = 20) -> DataFrame:
    """The n worst rows of each key behind a finding: databases, tables or sessions, ties by ``ident``."""
    test, by, down = DRILLS[kind]
    return top_n(rows.where(test), key, [F.desc_nulls_last(by) if down else F.asc_nulls_last(by), F.asc(ident)], n)


def overlay(signals: DataFrame, raw: DataFrame, key: list[str], shared: list[str], catalog: list[str]) -> DataFrame:
    """Signals (probe_id, key, ts, shared...) completed from the newest snapshot (key, ts, shared..., catalog...) at or before them.

    Catalog facts always come from the snapshot; a shared signal only where it is absent, then ``backed`` names it.
    """
    struct = F.struct(*(F.col(c) for c in [*shared, *catalog])).alias("snap")
    found = asof(signals.select("probe_id", *key, "ts"), raw.select(*key, "ts", struct), key, "ts", "snap").select("probe_id", "snap")
    rows = signals.join(found, "probe_id", "left")
    backed = F.array_join(F.filter(F.array(*(F.when(F.col(c).isNull() & F.col(f"snap.{c}").isNotNull(), c) for c in shared)), lambda x: x.isNotNull()), ",")
    return rows.select("probe_id", *key, "ts", *(F.coalesce(c, f"snap.{c}").alias(c) for c in shared), *(F.col(f"snap.{c}").alias(c) for c in catalog), backed.alias("backed"))
