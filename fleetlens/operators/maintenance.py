"""Maintenance, sessions, databases, replication and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.exprs import lsn_to_long, safe_ratio

# The order of session states, the settings a user should tune, and settings subsets.
STATES = ["idle in transaction", "idle in transaction (aborted)", "active", "idle", "fastpath function call", "disabled"]
TUNE = ["autovacuum_analyze_scale_factor", "autovacuum_analyze_threshold", "autovacuum_naptime", "autovacuum_vacuum_insert_scale_factor", "autovacuum_vacuum_insert_threshold", "autovacuum_vacuum_scale_factor", "autovacuum_vacuum_threshold", "vacuum_cost_limit"]
REPLICATION = ["synchronous_standby_names", "synchronous_commit"]


def xid_danger(classes: DataFrame, key: list[str], max_value: int, limit: int) -> DataFrame:
    """M3: tables with fewer than ``limit`` transactions left before wraparound; an overflow table counts for its owner."""
    toast = classes.select(*key, F.col("relid").alias("reltoastrelid"), F.col("xid_age").alias("_toast"))
    left = max_value - F.greatest("xid_age", "_toast")
    return classes.where("relkind = 'r'").join(toast, [*key, "reltoastrelid"], "left").select(*key, "relid", left.alias("transactions_left")).where(F.col("transactions_left") < limit)


def maintenance_info(stat_tables: DataFrame, pattern: str = "") -> DataFrame:
    """M4: when tables were last vacuumed and analyzed, by hand or not, names that hold ``pattern`` only."""
    rows = stat_tables.withColumns({"vacuumed_at": F.greatest("last_vacuum", "last_autovacuum"), "analyzed_at": F.greatest("last_analyze", "last_autoanalyze")})
    return rows.where(F.contains(F.lower("relname"), F.lit(pattern.lower())))


def progress(snaps: DataFrame, key: list[str]) -> DataFrame:
    """M5: percentage done of running operations; over snapshots (key, kind, pid, ts, done, total) also rate and seconds left.

    A counter that falls back marks a new phase: no rate.
    """
    w = Window.partitionBy(*key, "kind", "pid").orderBy("ts")
    moved, took = F.col("done") - F.lag("done").over(w), F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    rate = F.when((moved >= 0) & (took > 0), moved / took)
    rows = snaps.withColumns({"pct": safe_ratio(F.col("done"), F.col("total"), 100.0), "rate": rate})
    return rows.withColumn("seconds_left", F.when(F.col("rate") > 0, (F.col("total") - F.col("done")) / F.col("rate")))


def connection_sources(activity: DataFrame, key: list[str]) -> DataFrame:
    """Sessions by database, user, source and address; what a background process lacks is its kind."""
    named = [F.coalesce(F.col(c), F.col("backend_type"), F.lit("")).alias(c) for c in ("database", "user", "app", "client_addr")]
    return activity.groupBy(*key, *named).agg(F.count("*").alias("n"))


def sessions(activity: DataFrame, ssl: DataFrame, key: list[str], user: str = "", state: str = "") -> DataFrame:
    """Sessions with their encryption; ``state_order`` ranks clients first, then states by urgency, then pid."""
    rows = activity.join(ssl.select(*key, "pid", "ssl"), [*key, "pid"], "left").withColumn("ssl", F.coalesce("ssl", F.lit(False)))
    if user:
        rows = rows.where(F.contains(F.lower("user"), F.lit(user.lower())))
    if state:
        rows = rows.where(F.col("state") == state)
    at = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    order = F.when(F.coalesce(at, F.lit(0)) == 0, len(STATES)).otherwise(at - 1)
    other = F.when(F.col("backend_type") == "client backend", 0).otherwise(1)
    return rows.withColumn("state_order", F.row_number().over(Window.partitionBy(*key).orderBy(other, order, "pid")))


def db_health(stat_db: DataFrame) -> DataFrame:
    """The share of transactions rolled back beside deadlocks, conflicts and checksum failures."""
    return stat_db.withColumn("rollback_pct", safe_ratio(F.col("xact_rollback"), F.col("xact_commit") + F.col("xact_rollback"), 100.0))


def db_size(stat_db: DataFrame, key: list[str]) -> DataFrame:
    """Size of each database."""
    return stat_db.select(*key, "size_bytes")


def stats_reset(stat_db: DataFrame, key: list[str]) -> DataFrame:
    """D3: when statistics were reset and the days since (1 at least), the base of per-day rates."""
    return stat_db.select(*key, "stats_reset", F.greatest(F.datediff("captured_at", "stats_reset"), F.lit(1)).alias("days"))


def repl_lag(hosts: DataFrame) -> DataFrame:
    """A replica's lag in seconds; 0 on a primary and where all that was received is replayed."""
    behind = F.unix_timestamp("captured_at") - F.unix_timestamp("last_replay_at")
    return hosts.withColumn("lag_s", F.when(~F.col("in_recovery") | (F.col("receive_lsn") == F.col("replay_lsn")), 0).otherwise(behind))


def slot_backlog(slots: DataFrame, current: str = "current_lsn") -> DataFrame:
    """R2: bytes that each slot holds back, from log positions 'hi/lo'."""
    return slots.withColumn("backlog_bytes", lsn_to_long(F.col(current)) - lsn_to_long(F.col("restart_lsn")))


def repl_status(replication: DataFrame, slots: DataFrame, key: list[str]) -> DataFrame:
    """Replicas with their slot and lag in bytes (null on a standby); ``lag_rank`` puts the farthest behind first, unknown last."""
    owned = slots.select(*key, F.col("active_pid").alias("pid"), "slot_name")
    lag = F.when(~F.col("in_recovery"), lsn_to_long(F.col("current_lsn")) - lsn_to_long(F.col("replay_lsn")))
    rows = replication.join(owned, [*key, "pid"], "left").withColumns({"slot_name": F.coalesce("slot_name", F.lit("")), "replay_lag_bytes": lag})
    return rows.withColumn("lag_rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last("replay_lag_bytes"), "pid")))


def settings_subset(settings: DataFrame, names: list[str]) -> DataFrame:
    """The named settings."""
    return settings.where(F.col("name").isin(names))


def settings_advice(settings: DataFrame, writer: DataFrame, key: list[str]) -> DataFrame:
    """G1: (key, rule, name, value) for each setting or counter that asks for attention.

    Settings become one row for each key and every rule reads that row, so the table is read once. ``writer`` holds
    req, timed, maxwritten_clean and days of each key.
    """
    wide = settings.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("setting", "source")))).alias("s"))
    rows = wide.join(writer, key, "left")
    value = lambda n: F.element_at("s", n)["setting"]
    number = lambda c: c.try_cast("double")
    effective = lambda n, base: F.coalesce(F.nullif(value(n), F.lit("-1")), value(base))

    def finding(rule: str, name: str, v: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("name"), v.cast("string").alias("value")))

    found = [
        finding("logMinDurationTooLow", "log_min_duration_statement", value("log_min_duration_statement"), number(value("log_min_duration_statement")).between(0, 10)),
        *(finding("collapseLimitDiffer", n, value(n), value(n) != "8") for n in ("from_collapse_limit", "join_collapse_limit")),
        finding("hugePagesDisabled", "huge_pages", value("huge_pages"), ~value("huge_pages").isin("on", "try")),
        *(finding("suboptimalCompression", n, value(n), value(n) == "pglz") for n in ("default_toast_compression", "wal_compression")),
        finding("autovacuumDisabled", "autovacuum", value("autovacuum"), value("autovacuum") != "on"),
        *(finding("tuneParameter", n, value(n), F.element_at("s", n)["source"] == "default") for n in TUNE),
    ]
    for rule, n, base, test in (
        ("tuneCostLimit", "autovacuum_vacuum_cost_limit", "vacuum_cost_limit", lambda x: x < 1000),
        ("tuneWorkMem", "autovacuum_work_mem", "maintenance_work_mem", lambda x: x <= 65536),
    ):
        found.append(finding(rule, n, effective(n, base), test(number(effective(n, base)))))
    delay = "autovacuum_vacuum_cost_delay"
    days = F.greatest(F.col("days"), F.lit(1))
    per_day = F.floor(F.col("maxwritten_clean") / days)
    found += [
        finding("tuneCostDelay", delay, value(delay), number(value(delay)) > 5),
        finding("tooManyCheckpoints", "checkpoints", F.concat_ws("/", "req", "timed"), (F.col("req") > 0.3 * F.col("timed")) & (F.floor(F.col("req") / days) > 20)),
        finding("highMaxwrittenClean", "bgwriter", per_day, per_day > 1000),
    ]
    return rows.select(*key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select(*key, "f.*")
