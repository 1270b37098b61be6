"""Health scores: category penalties, adjustments, weights, ceiling, rules, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.exprs import ladder

# The categories' weights.
WEIGHTS = {"connections": 0.15, "performance": 0.15, "storage": 0.10, "replication": 0.15, "maintenance": 0.15, "horizon": 0.10, "wal_checkpoint": 0.10, "locks": 0.10}


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def _line(x: Column, lo: float, hi: float, a: float, b: float) -> Column:
    """From a at lo to b at hi, straight."""
    return a + (x - lo) / (hi - lo) * (b - a)


def _capped(*terms: Column) -> Column:
    return F.round(F.least(F.lit(100.0), reduce(lambda p, q: p + q, terms)), 1)


def _above(x: Column, bound: float, value: Column) -> Column:
    return F.when(x > bound, value).otherwise(0.0)


def penalties(raw: DataFrame) -> DataFrame:
    """A penalty from 0 to 100 for each category, in one projection."""
    zero = F.lit(0.0)
    r = F.when(_c("conn_max") > 0, _c("conn_total") / _c("conn_max")).otherwise(0.0)
    connections = _capped(
        ladder(r, [(0.95, _line(r, 0.95, 1.0, 70, 100)), (0.80, _line(r, 0.80, 0.95, 30, 70)), (0.60, _line(r, 0.60, 0.80, 0, 30))]),
        F.least(5 * _c("idle_in_tx"), F.lit(30.0)), _above(_c("longest_tx_s"), 300, F.least((_c("longest_tx_s") - 300) / 60 * 5, F.lit(20.0))),
    )
    c = _c("cache_hit_pct")
    graded = ladder(c, [(95, 0.0), (90, _line(c, 95, 90, 0, 20)), (85, _line(c, 90, 85, 20, 50))], _line(c, 85, 75, 50, 100), strict=False)
    performance = _capped(F.when((_c("cache_sample") > 0) & (_c("cache_sample") < 50_000), 0.0).otherwise(graded))
    d, a, n = _c("dead_max_pct"), _c("dead_avg_pct"), _c("bloated_tables")
    storage = _capped(
        ladder(d, [(30, 40.0), (20, _line(d, 20, 30, 20, 40))], d), _above(a, 15, F.least((a - 15) * 2, F.lit(30.0))),
        _above(n, 5, F.least(3 * n, F.lit(30.0))), ladder(_c("newpage_ratio"), [(0.20, 20.0), (0.10, 10.0), (0.05, 5.0)]),
    )
    s, mb = _c("replica_lag_s"), _c("replica_lag_mb")
    replication = F.when(_c("replicas") <= 0, 0.0).otherwise(_capped(
        ladder(s, [(30, 50.0), (5, _line(s, 5, 30, 10, 50)), (1, _line(s, 1, 5, 0, 10))]),
        _above(mb, 100, F.least(mb / 10, F.lit(30.0))), F.least(30 * _c("replicas_lost"), F.lit(60.0)),
    ))
    x, h, b = _c("xid_age"), _c("vacuum_overdue_h"), _c("vacuum_backlog")
    maintenance = _capped(
        ladder(x, [(1.6e9, 80 + F.least((x - 1.6e9) / 5e8 * 20, F.lit(20.0))), (2e8, _line(x, 2e8, 1.6e9, 0, 80))]),
        ladder(h, [(1440, 30.0), (504, F.least(15 + (h - 504) / 24 * 0.5, F.lit(30.0))), (168, (h - 168) / 24)]),
        _above(b, 5, F.least((b - 5) * 1.5, F.lit(15.0))), F.least(5 * _c("never_vacuumed"), F.lit(20.0)),
        F.least(3 * _c("autovac_off_tables"), F.lit(15.0)), F.least(2 * _c("stale_stats"), F.lit(15.0)),
    )
    z = _c("horizon_age")
    horizon = _capped(ladder(z, [(1e8, 70 + F.least((z - 1e8) / 1e8 * 30, F.lit(30.0))), (1e7, _line(z, 1e7, 1e8, 30, 70)), (1e6, _line(z, 1e6, 1e7, 0, 30))]), zero)
    points = _c("checkpoints_timed") + _c("checkpoints_req")
    q = F.when(points > 0, _c("checkpoints_req") / points).otherwise(0.0)
    wal = F.when(points < 10, 0.0).otherwise(_capped(ladder(q, [(0.20, 70 + F.least((q - 0.20) / 0.30 * 30, F.lit(30.0))), (0.10, _line(q, 0.10, 0.20, 30, 70)), (0.05, _line(q, 0.05, 0.10, 0, 30))]), zero))
    locks = _capped(
        ladder(_c("lock_waiters"), [(10, 60.0), (3, 30.0), (1, 10.0)], strict=False), ladder(_c("lock_wait_s"), [(60, 40.0), (30, 20.0), (10, 5.0)]),
        ladder(_c("ungranted"), [(15, 30.0), (5, 15.0), (2, 5.0)], strict=False), ladder(_c("lock_pool"), [(0.8, 30.0), (0.6, 15.0), (0.5, 5.0)]),
        ladder(_c("deadlocks"), [(100, 20.0), (10, 10.0), (1, 3.0)], strict=False),
    )
    return raw.withColumns(dict(zip(WEIGHTS, (connections, performance, storage, replication, maintenance, horizon, wal, locks))))


def adjust(scored: DataFrame) -> DataFrame:
    """Instance adjustments in their order, each sum capped at 100 as it is added, rounded once at the end."""
    steps: dict[str, list[Column]] = {
        "maintenance": [F.when(F.col("autovacuum_off"), 100.0).otherwise(0.0), F.when(F.col("track_counts_off"), 100.0).otherwise(0.0)],
        "performance": [F.when(F.col("io_timing_off"), 5.0).otherwise(0.0), ladder(_c("latency_ratio"), [(6, 50.0), (3, 30.0), (1.5, 10.0)], strict=False), ladder(_c("seqscan_ratio"), [(6, 40.0), (3, 25.0), (1.5, 10.0)], strict=False)],
        "storage": [F.when(_c("hot_ratio") < 0.5, 30.0).when(_c("hot_ratio") < 0.65, 15.0).when(_c("hot_ratio") < 0.8, 5.0).otherwise(0.0), ladder(_c("disk_used"), [(0.9, 80.0), (0.8, 30.0), (0.7, 10.0)], strict=False)],
        "connections": [ladder(_c("load_per_cpu"), [(4, 60.0), (2, 30.0), (1, 10.0)], strict=False), ladder(_c("pooler_used"), [(0.8, 30.0), (0.6, 15.0), (0.5, 5.0)], strict=False)],
    }
    return scored.withColumns({name: F.round(reduce(lambda p, t: F.least(p + t, F.lit(100.0)), terms, F.col(name)), 1) for name, terms in steps.items()})


def category_rows(adjusted: DataFrame, key: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(key, category, penalty, weight); categories that don't apply go and the others share their weight.

    Weights that don't sum to a positive number, or hold a negative one, fall back to the fixed ones.
    """
    w = WEIGHTS | (weights or {})
    if min(w.values()) < 0 or sum(w.values()) <= 0:
        w = WEIGHTS
    rows = adjusted.unpivot([*key, "replicas", "in_recovery"], list(WEIGHTS), "category", "penalty")
    weight = reduce(lambda acc, kv: acc.when(F.col("category") == kv[0], kv[1] / sum(w.values())), w.items(), F.when(F.lit(False), 0.0))
    applies = ~((F.col("category") == "replication") & (F.col("replicas") <= 0)) & ~((F.col("category") == "maintenance") & F.col("in_recovery"))
    rows = rows.withColumn("weight", weight).where(applies)
    whole = F.sum("weight").over(Window.partitionBy(*key))
    return rows.select(*key, "category", "penalty", F.when(whole > 0, F.col("weight") / whole).otherwise(0.0).alias("weight"))


def health_score(raw: DataFrame, key: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """100 minus the weighted penalties, clamped, one decimal, and not above 30 in a critical state."""
    scores = category_rows(adjust(penalties(raw)), key, weights).groupBy(*key).agg(F.sum(F.round(F.col("penalty") * F.col("weight"), 9).cast("decimal(20,9)")).cast("double").alias("lost"))
    primary = ~F.col("in_recovery")
    critical = (F.col("checksum_failures") > 0) | (_c("disk_used") >= 0.9) | (primary & ((_c("xid_age") >= 1.6e9) | F.col("autovacuum_off") | F.col("track_counts_off")))
    score = F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("lost"))), 6), 1)  # first to 6 places, so that halves round up whatever the last bits
    return raw.select(*key, critical.alias("critical")).join(scores, key).select(*key, "critical", F.when(F.col("critical"), F.least(score, F.lit(30.0))).otherwise(score).alias("score"))


# Rule, category, metric, bounds of high, medium and low (null: none), whether small values are bad, and what the shown value is multiplied by.
RULES = [
    ("high_connection_ratio", "connections", "conn_ratio", 0.95, 0.80, 0.60, False, 1.0),
    ("idle_in_transaction", "connections", "idle_in_tx", 10.0, 5.0, 2.0, False, 1.0),
    ("long_running_transaction", "connections", "longest_tx_s", 1800.0, 600.0, 300.0, False, 1.0),
    ("low_cache_hit_ratio", "performance", "graded_cache_hit_pct", 85.0, 90.0, 95.0, True, 1.0),
    ("high_max_dead_ratio", "storage", "dead_max_pct", 30.0, 20.0, 10.0, False, 1.0),
    ("high_avg_dead_ratio", "storage", "dead_avg_pct", 25.0, 15.0, 5.0, False, 1.0),
    ("many_bloated_tables", "storage", "bloated_tables", 20.0, 10.0, 5.0, False, 1.0),
    ("replication_lag_time", "replication", "replica_lag_s", 30.0, 5.0, 1.0, False, 1.0),
    ("replication_lag_bytes", "replication", "replica_lag_mb", 1024.0, 100.0, 10.0, False, 1048576.0),
    ("disconnected_replicas", "replication", "replicas_lost", 2.0, 1.0, None, False, 1.0),
    ("xid_wraparound_risk", "maintenance", "xid_age", 1.6e9, 2e8, 1.5e8, False, 1.0),
    ("stale_vacuum", "maintenance", "vacuum_overdue_days", 60.0, 21.0, 7.0, False, 24.0),
    ("vacuum_backlog", "maintenance", "vacuum_backlog", 30.0, 15.0, 6.0, False, 1.0),
    ("tables_never_vacuumed", "maintenance", "never_vacuumed", 5.0, 2.0, 1.0, False, 1.0),
    ("autovacuum_disabled", "maintenance", "autovacuum_off", 1.0, None, None, False, 0.0),
    ("track_counts_disabled", "maintenance", "track_counts_off", 1.0, None, None, False, 0.0),
    ("tables_with_autovacuum_off", "maintenance", "autovac_off_tables", None, None, 1.0, False, 1.0),
    ("relfrozenxid_age_outlier", "maintenance", "relfrozenxid_age", 1.6e9, 2e8, 1.5e8, False, 1.0),
    ("horizon_lag_xids", "horizon", "horizon_age", 1e8, 1e7, 1e6, False, 1.0),
    ("requested_checkpoint_ratio", "wal_checkpoint", "checkpoint_ratio", 0.20, 0.10, 0.05, False, 1.0),
    ("track_io_timing_disabled", "performance", "io_timing_off", None, None, 1.0, False, 0.0),
    ("active_lock_waiters", "locks", "lock_waiters", 10.0, 3.0, 1.0, False, 1.0),
    ("longest_lock_wait_seconds", "locks", "lock_wait_s", 60.0, 30.0, 10.0, False, 1.0),
    ("ungranted_locks", "locks", "ungranted", 15.0, 5.0, 2.0, False, 1.0),
    ("deadlocks_rate", "locks", "deadlocks", None, None, 1.0, False, 1.0),
    ("lock_pool_saturation", "locks", "lock_pool", 0.8, 0.6, 0.5, False, 1.0),
    ("low_hot_update_ratio", "storage", "hot_ratio", 0.5, 0.65, 0.8, True, 1.0),
    ("high_newpage_update_ratio", "storage", "newpage_ratio", 0.2, 0.1, 0.05, False, 1.0),
    ("stale_planner_stats", "maintenance", "stale_stats", 10.0, 5.0, 3.0, False, 1.0),
    ("wal_level_minimal_with_replicas", "wal_checkpoint", "minimal_wal_replicas", 1.0, None, None, False, 1.0),
    ("wal_level_logical_without_publications", "wal_checkpoint", "idle_logical_wal", None, None, 1.0, False, 0.0),
    ("checksum_failures", "storage", "checksum_failures", 1e-300, None, None, False, 1.0),
    ("host_cpu_saturation", "connections", "load_per_cpu", 4.0, 2.0, 1.0, False, 1.0),
    ("pooler_saturation", "connections", "pooler_used", 0.8, 0.6, 0.5, False, 1.0),
    ("sequence_exhaustion", "storage", "sequence_free_pct", 5.0, 10.0, 20.0, True, 1.0),
    ("latency_regression", "performance", "latency_ratio", 6.0, 3.0, 1.5, False, 1.0),
    ("seq_scan_regression", "performance", "seqscan_ratio", 6.0, 3.0, 1.5, False, 1.0),
    ("host_disk_space", "storage", "disk_used", 0.9, 0.8, 0.7, False, 1.0),
]
# Severities, the gravest first.
SEVERITIES = ["HIGH", "MEDIUM", "LOW"]
#: What is taken for granted where the captured metrics lack a column: nothing to report.
QUIET = {"relfrozenxid_age": 0.0, "wal_level": "replica", "logical_slots": 0, "wal_level_managed": False, "sequence_used": 0.0}


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule string, category string, metric string, high double, medium double, low double, inverted boolean, scale double")


def rule_metrics(raw: DataFrame) -> DataFrame:
    """raw with the metrics that rules look at but captures don't hold as such; null where a rule doesn't apply."""
    raw = raw.withColumns({c: F.lit(v) for c, v in QUIET.items() if c not in raw.columns})
    points = _c("checkpoints_timed") + _c("checkpoints_req")
    return raw.withColumns({
        "conn_ratio": F.when(_c("conn_max") > 0, _c("conn_total") / _c("conn_max")),
        "graded_cache_hit_pct": F.when((_c("cache_sample") == 0) | (_c("cache_sample") >= 50_000), _c("cache_hit_pct")),
        "vacuum_overdue_days": _c("vacuum_overdue_h") / 24,
        "checkpoint_ratio": F.when(points >= 10, _c("checkpoints_req") / points),
        "minimal_wal_replicas": F.when(F.col("wal_level") == "minimal", _c("replicas")),
        "idle_logical_wal": F.when((F.col("wal_level") == "logical") & (F.col("logical_slots") <= 0) & ~F.col("wal_level_managed"), 1.0),
        "sequence_free_pct": 100 * (1 - _c("sequence_used")),
    })


def evaluate_rules(raw: DataFrame, key: list[str]) -> DataFrame:
    """Findings (key, rule, category, value, severity); the fixed table of rules is joined to the unpivoted metrics.

    On standbys the maintenance rules rest; rules of replication lag need replicas. ``worst_first`` puts them in order.
    """
    metrics = sorted({r[2] for r in RULES})
    long = rule_metrics(raw).unpivot([*key, "replicas", "in_recovery"], [_c(m).alias(m) for m in metrics], "metric", "value")
    hit = long.join(F.broadcast(rule_table(raw.sparkSession)), "metric")  # one row for each of the fixed rules
    reach = lambda bound: F.when(F.col("inverted"), F.col("value") < F.col(bound)).otherwise(F.col("value") >= F.col(bound))
    severity = F.when(reach("high"), "HIGH").when(reach("medium"), "MEDIUM").when(reach("low"), "LOW")
    applies = ~(F.col("rule").startswith("replication_lag") & (F.col("replicas") == 0)) & ~((F.col("category") == "maintenance") & F.col("in_recovery"))
    shown = F.when(F.col("rule") == "sequence_exhaustion", 1 - F.col("value") / 100).otherwise(F.col("value") * F.col("scale"))
    return hit.withColumn("severity", severity).where(F.col("severity").isNotNull() & applies).select(*key, "rule", "category", shown.alias("value"), "severity")


def worst_first(findings: DataFrame, key: list[str]) -> DataFrame:
    """Findings with their place (rn) within each key: by severity, then rule."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(rank, "rule")))


def fleet_rank(scores: DataFrame, n: int) -> DataFrame:
    """The n worst scores, unreadable ones (null) last, ties by the key columns."""
    keys = [c for c in scores.columns if c not in ("score", "critical")]
    return scores.orderBy(F.asc_nulls_last("score"), *keys).limit(n)


def worst_database(scores: DataFrame, key: list[str]) -> DataFrame:
    """The database with the lowest score of each instance, ties by name."""
    return scores.groupBy(*key).agg(F.min_by("database", F.struct("score", "database")).alias("database"), F.min("score").alias("score"))
