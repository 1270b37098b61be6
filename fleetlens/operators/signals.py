"""Signals from counters and gauges, their way into the health score, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.exprs import safe_ratio
from fleetlens.operators.health import health_score
from fleetlens.operators.series import dips, pivot_signals, seasonal_baseline, with_baseline

XID_LIMIT = 2_147_483_648
# Signal, how it comes from metrics, the metrics and their label (all if none), factor.
SIGNALS = [
    ("cache_hit_pct", "rate_share", "database_blocks", "hit", 100.0), ("latency_ms", "rate_ratio", "statements_seconds", "statements_calls", 1000.0),
    ("seq_scan_rate", "rate", "table_seq_tup_read", None, 1.0), ("checksum_failures", "increase", "checksum_failures", None, 1.0),
    ("deadlocks", "sum", "deadlocks", None, 1.0), ("checkpoints_timed", "sum", "checkpoints", "timed", 1.0), ("checkpoints_req", "sum", "checkpoints", "req", 1.0),
    ("checkpoints_req_rate", "rate", "checkpoints", "req", 1.0), ("checkpoints_all_rate", "rate", "checkpoints", None, 1.0), ("lock_waiters", "sum", "wait_events", "Lock", 1.0),
    ("replica_lag_s", "max", "replication_lag_seconds", None, 1.0), ("replica_lag_bytes", "max", "replication_lag_bytes", None, 1.0), ("ungranted", "sum", "locks_not_granted", None, 1.0),
    ("conn_total", "sum", "connections_all", None, 1.0), ("conn_active", "sum", "connections", "active", 1.0), ("idle_in_tx", "sum", "connections", "idle in transaction", 1.0),
    ("conn_max", "max", "settings", "max_connections", 1.0), ("xacts_left", "min", "xacts_left", None, 1.0), ("load_avg", "max", "load15", None, 1.0), ("vcpus", "count", "cpu_seconds", None, 1.0),
    ("bloat_max", "max", "table_bloat_ratio", None, 1.0), ("sequence_max", "max", "sequence_exhaustion_ratio", None, 1.0), ("type_max", "max", "datatype_exhaustion_ratio", None, 1.0),
    ("pooler_clients", "sum", "pooler_clients", None, 1.0), ("pooler_servers", "sum", "pooler_servers", None, 1.0), ("pooler_pool", "sum", "pooler_pool_size", None, 1.0),
    ("disk_used", "max_ratio", "disk_used_bytes", "disk_total_bytes", 1.0), ("dead_max_pct", "dead_max", "tuples_dead", "tuples_live", 100.0), ("dead_avg_pct", "dead_avg", "tuples_dead", "tuples_live", 100.0),
    ("hot_ratio", "rate_over", "tuples_hot_updated", "tuples_updated", 1.0),
]


def increases(samples: DataFrame, key: list[str], step_s: int) -> DataFrame:
    """(key, metric, label, series, ts, value, grown, seconds): growth of each series in each step; after a reset it counts from 0."""
    w = Window.partitionBy(*key, "metric", "label", "series").orderBy("ts")
    before = F.lag("value").over(w)
    grown = F.when(before.isNull(), None).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    rows = samples.withColumns({"_grown": grown, "_sec": F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))})
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / step_s) * step_s)
    return rows.groupBy(*key, "metric", "label", "series", slot.alias("step")).agg(F.max_by("value", "ts").alias("value"), F.sum("_grown").alias("grown"), F.sum("_sec").alias("seconds")).withColumnRenamed("step", "ts")


def derive_signals(samples: DataFrame, key: list[str], step_s: int = 300, signals: list[tuple] | None = None) -> DataFrame:
    """(key, ts, signal, value) from samples (key, metric, label, series, ts, value).

    Ratios between two metrics of one series pair them by an aggregate over the series, so the samples are read and
    grouped once; a signal without its metrics is absent, not 0.
    """
    use = signals or SIGNALS
    step = increases(samples, key, step_s)
    rate = F.when(F.col("seconds") > 0, F.col("grown") / F.col("seconds"))
    # ratios within one series: used / total, dead / (dead + live)
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    paired = step.where(F.col("metric").isin("disk_used_bytes", "disk_total_bytes", "tuples_dead", "tuples_live")).groupBy(*key, "ts", "series").agg(
        (of("disk_used_bytes") / F.nullif(of("disk_total_bytes"), F.lit(0.0))).alias("disk"), (of("tuples_dead") + of("tuples_live")).alias("rows"), of("tuples_dead").alias("dead"))
    dead = F.when(F.col("rows") > 10_000, F.col("dead") / F.col("rows"))
    pairs = paired.groupBy(*key, "ts").agg(F.max("disk").alias("max_ratio"), F.max(dead).alias("dead_max"), F.avg(dead).alias("dead_avg"))
    def value(how: str, a: str, b: str | None, factor: float) -> Column:
        m = F.col("metric") == a
        hit = m if b is None else m & (F.col("label") == b)
        if how in ("sum", "max", "min"):
            return factor * getattr(F, how)(F.when(hit, F.col("value")))
        if how == "count":
            return F.nullif(F.count_distinct(F.when(hit, F.col("label"))), F.lit(0)).cast("double")
        if how == "rate":
            return factor * F.sum(F.when(hit, rate))
        if how == "increase":
            return factor * F.coalesce(F.sum(F.when(hit, F.col("grown"))), F.lit(0.0))
        if how == "rate_share":
            return factor * F.sum(F.when(hit, rate)) / F.greatest(F.sum(F.when(m, rate)), F.lit(1.0))
        other = F.sum(F.when(F.col("metric") == b, rate))
        if how == "rate_ratio":
            return factor * F.sum(F.when(m, rate)) / F.greatest(other, F.lit(1.0))
        return F.when(other > 0.1, F.sum(F.when(m, rate)) / other).when(other >= 0, 1.0)  # rate_over: quiet reads as healthy

    direct = [(n, value(how, a, b, f)) for n, how, a, b, f in use if how not in ("max_ratio", "dead_max", "dead_avg")]
    wide = step.groupBy(*key, "ts").agg(*(v.cast("double").alias(n) for n, v in direct)).join(pairs, [*key, "ts"], "left")
    wide = wide.withColumns({n: f * F.col(how) for n, how, _, _, f in use if how in ("max_ratio", "dead_max", "dead_avg")})
    return wide.unpivot([*key, "ts"], [n for n, *_ in use], "signal", "value").where("value is not null")


# What an absent signal reads as.
NEUTRAL = {
    "conn_total": 0.0, "conn_max": 0.0, "idle_in_tx": 0.0, "longest_tx_s": 0.0, "cache_hit_pct": 100.0, "cache_sample": 0.0, "dead_max_pct": 0.0, "dead_avg_pct": 0.0, "bloated_tables": 0.0,
    "newpage_ratio": 0.0, "replica_lag_s": 0.0, "replicas_lost": 0.0, "vacuum_overdue_h": 0.0, "vacuum_backlog": 0.0, "never_vacuumed": 0.0, "autovac_off_tables": 0.0, "stale_stats": 0.0,
    "horizon_age": 0.0, "checkpoints_timed": 0.0, "checkpoints_req": 0.0, "lock_waiters": 0.0, "lock_wait_s": 0.0, "ungranted": 0.0, "lock_pool": 0.0, "deadlocks": 0.0, "hot_ratio": 1.0,
    "disk_used": 0.0, "checksum_failures": 0.0, "latency_ratio": 0.0, "seqscan_ratio": 0.0,
}


def signals_to_raw(wide: DataFrame) -> DataFrame:
    """The score's inputs from signals, absent ones healthy; lag shows that there is a replica; age is what of the limit is used up."""
    have = set(wide.columns)
    col = lambda n: F.col(n).cast("double") if n in have else F.lit(None).cast("double")
    lag_bytes = col("replica_lag_bytes")
    out = {n: F.coalesce(col(n), F.lit(d)) for n, d in NEUTRAL.items()}
    out["replicas"] = F.when(col("replica_lag_s").isNotNull() | lag_bytes.isNotNull(), 1).otherwise(0)
    out["replica_lag_mb"] = F.coalesce(lag_bytes / (1 << 20), F.lit(0.0))
    out["xid_age"] = F.coalesce(F.greatest(XID_LIMIT - col("xacts_left"), F.lit(0.0)), F.lit(0.0))
    out["load_per_cpu"] = F.coalesce(safe_ratio(col("load_avg"), col("vcpus")), F.lit(0.0))
    out["pooler_used"] = F.coalesce(safe_ratio(col("pooler_servers"), col("pooler_pool")), F.lit(0.0))
    out |= {n: F.coalesce(F.col(n), F.lit(False)) if n in have else F.lit(False) for n in ("autovacuum_off", "track_counts_off", "io_timing_off", "in_recovery")}
    return wide.withColumns(out)


def score_history(long: DataFrame, signals: list[str], start: str, end: str, min_points: int = 14 * 24) -> DataFrame:
    """The score of each target over time with the score usual at that hour, and whether it dips below.

    Latency and scans are graded against their own seasonal baselines, over the whole history; only the shown range is
    cut, at the end.
    """
    regress = long.where(F.col("signal").isin("latency_ms", "seq_scan_rate"))
    ratios = with_baseline(regress, seasonal_baseline(regress, min_points)).groupBy("target", "ts").pivot("signal", ["latency_ms", "seq_scan_rate"]).agg(F.max("ratio"))
    named = ratios.withColumnsRenamed({"latency_ms": "latency_ratio", "seq_scan_rate": "seqscan_ratio"})
    raw = signals_to_raw(pivot_signals(long, signals).join(named, ["target", "ts"], "left"))
    scores = health_score(raw, ["target", "ts"]).select("target", F.lit("score").alias("signal"), "ts", F.col("score").alias("value"))
    base = seasonal_baseline(scores, min_points)
    low = dips(scores, base).select("target", "ts", F.lit(True).alias("dip"))
    rows = with_baseline(scores, base).join(low, ["target", "ts"], "left")
    shown = F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return rows.where(shown).select("target", "ts", F.col("value").alias("score"), "baseline", F.coalesce("dip", F.lit(False)).alias("dip"))


def map_targets(hosts: DataFrame, mapping: DataFrame, key: list[str]) -> DataFrame:
    """Where a host's metrics are found: its mapping (key, env, service, host) first, else what discovery says (source, env label, id).

    Hosts of fixed clusters without a mapping stay unmapped (null service).
    """
    given = mapping.select(*key, F.col("env").alias("_env"), F.col("service").alias("_service"), F.col("host").alias("_host"), F.lit(True).alias("_given"))
    found = F.coalesce((F.col("source") != "") & (F.col("source") != "static"), F.lit(False))
    cluster, instance = key
    rows = hosts.join(given, key, "left")
    pick = lambda a, b: F.when(F.col("_given"), F.col(a)).when(found, b)
    return rows.select(*key, pick("_env", F.col("env_label")).alias("env"), pick("_service", F.col(cluster)).alias("service"), pick("_service", F.col("provider_id")).alias("service_id"), pick("_host", F.col(instance)).alias("host"))


def mapping_check(targets: DataFrame, series: DataFrame, key: list[str]) -> DataFrame:
    """How many series each target (key, role) matches; exactly one is right."""
    n = series.groupBy(*key, "role").agg(F.count("*").alias("matched"))
    return targets.join(n, [*key, "role"], "left").withColumn("matched", F.coalesce("matched", F.lit(0))).withColumn("ok", F.col("matched") == 1)
