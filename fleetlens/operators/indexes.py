"""Index and table usage, caching, maintenance thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import safe_ratio
from fleetlens.functions.graph import root_of


def index_caching(statio: DataFrame) -> DataFrame:
    """Cache hit fraction of each index, 0 without traffic."""
    return statio.withColumn("hit", F.coalesce(safe_ratio(F.col("idx_blks_hit"), F.col("idx_blks_hit") + F.col("idx_blks_read")), F.lit(0.0)))


def hit_rate(statio: DataFrame, key: list[str], hit: str, read: str) -> DataFrame:
    """I4, T4: overall hit rate, null without traffic."""
    return statio.groupBy(*key).agg(safe_ratio(F.sum(hit), F.sum(hit) + F.sum(read)).alias("hit_rate"))


def missing_indexes(stat_tables: DataFrame, used_pct: int = 95, min_rows: int = 10_000) -> DataFrame:
    """Larger tables that use indexes in less than ``used_pct`` percent of scans (integer division)."""
    scans = F.col("seq_scan") + F.col("idx_scan")
    return stat_tables.where(scans > 0).withColumn("idx_pct", F.expr("100 * idx_scan div (seq_scan + idx_scan)")).where((F.col("idx_pct") < used_pct) & (F.col("n_live_tup") >= min_rows))


def index_usage(stat_tables: DataFrame) -> DataFrame:
    """Percentage of scans that use an index, null without scans."""
    return stat_tables.withColumn("idx_pct", safe_ratio(F.col("idx_scan"), F.col("seq_scan") + F.col("idx_scan"), 100.0))


def exclude_locked(df: DataFrame, locks: DataFrame, key: list[str]) -> DataFrame:
    """I16: without objects that are locked exclusively; nulls among the locks don't matter."""
    return df.join(locks.where("mode = 'AccessExclusiveLock' and granted").select(*key).distinct(), key, "left_anti")


def unused(stat_idx: DataFrame, threshold: int, locks: DataFrame, key: list[str]) -> DataFrame:
    """Non-unique indexes with at most ``threshold`` scans that aren't locked."""
    return exclude_locked(stat_idx.where((F.col("idx_scan") <= threshold) & ~F.col("unique")), locks, key)


def unused_cluster(stat_idx: DataFrame, threshold: int, key: list[str]) -> DataFrame:
    """Indexes with at most ``threshold`` scans on every host."""
    return stat_idx.groupBy(*key).agg(F.max("idx_scan").alias("idx_scan"), F.max("size_bytes").alias("size_bytes")).where(F.col("idx_scan") <= threshold)


def unused_verdict(samples: DataFrame, edges: DataFrame, expected: DataFrame, key: list[str], min_days: float = 7.0, used_per_day: float = 0.1) -> DataFrame:
    """Verdict for each root index over all hosts.

    Partitions are summed into their root on each host; rates use a window of an hour at least. An expected host without
    samples makes the verdict unknown; any host that uses the index settles it as used; a used index with old evidence
    is stale; windows shorter than ``min_days`` are not enough.
    """
    roots = root_of(edges, key).select(*key, F.col("child").alias("index"), "root")
    per_host = samples.join(roots, [*key, "index"], "left").groupBy(*key, F.coalesce("root", "index").alias("index"), "host").agg(F.sum("idx_scan").alias("scans"), F.min("window_days").alias("days"))
    rate = F.col("scans") / F.greatest(F.col("days"), F.lit(1 / 24))
    per_index = per_host.groupBy(*key, "index").agg(F.max(rate).alias("per_day"), F.sum("scans").alias("scans"), F.min("days").alias("days"), F.count_distinct("host").alias("hosts"))
    wanted = expected.groupBy(*key).agg(F.count_distinct("host").alias("expected"))
    verdict = (
        F.when(F.col("per_day") >= used_per_day, "used")
        .when(F.col("hosts") < F.coalesce("expected", "hosts"), "unknown")
        .when(F.col("days") < min_days, "insufficient_data")
        .when(F.col("scans") > 0, "stale_evidence").otherwise("drop_candidate")
    )
    return per_index.join(wanted, key, "left").select(*key, "index", "scans", "per_day", "days", "hosts", verdict.alias("verdict"))


def stat_info(t: DataFrame) -> DataFrame:
    """Shares of inserts, updates, deletes, in-page updates and kinds of scan."""
    writes = F.col("n_tup_ins") + F.col("n_tup_upd") + F.col("n_tup_del")
    scans = F.col("seq_scan") + F.col("idx_scan")
    return t.withColumns({
        "ins_pct": safe_ratio(F.col("n_tup_ins"), writes, 100.0), "upd_pct": safe_ratio(F.col("n_tup_upd"), writes, 100.0), "del_pct": safe_ratio(F.col("n_tup_del"), writes, 100.0),
        "hot_pct": safe_ratio(F.col("n_tup_hot_upd"), F.col("n_tup_upd"), 100.0), "seq_pct": safe_ratio(F.col("seq_scan"), scans, 100.0), "idx_pct": safe_ratio(F.col("idx_scan"), scans, 100.0),
    })


def partition_sizes(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """T5: children, total and average size of each parent."""
    return edges.join(sizes, edges["child"] == sizes["oid"]).groupBy("parent").agg(F.count("*").alias("children"), F.sum("size_bytes").alias("total_bytes"), F.avg("size_bytes").alias("avg_bytes"))


def autovac_due(t: DataFrame, row_basis: str = "least") -> DataFrame:
    """Whether vacuum and analyze are due by the thresholds base + factor * rows; options of a table go first."""
    rows = F.least("reltuples", F.col("n_live_tup").cast("double")) if row_basis == "least" else F.col("reltuples")
    at = lambda base, factor: F.col(base) + F.col(factor) * F.greatest(rows, F.lit(0.0))
    vacuum = (F.col("n_dead_tup") > at("vacuum_base", "vacuum_factor")) | (F.col("n_ins_since_vacuum") > at("insert_base", "insert_factor"))
    return t.withColumns({"vacuum_due": vacuum, "analyze_due": F.col("n_mod_since_analyze") > at("analyze_base", "analyze_factor")})


def autovac_summary(due: DataFrame, key: list[str]) -> DataFrame:
    """M2: tables due for vacuum alone, analyze alone, both, any."""
    v, a = F.col("vacuum_due"), F.col("analyze_due")
    count = lambda c, n: F.count_if(c).alias(n)
    return due.groupBy(*key).agg(count(v & ~a, "vacuum_only"), count(a & ~v, "analyze_only"), count(v & a, "both"), count(v | a, "total"))


def count_by(df: DataFrame, key: list[str | Column], where: Column | None = None) -> DataFrame:
    """Sessions by source, state or wait event."""
    return (df if where is None else df.where(where)).groupBy(*key).agg(F.count("*").alias("n"))


def table_caching(statio: DataFrame) -> DataFrame:
    """Cache hit ratio of heap, indexes, overflow table and its index; tables without traffic are left out."""
    kinds = ["heap", "idx", "toast", "tidx"]
    n = {k: F.coalesce(F.col(f"{k}_blks_hit"), F.lit(0)) + F.coalesce(F.col(f"{k}_blks_read"), F.lit(0)) for k in kinds}
    return statio.where(sum(n.values(), F.lit(0)) > 0).withColumns({f"{k}_ratio": safe_ratio(F.col(f"{k}_blks_hit"), n[k]) for k in kinds})


def vacuum_thresholds(t: DataFrame) -> DataFrame:
    """When vacuum, insert vacuum and analyze come due: base + factor * reltuples; a table's own options (map reloptions) go before the settings."""
    def pick(option: str, setting: str) -> Column:
        return F.coalesce(F.try_element_at("reloptions", F.lit(option)).try_cast("double"), F.col(setting))

    rows = F.greatest(F.col("reltuples"), F.lit(0.0))
    names = {"vacuum": ("autovacuum_vacuum", "vacuum"), "insert": ("autovacuum_vacuum_insert", "insert"), "analyze": ("autovacuum_analyze", "analyze")}
    return t.withColumns({f"{n}_at": pick(f"{o}_threshold", f"{s}_base") + pick(f"{o}_scale_factor", f"{s}_factor") * rows for n, (o, s) in names.items()})
