"""Statement statistics: contribution reports, tops, comparisons, blocked sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.exprs import safe_ratio, sanitize
from fleetlens.functions.windows import top_n, topn_any, unpivot_metrics, with_shares


def derive_times(stmts: DataFrame) -> DataFrame:
    """Total, io and cpu time and cache hit percentage; cpu is null where io exceeds the total."""
    total = F.col("plan_ms") + F.col("exec_ms")
    return stmts.withColumns({
        "total_ms": total,
        "cpu_ms": F.when(total >= F.col("io_ms"), total - F.col("io_ms")),
        "hit_pct": safe_ratio(F.col("blks_hit"), F.col("blks_hit") + F.col("blks_read"), 100.0),
    })


def contribution_report(stmts: DataFrame, metrics: list[str], part: list[str], whole: list[str] | None = None) -> DataFrame:
    """Sums by query and database, with each metric's share of the database and of the instance.

    Shares are taken over all statements, before any truncation.
    """
    sums = stmts.groupBy(*(whole or []), *part, "queryid").agg(*(F.sum(m).alias(m) for m in metrics))
    return with_shares(sums, metrics, [*(whole or []), *part], whole or [])


def report_tops(report: DataFrame, metrics: list[str], part: list[str], n: int = 10, pin: Column | None = None) -> DataFrame:
    """Rows in the first n of any metric in their database, and the pinned query."""
    return topn_any(report, part, ["queryid"], metrics, n, pin)


def top_by(stmts: DataFrame, metric: str, n: int = 10) -> DataFrame:
    """The n queries with most of a metric, ties by queryid."""
    sums = stmts.groupBy("queryid").agg(*(F.sum(c).alias(c) for c in stmts.columns if c not in ("queryid", "database", "query", "user")))
    return sums.orderBy(F.desc(metric), "queryid").limit(n)


def top_chart(stmts: DataFrame, metrics: list[str], n: int = 10) -> DataFrame:
    """For each metric the n largest queries with their share of its total; one pass by unpivoting."""
    sums = stmts.groupBy("queryid").agg(*(F.sum(m).alias(m) for m in metrics))
    long = unpivot_metrics(sums, ["queryid"], metrics)
    total = long.groupBy("metric").agg(F.sum("value").alias("total"))  # a row for each metric
    tops = top_n(long, ["metric"], [F.desc("value"), F.asc("queryid")], n)
    return tops.join(F.broadcast(total), "metric").select("metric", "queryid", "rn", "value", safe_ratio(F.col("value"), F.col("total"), 100.0).alias("pct"))


def exclude_users(stmts: DataFrame, users: list[str]) -> DataFrame:
    """Without the statements of these users; unknown users stay."""
    return stmts.where(F.col("user").isNull() | ~F.col("user").isin(users))


def exclude_solely(report: DataFrame, users: list[str]) -> DataFrame:
    """Without rows whose users are all excluded."""
    return report.where(F.size(F.array_except("usernames", F.array(*map(F.lit, users)))) > 0)


def scope_report(report: DataFrame, metrics: list[str], database: Column | None = None) -> DataFrame:
    """One database with its own shares, or the instance with the total's."""
    suffix = "total_pct" if database is None else "pct"
    rows = report if database is None else report.where(database)
    return rows.select("queryid", "database", *metrics, *(F.col(f"{m}_{suffix}").alias(f"{m}_share") for m in metrics))


def compare(a: DataFrame, b: DataFrame, metrics: list[str], key: list[str]) -> DataFrame:
    """Full outer join of two snapshots; a_<m>, b_<m> and where the row is present."""
    side = lambda df, p: df.select(*key, *(F.col(m).alias(f"{p}_{m}") for m in metrics), F.lit(True).alias(f"_{p}"))
    present = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_a").otherwise("only_b")
    return side(a, "a").join(side(b, "b"), key, "full_outer").withColumn("present", present).drop("_a", "_b")


def compare_counts(compared: DataFrame) -> DataFrame:
    """Rows in both snapshots and in one alone."""
    return compared.groupBy("present").agg(F.count("*").alias("n"))


def compare_view(compared: DataFrame, metric: str, key: list[str], side: str = "a", hide_absent_a: bool = False, hide_absent_b: bool = False, only: str | None = None, n: int = 100) -> DataFrame:
    """The first n rows with their place (rn) by one side's metric, largest first (absent counts as 0), ties by key; rows absent on a side may be hidden, or one kind of presence shown alone."""
    rows = compared
    if hide_absent_a:
        rows = rows.where("present <> 'only_b'")
    if hide_absent_b:
        rows = rows.where("present <> 'only_a'")
    if only:
        rows = rows.where(F.col("present") == only)
    by = [F.desc(F.coalesce(f"{side}_{metric}", F.lit(0))), *key]
    first = rows.orderBy(*by).limit(n)  # each task keeps n rows
    return first.withColumn("rn", F.row_number().over(Window.orderBy(*by)))


def blocked_pairs(locks: DataFrame, key: list[str], holders_only: bool = False) -> DataFrame:
    """Waiting locks with the other locks on the same transaction or relation; unmatched waiters stay.

    The OR of the two conditions is split in two equi-joins, the second without what the first has found.
    """
    waits = locks.where(~F.col("granted")).select(*key, "pid", "locktype", "relation", "transactionid", "lock_database")
    held = locks.where("granted") if holders_only else locks
    other = held.select(*key, F.col("pid").alias("blocker"), F.col("locktype").alias("o_type"), F.col("relation").alias("o_relation"), F.col("transactionid").alias("o_xid"), F.col("lock_database").alias("o_db"))
    by_xid = waits.join(other.where("o_xid is not null"), [*key], "inner").where("transactionid = o_xid and pid <> blocker")
    by_rel = waits.join(other, [*key], "inner").where(
        (F.col("relation") == F.col("o_relation")) & (F.col("locktype") == F.col("o_type")) & F.col("lock_database").eqNullSafe(F.col("o_db")) & (F.col("pid") != F.col("blocker")) & ~F.coalesce(F.col("transactionid") == F.col("o_xid"), F.lit(False))
    )
    pairs = by_xid.unionByName(by_rel).select(*key, "pid", "blocker").distinct()
    return waits.select(*key, "pid").distinct().join(pairs, [*key, "pid"], "left")


def sanitised(stmts: DataFrame) -> DataFrame:
    """Statement texts without credentials."""
    return stmts.withColumn("query", sanitize(F.col("query")))


def fold_workload(entries: DataFrame) -> DataFrame:
    """One row for each fingerprint: sums, hosts, ids and the longest text (ties by text); empty ones never fold."""
    key = F.when(F.col("fingerprint") == "", F.concat(F.lit("#"), F.col("host"), F.lit("#"), F.col("queryid").cast("string"))).otherwise(F.col("fingerprint"))
    return entries.groupBy(key.alias("fold")).agg(
        F.sum("calls").alias("calls"), F.sum("exec_ms").alias("exec_ms"), F.count_distinct("host").alias("hosts"),
        F.count_distinct("queryid").alias("ids"), F.max_by("query", F.struct(F.length("query"), "query")).alias("query"),
    )


def advisor_workload(stmts: DataFrame, exclude: list[str], n: int = 500) -> DataFrame:
    """Per query sums and longest text of users that aren't excluded (unknown users stay), the n longest-running."""
    kept = exclude_users(stmts, exclude)
    sums = kept.groupBy("queryid").agg(F.sum("calls").alias("calls"), F.sum("exec_ms").alias("exec_ms"), F.max_by("query", F.struct(F.length("query"), "query")).alias("query"))
    return sums.orderBy(F.desc("exec_ms"), "queryid").limit(n)


def search_report(report: DataFrame, text: str, share: str, high: float = 5.0) -> DataFrame:
    """Rows whose text or queryid holds ``text``, with a flag for shares above ``high`` percent."""
    low = F.lower(F.col("query"))
    return report.where(low.contains(text.lower()) | F.col("queryid").cast("string").contains(text)).withColumn("high", F.col(share) > high)


def stats_window(snaps: DataFrame) -> DataFrame:
    """Seconds from the statistics' reset to the capture."""
    return snaps.withColumn("window_s", F.unix_timestamp("captured_at") - F.unix_timestamp("stats_reset"))


def running(activity: DataFrame, min_ms: float, pattern: str | None = None, like: bool = True) -> DataFrame:
    """Sessions running for ``min_ms`` or longer, the longest first; waiting if an event is set."""
    rows = activity.where(F.col("running_ms") >= min_ms).withColumn("waiting", F.col("wait_event").isNotNull())
    if pattern:
        rows = rows.where(F.col("query").ilike(pattern) if like else ~F.col("query").ilike(pattern))
    return rows.orderBy(F.desc("running_ms"), "pid")


def harshest(probes: DataFrame, key: list[str]) -> DataFrame:
    """Of each group's lock probes the one with most blocked pids, ties by the longest wait, then the latest."""
    sums = probes.groupBy(*key, "probe_at").agg(F.count_distinct("pid").alias("blocked"), F.max("wait_s").alias("longest_s"))
    return top_n(sums, key, [F.desc("blocked"), F.desc("longest_s"), F.desc("probe_at")], 1).drop("rn")


def lag_previous(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The value of the row before, by key and order."""
    return df.withColumn(f"previous_{value}", F.lag(value).over(Window.partitionBy(*key).orderBy(order)))
