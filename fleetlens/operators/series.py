"""Signals, seasonal baselines and dips (X2-X7); hot objects: counter deltas, tops and tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.exprs import hour_of_week
from fleetlens.functions.windows import nearest_rank, running_last, top_n


def pivot_signals(long: DataFrame, signals: list[str]) -> DataFrame:
    """One row for each target and time, a column for each of the given signals; absent is null, not 0."""
    return long.groupBy("target", "ts").pivot("signal", signals).agg(F.last("value", ignorenulls=True))


def value_counts(series: DataFrame) -> DataFrame:
    """(target, signal, how, value, n): how often each value stands in each hour of the week. Tables of several days add up."""
    known = series.where("value is not null")
    return known.groupBy("target", "signal", hour_of_week(F.col("ts")).alias("how"), "value").agg(F.count("*").alias("n"))


def fold_counts(state: DataFrame, added: DataFrame, expired: DataFrame | None = None) -> DataFrame:
    """X4 from day to day: the counts of ``state`` with a day's own added and those of one beyond the window taken out."""
    every = state.unionByName(added)
    if expired is not None:
        every = every.unionByName(expired.withColumn("n", -F.col("n")))
    return every.groupBy("target", "signal", "how", "value").agg(F.sum("n").alias("n")).where("n > 0")


def baseline_from_counts(counts: DataFrame, min_points: int) -> DataFrame:
    """(target, signal, how, median, n) of series of ``min_points`` points or more.

    The median is half the values at ranks (n + 1) / 2, rounded down and up, which lie where the running count reaches them;
    no group's values are held together, equal ones are one row.
    """
    hour = ["target", "signal", "how"]
    enough = counts.groupBy("target", "signal").agg(F.sum("n").alias("points")).where(F.col("points") >= min_points)
    w = Window.partitionBy(*hour)
    last, n = F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(w)
    ranked = counts.join(enough.drop("points"), ["target", "signal"], "left_semi").withColumns({"_last": last, "_all": n})
    low, high = F.floor((F.col("_all") + 1) / 2), F.ceil((F.col("_all") + 1) / 2)
    hit = lambda r: F.when((r > F.col("_last") - F.col("n")) & (r <= F.col("_last")), F.col("value") / 2)
    return ranked.groupBy(*hour).agg((F.sum(hit(low)) + F.sum(hit(high))).alias("median"), F.sum("n").alias("n"))


def seasonal_baseline(series: DataFrame, min_points: int) -> DataFrame:
    """(target, signal, how, median, n) by hour of week, for series of ``min_points`` points or more; see ``baseline_from_counts``."""
    return baseline_from_counts(value_counts(series), min_points)


def with_baseline(series: DataFrame, base: DataFrame) -> DataFrame:
    """The baseline of each point's hour, and value / baseline where both are above 0."""
    joined = series.withColumn("how", hour_of_week(F.col("ts"))).join(base.select("target", "signal", "how", F.col("median").alias("baseline")), ["target", "signal", "how"], "left")
    return joined.withColumn("ratio", F.when((F.col("value") > 0) & (F.col("baseline") > 0), F.col("value") / F.col("baseline")))


def dips(series: DataFrame, base: DataFrame, min_drop: float = 10.0) -> DataFrame:
    """Points that lie more than ``min_drop`` below their baseline."""
    found = with_baseline(series, base)
    return found.where(F.col("baseline") - F.col("value") > min_drop).select("target", "signal", "ts", "value", "baseline")


def counter_delta(samples: DataFrame, key: list[str], order: str, counters: list[str]) -> DataFrame:
    """K3: increase of each counter since the sample before; valid is false where any counter has gone back.

    The first sample counts from 0.
    """
    w = Window.partitionBy(*key).orderBy(order)
    before = {c: F.coalesce(F.lag(c).over(w), F.lit(0)) for c in counters}
    valid = F.lit(True)
    for c in counters:
        valid = valid & (F.col(c) >= before[c])
    return samples.select(*key, order, *((F.col(c) - before[c]).alias(f"d_{c}") for c in counters), valid.alias("valid"))


def top_objects(objects: DataFrame, part: list[str], n: int) -> DataFrame:
    """K6, K7: exact first n of each class by value, ties by object; objects without activity never rank."""
    return top_n(objects.where("value > 0"), part, [F.desc("value"), F.asc("object")], n)


def tail(objects: DataFrame, part: list[str], n: int) -> DataFrame:
    """The objects outside the first n."""
    return objects.join(top_objects(objects, part, n).select(*part, "object"), [*part, "object"], "left_anti")


def tail_histogram(objects: DataFrame, part: list[str], n: int) -> DataFrame:
    """K8: nearest-rank deciles, P95 and P99 of everything outside the first n, in long form."""
    return nearest_rank(tail(objects, part, n), part, "value", [*(i / 10 for i in range(1, 10)), 0.95, 0.99])


def tail_summary(objects: DataFrame, part: list[str], n: int) -> DataFrame:
    """K8: number, sum and largest value of everything outside the first n."""
    return tail(objects, part, n).groupBy(*part).agg(F.count("*").alias("count"), F.sum("value").alias("sum"), F.max("value").alias("max"))


def coverage(objects: DataFrame, part: list[str], n: int) -> DataFrame:
    """K9: the share of the first n in all activity, 1 where nothing moved; the first n and a sum, no ranking of all."""
    tops = top_objects(objects, part, n).groupBy(*part).agg(F.sum("value").alias("_top"))
    total = objects.groupBy(*part).agg(F.sum("value").alias("_all"))
    return total.join(tops, part, "left").select(*part, F.when(F.col("_all") > 0, F.coalesce("_top", F.lit(0)) / F.col("_all")).otherwise(1.0).alias("coverage"))


def aggregate_hosts(rows: DataFrame, key: list[str], value: str, size: str | None = None, expected: DataFrame | None = None) -> DataFrame:
    """K5: sums over valid hosts and their number; with ``size`` the largest copy on any host, valid or not; by_host maps valid hosts to their sums.

    Objects without a valid host stay, with null sums. With ``expected`` (host) the hosts that sent nothing at all are listed as missing.
    """
    valid = F.col("valid")
    per = rows.groupBy(*key, "host").agg(F.sum(F.when(valid, F.col(value))).alias("_v"), F.bool_or(valid).alias("_ok"), *([F.max(size).alias("_size")] if size else []))
    by_host = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("_ok"), F.struct("host", "_v")))))  # an entry for each host
    out = per.groupBy(*key).agg(F.sum("_v").alias(value), F.count_if("_ok").alias("hosts"), *([F.max("_size").alias(size)] if size else []), by_host.alias("by_host"))
    if expected is None:
        return out
    missing = expected.select("host").distinct().join(rows.select("host").distinct(), "host", "left_anti").agg(F.sort_array(F.collect_list("host")).alias("m"))
    return out.withColumn("missing", missing.scalar())


def previous_rank(tops: DataFrame, part: list[str], order: str) -> DataFrame:
    """An object's rank in the snapshot before, null where it wasn't in it; an object may have any number of snapshots."""
    marked = tops.withColumn("_rank", F.struct("rn"))
    return running_last(marked, part, [order], "_rank", "_was", before=1).withColumn("previous_rank", F.col("_was.rn")).drop("_rank", "_was")
