"""Hot objects: roll-up of hash partitions, epochs, percentiles, rates and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.graph import root_of

PROBS = [*(i / 10 for i in range(1, 10)), 0.95, 0.99]


def rollup_hash(edges: DataFrame, counters: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """K1, K2: counters of hash partitions summed into their topmost hash-partitioned ancestor.

    Only edges below a parent of strategy 'h' lead upwards. ``part_sig`` digests the leaves' ids in numeric order, so a
    changed partition set shows.
    """
    roots = root_of(edges.where("parent_strategy = 'h'"), key).select(*key, F.col("child").alias("relid"), "root")
    rows = counters.join(roots, [*key, "relid"], "left").withColumn("target", F.coalesce("root", "relid"))
    leaves = F.transform(F.array_sort(F.collect_list("relid")), lambda x: x.cast("string"))
    return rows.groupBy(*key, "target").agg(*(F.sum(n).alias(n) for n in names), F.md5(F.array_join(leaves, ",")).alias("part_sig"))


def epoch_ok(anchors: DataFrame, sample: DataFrame, key: list[str]) -> DataFrame:
    """K4: whether each host of ``sample`` still counts from the reset of its anchor (both unknown counts); false without one."""
    was = anchors.select(*key, F.col("stats_reset").alias("_was"), F.lit(True).alias("_seen"))
    rows = sample.select(*key, "stats_reset").join(was, key, "left")
    return rows.select(*key, (F.coalesce("_seen", F.lit(False)) & F.col("stats_reset").eqNullSafe(F.col("_was"))).alias("complete"))


def percentile_of(value: Column, deciles: Column, upper: Column, top: Column) -> Column:
    """The share of the tail that ``value`` exceeds, straight between the quantiles; on equal quantiles the upper edge."""
    values = F.concat(F.array(F.lit(0.0)), deciles, F.coalesce(upper, F.array().cast("array<double>")))
    probs = F.when(F.size(upper) > 0, F.array(F.lit(0.0), *map(F.lit, PROBS))).otherwise(F.array(F.lit(0.0), *map(F.lit, PROBS[:9])))
    more = top > F.element_at(values, -1)
    values, probs = F.when(more, F.concat(values, F.array(top))).otherwise(values), F.when(more, F.concat(probs, F.array(F.lit(1.0)))).otherwise(probs)
    at = F.size(F.filter(values, lambda v: v <= value))  # the ladder never falls, so these are its first values
    lo, hi, p, q = F.get(values, at - 1), F.get(values, at), F.get(probs, at - 1), F.get(probs, at)
    return F.when((value <= 0) | deciles.isNull(), 0.0).when(at >= F.size(values), F.element_at(probs, -1)).otherwise(p + (q - p) * (value - lo) / (hi - lo))


def project_percentile(values: DataFrame, histograms: DataFrame, key: list[str]) -> DataFrame:
    """Values (key, object, value) against their class's histogram (key, deciles, upper, top)."""
    at = percentile_of(F.col("value").cast("double"), F.col("deciles"), F.col("upper"), F.col("top").cast("double"))
    return values.join(histograms, key, "left").select(*key, "object", "value", at.alias("percentile"))


def histogram_row(quantiles: DataFrame, tops: DataFrame, key: list[str]) -> DataFrame:
    """A histogram in one row from its quantiles (key, q, value) and the tail's largest value (key, top)."""
    order = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("q", F.col("value").cast("double").alias("value"))))), lambda x: x["value"])
    return quantiles.groupBy(*key).agg(order(F.col("q") <= 0.9).alias("deciles"), order(F.col("q") > 0.9).alias("upper")).join(tops, key)


def window_days(windows: DataFrame, key: list[str]) -> DataFrame:
    """The longest complete host window of each snapshot, in days."""
    days = (F.unix_timestamp("to_ts") - F.unix_timestamp("from_ts")) / 86400.0
    return windows.where("complete").groupBy(*key).agg(F.max(days).alias("days"))


def rate_per_day(objects: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """An object's activity a day over the longest complete window, null without one."""
    return objects.join(window_days(windows, key), key, "left").withColumn("per_day", F.when(F.col("days") > 0, F.col("value") / F.col("days"))).drop("days")


def object_history(tops: DataFrame, kind: str, name: str, start: str | None = None) -> DataFrame:
    """An object's ranks and values in stored tops, oldest first."""
    rows = tops.where((F.col("kind") == kind) & (F.col("object") == name))
    return (rows.where(F.col("captured_at") >= F.lit(start).cast("timestamp")) if start else rows).orderBy("captured_at", "class")


def live_percentile(anchors: DataFrame, sample: DataFrame, windows: DataFrame, histograms: DataFrame, key: list[str]) -> DataFrame:
    """Where each object's present rate lies in its class's tail.

    A host's growth since its own anchor, over that anchor's age; hosts whose reset or partitions changed, or whose
    counter fell, are left out. The summed rate is brought to the snapshot's window before it is projected.
    """
    was = anchors.select(*key, "object", "host", F.col("value").alias("_v"), F.col("stats_reset").alias("_reset"), F.col("part_sig").alias("_sig"), F.col("captured_at").alias("_at"))
    days = (F.unix_timestamp("captured_at") - F.unix_timestamp("_at")) / 86400.0
    fair = F.col("stats_reset").eqNullSafe(F.col("_reset")) & F.col("part_sig").eqNullSafe(F.col("_sig")) & (F.col("value") >= F.col("_v")) & (days > 0)
    rates = sample.join(was, [*key, "object", "host"]).where(fair).groupBy(*key, "object").agg(F.sum((F.col("value") - F.col("_v")) / days).alias("per_day"))
    scaled = rates.join(window_days(windows, key), key, "left").withColumn("value", F.col("per_day") * F.coalesce("days", F.lit(1.0)))
    return project_percentile(scaled, histograms, key).drop("value").join(rates, [*key, "object"])
