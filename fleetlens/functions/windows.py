"""Ranking, shares and quantiles within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.store import settled


def top_n(df: DataFrame, part: list[str], by: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each group; the literal bound lets Spark cut groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*part).orderBy(*by))).where(F.col(rank) <= n)


def unpivot_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """(ids, metric, value), one row for each metric; a single pass over df."""
    return df.unpivot(ids, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def topn_any(df: DataFrame, part: list[str], key: list[str], metrics: list[str], n: int, pin: Column | None = None) -> DataFrame:
    """Rows that are among the first n of their group by any metric (largest first, ties by key), and pinned ones.

    A row's hash of the key puts it into one of 16 n lots. The n-th largest of the lots' maxima is at most the n-th largest
    value, so rows below it in every metric are left out without a sort; a group with fewer lots keeps all. These bounds, a row
    for each group, are broadcast. The rest, ties at the bound included, is written and ranked in long form, where the bound on the rank limits each group early.
    """
    lots = df.groupBy(*part, F.pmod(F.hash(*key), F.lit(16 * n)).alias("_lot")).agg(*(F.max(m).alias(m) for m in metrics))
    nth = lambda m: F.get(F.sort_array(F.collect_list(m), asc=False), F.lit(n - 1))
    bounds = lots.groupBy(*part).agg(*(nth(m).alias(f"_least_{m}") for m in metrics)).withColumnsRenamed({p: f"_group_{p}" for p in part})  # lists of 16 n values
    same, high = F.lit(True), F.lit(False) if pin is None else pin
    for p in part:
        same = same & F.col(p).eqNullSafe(F.col(f"_group_{p}"))
    for m in metrics:
        high = high | F.col(f"_least_{m}").isNull() | (F.col(m) >= F.col(f"_least_{m}"))
    few = settled(df.join(F.broadcast(bounds), same).where(high).select(*df.columns), "few")
    ranked = top_n(unpivot_metrics(few, [*part, *key], metrics), [*part, "metric"], [F.col("value").desc_nulls_last(), *map(F.asc, key)], n)
    kept = ranked.select(*part, *key)
    if pin is not None:
        kept = kept.unionByName(few.where(pin).select(*part, *key))
    return few.join(kept.distinct(), [*part, *key], "left_semi")


def with_shares(df: DataFrame, metrics: list[str], part: list[str], whole: list[str]) -> DataFrame:
    """Each metric's percentage of its group's sum (<m>_pct) and of the wider group's (<m>_total_pct), null where the sum is 0.

    Sums are aggregated before the shuffle and looked up, so that no group's rows come together in one task.
    """
    for suffix, keys in (("pct", part), ("total_pct", whole)):
        sums = F.struct(*(F.sum(m).alias(m) for m in metrics)).alias("_sums")
        if keys:
            totals = df.groupBy(*keys).agg(sums).withColumnsRenamed({k: f"_{k}" for k in keys})
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            df = df.join(totals, same).drop(*(f"_{k}" for k in keys))
        else:
            df = df.withColumn("_sums", df.agg(sums).scalar())
        df = df.withColumns({f"{m}_{suffix}": F.when(F.col("_sums")[m] != 0, 100.0 * F.col(m) / F.col("_sums")[m]) for m in metrics}).drop("_sums")
    return df


def running_total(df: DataFrame, part: list[str], order: str, weight: str, total: str = "running") -> DataFrame:
    """df with the sum of ``weight`` over all rows of the group up to and with this one, by ``order`` (unique in a group).

    Rows are put in range partitions by group and order; a small table of the partitions' sums tells what stands before
    each, so that a group may span many tasks.
    """
    ranged = settled(df.repartitionByRange(*part, order).withColumn("_p", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*part, "_p").agg(F.sum(weight).alias("_s"))  # a row for each group in each partition
    before = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(*part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).drop("_s")
    own = F.sum(weight).over(Window.partitionBy(*part, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(total, own).join(before, [*part, "_p"]).withColumn(total, F.col(total) + F.coalesce("_before", F.lit(0))).drop("_p", "_before")


def nearest_rank(df: DataFrame, part: list[str], value: str, at: list[float]) -> DataFrame:
    """(part, q, value): the value at rank max(1, ceil(q n - 1e-9)) of each group, for each q of ``at``; from counts of equal values."""
    counts = df.groupBy(*part, F.col(value).alias("value")).agg(F.count("*").alias("_n"))
    ranked = running_total(counts, part, "value", "_n", "_last")
    ranked = ranked.join(ranked.groupBy(*part).agg(F.sum("_n").alias("_all")), part)
    picks = F.array(*(F.struct(F.lit(q).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_all") - 1e-9)).alias("r")) for q in at))
    hit = F.filter(picks, lambda p: (p["r"] > F.col("_last") - F.col("_n")) & (p["r"] <= F.col("_last")))
    return ranked.select(*part, "value", F.explode(hit).alias("p")).select(*part, F.col("p.q").alias("q"), "value")


def running_last(df: DataFrame, part: list[str], order: list[str], value: str, name: str, before: int = 0) -> DataFrame:
    """df with the last non-null ``value`` of the group up to this row by ``order``, or up to ``before`` rows before it.

    As in ``running_total`` rows are put in range partitions, and a small table tells the last value before each, so that a
    group may span many tasks.
    """
    ranged = settled(df.repartitionByRange(*part, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    own = Window.partitionBy(*part, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -before)
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = ranged.groupBy(*part, "_p").agg(F.max_by(value, place).alias("_e"))  # a row for each group in each partition
    past = Window.partitionBy(*part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_past", F.last("_e", ignorenulls=True).over(past)).drop("_e").withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(part)} | {"_p": "_q"})
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(part):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = ranged.withColumn("_own", F.last(value, ignorenulls=True).over(own)).join(ends, same, "left")
    return found.withColumn(name, F.coalesce("_own", "_past")).drop("_own", "_past", "_p", "_q", *(f"_k{i}" for i in range(len(part))))
