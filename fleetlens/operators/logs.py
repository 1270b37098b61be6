"""Log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import mask_template

# Severities from least to worst; any other ranks below them.
SEVERITIES = ["DEBUG", "INFO", "LOG", "NOTICE", "WARNING", "ERROR", "FATAL", "PANIC"]


def log_search(logs: DataFrame, includes: list[str], excludes: list[str], severity: list[str] | None = None, placeholder: str = "<*>") -> DataFrame:
    """Lines with every include and no exclude, whatever their case; an exclude with the placeholder is held against the template."""
    low = F.lower(F.col("text"))
    rows = logs.where(F.col("severity").isin(severity)) if severity else logs
    for s in includes:
        rows = rows.where(low.contains(s.lower()))
    for s in excludes:
        against = F.lower(mask_template(F.col("text"), placeholder)) if placeholder in s else low
        rows = rows.where(~against.contains(s.lower()))
    return rows


def log_groups(logs: DataFrame) -> DataFrame:
    """Count, first and last time, worst severity and latest text of each template; no cap on the lines read.

    Severities rank whatever their case, unknown ones and null last; the worst is given as it was written, of several
    spellings the last by name.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.upper("severity")), F.lit(0))
    rows = logs.select(mask_template(F.col("text")).alias("template"), "ts", "text", F.struct(rank.alias("rank"), "severity").alias("worst"))
    groups = rows.groupBy("template").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("worst").alias("worst"), F.max_by("text", F.struct("ts", "text")).alias("latest"))
    return groups.withColumn("severity", F.col("worst.severity")).drop("worst")


def log_histogram(logs: DataFrame, max_buckets: int = 40) -> DataFrame:
    """(bucket, severity, n) over the covered span in at most ``max_buckets`` buckets of a second or more."""
    span = logs.agg(F.min(F.unix_timestamp("ts")).alias("t0"), F.max(F.unix_timestamp("ts")).alias("t1"))
    width = F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0") + 1) / max_buckets))
    t0, by = span.select("t0").scalar(), span.select(width.alias("width")).scalar()
    return logs.groupBy(F.floor((F.unix_timestamp("ts") - t0) / by).alias("bucket"), "severity").agg(F.count("*").alias("n"))
