"""Activity triggers: sliding baseline, spikes, role changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.streaming.replay import replayed, streamed
from fleetlens.streaming.segments import SpikeConfig


def with_activity_baseline(samples: DataFrame, key: list[str], window_s: int = 1800) -> DataFrame:
    """Mean of the samples in the trailing window without the latest; null with fewer than two."""
    w = Window.partitionBy(*key).orderBy(F.unix_timestamp("ts")).rangeBetween(-window_s, 0)
    n, total = F.count("active").over(w), F.sum("active").over(w)
    return samples.withColumn("baseline", F.when(n >= 2, (total - F.col("active")) / (n - 1)))


def role_changes(samples: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Samples whose role differs from the one before; direction tells which way."""
    was = F.lag("in_recovery").over(Window.partitionBy(*key).orderBy(*order))
    direction = F.when(was & ~F.col("in_recovery"), "promoted").when(~was & F.col("in_recovery"), "demoted")
    return samples.withColumn("direction", direction).where("direction is not null")


def spike_events(samples: DataFrame, cfg: SpikeConfig | None = None, span_s: int = 86400) -> DataFrame:
    """Z2 over stored samples (instance, ts, active): instance, onset, at, peak and coverage of each spike; see ``replayed``."""
    return _spikes(replayed(samples, cfg or SpikeConfig(), span_s=span_s))


def spike_stream(samples: DataFrame, cfg: SpikeConfig | None = None, late: str = "10 minutes") -> DataFrame:
    """Z2 over a stream; see ``streamed``."""
    return _spikes(streamed(samples, cfg or SpikeConfig(), late=late))


def _spikes(events: DataFrame) -> DataFrame:
    return events.select("instance", "onset", "at", F.col("value").alias("peak"), "coverage")
