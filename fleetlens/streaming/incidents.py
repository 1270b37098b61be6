"""What follows a spike: recovery, debounce, deferred follow-ups, peaks of blocked sessions, event log, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.timelines import greedy
from fleetlens.sources.snapshots import asof
from fleetlens.streaming.replay import replayed, streamed
from fleetlens.streaming.segments import IncidentConfig, SpikeConfig


def incident_events(samples: DataFrame, spike: SpikeConfig | None = None, cfg: IncidentConfig | None = None, span_s: int = 86400) -> DataFrame:
    """Z3, Z5, Z6 over stored samples (instance, ts, active): instance, kind, at and value of each event; see ``replayed``."""
    return replayed(samples, spike or SpikeConfig(), cfg or IncidentConfig(), span_s).select("instance", "kind", "at", "value")


def incident_stream(samples: DataFrame, spike: SpikeConfig | None = None, cfg: IncidentConfig | None = None, late: str = "10 minutes") -> DataFrame:
    """Z3, Z5, Z6 over a stream; an event-time timer brings a follow-up even if no more samples come. See ``streamed``."""
    return streamed(samples, spike or SpikeConfig(), cfg or IncidentConfig(), late).select("instance", "kind", "at", "value")


def debounce(events: DataFrame, key: list[str], min_gap_s: int = 3600) -> DataFrame:
    """The events that are accepted: ``min_gap_s`` or more after the last accepted one, whatever their kind; see ``greedy``."""
    timed = events.withColumn("t", F.unix_timestamp("ts"))
    first = timed.groupBy(*key, "t").agg(F.min_by("kind", F.struct("ts", "kind")).alias("kind"))
    accepted = greedy(first.select(*key, "t", (F.col("t") + min_gap_s).alias("until")), key)
    return first.join(accepted, [*key, "t"]).select(*key, F.timestamp_seconds("t").alias("ts"), "kind")


def lock_peak(events: DataFrame, blocked: DataFrame, key: list[str]) -> DataFrame:
    """Most blocked sessions while each spike (key, onset_ts, at_ts) formed.

    Every count (probe_id, key, ts, blocked) looks up the newest onset before it and counts if the spike hadn't fired
    yet: one running window, no range join.
    """
    spans = events.select(*key, F.col("onset_ts").alias("ts"), F.struct("onset_ts", "at_ts").alias("span"))
    found = asof(blocked.select("probe_id", *key, "ts"), spans, key, "ts", "span").join(blocked.select("probe_id", "blocked"), "probe_id")
    peaks = found.where(F.col("ts") <= F.col("span.at_ts")).groupBy(*key, F.col("span.onset_ts").alias("onset_ts")).agg(F.max("blocked").alias("lock_peak"))
    return events.join(peaks, [*key, "onset_ts"], "left")


def event_log(events: DataFrame, path: str, checkpoint: str) -> object:
    """A stream of events with their outcomes appended to files, errors and empty reports included; exactly once by the checkpoint."""
    rows = events.withColumn("outcome", F.coalesce("outcome", F.lit("ok")))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def effective_config(hosts: DataFrame, overrides: DataFrame, defaults: dict[str, object], key: list[str]) -> DataFrame:
    """Each host's settings: its cluster's override (key, settings...) where there is one, the default elsewhere; hosts may be a stream."""
    given = overrides.select(*key, *(F.col(n).alias(f"_{n}") for n in defaults))
    rows = hosts.join(given, key, "left")
    return rows.withColumns({n: F.coalesce(f"_{n}", F.lit(v)) for n, v in defaults.items()}).drop(*(f"_{n}" for n in defaults))
