"""Stored samples replayed in spans of time, many of a host's at once, and streams of samples with typed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.functions.store import settled
from fleetlens.streaming.segments import EMPTY, Carry, IncidentConfig, SpikeConfig, Stretch, events_in, settled_carry

EVENT = "kind string, onset double, at double, value double, coverage double"
_NAMES = [c.split()[0] for c in EVENT.split(", ")]


def sample_rows(samples: DataFrame) -> DataFrame:
    return samples.select(F.col("instance").cast("string").alias("instance"), "ts", F.unix_timestamp("ts").cast("double").alias("t"), F.col("active").cast("double").alias("active"))


def replayed(samples: DataFrame, spike: SpikeConfig, incident: IncidentConfig | None = None, span_s: int = 86400) -> DataFrame:
    """(instance, kind, onset, at, value, coverage) of all events of stored samples (instance, ts, active).

    A host's history is cut into spans of ``span_s`` seconds (the window at least), each with the window before it, and
    every span is a group of its own, so one host with all the rows is many tasks. A span is first run as if nothing was
    open before it. Where the span before ends with something that matters (an open candidate, an incident, an event
    within the least gap), it is run again with that, all such spans at once, until no span begins otherwise than the one
    before it ends. As states fade within the gap and an incident's length, that takes a round or two; the rounds
    are as many as the spans that one incident lasts.
    """
    if span_s < spike.window_s:
        raise ValueError("a span holds a window at least")
    gap = incident.min_gap_s if incident else spike.min_gap_s
    own = F.floor(F.col("t") / span_s)
    late = F.col("t") - own * span_s >= span_s - spike.window_s  # in the window of the span after
    rows = sample_rows(samples).drop("ts").withColumn("_own", own).withColumn("span", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    rows = settled(rows.withColumn("old", F.col("span") > F.col("_own")).drop("_own"), "spans")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", "active"])
        before = int(frame["old"].sum())
        entry = [float(x) for x in frame["entry"].iloc[0]]
        if before == len(frame):
            return pd.DataFrame(columns=["instance", "span", "entry", "exit", "events"], dtype=object)
        carry = Carry(*entry)
        found = events_in(Stretch(frame["t"].to_numpy(), frame["active"].to_numpy(), before, spike), carry, incident)
        return pd.DataFrame({"instance": [key[0]], "span": [key[1]], "entry": [entry], "exit": [settled_carry(carry, float((key[1] + 1) * span_s), gap)], "events": [[dict(zip(_NAMES, e)) for e in found]]})

    schema = f"instance string, span long, entry array<double>, exit array<double>, events array<struct<{EVENT.replace(' ', ':')}>>".replace(",:", ", ")
    nothing = F.array(*map(F.lit, EMPTY))

    def ran(given: DataFrame) -> DataFrame:
        return given.groupBy("instance", "span").applyInPandas(run, schema)

    done = settled(ran(rows.withColumn("entry", nothing)), "replayed")
    while True:
        behind = F.lag("exit").over(Window.partitionBy("instance").orderBy("span"))
        meant = done.withColumn("_entry", F.coalesce(faded(behind, F.col("span") * span_s, gap), nothing))
        again = settled(meant.where(F.col("_entry") != F.col("entry")).select("instance", "span", F.col("_entry").alias("entry")), "again")
        if again.isEmpty():
            break
        fresh = ran(rows.join(again, ["instance", "span"]))
        done = settled(done.join(again.select("instance", "span"), ["instance", "span"], "left_anti").unionByName(fresh), "replayed")
    return done.select("instance", F.explode("events").alias("e")).select("instance", *(F.col(f"e.{n}") for n in _NAMES))


def faded(carry: Column, at: Column, gap: float) -> Column:
    """A span's exit as a later span sees it: an event that lies the least gap back matters no more."""
    place = list(Carry.__dataclass_fields__).index("last")
    return F.transform(carry, lambda x, i: F.when((i == place) & (at - x >= gap), F.lit(EMPTY[place])).otherwise(x))


class SampleProcessor(StatefulProcessor):
    """A host's samples as they come: the window's samples in a list, the carried numbers in a value, the follow-up in a timer."""

    def __init__(self, spike: SpikeConfig, incident: IncidentConfig | None = None):
        self.spike, self.incident = spike, incident

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getListState("window", "t double, active double")
        self.carry = handle.getValueState("carry", ", ".join(f"{n} double" for n in Carry.__dataclass_fields__))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["t", "active"])
        held = [tuple(r) for r in self.window.get()]
        carry = self._carry()
        due = carry.due
        t, active = (np.array([*(h[i] for h in held), *frame[c]], float) for i, c in enumerate(("t", "active")))
        events = events_in(Stretch(t, active, len(held), self.spike), carry, self.incident)
        kept = t >= t[-1] - self.spike.window_s
        self.window.put(list(zip(t[kept].tolist(), active[kept].tolist())))
        self.carry.update(tuple(carry.numbers()))
        if carry.due != due:
            if due >= 0:
                self.handle.deleteTimer(int(due * 1000))
            if carry.due >= 0:
                self.handle.registerTimer(int(carry.due * 1000))
        yield self._frame(key, events)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """No sample came at the follow-up's time."""
        carry, events = self._carry(), []
        if carry.due >= 0 and int(carry.due * 1000) == expiredTimerInfo.getExpiryTimeInMs():
            last = [r[1] for r in self.window.get()][-1:] or [0.0]
            events.append(("deferred", -1.0, carry.due, last[0], -1.0))
            carry.due = -1.0
            self.carry.update(tuple(carry.numbers()))
        yield self._frame(key, events)

    def close(self) -> None:
        pass

    def _carry(self) -> Carry:
        return Carry(*self.carry.get()) if self.carry.exists() else Carry()

    def _frame(self, key: tuple, events: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *e) for e in events], columns=["instance", *_NAMES]).astype({"onset": float, "at": float, "value": float, "coverage": float})


def streamed(samples: DataFrame, spike: SpikeConfig, incident: IncidentConfig | None = None, late: str = "10 minutes") -> DataFrame:
    """The same events of a stream of samples; late ones fall to the watermark. State is a host's window and a few numbers.

    The session's state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``), which typed state asks for.
    """
    rows = sample_rows(samples.withWatermark("ts", late))
    return rows.groupBy("instance").transformWithStateInPandas(SampleProcessor(spike, incident), f"instance string, {EVENT}", "Append", "EventTime")
