"""Greedy choices along a group's time, for groups of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.store import settled
from fleetlens.functions.windows import running_last


def _chained(frame: pd.DataFrame, key: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows of a partition by key and time, and for each the place of its key's first row not before its ``until``, len(frame) where there is none."""
    frame = frame.assign(_g=frame.groupby(key, dropna=False, sort=False).ngroup()).sort_values(["_g", "t"], ignore_index=True)
    g, t = frame["_g"].to_numpy(), frame["t"].to_numpy()
    low, n = t.min(), len(frame)
    span = t.max() - low + 2  # keys follow each other on one line
    sought = np.maximum(np.searchsorted(g * span + (t - low), g * span + np.clip(frame["until"].to_numpy() - low, 0, span - 1), "left"), np.arange(1, n + 1))
    return frame, np.where(np.append(g, -1)[sought] == g, sought, n)


def greedy(events: DataFrame, key: list[str]) -> DataFrame:
    """(key, t) of the events taken from (key, t, until), whole numbers, t distinct in a key: the first, and after each the first one not before its ``until``.

    Events lie in range partitions by key and time, so a key may span many. In each partition every event learns the last
    one that its own chain takes there, by pointer doubling; the first event at or behind that one's ``until`` is where
    the chain enters another partition. Chains that meet are one, so few such entries remain; those that the
    first event of a key reaches are found in log2 of its partitions rounds, and each partition walks on from its entry.
    """
    kind = {c: events.schema[c].dataType.simpleString() for c in [*key, "t"]}
    keys = ", ".join(f"{c} {kind[c]}" for c in key)
    ranged = settled(events.select(*key, "t", "until").repartitionByRange(*key, "t").withColumn("_p", F.spark_partition_id()), "ranged")

    def leave(frame: pd.DataFrame) -> pd.DataFrame:
        frame, hop = _chained(frame, key)
        n = len(frame)
        hop, last = np.append(hop, n), np.append(np.arange(n), n)
        while (hop[:n] < n).any():
            last = np.where(hop < n, last[hop], last)
            hop = hop[hop]
        return frame[[*key, "t", "_p"]].assign(beyond=frame["until"].to_numpy()[last[:n]])

    wide = ranged.groupBy(*key).agg(F.count_distinct("_p").alias("_n"), F.min("t").alias("t"))
    starts = settled(wide.select(*key, "t", (F.col("_n") > 1).alias("_wide")), "starts")
    reached = starts.select(*key, "t")
    if not starts.where("_wide").isEmpty():
        own = ranged.join(starts.where("_wide").select(*key), key, "left_semi")
        left = settled(own.groupBy("_p").applyInPandas(leave, f"{keys}, t {kind['t']}, _p int, beyond {kind['t']}"), "left")
        # where each distinct exit goes on: the first event at or behind it, which is the last one met when time runs backwards
        asked = left.select(*key, F.col("beyond").alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast(kind["t"]).alias("_t")).distinct()
        there = own.select(*key, F.col("t").alias("_at"), F.lit(0).alias("_ask"), F.col("t").alias("_t"))
        back = there.unionByName(asked).withColumn("_back", -F.col("_at"))
        entry = running_last(back, key, ["_back", "_ask"], "_t", "entry").where("_ask = 1").select(*key, F.col("_at").alias("beyond"), "entry")
        hops = settled(left.join(entry.where("entry is not null"), [*key, "beyond"]).select(*key, "t", F.col("entry").alias("to")), "hops")
        nodes = hops.select(*key, F.col("to").alias("t")).distinct().unionByName(starts.where("_wide").select(*key, "t")).distinct()
        hops = settled(hops.join(nodes, [*key, "t"], "left_semi"), "hops")
        reached = settled(reached, "reached")
        while not hops.isEmpty():
            reached = settled(reached.unionByName(reached.join(hops, [*key, "t"]).select(*key, F.col("to").alias("t"))).distinct(), "reached")
            on = hops.select(*key, F.col("t").alias("to"), F.col("to").alias("_on"))
            hops = settled(hops.join(on, [*key, "to"]).select(*key, "t", F.col("_on").alias("to")), "hops")
    entries = ranged.join(reached, [*key, "t"]).select(*key, "_p", F.col("t").alias("_entry"))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame, hop = _chained(frame, key)
        at, taken = np.flatnonzero(frame["t"].to_numpy() == frame["_entry"].to_numpy()), []
        while len(at):  # a place for each key
            taken.append(at)
            at = hop[at]
            at = at[at < len(hop)]
        return frame[[*key, "t"]].iloc[np.concatenate(taken)]

    return ranged.join(entries, [*key, "_p"]).groupBy("_p").applyInPandas(walk, f"{keys}, t {kind['t']}")
