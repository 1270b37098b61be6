"""Comparing the members of buckets in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import written


#: Sizes of large buckets are broadcast up to this number of buckets.
FEW = 100_000


def block_tasks(rows: DataFrame, keys: list[str], ident: str, block: int) -> DataFrame:
    """Rows of buckets dealt into tasks (keys, blk_a, blk_b), a shuffle of the rows.

    A bucket of up to ``block`` rows is one task; a larger one is cut into blocks by a hash of ``ident`` and each two
    blocks meet in one task, so no task holds more than about 2 * block rows, however large its bucket is. ``blk`` is
    the row's own block. Only large buckets are looked up; their sizes are broadcast if they are FEW, joined otherwise.
    """
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    large = written(large.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_blocks")), "large")
    dealt = (
        rows.join(F.broadcast(large) if large.count() <= FEW else large, keys, "left")
        .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        .withColumn("blk", F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("blk_a", F.least("blk", "_other")).withColumn("blk_b", F.greatest("blk", "_other"))
        .drop("_blocks", "_other")
    )
    order = [*keys, "blk_a", "blk_b"]
    return dealt.repartition(*order).sortWithinPartitions(*order)


def merge_labels(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] in ``parent`` (flat: each entry is its set's smallest member)."""
    while len(a):
        x, y = parent[a], parent[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def whole_groups(batches: Iterator, keys: list[str], rows: int) -> Iterator:
    """Pandas frames of at least ``rows`` rows (but the last), cut only where ``keys`` change; the input is sorted."""
    import pandas as pd

    held: list = []
    count = 0
    for batch in batches:
        frame = batch if isinstance(batch, pd.DataFrame) else batch.to_pandas()
        if not len(frame):
            continue
        held.append(frame)
        count += len(frame)
        if count < rows:
            continue
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        k = frame[keys].to_numpy()
        change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
        if len(change):
            cut = change[-1] + 1
            yield frame.iloc[:cut].reset_index(drop=True)
            frame = frame.iloc[cut:].reset_index(drop=True)
        held, count = [frame], len(frame)
        if not len(change):
            rows = max(rows, 2 * count)  # one group so far: wait for its end
    if held:
        yield pd.concat(held, ignore_index=True)
