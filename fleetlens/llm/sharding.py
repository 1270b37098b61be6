"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def block_sizes(total: int, shards: int, block: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, rows) of every block: shards differ by one row at most, blocks hold ``block`` at most."""
    out = []
    for s in range(shards):
        size = total // shards + (s < total % shards)
        pieces = max(1, -(-size // block))
        first = 0
        for p in range(pieces):
            n = size // pieces + (p < size % pieces)
            out.append((s, first, n))
            first += n
    return out


#: numpy draws from populations below this size only.
LARGE = 10**9


def large_hypergeometric(dice: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows drawn from good + bad are good, for populations of any size.

    Inversion over the counts within 12 deviations and 60 of the mode, weighed by the exact ratios of neighbouring
    probabilities; what lies outside is less than a double's resolution. Takes about sqrt(good + bad) steps.
    """
    total = good + bad
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    reach = 60 + int(12 * math.sqrt(sample * (good / total) * (bad / total) * ((total - sample) / max(1, total - 1))))
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.int64)  # the ratio of the probabilities of k + 1 and k
    step = np.log(((good - k) / (k + 1)) * ((sample - k) / (bad - sample + k + 1)))
    log = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.cumsum(np.exp(log - log[mode - low]))
    return low + min(high - low, int(np.searchsorted(weight, dice.random() * weight[-1], "right")))


def drawn(dice: np.random.Generator, capacity: np.ndarray, sample: int) -> np.ndarray:
    """Multivariate hypergeometric counts; large populations are halved until numpy takes them."""
    if len(capacity) == 1:
        return np.array([sample], np.int64)
    if int(capacity.sum()) < LARGE:
        return dice.multivariate_hypergeometric(capacity, sample, method="marginals")
    mid = len(capacity) // 2
    left = large_hypergeometric(dice, int(capacity[:mid].sum()), int(capacity[mid:].sum()), sample)
    return np.concatenate([drawn(dice, capacity[:mid], left), drawn(dice, capacity[mid:], sample - left)])


def matrix_row(part: int, counts: np.ndarray, capacity: np.ndarray, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix: how many of its rows go to each block.

    The matrix has the given row and column sums and the law of a uniform shuffle. It is drawn by halving the
    partitions: what the left half sends is multivariate hypergeometric in the capacities, the right half sends the
    rest. Each halving has its own random stream, so a task draws its row alone, without the rest of the matrix.
    """
    lo, hi = 0, len(counts)
    capacity = capacity.astype(np.int64)
    total = np.concatenate([[0], np.cumsum(counts)])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = drawn(np.random.default_rng([seed, lo, hi]), capacity, int(total[mid] - total[lo]))
        lo, hi, capacity = (lo, mid, left) if part < mid else (mid, hi, capacity - left)
    return capacity


def shuffle_into_shards(rows: DataFrame, shards: int = 8, seed: int = 20, block: int = 1 << 16) -> DataFrame:
    """All rows with ``shard`` (0 to shards-1) and ``slot`` (0, 1, ... within the shard, in random order).

    Law ``rows``: shard sizes are at most one apart. Partitions are counted, each task draws its row of the
    communication matrix, permutes its rows locally by dealing them a shuffled list of target blocks, the blocks are
    exchanged, and each block of at most ``block`` rows is permuted again. ``rows`` should be read straight from a
    table: its partitions must be the same in both passes, and a task fails if its count has changed. Repeated rows
    and nulls are rows like any other; an empty table gives none. Columns of rows that are named shard or slot are
    replaced; all others are kept, whatever their names.
    """
    rows = rows.drop("shard", "slot")
    own = rows.columns
    rows = rows.toDF(*(f"c{i}" for i in range(len(own))))  # no name can clash with those below

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], ["part", "n"])

    counted = dict(rows.mapInArrow(tally, "part int, n long").collect())  # a pair for each partition
    counts = np.array([counted.get(p, 0) for p in range(max(counted, default=-1) + 1)], np.int64)
    blocks = block_sizes(int(counts.sum()), shards, block)
    capacity = np.array([n for _, _, n in blocks], np.int64)
    shard_of, first_of = (np.array([b[i] for b in blocks]) for i in (0, 1))
    names = [*rows.columns, "block", "shard", "first", "dice", "at"]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in zip(names[-5:], (T.IntegerType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.LongType())))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        n = int(counts[part]) if part < len(counts) else 0
        targets = np.repeat(np.arange(len(capacity)), matrix_row(part, counts, capacity, seed)) if n else np.zeros(0, np.int64)
        dice = np.random.default_rng([seed, part])
        targets = dice.permutation(targets)
        done = 0
        for b in batches:
            mine = targets[done : done + b.num_rows]
            if len(mine) < b.num_rows:
                raise RuntimeError("the partition has more rows than were counted")
            extra = [pa.array(mine.astype(np.int32)), pa.array(shard_of[mine].astype(np.int32)), pa.array(first_of[mine].astype(np.int64)), pa.array(dice.random(len(mine))), pa.array(np.arange(done, done + len(mine)) + (part << 40))]
            done += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names)
        if done != n:
            raise RuntimeError("the partition has fewer rows than were counted")

    again = Window.partitionBy("block").orderBy("dice", "at")
    placed = rows.mapInArrow(deal, schema).withColumn("slot", F.col("first") + F.row_number().over(again) - 1)
    return placed.select(*(F.col(c).alias(n) for c, n in zip(rows.columns, own)), "shard", "slot")
