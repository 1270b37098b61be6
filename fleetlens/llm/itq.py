"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking with the vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.blocks import block_tasks, merge_labels, whole_groups
from fleetlens.llm.common import written
from fleetlens.llm.components import connected_components

SAMPLE = 4096
CODE = 128  # bits of a code, two 64-bit words
#: log2 of the members that a bucket of evenly spread vectors has.
MEMBERS = 9
MOST_TABLES = 256
TILE = 1024


def learn_projection(vectors: np.ndarray, rounds: int = 25, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix): principal axes, then rotations under which signs lie close to the vectors, so that codes are balanced.

    Each rotation gives as many bits as there are axes (CODE at most) and starts from another random one, until there
    are CODE bits.
    """
    mean = vectors.mean(axis=0)
    x = vectors - mean
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :CODE]
    v = x @ axes
    d = axes.shape[1]
    out = []
    for k in range(-(-CODE // d)):
        r = np.linalg.qr(np.random.default_rng([seed, k]).normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, np.concatenate(out, axis=1)[:, :CODE]


def pairs_at(vectors: np.ndarray, threshold: float, pairs: int = 4096, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors whose cosine is just ``threshold``: sampled ones, moved in any direction, and in directions between sampled ones."""
    dice = np.random.default_rng(seed)
    cosine = min(1.0, max(-1.0, threshold))
    x = vectors[dice.integers(0, len(vectors), pairs)]
    out = []
    for way in (dice.normal(size=x.shape), vectors[dice.integers(0, len(vectors), pairs)] - vectors[dice.integers(0, len(vectors), pairs)]):
        way = way - (way * x).sum(axis=1, keepdims=True) * x
        length = np.sqrt((way * way).sum(axis=1))
        some = length > 1e-6
        if some.any():
            out.append((x[some], cosine * x[some] + math.sqrt(1 - cosine * cosine) * way[some] / length[some, None]))
    return out or [(x, x)]


@dataclass
class Index:
    """What is learnt for the vectors of one length; ``tables`` holds the code bits that make each table's key."""

    mean: np.ndarray
    matrix: np.ndarray
    tables: np.ndarray
    radius: int

    def signs(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.matrix >= 0

    def masks(self) -> np.ndarray:
        """(tables, 2) words with a table's bits set."""
        bits = np.zeros((len(self.tables), CODE), bool)
        np.put_along_axis(bits, self.tables, True, axis=1)
        return words_of_code(bits)

    def key(self, signs: np.ndarray, table: int) -> np.ndarray:
        own = self.tables[table]
        return (signs[:, own] @ (1 << np.arange(len(own), dtype=np.int64))) + (table << 48)


def words_of_code(signs: np.ndarray) -> np.ndarray:
    return np.packbits(signs, axis=1, bitorder="little").view("<u8")


def learn_index(vectors: np.ndarray, n: int, threshold: float, miss: float = 0.04, seed: int = 7) -> Index:
    """An index for ``n`` vectors, from a sample of unit vectors.

    Keys have log2(n) - MEMBERS bits, so that buckets stay as large as they are when the table grows; each table's key
    takes its bits at random from the code. What a set of tables and the Hamming radius miss is measured on pairs made
    at just the threshold (see ``pairs_at``; the worse sort counts) from that half of the sample that the rotations
    haven't seen, and tables are added until it is ``miss`` at most.
    If MOST_TABLES don't do, keys get shorter; without bits all vectors share a bucket, so recall never depends on n.
    """
    mean, matrix = learn_projection(vectors[::2])
    index = Index(mean, matrix, np.zeros((1, 0), np.int64), CODE)
    differ = [index.signs(a) != index.signs(b) for a, b in pairs_at(vectors[1::2] if len(vectors) > 1 else vectors, threshold)]
    index.radius = int(max(np.quantile(d.sum(axis=1), 0.998) for d in differ))
    for bits in range(max(0, round(math.log2(max(1, n))) - MEMBERS), -1, -1):
        dice = np.random.default_rng([seed, bits])
        missed, tables = [np.ones(len(d), bool) for d in differ], []
        while len(tables) < MOST_TABLES:
            tables.append(dice.permutation(CODE)[:bits])
            missed = [m & d[:, tables[-1]].any(axis=1) for m, d in zip(missed, differ)]
            if max((m | (d.sum(axis=1) > index.radius)).mean() for m, d in zip(missed, differ)) <= miss:
                index.tables = np.array(tables, np.int64).reshape(len(tables), bits)
                return index
    return index


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def candidates(code: np.ndarray, blk: np.ndarray, cross: bool, index: Index, masks: np.ndarray, table: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of one bucket within the Hamming radius that share no earlier table's key, in pieces of bounded size.

    ``cross``: the members are of two blocks and only pairs between them count.
    """
    n = len(code)
    for i0 in range(0, n, TILE):
        for j0 in range(i0, n, TILE):
            a, b = code[i0 : i0 + TILE], code[j0 : j0 + TILE]
            far = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]) + np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
            i, j = np.nonzero(far <= index.radius)
            i, j = i + i0, j + j0
            fit = i < j
            if cross:
                fit &= blk[i] != blk[j]
            i, j = i[fit], j[fit]
            if table and len(i):
                differ = code[i] ^ code[j]
                fresh = np.ones(len(i), bool)
                for m in masks[:table]:
                    fresh &= (differ & m).any(axis=1)
                i, j = i[fresh], j[fresh]
            if len(i):
                yield i, j


TASK = ["dim", "key", "blk_a", "blk_b"]


def _groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, list[tuple[int, int, tuple[int, int, int, int]]]]]:
    """Frames of whole buckets with their codes and (first row, end, task) of each bucket of two members or more."""
    for frame in whole_groups((b.to_pandas() for b in batches), TASK, rows):
        k = frame[TASK].to_numpy()
        edge = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]])
        code = frame[["c0", "c1"]].to_numpy().view(np.uint64)
        yield frame, code, [(lo, hi, tuple(k[lo].tolist())) for lo, hi in zip(edge.tolist(), edge[1:].tolist()) if hi - lo > 1]


def embedding_groups(vectors: DataFrame, threshold: float = 0.9, sample: int = SAMPLE, block: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    Equal vectors are compared once and counted with their number. For each length of vectors an index is learnt on at
    most ``sample`` distinct ones (picked by hash); all vectors are coded and entered in every table (see
    ``learn_index``), as node and code, without the vector. Members of a bucket within the Hamming radius are
    candidates; only those that have one fetch their vectors and are compared by cosine in double precision. A pair
    that meets in several tables counts in the first. Large buckets are cut into blocks, and tasks return counts and a
    forest of links, never pairs. Links are never false; recall is 0.95 or more of pairs just at the threshold.

    Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors link with
    those of their own length only. Repeated rows count as separate vectors; a null vec_id gets a row, is counted, and
    never names a component. An empty table gives no rows; further columns are ignored.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    value = F.col("embedding").cast(f"array<{kind}>")
    good = value.isNotNull() & (F.size(value) > 0) & F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(value, lambda x: x != 0)
    zero = F.lit(0).cast(kind)  # adding it makes -0 and 0 equal
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.transform(value, lambda x: x + zero)).alias("v"))
    distinct = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = sorted(distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect())  # a pair for each length
    learnt = {}
    for dim, n in sizes:
        picked = distinct.where(F.size("v") == dim).orderBy(F.xxhash64("v"), "node").limit(sample).select("v").toArrow().column("v").combine_chunks()
        learnt[dim] = learn_index(_unit(_matrix(picked, dim)), n, threshold)
    shared = distinct.sparkSession.sparkContext.broadcast(learnt)  # CODE numbers for each axis of each length

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(0).value_lengths().to_numpy()
            for dim in np.unique(length).tolist():
                own = b.filter(pa.array(length == dim))
                index = shared.value[dim]
                signs = index.signs(_unit(_matrix(own.column(0), dim)))
                code = words_of_code(signs).view(np.int64)
                for t in range(len(index.tables)):
                    columns = [np.full(len(code), dim, np.int32), index.key(signs, t), None, code[:, 0], code[:, 1]]
                    yield pa.RecordBatch.from_arrays([own.column(1) if c is None else pa.array(c) for c in columns], ["dim", "key", "node", "c0", "c1"])

    entries = distinct.select("v", "node").mapInArrow(enter, "dim int, key long, node long, c0 long, c1 long")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*TASK, "blk", "node", "c0", "c1"]
        masks = {dim: i.masks() for dim, i in shared.value.items()}
        for frame, code, groups in _groups(batches, 1 << 16):
            some = np.zeros(len(frame), bool)
            blk = frame["blk"].to_numpy()
            for lo, hi, (dim, key, a, b) in groups:
                for i, j in candidates(code[lo:hi], blk[lo:hi], a != b, shared.value[dim], masks[dim], key >> 48):
                    some[lo + i] = some[lo + j] = True
            yield pa.RecordBatch.from_pandas(frame.loc[some, names], preserve_index=False)

    task = "dim int, key long, blk_a int, blk_b int, blk int, node long, c0 long, c1 long"
    chosen = block_tasks(entries, ["dim", "key"], "node", block).mapInArrow(choose, task)
    fetched = chosen.join(distinct.select("node", "v", "copies"), "node").repartition(*TASK).sortWithinPartitions(*TASK)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {dim: i.masks() for dim, i in shared.value.items()}
        for frame, code, groups in _groups(batches, 1 << 12):
            node, copies, blk = (frame[c].to_numpy() for c in ("node", "copies", "blk"))
            links, parent = np.zeros(len(frame), np.int64), np.arange(len(frame))
            for lo, hi, (dim, key, a, b) in groups:
                x = _unit(np.stack(frame["v"].to_numpy()[lo:hi]).astype(np.float64))
                for i, j in candidates(code[lo:hi], blk[lo:hi], a != b, shared.value[dim], masks[dim], key >> 48):
                    i0, j0 = int(i[0]) // TILE * TILE, int(j[0]) // TILE * TILE
                    if 20 * len(i) > min(TILE, hi - lo) ** 2:
                        near = (x[i0 : i0 + TILE] @ x[j0 : j0 + TILE].T)[i - i0, j - j0] >= threshold
                    else:
                        step = max(1, (1 << 20) // dim)
                        near = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + step]], x[j[s : s + step]]) for s in range(0, len(i), step)]) >= threshold
                    i, j = i[near] + lo, j[near] + lo
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    merge_labels(parent, i, j)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[parent[some]])], ["node", "links", "root"])

    found = written(fetched.mapInArrow(compare, "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "_node")
    ids = distinct.select("node", "rep", "copies")
    named = ids.join(links, "node", "left").join(components, F.col("node") == F.col("_node"), "left").select("node", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("node", "rep", "copies", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id")
    # A vector that stands once is its row; only rows of the others look theirs up by its value.
    once = named.where("copies = 1").select(F.col("rep").alias("vec_id"), "n_links", "component_id")
    others = named.where("copies > 1").join(distinct.where("copies > 1").select("node", "v"), "node").select("v", "n_links", "component_id")
    again = rows.where("v is not null").join(others, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return once.unionByName(again).unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
