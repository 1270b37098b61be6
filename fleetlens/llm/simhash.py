"""SimHash near-duplicates: fingerprints of word shingles, compared bit plane by bit plane."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.blocks import block_tasks, merge_labels, whole_groups
from fleetlens.llm.common import LOWER_TABLE, utf8, written
from fleetlens.llm.components import connected_components

BITS = 64
#: The word is cut into four quarters; two fingerprints that differ in two bits or fewer agree on two whole quarters.
QUARTER = 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, piece: int = 1 << 15) -> int:
    """64-bit SimHash of a text's shingles of ``shingle`` words, repeats included; 0 without words."""
    words = text.translate(LOWER_TABLE).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends)]
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :])]
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(raw), piece):
        counts += np.unpackbits(raw[i : i + piece], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(raw), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, shingle: int = 3, digest: bool = False) -> DataFrame:
    """(doc_id, fp long) of every document; with ``digest`` also the SHA-256 of id and text in hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(1))
            columns = [b.column(0), pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64), pa.int64())]
            if digest:
                columns.append(pa.array([hashlib.sha256(f"{'n' if i is None else i}|".encode() + t).hexdigest() for i, t in zip(b.column(0).to_pylist(), texts)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "digest"][: len(columns)])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, fp long" + (", digest string" if digest else ""))


def near_pairs(fps: np.ndarray, group: np.ndarray, blk: np.ndarray, cross: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group whose fingerprints differ in ``radius`` bits or fewer.

    Bit planes are stored vertically. For each distance k between rows, all pairs (i, i+k) are compared at once: the
    planes are XORed with themselves k rows on, and bitwise carry-save counters add up the differing bits. A block of
    pairs is abandoned once all of its counters exceed the radius. Groups stand in order of falling size, so that the
    pairs for k are a prefix of the rows.
    """
    n = len(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    sizes = np.bincount(group)[group]
    shifted = [np.packbits(bits[:, r:], axis=1) for r in range(min(8, n))]
    block = 1 << 12
    for k in range(1, int(sizes.max(initial=1))):
        last = int(np.searchsorted(-sizes, -k, "left")) - k  # rows of groups with more than k members
        if last <= 0:
            continue
        able = (group[:last] == group[k : k + last]) & (~cross[:last] | (blk[:last] != blk[k : k + last]))
        able = np.packbits(able)
        for at in range(0, len(able), block):
            lanes = able[at : at + block]
            ones, twos, over = np.zeros_like(lanes), np.zeros_like(lanes), ~lanes
            here, there = slice(at, at + len(lanes)), slice(at + k // 8, at + k // 8 + len(lanes))
            for bit in range(BITS):
                other = shifted[k % 8][bit][there]
                diff = shifted[0][bit][here] ^ (other if len(other) == len(lanes) else np.pad(other, (0, len(lanes) - len(other))))
                carry = ones & diff
                ones ^= diff
                over |= twos & carry
                twos ^= carry
                if bit % 4 == 3:
                    gone = over | (ones & twos) if radius == 2 else over | twos if radius == 1 else over
                    if (gone == 0xFF).all():
                        break
            else:
                gone = over | (ones & twos) if radius == 2 else over | twos if radius == 1 else over | twos | ones
                i = np.flatnonzero(np.unpackbits(~gone)) + at * 8
                i = i[i < last]
                if len(i):
                    yield i, i + k


def fingerprint_links(distinct: DataFrame, radius: int = 2, block: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``; a forest with the components of all links within the radius.

    Six tables, one for each two quarters, hold the fingerprints by 32 of their bits. The search is exact for a radius
    of 2 or less.
    """
    if radius not in (0, 1, 2):
        raise ValueError("the tables are exact for a radius of 0, 1 or 2")
    quarter = [F.shiftrightunsigned("fp", QUARTER * q).bitwiseAND(F.lit(0xFFFF)) for q in range(4)]
    tables = [F.struct(F.lit(4 * i + j).alias("t"), (quarter[i] * 65536 + quarter[j]).alias("key")) for i in range(4) for j in range(i + 1, 4)]
    rows = distinct.select("fp", F.explode(F.array(*tables)).alias("s")).select("fp", "s.t", "s.key")
    keys = ["t", "key", "blk_a", "blk_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in whole_groups((b.to_pandas() for b in batches), keys, 1 << 16):
            k = frame[keys].to_numpy()
            group = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])
            size = np.bincount(group)
            order = np.lexsort((group, -size[group]))
            renumber = np.empty(len(size), np.int64)
            renumber[np.argsort(-size, kind="stable")] = np.arange(len(size))
            fps = frame["fp"].to_numpy()[order]
            blk, cross = frame["blk"].to_numpy()[order], (frame["blk_a"] != frame["blk_b"]).to_numpy()[order]
            parent = np.arange(len(fps))
            for i, j in near_pairs(fps, renumber[group[order]], blk, cross, radius):
                merge_labels(parent, i, j)
            linked = np.flatnonzero(parent != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[linked], pa.int64()), pa.array(fps[parent[linked]], pa.int64())], ["a", "b"])

    return block_tasks(rows, ["t", "key"], "fp", block).mapInArrow(run, "a long, b long")


def grouped(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, rep, component_id) of the distinct fingerprints of prints (doc_id, fp): smallest doc_id of the fingerprint and of its group."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fps")
    components = connected_components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(components, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    return named.join(named.groupBy("root").agg(F.min("rep").alias("component_id")), "root")


def simhash_groups(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id reachable. Equal
    fingerprints are compared once, so copies cost nothing. Null or empty texts have the fingerprint zero and link
    like any other; repeated rows each get a row; a null doc_id gets a row too but never names a component; further
    columns are ignored. An empty table gives no rows.
    """
    prints = written(with_fingerprint(docs, shingle), "prints")
    return prints.join(grouped(prints, radius).select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One document of each group, with its own columns: the smallest doc_id, then the first SHA-256 of id and text.

    A document is judged by its own fingerprint, so unlike texts under one doc_id are each kept or dropped with their
    own group. Ids come before null; of rows with equal id and text the one stays whose
    other columns come first as JSON. Null and empty texts form one group. An
    empty table gives no rows; further columns are carried, whatever their names.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    mine = docs.toDF(*names).withColumnsRenamed({names[docs.columns.index(c)]: c for c in ("doc_id", "text")})
    prints = written(with_fingerprint(mine, shingle, digest=True), "prints")
    groups = grouped(prints, radius).select("fp", "root")
    # The first document of each fingerprint, then of each group: no group is gathered in one place.
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "digest")
    first = prints.groupBy("fp").agg(F.min(order).alias("first")).join(groups, "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = first.select(F.col("first.digest").alias("_d"))
    named = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("n"))
    marked = mine.withColumn("_d", F.sha2(F.concat(named, F.lit("|"), F.coalesce(F.col("text").cast("string"), F.lit(""))), 256))
    others = [c for c in mine.columns if c not in ("doc_id", "text")]
    every = F.struct(*mine.columns)
    one = F.min_by(every, F.to_json(F.struct(*others))) if others else F.first(every)
    # Equal rows are combined before the shuffle, which the join then needs no more.
    kept = marked.groupBy("_d").agg(one.alias("one")).join(chosen, "_d", "left_semi")
    return kept.select(*(F.col(f"one.{c}").alias(n) for c, n in zip(mine.columns, docs.columns)))
