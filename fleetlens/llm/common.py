"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes that are not part of a word become spaces, A-Z become a-z; bytes from 0x80 on are parts of words.
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
WORD_TABLE = bytes(c if (c := _UPPER.get(b, b)) in _WORD_BYTES else 0x20 for b in range(256))
LOWER_TABLE = bytes(_UPPER.get(b, b) for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return text.translate(WORD_TABLE).split()


def utf8(column) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def joined(batches: Iterator[pa.RecordBatch], column: int, most: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches put together until they hold about ``most`` bytes of text; what is shared within one is done once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        n = pc.sum(pc.binary_length(b.column(column))).as_py() or 0
        if held and size + n > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.concat_batches(held)


def distinct_pieces(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at each single space: (distinct pieces, number of each piece in order, where each text begins)."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), first.astype(np.int64)


def spell_out(parts: Sequence[bytes], number: np.ndarray, first: np.ndarray, kind: str) -> list[bytes]:
    """For each text the parts with its numbers, joined; ``kind`` is the parts' item type."""
    blob = np.frombuffer(b"".join(parts), kind)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize
    start = np.cumsum(size) - size
    length = size[number]
    end = np.cumsum(length)
    kind_of = np.int32 if len(blob) + end[-1:].sum() < 1 << 31 else np.int64
    source = np.repeat((start[number] - (end - length)).astype(kind_of), length)
    source += np.arange(len(source), dtype=kind_of)
    edge = np.concatenate([[0], end])[first] * np.dtype(kind).itemsize
    raw = blob[source].tobytes()
    return [raw[a:b] for a, b in zip(edge.tolist(), edge[1:].tolist())]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where no folder is named, as in tests."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_training(doc_id: Column) -> Column:
    """True for rows whose label may be learnt: crc32 of the id as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, y) of at most ``bound`` labelled training rows, picked by a hash of the id.

    Only the ids and labels of the sample are broadcast, at most ``bound`` rows. A doc_id with several labels takes
    their mean; repeated documents appear as often as they occur.
    """
    picked = (
        labels.where(in_training(F.col("doc_id")) & F.col(label).isNotNull())
        .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y")
