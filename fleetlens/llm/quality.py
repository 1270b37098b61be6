"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import held_out, training_rows, utf8, words_of, written

WORD_BITS = 14
STEPS = 9  # knots of each statistic
STATISTICS = 14
#: Numeric columns of the documents that are inputs beside the text, where they exist.
METADATA = ("n_chars",)
DIMENSIONS = (1 << WORD_BITS) + (STATISTICS + len(METADATA)) * STEPS
RANK = 6
SAMPLE = 8000
SAMPLE_VALUES = 8_000_000
TOGETHER = 32  # rows scored at once
_CLASS = np.zeros(256, np.int64)  # 0 other bytes, 1 letters a-z, 2 A-Z, 3 digits, 4 spaces, 5 line ends, 6 sentence marks, 7 symbols
for _chars, _kind in ((range(0x21, 0x7F), 7), (b".,;:!?'\"()-", 6), (range(0x61, 0x7B), 1), (range(0x41, 0x5B), 2), (range(0x30, 0x3A), 3), (b" \t", 4), (b"\r\n", 5)):
    _CLASS[list(_chars)] = _kind


def statistics(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Structure statistics, each scaled to 0..1."""
    n, m = max(1, len(text)), max(1, len(words))
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 8) / n
    lines = text.split(b"\n")
    again = sum(map(eq, words, words[1:])) / m
    return [
        math.log2(1 + len(text)) / 24, math.log2(1 + len(words)) / 20, min(1.0, sum(map(len, words)) / m / 16), distinct / m,
        *(math.sqrt(k) for k in kinds[[0, 2, 3, 4, 5, 6, 7]]), math.sqrt(again), math.sqrt(1 - len(set(lines)) / len(lines)), min(1.0, m / len(lines) / 256),
    ]


def features(text: bytes, metadata: Sequence[float | None], crc: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a whole text and its metadata.

    Its distinct words, hashed, have equal weights of norm 1. A statistic, and log2 of a metadata number, lies between
    two of its knots and gives each a weight by its distance; null metadata give nothing.
    """
    words = words_of(text)
    seen = set(words)
    if len(crc) > 75_000:
        crc.clear()
    mask = (1 << WORD_BITS) - 1
    hashed = []
    for w in seen:
        if (h := crc.get(w)) is None:
            h = crc[w] = zlib.crc32(w) & mask
        hashed.append(h)
    numbers = statistics(text, words, len(seen)) + [None if x is None or x != x else math.log2(1 + max(0.0, x)) / 24 for x in metadata]
    value = np.full(len(hashed) + 2 * len(numbers), 1 / math.sqrt(max(1, len(seen))))
    at = len(hashed)
    for i, x in enumerate(numbers):
        place = 0.0 if x is None else min(1.0, x) * (STEPS - 1)
        low = min(STEPS - 2, int(place))
        hashed += (mask + 1 + i * STEPS + low, mask + 2 + i * STEPS + low)
        value[at : at + 2] = (0.0, 0.0) if x is None else (low + 1 - place, place - low)
        at += 2
    return np.array(hashed, np.int64), value


class FactorisationMachine:
    """bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, the pairs in linear time as (square of sum - sum of squares) / 2."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(self.logits([(index, value)])[0])

    def logits(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of many rows at once; each has a feature at least."""
        if not rows:
            return np.zeros(0)
        start = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        index, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
        xv = self.v[index] * value[:, None]
        total = np.add.reduceat(xv, start)
        return self.bias + np.add.reduceat(self.w[index] * value, start) + 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((xv * xv).sum(axis=1), start))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, times: np.ndarray | None = None, rank: int = RANK, epochs: int = 8, steps: int = 300, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, seed: int = 6) -> FactorisationMachine:
        """Logistic loss by Adagrad over small batches, so that memory is bounded by a batch; ``epochs``, but ``steps`` batches at least.

        A row counts ``times``. Without rows of both kinds: the share of ones (one half without rows).
        """
        dice = np.random.default_rng(seed)
        times = np.ones(len(y)) if times is None else times
        share = (times @ y + 0.5) / (times.sum() + 1)
        bias = math.log(share / (1 - share))
        theta = np.zeros((DIMENSIONS, rank + 1))  # w, then v
        if len(y) == 0 or y.min() == y.max():
            return cls(bias, theta[:, 0], theta[:, 1:])
        theta[:, 1:] = dice.normal(0, 0.02, (DIMENSIONS, rank))
        square, square_bias = np.full_like(theta, 1e-4), 1e-4
        met = np.zeros(DIMENSIONS, bool)
        for _ in range(max(epochs, -(-steps * batch // max(batch, len(rows))))):
            order = dice.permutation(len(rows))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                count = np.array([len(rows[i][0]) for i in own])
                start = np.cumsum(count) - count
                index, x = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])[:, None]
                xt = theta[index] * x
                sums = np.add.reduceat(xt, start)
                pairs = 0.5 * ((sums[:, 1:] ** 2).sum(1) - np.add.reduceat((xt[:, 1:] ** 2).sum(1), start))
                error = (1 / (1 + np.exp(-np.clip(bias + sums[:, 0] + pairs, -30, 30))) - y[own]) * times[own] / times[own].sum()
                inner = np.repeat(sums, count, axis=0) - xt
                inner[:, 0] = 1
                inner *= np.repeat(error, count)[:, None] * x
                by = np.argsort(index, kind="stable")
                used, first = np.unique(index[by], return_index=True)
                met[used] = True
                grad = np.add.reduceat(inner[by], first) + decay * theta[used]
                square[used] += grad**2
                theta[used] -= rate * grad / np.sqrt(square[used])
                g = error.sum()
                square_bias += g * g
                bias -= rate * g / math.sqrt(square_bias)
        theta[~met] = 0
        return cls(bias, theta[:, 0].copy(), theta[:, 1:].copy())


def _inputs(docs: DataFrame) -> list[Column]:
    """The text and the metadata as doubles; null where a column is missing."""
    have = {c.lower() for c in docs.columns}
    return [F.col("text").cast("string").alias("_text"), *((F.col(m) if m in have else F.lit(None)).cast("double").alias(f"_m{i}") for i, m in enumerate(METADATA))]


def _rows(b: pa.RecordBatch, at: int, crc: dict[bytes, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    metadata = list(zip(*(b.column(at + 1 + i).to_pylist() for i in range(len(METADATA)))))
    return (features(t, m, crc) for t, m in zip(utf8(b.column(at)), metadata))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, sample_values: int = SAMPLE_VALUES) -> FactorisationMachine:
    """Fit on labelled training rows, at most ``sample``, and at most ``sample_values`` feature values of them.

    Features come from whole texts; which rows make up the sample depends on hashes alone. Rows with equal features and
    label are one that counts as often as they occur; one too large for what is left of ``sample_values`` is passed over,
    smaller ones behind it are not. Null and empty texts are rows like others; without labels or documents the score is
    the share of ones (one half).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc: dict[bytes, int] = {}
        for b in batches:
            rows = list(_rows(b, 1, crc))
            columns = [b.column(0), pa.array([len(i) for i, _ in rows], pa.int64()), pa.array([i.astype("<i4").tobytes() for i, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["y", "n", "index", "value"])

    picked = training_rows(docs.select("doc_id", F.struct(*_inputs(docs)).alias("text")), labels, label, sample).select("y", "text.*")
    made = picked.mapInArrow(run, "y double, n long, index binary, value binary").withColumn("h", F.xxhash64("index", "value", "y"))
    made = written(made.groupBy("h").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("y", "n", "index", "value"))), "features")
    held, taken = 0, []
    for h, n in made.orderBy("h").limit(sample).select("h", "n").collect():  # at most ``sample`` rows
        if held + n <= sample_values:
            held += n
            taken.append((h,))
    got = made.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "h long")), "h").select("y", "times", "index", "value").toArrow()
    rows = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for i, v in zip(got.column("index").to_pylist(), got.column("value").to_pylist())]
    y, times = (np.array(got.column(c).to_pylist(), float) for c in ("y", "times"))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0].tobytes(), rows[i][1].tobytes(), y[i]))  # tasks may end in any order
    return FactorisationMachine.fit([rows[i] for i in order], y[order], times[order])


def _scored(docs: DataFrame, names: list[str], model: FactorisationMachine, threshold: float) -> DataFrame:
    """The columns ``names`` as c0, c1, ..., which clash with nothing, and score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS * (RANK + 1) numbers
    inner = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([*(T.StructField(i, docs.schema[c].dataType) for i, c in zip(inner, names)), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc: dict[bytes, int] = {}
        for b in batches:
            rows = _rows(b, len(names), crc)
            logits = [shared.value.logits(some) for some in iter(lambda: list(islice(rows, TOGETHER)), [])]
            score = 1 / (1 + np.exp(-np.clip(np.concatenate([*logits, np.zeros(0)]), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema.names)

    return docs.select(*(F.col(c).alias(i) for i, c in zip(inner, names)), *_inputs(docs)).mapInArrow(run, schema)


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: all of ``docs``) and score, predicted.

    Null and empty texts are scored by their (empty) features; repeated rows and null ids get a row each; an empty table
    gives no rows; lang, source, doc_id and labels are never read. Columns named score or predicted are replaced.
    """
    names = [c for c in carry or docs.columns if c.lower() not in ("score", "predicted")]
    return _scored(docs, names, model, threshold).withColumnsRenamed({f"c{i}": n for i, n in enumerate(names)})


def keep_good(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, with their own columns, whatever their names; odd input as above."""
    good = _scored(docs, docs.columns, model, threshold).where("predicted = 1")
    return good.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)))


def score_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by a model trained on ``labels``; odd input as in its two parts."""
    model = train_quality(docs, labels)
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return score_quality(marked, model, carry=["doc_id", "held_out"])
