"""Language-model scores by a log-bilinear neural model, trained with noise-contrastive estimation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import LOWER_TABLE, by_bytes, utf8, written

#: Fixed values of the base score: what is added to each count, and once more for all words never met.
PRIOR = 0.1
#: Ends a text; no word holds white space.
END = "\n"
CLASS = 64  # outcomes of a class
OUTCOMES = 64 * CLASS  # most outcomes of the model: END, all other words together, and the most frequent words
LEXICON = 1 << 16  # most words whose counts tasks hold; those of all others are joined
CONTEXT, RANK = 3, 16
END_ID, OTHER = 0, 1
#: Noise samples for each batch among the classes, and among the words of each class.
NOISE = 24
BATCH = 16384
RATE = 0.03
AT_ONCE = 4096  # contexts scored by one matrix product
#: Training tokens of a task, rounds of training, and least number of batches that a round takes.
TASK_TOKENS, ROUNDS, STEPS = 8_000_000, 3, 40


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_TABLE).split()


def count_tokens(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word, n) over all texts; END stands once for each. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for b in batches:
            for part in by_bytes(b, 0):
                for text in utf8(part.column(0)):
                    counts.update(tokens_of(text))
                counts[END.encode()] += part.num_rows
                if len(counts) > flush:
                    yield out()
        if counts:
            yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The most frequent words and their counts, ``most`` at most, those of one step of the logarithm all or none; most frequent first."""
    stepped = counts.where(F.col("word") != END).withColumn("step", F.floor(8 * F.log2("n")).cast("int"))
    least, held = 1 << 30, 0
    for step, n in sorted(stepped.groupBy("step").agg(F.count("*")).collect(), reverse=True):  # some hundreds of steps
        if held + n > most:
            break
        least, held = step, held + n
    return sorted(((r[0], r[1]) for r in stepped.where(F.col("step") >= least).select("word", "n").collect()), key=lambda r: (-r[1], r[0]))


def _log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of each row's share at its place, normalised over the row."""
    x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return own - np.log(x.sum(axis=1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sums of their rows."""
    by = np.argsort(index.astype(np.uint16), kind="stable")
    index = index[by]
    first = np.flatnonzero(np.concatenate([[True], np.diff(index) != 0]))
    return index[first], np.add.reduceat(rows[by], first)


class LogBilinear:
    """p(w | the CONTEXT tokens before) from sum_j r(w_j) C_j, by an inner product with the outcome's vector and its bias.

    Outcomes are dealt into classes of CLASS; p is the class's share among all times the outcome's within its class, each
    normalised exactly. ``share`` are the outcomes' shares in training: noise is drawn by them, and biases start with
    their logarithms, so an untrained model is the unigram model.
    """

    def __init__(self, share: np.ndarray, seed: int = 13):
        self.size, self.classes = len(share), -(-len(share) // CLASS)
        dice = np.random.default_rng(seed)
        padded = np.zeros(self.classes * CLASS)
        padded[: self.size] = share
        by_class = padded.reshape(-1, CLASS)
        self.p_class = by_class.sum(axis=1)
        self.p_class /= self.p_class.sum()
        self.p_word = by_class / np.maximum(by_class.sum(axis=1, keepdims=True), 1e-30)
        self.log_class, self.log_word = (np.log(np.maximum(p, 1e-30)).astype(np.float32) for p in (self.p_class, self.p_word.ravel()))
        f = np.float32
        #: vectors of words before (the last one stands before a text), context matrices, outcomes, classes; biases are last
        self.parts: dict[str, np.ndarray] = {
            "before": dice.normal(0, 0.1, (self.size + 1, RANK)).astype(f),
            "context": np.concatenate([np.eye(RANK) / (j + 1) for j in range(CONTEXT)]).astype(f),
            "word": np.concatenate([dice.normal(0, 0.1, (self.classes * CLASS, RANK)), self.log_word[:, None]], axis=1).astype(f),
            "class": np.concatenate([dice.normal(0, 0.1, (self.classes, RANK)), self.log_class[:, None]], axis=1).astype(f),
        }
        #: sums of squared gradients of each row
        self.square = {k: np.full(len(v), 1.0, f) for k, v in self.parts.items()}

    def contexts(self, stream: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.stack([stream[place - 1 - j] for j in range(CONTEXT)])

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms; ``context`` has a row for each distance. Targets are taken class by class, as matrix products."""
        tables = [self.parts["before"] @ self.parts["context"][j * RANK : (j + 1) * RANK] for j in range(CONTEXT)]
        out = np.empty(len(target), np.float64)
        by = np.argsort(target.astype(np.uint16), kind="stable")
        target = target[by]
        q = tables[0][context[0][by]]
        for j in range(1, CONTEXT):
            q += tables[j][context[j][by]]
        kind = target // CLASS
        classes, words = self.parts["class"], self.parts["word"]
        own = np.empty(len(target))
        for at in range(0, len(target), AT_ONCE):
            to = min(at + AT_ONCE, len(target))
            own[at:to] = _log_share(q[at:to] @ classes[:, :RANK].T + classes[:, RANK], kind[at:to])
        edge = np.searchsorted(kind, np.arange(self.classes + 1))
        for c in np.unique(kind).tolist():
            low, high = c * CLASS, min(self.size, (c + 1) * CLASS)
            for at in range(edge[c], edge[c + 1], AT_ONCE):
                to = min(at + AT_ONCE, edge[c + 1])
                own[at:to] += _log_share(q[at:to] @ words[low:high, :RANK].T + words[low:high, RANK], target[at:to] - low)
        out[by] = own
        return out


class Trainer:
    """Noise-contrastive estimation by Adagrad over batches; the state of one task. ``square`` goes from round to round."""

    def __init__(self, model: LogBilinear, seed: int, rate: float = RATE):
        self.model, self.rate = model, rate
        self.dice = np.random.default_rng(seed)
        self.parts = {k: v.copy() for k, v in model.parts.items()}
        self.square = {k: v.copy() for k, v in model.square.items()}
        self.met = {k: np.zeros(len(v), np.int64) for k, v in self.parts.items()}
        self.class_edge, self.word_edge = np.cumsum(model.p_class), np.cumsum(model.p_word, axis=1)

    def _move(self, part: str, index: np.ndarray, grad: np.ndarray) -> None:
        square = self.square[part][index] + (grad * grad).mean(axis=1)
        self.square[part][index] = square
        self.parts[part][index] += self.rate * grad / np.sqrt(square)[:, None]
        self.met[part][index] += 1

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        """A batch: each target against NOISE classes and NOISE words of its class, drawn by their shares and shared by the batch."""
        m, log_k = self.model, np.float32(math.log(NOISE))
        by = np.argsort(target.astype(np.uint16), kind="stable")
        target, context = target[by], context[:, by]
        kind = target // CLASS
        before, matrices = self.parts["before"], self.parts["context"].reshape(CONTEXT, RANK, RANK)
        x = [before[c] for c in context]
        q = x[0] @ matrices[0]
        for j in range(1, CONTEXT):
            q += x[j] @ matrices[j]

        def errors(part: str, of: np.ndarray, log_share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(vectors, errors) of the true outcomes."""
            rows = self.parts[part][of]
            return rows[:, :RANK], _sigmoid(log_k + log_share[of] - np.einsum("ij,ij->i", q, rows[:, :RANK]) - rows[:, RANK])

        def pulled(part: str, noise: np.ndarray, own: slice, log_share: np.ndarray) -> np.ndarray:
            """What the noise pulls its own rows; the contexts are pushed in place."""
            rows = self.parts[part][noise]
            wrong = _sigmoid(q[own] @ rows[:, :RANK].T + (rows[:, RANK] - log_share[noise] - log_k))
            back[own] -= wrong @ rows[:, :RANK]
            return -np.concatenate([wrong.T @ q[own], wrong.sum(axis=0)[:, None]], axis=1)

        vectors, right = errors("word", target, m.log_word)
        back = right[:, None] * vectors
        first = np.flatnonzero(np.concatenate([[True], np.diff(target) != 0]))
        moves = {"word": [(target[first], np.concatenate([np.add.reduceat(right[:, None] * q, first), np.add.reduceat(right, first)[:, None]], axis=1))]}
        vectors, right = errors("class", kind, m.log_class)
        back += right[:, None] * vectors
        first = np.flatnonzero(np.concatenate([[True], np.diff(kind) != 0]))
        noise = np.minimum(np.searchsorted(self.class_edge, self.dice.random(NOISE)), m.classes - 1)
        moves["class"] = [(kind[first], np.concatenate([np.add.reduceat(right[:, None] * q, first), np.add.reduceat(right, first)[:, None]], axis=1)), (noise, pulled("class", noise, slice(None), m.log_class))]
        for c, low, high in zip(kind[first].tolist(), first.tolist(), [*first[1:].tolist(), len(kind)]):
            noise = c * CLASS + np.minimum(np.searchsorted(self.word_edge[c], self.dice.random(NOISE) * self.word_edge[c, -1]), CLASS - 1)
            moves["word"].append((noise, pulled("word", noise, slice(low, high), m.log_word)))
        moves["before"] = [(np.concatenate(context), np.concatenate([back @ b.T for b in matrices]))]
        moves["context"] = [(np.arange(CONTEXT * RANK), np.concatenate([a.T @ back for a in x]))]
        for part, some in moves.items():
            self._move(part, *_summed(np.concatenate([i for i, _ in some]), np.concatenate([g for _, g in some])))


@dataclass
class LanguageModel:
    """What scoring needs of the corpus: the network, the base logarithms of the lexicon's words, and the totals."""

    network: LogBilinear
    words: list[str]  # the lexicon, most frequent first
    logs: np.ndarray  # log10 of their base shares
    end_count: int
    tokens: int
    distinct: int
    other_log: float  # log10 of the base share of all words that are no outcomes, one never met included

    @property
    def unit(self) -> float:
        return self.tokens + PRIOR * (self.distinct + 1)


def _numbered(lists: list[list[bytes]], number: dict[bytes, int], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, place, lexicon index): outcomes with CONTEXT starts before each text and END behind; where the outcomes stand."""
    get = number.get
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    index = np.array([get(w, -1) for words in lists for w in words], np.int64)
    end = np.cumsum(size + 1 + CONTEXT)
    stream = np.full(int(end[-1]) if len(end) else 0, start, np.int64)
    place = np.arange(len(index)) + np.repeat((end - (size + 1)) - (np.cumsum(size) - size), size)
    outcome = index + 2
    outcome[(index < 0) | (outcome >= start)] = OTHER
    stream[place] = outcome
    stream[end - 1] = END_ID
    return stream, np.sort(np.concatenate([place, end - 1])), index


def train_model(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS, lexicon: int = LEXICON, outcomes: int = OUTCOMES) -> LanguageModel:
    """The language model of ``docs``, whose tokens ``counts`` (see ``count_tokens``) has.

    The network's outcomes are the ``outcomes`` - 2 most frequent words, END, and all other words together. In each of
    ``rounds`` every task trains a copy on its own texts, a part of them by a hash, all in all each text once (more often
    where that gives fewer than STEPS batches); copies are then averaged row by row in a shuffle, weighted by
    the batches that moved the row. What comes to the driver are the lexicon and one set of parameters, of fixed size.
    Which texts meet in a task depends on the table's files, so scores may differ in their last places between layouts.
    """
    spark = docs.sparkSession
    tokens, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()
    top = frequent(counts, lexicon)
    words, n = [r[0] for r in top], np.array([r[1] for r in top], float)
    unit = tokens + PRIOR * (distinct + 1)
    base = (n + PRIOR) / unit
    known = base[: outcomes - 2]
    share_end = (ends + PRIOR) / unit
    other = max(1 - share_end - known.sum(), PRIOR / unit)
    share = np.concatenate([[share_end, other], known])
    model = LanguageModel(LogBilinear(share / share.sum()), words, np.log10(base), ends, tokens, distinct, math.log10(other))
    if not ends:
        return model
    tasks = max(1, -(-tokens // TASK_TOKENS))
    number = {w.encode(): i for i, w in enumerate(words[: outcomes - 2])}
    shared_number = spark.sparkContext.broadcast(number)
    # rows of a hash, not of an id: a text of any id or none falls in some round
    rows = docs.select(F.col("text").cast("string").alias("text")).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(rounds)))
    repeat = max(1, -(-STEPS * BATCH * rounds // tokens))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model.network)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            network, number = shared.value, shared_number.value
            trainer = Trainer(network, 13 + k)
            context, target, held = [], [], 0

            def learn() -> None:
                c, t = np.concatenate(context, axis=1), np.concatenate(target)
                for _ in range(repeat):
                    order = trainer.dice.permutation(len(t))
                    for at in range(0, len(t), BATCH):
                        trainer.step(c[:, order[at : at + BATCH]], t[order[at : at + BATCH]])

            for b in batches:
                for part in by_bytes(b, 0, 2 << 20):
                    stream, place, _ = _numbered([tokens_of(t) for t in utf8(part.column(0))], number, network.size)
                    context.append(network.contexts(stream, place).astype(np.int32))
                    target.append(stream[place].astype(np.int32))
                    held += len(place)
                    if held >= 32 * BATCH:
                        learn()
                        context, target, held = [], [], 0
            if held:
                learn()
            for name, values in trainer.parts.items():
                moved = np.flatnonzero(trainer.met[name])
                if len(moved):
                    values = np.concatenate([values[moved], trainer.square[name][moved, None]], axis=1)
                    width = values.shape[1]
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(moved) + 1, width, dtype=np.int32)), pa.array(values.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(moved)), pa.array(moved), pa.array(trainer.met[name][moved]), flat], ["part", "row", "n", "v"])

        picked = rows.where((F.coalesce("part", F.lit(0)) == k)).select("text").coalesce(tasks)
        moved = picked.mapInArrow(run, "part string, row long, n long, v array<float>")
        mean = moved.groupBy("part", "row").agg(*(F.sum(F.get("v", F.lit(i)) * F.col("n")).alias(f"v{i}") for i in range(RANK + 2)), F.sum("n").alias("n"))
        for r in mean.collect():  # a row for each vector of the model
            values = model.network.parts[r.part]
            width = values.shape[1]
            values[r.row], model.network.square[r.part][r.row] = np.array(r[2 : 2 + width], float) / r.n, r[2 + width] / r.n
        shared.unpersist()
    shared_number.unpersist()
    return model


def score_texts(docs: DataFrame, model: LanguageModel, counts: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: doc_id), n_tokens, n_known, base_score and score of every document.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and one end. base_score sums log10 of each token's smoothed
    share of the training tokens; n_known tokens are among them. ``score`` is the model's log10 probability: a word that is
    no outcome has the probability of the outcome "other" times its base share among such words, one for all words never
    met, so the probabilities of all next tokens sum to 1. Lexicon words are scored in the tasks that read the texts; the
    counts of others are joined, a text's own first put together by word.

    Null and empty texts are their end alone; repeated rows and null ids get a row each; an empty table gives no rows;
    without training tokens all words are unknown; columns that aren't in ``carry`` are ignored.
    """
    carry = carry or ["doc_id"]
    k = len(carry)
    names = [f"c{i}" for i in range(k)]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON words and the network
    made = (("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("net", T.DoubleType()), ("rare", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("k", T.LongType())]))))
    inner = T.StructType([*(T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, carry)), *(T.StructField(n, t) for n, t in made)])
    kind = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number = {w.encode(): i for i, w in enumerate(m.words)}
        end_log = math.log10((m.end_count + PRIOR) / m.unit)
        logs = np.append(m.logs, 0.0)
        for whole in batches:
            for b in by_bytes(whole, k, 2 << 20):
                lists = [tokens_of(t) for t in utf8(b.column(k))]
                stream, place, index = _numbered(lists, number, m.network.size)
                size = np.fromiter(map(len, lists), np.int64, len(lists))
                first = np.cumsum(size) - size
                base, known, net = np.full(len(lists), end_log), np.full(len(lists), int(m.end_count > 0)), np.zeros(len(lists))
                text = np.repeat(np.arange(len(lists)), size)
                base += np.bincount(text, logs[index], len(lists))
                known += np.bincount(text, index >= 0, len(lists)).astype(np.int64)
                got = m.network.log_probabilities(m.network.contexts(stream, place), stream[place]) / math.log(10)
                net += np.add.reduceat(got, first + np.arange(len(lists)))  # each text has one end more
                # a lexicon word that is no outcome: its base share among "other"
                beyond = np.where((index < 0) | (index + 2 >= m.network.size), -m.other_log, 0.0) + np.where(index + 2 >= m.network.size, logs[index], 0.0)
                net += np.bincount(text, beyond, len(lists))
                rare = [Counter([words[i] for i in np.flatnonzero(index[a : a + n] < 0).tolist()]) for words, a, n in zip(lists, first.tolist(), size.tolist())]
                at = np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array([w for r in rare for w in r], pa.binary()).cast(pa.string()), pa.array([n for r in rare for n in r.values()], pa.int64())], ["word", "k"])
                yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(size + 1), pa.array(known), pa.array(base), pa.array(net), pa.ListArray.from_arrays(pa.array(at), flat).cast(kind)], inner.names)

    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(carry, names)), F.col("text").cast("string").alias("_text")).mapInArrow(run, inner)
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.k")
    log = F.log10((F.coalesce("n", F.lit(0)) + F.lit(PRIOR)) / F.lit(model.unit))
    found = rare.join(counts, "word", "left").groupBy("_row").agg(F.sum(F.col("k") * log).alias("_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("_known"))
    more = F.coalesce("_log", F.lit(0.0))
    out = rows.drop("rare").join(found, "_row", "left")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, carry)), "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("net") + more).alias("score"))


def score_corpus(docs: DataFrame, training: Column, carry: list[str] | None = None) -> DataFrame:
    """``score_texts`` of all ``docs`` by a model of those where ``training`` holds, and train_tokens; odd input as there."""
    learnt = docs.where(training)
    counts = written(count_tokens(learnt), "counts")
    model = train_model(learnt, counts)
    return score_texts(docs, model, counts, carry).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
