"""Toxicity of restored text: a noisy-channel decoder undoes disguises, a word model scores what it restores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import by_bytes, distinct_pieces, held_out, training_rows, utf8, words_of, written

# Letters that a written sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz"}
#: Signs that may be put between letters.
BETWEEN = " .-_*~/\\,'"
LETTERS = 28  # 0 the edge of a word, 1-26 a to z, 27 any other letter
SAMPLE = 20_000
_edge = ".,;:?\"'()[]{}<>«»„“”‘’…|*#%&=~`/\\-_"
_outer = "".join(c for c in _edge if c not in SIGNS)
#: Signs at a word's edge that may stand for a letter.
_masked = regex.compile(r"(?<![*#|])[*#|]{1,2}[\p{L}0-9@$!]|[\p{L}0-9@$!][*#|]{1,2}(?![*#|])")
_suspect = regex.compile(r"\p{L}[^\p{L}\s]+\p{L}|[0-9@$!€£¡+]\p{L}|\p{L}[0-9@$€£+]|(\p{L})\1\1")
_spaced = regex.compile(r"(?<![\p{L}\p{N}])(?:[\p{L}0-9@$!€|][ .\-_*~/]{1,2}){2,}[\p{L}0-9@$!€|](?![\p{L}\p{N}])")


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


class LetterModel:
    """Trigram probabilities of letters, interpolated; ``counts`` is LETTERS cubed."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + LETTERS)
        p2 = (two + 4 * p1) / (two.sum(1, keepdims=True) + 4)
        p3 = (three + 8 * p2[None]) / (three.sum(2, keepdims=True) + 8)
        self.cost = (-np.log(p3)).tolist()


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each sign of a disguised token, what may have been meant and what that costs; "" leaves it out, " " ends a word."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c, run = token[i], 1
        while i + run < len(token) and token[i + run] == c:
            run += 1
        if c.isalpha():
            if run >= 3:
                out.append([(c, 0.5), (c + c, 0.5)])
            else:
                out += [[(c, 0.0)]] * run
        else:
            meant = [(x, 1.0 if len(SIGNS[c]) < 5 else 3.5) for x in SIGNS.get(c, "")] if run < 3 else []
            if c in BETWEEN:
                meant.append(("", 1.0))
            out += [[*meant, (" ", 4.0 if SIGNS.get(c) else 1.5)]] * (min(run, 2) if c not in BETWEEN else 1)
        i += run
    return out


def read(steps: list[list[tuple[str, float]]], model: LetterModel) -> tuple[float, str]:
    """The cheapest reading of a lattice under channel and letter costs, with its cost (Viterbi)."""
    cost = model.cost
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for choices in [*steps, [(" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (total, path) in best.items():
            for said, price in choices:
                p, q, sum_ = a, b, total + price
                for c in said:
                    if c == " ":
                        if q:
                            sum_ += cost[p][q][0]
                        p, q = 0, 0
                    else:
                        k = _code(c)
                        sum_ += cost[p][q][k]
                        p, q = q, k
                if (p, q) not in new or sum_ < new[p, q][0]:
                    new[p, q] = (sum_, (path, said))
        best = new
    total, path = min(best.values(), key=lambda x: x[0])
    said = []
    while path:
        path, s = path
        said.append(s)
    return total, "".join(reversed(said)).strip()


#: What leaving out a sign at a word's edge costs that could stand for a letter.
LEFT_OUT = 1.0


class Restorer:
    """Restored text: leetspeak, spacing and repetition undone; clean tokens have one reading and stay."""

    def __init__(self, model: LetterModel, most: int = 700_000):
        self.model, self.most = model, most
        self.known: dict[str, tuple[str, ...]] = {}

    def reading(self, token: str) -> str:
        """A lower-case token as it was meant; of the readings with and without signs at its edges the cheaper one."""
        inner, outer = token.strip(_edge), token.strip(_outer)
        masked = outer != inner and any(map(str.isalpha, outer)) and _masked.search(outer)
        if not masked and not _suspect.search(inner) and not _spaced.fullmatch(token):
            return token
        cost, text = read(lattice(inner), self.model)
        if masked:
            more, with_edge = read(lattice(outer), self.model)
            if more < cost + LEFT_OUT * (len(outer) - len(inner)):
                return with_edge
        return text

    def token(self, token: str) -> tuple[str, ...]:
        """The restored words of a token."""
        if (got := self.known.get(token)) is None:
            got = (token,) if token.isalpha() and not _suspect.search(token) else tuple(words_text(self.reading(token)))
            if len(self.known) > self.most:
                self.known.clear()
            self.known[token] = got
        return got

    def joined(self, text: str) -> str:
        """The lower-case text with letters that stand apart put together."""
        return _spaced.sub(lambda m: self.reading(m.group()), text)

    def words(self, text: str) -> set[str]:
        """The words of the restored text."""
        return {w for t in set(self.joined(text.lower()).split()) for w in self.token(t)}

    def telling(self, texts: list[str], weights: dict[str, float]) -> list[set[str]]:
        """The words of each restored text that have weights; each distinct token is restored once for all texts."""
        tokens, number, first = distinct_pieces(pa.array([" ".join(self.joined(t.lower()).split()) for t in texts], pa.string()))
        own = [[w for w in self.token(t) if w in weights] for t in tokens]
        out: list[set[str]] = [set() for _ in texts]
        hits = np.flatnonzero(np.fromiter(map(bool, own), bool, len(own))[number])
        for i, n in zip((np.searchsorted(first, hits, "right") - 1).tolist(), number[hits].tolist()):
            out[i].update(own[n])
        return out

    def text(self, text: str) -> str:
        """The restored text in lower case, all else as it is: what ``words`` and ``telling`` take words from."""
        return regex.sub(r"\S+", lambda m: self.reading(m.group()), self.joined(text.lower()))


def words_text(s: str) -> list[str]:
    return [w.decode() for w in words_of(s.encode())]


def letter_counts(docs: DataFrame, flush: int = 300_000) -> np.ndarray:
    """Letter trigram counts over all words of all documents.

    Words are counted in tasks, then over the corpus (a shuffle of the distinct words, which grow with it); trigrams
    are counted from that table, and LETTERS cubed sums reach the driver.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = [k.decode() for k in words]
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
            words.clear()
            return batch

        for b in batches:
            for t in utf8(b.column(0)):
                words.update(words_of(t))
                if len(words) > flush:
                    yield out()
        yield out()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not word.isalpha():
                    continue
                codes = [0, 0, *map(_code, word), 0]
                for x, y, z in zip(codes, codes[1:], codes[2:]):
                    total[(x * LETTERS + y) * LETTERS + z] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    words = docs.select(F.col("text").cast("string")).mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = words.mapInArrow(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LETTERS**3, np.int64)
    for g, n in sums:
        out[g] = n
    return out


class ToxicityModel:
    def __init__(self, letters: LetterModel, weights: dict[str, float], bias: float):
        self.letters, self.weights, self.bias = letters, weights, bias

    def score(self, words: set[str]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + math.fsum(self.weights[w] for w in words if w in self.weights)))))


def fit_logistic(rows: list[list[int]], y: np.ndarray, times: np.ndarray, size: int, prior: float, ridge: float = 0.3) -> np.ndarray:
    """Weights of ``size`` indicators and a bias (last) by penalised logistic regression, rows counting ``times``.

    Newton's method; each step is solved by conjugate gradients, so that time and memory go with the indicators set.
    """
    flat = np.array([i for r in rows for i in [*r, size]], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    forward = lambda v: np.bincount(row, v[flat], len(rows))
    back = lambda v: np.bincount(flat, v[row], size + 1)
    weight = np.full(size + 1, ridge)
    weight[-1] = 1e-6
    theta = np.zeros(size + 1)
    theta[-1] = prior
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(forward(theta), -30, 30)))
        grad = back(times * (p - y)) + weight * theta
        if np.abs(grad).max() < 1e-8:
            break
        curve = times * p * (1 - p)
        step, rest = np.zeros(size + 1), grad.copy()
        way, size2 = rest.copy(), rest @ rest
        for _ in range(200):
            bent = back(curve * forward(way)) + weight * way
            rate = size2 / (way @ bent)
            step += rate * way
            rest -= rate * bent
            old, size2 = size2, rest @ rest
            if size2 < 1e-20:
                break
            way = rest + size2 / old * way
        theta -= step
    return theta


def beyond_chance(k: Column, n: Column, share: float) -> Column:
    """Twice the log likelihood ratio of k ones among n rows against their ``share``; unlike a deviation it holds for few rows."""
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    return 2 * (part(k, share) + part(n - k, 1 - share))


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Letter model over all documents; word weights from at most ``sample`` labelled training rows.

    All restored words that toxic rows hold beyond chance get weights by penalised logistic regression: those held at more
    than twice the share whose likelihood ratio (``beyond_chance``) is 16, four deviations, at least, however many rows
    there are. Null and empty texts are rows without words;
    repeated documents count as often as they occur. Without labels of both kinds, or without documents, the share of
    ones is the score.
    """
    letters = LetterModel(letter_counts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(letters)  # LETTERS cubed numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for b in batches:
            words = [sorted(restore.words(t or "")) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(words, pa.list_(pa.string()))], ["y", "words"])

    rows = written(training_rows(docs, labels, "toxic", sample).mapInArrow(run, "y double, words array<string>"), "restored")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    share = (ones + 0.5) / (n + 1)
    prior = math.log(share / (1 - share))
    if not 0 < ones < n:
        return ToxicityModel(letters, {}, prior)
    stats = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    chosen = sorted(r[0] for r in stats.where((F.col("k") > 2 * share * F.col("n")) & (beyond_chance(F.col("k"), F.col("n"), share) >= 16)).select("word").collect())
    place = {w: i for i, w in enumerate(chosen)}
    own = F.array_sort(F.filter("words", lambda w: w.isin(chosen))) if chosen else F.array().cast("array<string>")
    has = rows.select("y", own.alias("own")).groupBy("y", "own").agg(F.count("*").alias("n"))
    got = sorted((r.y, tuple(r.own), r.n) for r in has.collect())  # at most ``sample`` rows
    theta = fit_logistic([[place[w] for w in own] for _, own, _ in got], np.array([g[0] for g in got]), np.array([g[2] for g in got], float), len(chosen), prior)
    return ToxicityModel(letters, dict(zip(chosen, theta[:-1].tolist())), float(theta[-1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: doc_id), held_out, score and predicted of every document.

    Null and empty texts get the score of a text without telling words; repeated rows and null ids get a row each; an
    empty table gives no rows; lang, source, labels and the id itself are never inputs of a score.
    """
    carry = carry or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``terms`` weights and the letter table
    frame = docs.select(*carry, held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("_text"))
    schema = frame.drop("_text").withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value.letters)
        for b in batches:
            score = []
            for part in by_bytes(b, b.num_columns - 1):
                found = restore.telling([t or "" for t in part.column(b.num_columns - 1).to_pylist()], shared.value.weights)
                score += map(shared.value.score, found)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], schema.names)

    return frame.mapInArrow(run, schema)
