"""Periodic runs, fill-in-the-middle and the language model against brute force, and on odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import bilinear, infill, queries, repeats
from fleetlens.llm.common import read_table

DATA = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("runs", T.StringType()), T.StructField("_text", T.StringType()), T.StructField("c0", T.IntegerType())])
LONG = "word " * 3000 + " ".join(f"w{i}" for i in range(30_000)) + " x" * 5000
ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c"), (None, "a b c"), (4, "same text same text same text same text"), (4, "same text same text same text same text"), (5, LONG), (6, "ü 𝄞 é́ <P"), (7, "x<S>y"), (8, "one")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "r", "t", 9) for i, t in ODD], DOCS)


def brute_runs(words, exponent, least):
    """Every stretch of equal words a period apart, by trying all periods."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, exponent * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_equal_brute_force():
    dice = random.Random(5)
    for _ in range(600):
        texts = []
        for _ in range(dice.randint(1, 4)):
            words = [dice.randrange(dice.choice((1, 2, 3, 6))) for _ in range(dice.choice((0, 1, 5, 6, 9, 40, 120)))]
            unit = [dice.randrange(3) for _ in range(dice.randint(1, 9))]
            at = dice.randrange(len(words) + 1)
            words[at:at] = (unit * 12)[: dice.randint(0, 90)]
            texts.append([b"%d" % w for w in words])
        exponent, least = dice.choice(((4, 6), (3, 1), (5, 12)))
        for words, (runs, collapsed) in zip(texts, repeats._found(texts, exponent, least)):
            assert runs == brute_runs(words, exponent, least)
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            assert collapsed == b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_common_prefixes_and_order_are_those_of_the_suffixes():
    dice = np.random.default_rng(3)
    symbols, text = dice.integers(0, 3, 300), np.repeat(np.arange(3), 100)
    esa = repeats.EnhancedSuffixArray(symbols, text)
    whole = [tuple(zip(text[i:].tolist(), symbols[i:].tolist())) for i in range(300)]
    assert esa.array.tolist() == sorted(range(300), key=lambda i: whole[i])
    for k in range(1, 300):
        a, b = (whole[i] for i in esa.array[k - 1 : k + 1])
        same = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert esa.lcp[k] == same


def test_runs_of_one_word_take_no_quadratic_time():
    (runs, collapsed), = repeats._found([[b"a"] * 200_000], 4, 6)
    assert runs == [(0, 200_000, 1)] and collapsed == b"a"


def test_collapse_runs_on_odd_input(spark, odd):
    got = {(r.doc_id, r.collapsed): r for r in repeats.collapse_runs(odd, ["doc_id", "runs"] if False else ["doc_id", "c0"]).collect()}
    assert len(repeats.collapse_runs(odd).collect()) == len(ODD)
    assert got[1, ""].runs == [] and got[2, ""].n_words == 0 and got[3, ""].n_words == 0
    assert [tuple(r) for r in got[4, "same text"].runs] == [(0, 8, 2)]
    long = next(r for (i, _), r in got.items() if i == 5)
    assert [tuple(r) for r in long.runs] == [(0, 3000, 1), (33_000, 5000, 1)] and long.n_words == 38_000
    assert repeats.collapse_runs(odd.limit(0)).collect() == []
    with pytest.raises(ValueError):
        repeats.collapse_runs(odd, exponent=2)


def test_planted_repeats_equal_the_rule(spark, odd):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i, f"a{i} b c d e f g h i j k") for i in range(10, 200)], "doc_id long, text string"))
    for r in queries.planted_repeats(docs.join(docs.select("doc_id", F.col("text").alias("was")), "doc_id")).collect() + queries.planted_repeats(docs.where("doc_id is null")).collect():
        if r.doc_id is None:
            assert r.text == "a b c"
    was = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.planted_repeats(docs.where("doc_id is not null")).collect():
        h = zlib.crc32(str(r.doc_id).encode())
        words = (was[r.doc_id] or "").split()
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert (r.text or "").split() == words


def test_skip_list_reaches_every_rank():
    lanes = infill.Lanes()
    dice = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 70, 5000):
        sizes = dice.integers(1, 5, n)
        before = np.concatenate([[0], np.cumsum(sizes)])
        widths, ones = infill.IndexableSkipList(n, sizes, lanes), infill.IndexableSkipList(n, None, lanes)
        for rank in {0, n, n // 2, n // 3, max(0, n - 1)}:
            assert widths.code_points(rank) == before[rank] and ones.code_points(rank) == rank
    assert len(infill.IndexableSkipList(5000, None, lanes).width) > 3


@pytest.mark.parametrize("unit", [None, r"\X", r"\S+\s*"])
def test_fill_in_middle_equals_plain_cuts(spark, odd, unit):
    import regex

    rows = infill.fill_in_middle(odd, ["doc_id", "text", "c0"], unit=unit).withColumn("again", infill.restored(F.col("form"), F.col("output"))).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = r.text or ""
        starts = range(len(text)) if unit is None else [m.start() for m in regex.finditer(unit, text)]
        cut = [0, *list(starts)[1:], len(text)] if text else [0]
        n = len(cut) - 1
        digest = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
        assert r.n == n and r.again == text
        if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            assert (r.form, r.output, r.prefix_chars, r.middle_chars) == ("plain", text, None, None)
            continue
        a, b = (cut[x] for x in sorted((h1 % (n + 1), h2 % (n + 1))))
        p, m, s = text[:a], text[a:b], text[b:]
        form = "spm" if h4 % 100 < 20 else "psm"
        assert (r.form, r.prefix_chars, r.middle_chars, r.output) == (form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")
    assert infill.fill_in_middle(odd.limit(0)).collect() == []


def test_probabilities_of_all_outcomes_sum_to_one_and_match_plain_sums():
    dice = np.random.default_rng(1)
    for size in (2, 63, 64, 65, 200):
        model = bilinear.LogBilinear(dice.dirichlet(np.ones(size)))
        trainer = bilinear.Trainer(model, 1)
        context, target = dice.integers(0, size + 1, (bilinear.CONTEXT, 500)), dice.integers(0, size, 500)
        for _ in range(3):
            trainer.step(context, target)
        model.parts = trainer.parts
        one = np.repeat(context[:, :1], size, axis=1)
        got = model.log_probabilities(one, np.arange(size))
        assert np.exp(got).sum() == pytest.approx(1, abs=1e-5)
        q = sum(model.parts["before"][one[j, 0]] @ model.parts["context"][j * bilinear.RANK : (j + 1) * bilinear.RANK] for j in range(bilinear.CONTEXT))
        classes, words = ((model.parts[k][:, :-1] @ q + model.parts[k][:, -1]).astype(float) for k in ("class", "word"))
        for w in (0, size - 1):
            c = w // bilinear.CLASS
            own = words[c * bilinear.CLASS : min(size, (c + 1) * bilinear.CLASS)]
            plain = classes[c] - np.log(np.exp(classes).sum()) + words[w] - np.log(np.exp(own).sum())
            assert got[w] == pytest.approx(plain, abs=1e-4)


def test_base_scores_equal_brute_force_and_the_model_beats_them(spark):
    docs = read_table(spark, DATA, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_lm_scores(spark, DATA).collect()}
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d: [*(t or "").translate(up).encode().split(), b"\n"] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = counts.total(), len(counts)
    assert set(got) == set(tokens)
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.05 * sum(r.n_tokens for r in out)


def test_all_next_tokens_share_probability_one(spark):
    """The sum over every word of the corpus, the end, and one word never met, behind an empty context."""
    docs = spark.createDataFrame([(i, f"a b c{i % 7} d{i}") for i in range(60)], "doc_id long, text string")
    counts = bilinear.written(bilinear.count_tokens(docs), "counts")
    model = bilinear.train_model(docs, counts, rounds=1, lexicon=8, outcomes=6)
    words = [r.word for r in counts.collect() if r.word != bilinear.END]
    single = spark.createDataFrame([(0, "")] + [(i + 1, w) for i, w in enumerate([*words, "never"])], "doc_id long, text string")
    scored = {r.doc_id: r.score for r in bilinear.score_texts(single, model, counts).collect()}
    end = {w: model.network.log_probabilities(np.array([[2 + model.words.index(w) if w in model.words[:4] else 1], [model.network.size], [model.network.size]]), np.array([0]))[0] / math.log(10) for w in [*words, "never"]}
    total = 10 ** scored[0] + sum(10 ** (scored[i + 1] - end[w]) for i, w in enumerate([*words, "never"]))
    assert total == pytest.approx(1, abs=1e-4)


def test_language_model_on_odd_input(spark, odd):
    got = bilinear.score_corpus(odd, F.coalesce(F.col("doc_id") != 8, F.lit(False)), ["doc_id", "_text", "c0"]).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        assert math.isfinite(r.score) and math.isfinite(r.base_score) and r._text == "t"
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_tokens == by[2][0].n_tokens == by[3][0].n_tokens == 1 and by[1][0].n_known == 1
    assert by[8][0].n_known == 1 and by[8][0].n_tokens == 2  # "one" was held out
    assert len(by[None]) == 2 and by[4][0].score == pytest.approx(by[4][1].score, rel=1e-5)
    assert bilinear.score_corpus(odd.limit(0), F.lit(True)).collect() == []
    nothing = bilinear.score_corpus(odd, F.lit(False)).collect()  # nothing to learn from
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)
