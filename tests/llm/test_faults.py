"""Inputs that once went wrong: long and repeated benchmark items, newer letters, repeated labelled rows, few labels, many entities."""

import os
import random
import unicodedata

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm import decontaminate, pii, quality, toxicity, word_bpe
from fleetlens.llm.common import scratch_root
from fleetlens.llm.lexicon import Lexicon, Merger
from fleetlens.llm.queries import OP2_SQL

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def by_sql(docs, items):
    con = duckdb.connect()
    for name, rows in (("documents", docs), ("benchmark", items)):
        con.execute(f"create table {name} ({'doc_id bigint' if name == 'documents' else 'item_id varchar'}, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    return sorted(con.execute(f"select doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, longest_at from ({OP2_SQL})").fetchall(), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")


def test_a_match_is_as_long_as_its_item(spark):
    dice = random.Random(1)
    words = [f"w{dice.randrange(4000)}" for _ in range(9000)]
    items = [("long", " ".join(words)), ("other", " ".join(words[4000:4050] + ["x"] * 20))]
    docs = [(1, " ".join(words)), (2, "a b " + " ".join(words[100:8000]) + " c"), (3, " ".join(words[4000:4050])), (4, "nothing of it")]
    got = decontaminate.find_contamination(*frames(spark, docs, items)).drop("runs", "items").collect()
    assert {r.doc_id: (r.longest_match, r.longest_at) for r in got} == {1: (9000, 0), 2: (7900, 2), 3: (50, 0), 4: (0, None)}
    assert sorted(map(tuple, got), key=str) == by_sql(docs, items)
    every = decontaminate.longest_matches(*frames(spark, docs, items)).collect()
    assert (("long", 0, 9000, 1, 0)) in {tuple(r) for r in every}


def test_repeated_items_are_one(spark):
    text = " ".join(f"v{i}" for i in range(200))
    items = spark.range(5000).select(F.lit("i").alias("item_id"), F.lit(text).alias("text"))
    blocks = [b.value for held, _ in decontaminate.test_blocks(items, 13, 1 << 14, 8) for b in held]
    assert [b.ids for b in blocks] == [["i"]]
    docs = [(1, text), (2, "x")]
    got = decontaminate.find_contamination(frames(spark, docs, [])[0], items, block_bytes=1 << 14).drop("runs", "items").collect()
    assert sorted(map(tuple, got), key=str) == by_sql(docs, [("i", text)] * 5)


def test_blocks_are_bounded_by_one_item_more(spark):
    items = spark.range(400).select(F.col("id").cast("string").alias("item_id"), F.concat_ws(" ", *(F.concat(F.lit(f"q{j}_"), F.col("id")) for j in range(20))).alias("text"))
    blocks = [b.value for held, _ in decontaminate.test_blocks(items, 13, 4000, 3) for b in held]
    assert sorted(i for b in blocks for i in b.ids) == sorted(map(str, range(400))) and len(blocks) > 10
    assert all(sum(map(len, b.vocabulary)) + 19 * len(b.ids) <= 4000 + 200 for b in blocks)


def test_an_empty_benchmark_counts_words(spark):
    got = decontaminate.find_contamination(*frames(spark, [(1, "a b"), (2, None)], [])).collect()
    assert {(r.doc_id, r.n_words, r.contaminated) for r in got} == {(1, 2, False), (2, 0, False)}


@pytest.mark.parametrize("around", ["a{}b", "{}", "A{}́ {}x", "1{}'s"])
def test_every_letter_is_encoded_as_by_the_library(around):
    library, merger = Tokenizer.from_file(TOKENIZER), Merger(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    letters = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 331 == 0 or unicodedata.category(chr(c)) not in ("Lo", "Cn", "Co"))]
    texts = [around.replace("{}", c) for c in letters]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert [i for c in word_bpe.chunks_of(text) for w in word_bpe.words_in(c) for i in merger.ids(w.encode())] == want.ids, ascii(text)


def test_rare_words_are_merged_together(monkeypatch):
    library, merger = Tokenizer.from_file(TOKENIZER), Merger(TOKENIZER)
    library.no_truncation()
    dice = random.Random(4)
    words = ["".join(dice.choices(a, k=dice.randrange(1, 90))) for a in ("abcdefghijklmnopqrstuvwxyz", "einsrtha", "ab", "éßжд中") for _ in range(500)] + ["a", "é", "aa", "a" * 64, "a" * 65, "the", "ing"]
    want = [np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    raw = [w.encode() for w in words]
    assert merger.many(raw) == merger.many(raw, block=7) == want and merger.many([]) == [] and merger.many([b"", raw[0]]) == [b"", want[0]]
    one_by_one = []
    monkeypatch.setattr(Merger, "ids", lambda self, w, ids=Merger.ids: one_by_one.append(len(w)) or ids(self, w))

    class Empty:  # knows no word
        numbers = staticmethod(lambda words: np.full(len(words), -1))
        ids_of = staticmethod(lambda numbers: [])

    encoder = word_bpe.WordEncoder(Empty, merger)
    assert encoder.encode([" ".join(words)]) == [b"".join(want)] and min(one_by_one) > 64


def test_frequent_pieces_outlive_a_full_memory():
    from fleetlens.llm import token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    encoder = token_files.PieceEncoder(path, public_tokenizers.PATTERN, most=300)
    asked = []
    many = encoder._many
    encoder._many = lambda words, sign: asked.append(set(words)) or many(words, sign)
    signs = ["", ".", "###", "'", "''s", "!\nLine", ".\nLine;;", "\n", "\n\nx", "'s", "'s.", "é", "1", "|", "\t.", "\u00a0", "$\n$"]
    dice = random.Random(5)
    letters = lambda n: "".join(dice.choices("etaoinshrdlü", k=n))
    for turn in range(8):
        words = ["theword", "other.", *(letters(7) + dice.choice(signs) for _ in range(400)), "theword,"]
        texts = [" ".join(words), "", " theword", "theword ", "a  theword", " ", "a b", None, "x<|endoftext|> theword", *signs]
        want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
        assert encoder.encode(pa.array(texts)) == want and encoder.encode(pa.array(["", *texts]).slice(1)) == want
    assert sum("theword" in x for x in asked) == 1  # a full memory was emptied before


def test_pieces_are_cut_at_signs_and_line_ends():
    from fleetlens.llm import token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    encoder = token_files.PieceEncoder(path, public_tokenizers.PATTERN)
    learnt = []
    learn = encoder._learn
    encoder._learn = lambda fresh: learnt.extend(fresh) or learn(fresh)
    dice = random.Random(6)
    words = ["".join(dice.choices("etaoinshrdl", k=6)) for _ in range(40)]
    signs = [".\n", ",", ";", ".", "?\n", "'s ", "-", "1", "!\n"]
    texts = ["".join(dice.choice(words) + dice.choice(signs) + dice.choice(["", " "]) for _ in range(300)) for _ in range(20)]
    texts += ["a \u00a0 \u00a0", "\x1f \u00a0 \u00a0", "a\n \n\nb", "don't", "('tis)", "\u3000\u3000\nb\n\u3000\u3000c", "é\u2003 \u1680 d", "x\x85  y"]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert encoder.encode(pa.array(texts)) == want  # white space on both sides of a space was cut in two before
    assert len(learnt) < 400  # each pair of words about a sign or a line end was a piece of its own before
    held, long = len(encoder.known), "y" * 5000
    assert encoder.encode(pa.array([long])) == [np.array(library.encode(long, add_special_tokens=False).ids, "<u2").tobytes()]
    assert len(encoder.known) == held  # long pieces take no memory
    assert encoder.encode(pa.array([], pa.string())) == [] and encoder.encode(pa.array(["", None], pa.large_string())) == [b"", b""]


def test_lexicon_gives_the_ids_of_many_words(tmp_path):
    ids = {b"a": [5], b"ab": [], b"b": [1, 2, 70_000], "é".encode(): [9, 8]}
    Lexicon.write(str(tmp_path / "x"), list(ids), list(ids.values()))
    lexicon = Lexicon(str(tmp_path / "x"))
    words = [b"b", b"a", "é".encode(), b"ab", b"b"]
    assert lexicon.ids_of(lexicon.numbers(words)) == [np.array(ids[w], "<u4").tobytes() for w in words]
    assert lexicon.ids_of(np.zeros(0, np.int64)) == [] and lexicon.numbers([b"abc", b""]).tolist() == [-1, -1]


def test_a_document_that_stands_often_hides_no_other(spark):
    dice = random.Random(3)
    docs = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{dice.randrange(60)}" for _ in range(40))) for i in range(60)]
    often = "tail " + " ".join(f"z{i}" for i in range(300))
    rows = docs[1:] + [(0, often)] * 400
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train_quality(frame, labels, sample_values=10_000)
    single = quality.train_quality(spark.createDataFrame([*docs[1:], (0, often)], "doc_id long, text string"), labels, sample_values=10_000)
    assert (model.w != 0).sum() == (single.w != 0).sum() > 100  # every distinct row has been learnt from
    scores = {r.doc_id: r.score for r in quality.score_quality(spark.createDataFrame(docs[1:], "doc_id long, text string"), model).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)
    # a row too large for the sample is passed over, those behind it aren't
    huge = [*docs[1:], (0, " ".join(f"y{i}" for i in range(5000)))]
    assert (quality.train_quality(spark.createDataFrame(huge, "doc_id long, text string"), labels, sample_values=4000).w != 0).sum() > 50


def test_rows_count_as_often_as_they_occur():
    dice = np.random.default_rng(1)
    rows = [(dice.choice(50, 8, replace=False), np.ones(8)) for _ in range(30)]
    y, times = dice.integers(0, 2, 30).astype(float), dice.integers(1, 4, 30).astype(float)
    weighted = quality.FactorisationMachine.fit(rows, y, times, batch=64, decay=0.0)
    again = [(r, v) for r, v, k in zip(rows, y, times) for _ in range(int(k))]
    spelt = quality.FactorisationMachine.fit([r for r, _ in again], np.array([v for _, v in again]), batch=64, decay=0.0)
    a, b = weighted.logits(rows), spelt.logits(rows)
    assert np.corrcoef(a, b)[0, 1] > 0.98 and ((a > 0) == (b > 0)).mean() > 0.9


def test_few_toxic_rows_are_enough_if_they_tell(spark):
    dice = random.Random(2)
    plain = lambda: " ".join(dice.choice("the of and river stone house tree walk open many small light".split()) for _ in range(30))
    docs = [(i, plain() + (" blargh" if i % 50 == 7 else "")) for i in range(300)]
    labels = [(i, int(i % 50 == 7)) for i in range(300)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_toxicity(*frames)
    assert set(model.weights) == {"blargh"}  # from five or six rows
    one = spark.createDataFrame([(i, int(i == 57)) for i in range(300)], "doc_id long, toxic int")
    assert toxicity.train_toxicity(frames[0], one).weights == {}  # a single row tells nothing


def test_likelihood_ratio_is_the_textbooks(spark):
    import math

    for k, n, share in ((3, 3, 0.02), (8, 20, 0.1), (0, 5, 0.3), (5, 5, 0.5)):
        want = 2 * sum(x * math.log(x / (n * p)) for x, p in ((k, share), (n - k, 1 - share)) if x)
        assert spark.range(1).select(toxicity.beyond_chance(F.lit(k), F.lit(n), share)).first()[0] == pytest.approx(want)


def test_many_entities_and_terms_form_few_pairs(spark):
    def text(n, words):
        return " ".join(f"user{i}@mail.org" for i in range(n)) + " " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(words))

    log = text(14_000, 3000)  # a third of a megabyte, twice
    docs = spark.createDataFrame([(1, log), (2, log + " other"), (3, "user1@mail.org said nothing")] + [(i, f"plain text number {i}") for i in range(4, 40)], "doc_id long, text string")
    kept = pii.written(pii.find_base(docs).where(F.size("found") > 0), "spans")
    plain = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    before = set(os.listdir(scratch_root(spark).removeprefix("file:")))
    telling = {r.doc_id: set(r.telling) for r in pii.disclosing(kept, plain, 0.8, 2).collect()}
    made = [d for d in set(os.listdir(scratch_root(spark).removeprefix("file:"))) - before if d.startswith("together-")]
    assert len(made) == 1 and spark.read.parquet(f"{scratch_root(spark)}/{made[0]}").count() < 20
    assert telling[1] == telling[2] and len(telling[1]) >= 3000


def test_a_mention_is_no_licence_and_an_altered_body_has_a_score(spark):
    from fleetlens.llm import license_scan

    mit = next(text for label, text, _ in license_scan.LICENCES if label == "mit")
    rows = [(1, "we do not use the Mozilla Public License here"), (2, mit), (3, mit.replace("hereby", "therefore")), (4, mit.replace("hereby", "therefore").replace("Software", "Program")), (5, "intro " + mit + " " + mit), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert (got[1].labels, got[1].score) == ("", 0.0) and (got[2].labels, got[2].score) == ("mit", 1.0)
    assert got[3].labels == "" and 0.95 < got[3].score < 1  # its key phrase was altered
    assert got[4].labels == "" and 0.5 < got[4].score < got[3].score and len(got[5].places) == 2
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = {r[0]: r for r in con.execute(license_scan.scan_sql()).fetchall()}
    for i, r in got.items():
        assert tuple(r)[:8] == want[i]


def test_any_altered_words_leave_a_rare_one_in_place():
    from fleetlens.llm import license_scan

    dice = random.Random(4)
    every = license_scan.templates()
    idf = {w: dice.random() for w in sorted({b["w"] for t in every for b in t["body"]})}
    index = license_scan.rare_postings(idf)
    for number, t in enumerate(every):
        own = {p["o"] for w in index.values() for p in w if p["t"] == number}
        for _ in range(20):
            kept = {b["o"] for b in dice.sample(t["body"], t["near"])}
            assert kept & own


def test_token_shards_are_even_in_bytes(spark, monkeypatch):
    from fleetlens.llm import token_files

    monkeypatch.setattr(token_files, "SHARD_BYTES", 1 << 20)
    # a tenth of the ids hold nine tenths of the bytes
    encoded = spark.range(20_000).selectExpr("id as doc_id", "cast(if(id between 5000 and 7000, 20000, 300) as bigint) as size", "cast('' as binary) as ids")
    bounds = token_files.shard_bounds(encoded, 2)
    dealt = token_files.in_shards(encoded, bounds).groupBy("shard").agg(F.sum("size").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("shard").collect()
    total = sum(r.n for r in dealt)
    assert len(dealt) > 30 and max(r.n for r in dealt) < 3 * total / len(dealt)
    assert all(x.b < y.a for x, y in zip(dealt, dealt[1:]))
    nameless = token_files.in_shards(spark.createDataFrame([(None, 64, b"")], "doc_id long, size long, ids binary"), bounds)
    assert nameless.first().shard == 0 and len(token_files.shard_bounds(encoded.limit(0), 3)) == 0


def test_one_id_for_all_rows_and_texts_of_megabytes(spark):
    from fleetlens.llm import token_files

    byte = public_tokenizers.path("byte_bpe_50k.json")
    long = " ".join(f"piece{i % 5000} of é text," for i in range(120_000))  # 2.5 MB
    rows = [(7, f"text number {i}") for i in range(40)] + [(7, "text number 3"), (7, None), (7, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for path, run, end in ((byte, lambda p: token_files.round_trip(docs, p, public_tokenizers.PATTERN), [0]), (TOKENIZER, lambda p: word_bpe.encode_decode(docs, p), [])):
        library = Tokenizer.from_file(path)
        library.no_truncation()
        got = sorted(bytes(r.ids) for r in run(path).collect())
        assert got == sorted(np.array([*library.encode(t or "", add_special_tokens=False).ids, *end], "<u4").tobytes() for _, t in rows)
    starts = sorted((r.start, r.n_tokens) for r in token_files.round_trip(docs, byte, public_tokenizers.PATTERN).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
