"""The pipeline's stages and the queries without SQL against brute force over whole small tables, and on odd input."""

import hashlib
import os
import re
import zlib
from collections import Counter
from math import exp, log2

import numpy as np
import pytest
import xxhash

pytest.importorskip("fleetlens.llm")
os.environ["TOKENIZERS_PARALLELISM"] = "false"
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from fleetlens.llm import pii, quality, queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def plain_pii(rows, threshold=0.8, support=2):
    """{(doc_id, text): spans (start, kind number, end)} and terms that disclose, by counting over all distinct rows."""
    units = list(dict.fromkeys((i, t or "") for i, t in rows))
    word = re.compile(pii.TERM)
    base = {u: sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, u[1]) if valid(kind, m.group())) for u in units}
    names = list(KINDS)

    def entity(u, s, k, e):
        v = u[1][s:e]
        return names[k] + ":" + (v.lower() if k == 0 else v if k == 1 else re.sub("[^0-9]", "", v))

    terms = {u: {w.lower() for w in word.findall(u[1])} for u in units}
    holds = {u: {entity(u, *x) for x in base[u]} for u in units}
    n_t, n_e = Counter(t for x in terms.values() for t in x), Counter(e for x in holds.values() for e in x)
    n_te = Counter((t, e) for u in units for e in holds[u] for t in terms[u])
    n = max(2, len(units))

    def tells(t, e):
        both = n_te[t, e]
        return both >= support and (1.0 if both >= n else log2(both * n / (n_t[t] * n_e[e])) / -log2(both / n)) >= threshold

    out = {}
    for u in units:
        telling = {t for e in holds[u] for t in terms[u] if tells(t, e)}
        free = [(m.start(), 4, m.end()) for m in word.finditer(u[1]) if m.group().lower() in telling and not any(s < m.end() and m.start() < e for s, _, e in base[u])]
        out[u] = base[u], sorted(base[u] + free)
    return out


def listed(spans):
    return ",".join(f"{[*KINDS, 'term'][k]}:{s}:{e}" for s, k, e in spans)


def cleaned(text, spans):
    at, out = 0, []
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{[*KINDS, 'term'][k]}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", lower(text).encode()) if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def contaminated(text, windows):
    words = WORDS.findall(lower(text))
    hit = {p for m, known in windows.items() for s in range(len(words) - m + 1) if tuple(words[s : s + m]) in known for p in range(s, s + m)}
    return bool(hit) and 20 * len(hit) >= len(words)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_pii_query_against_brute_force(spark, table):
    rows = [(r.doc_id, r.text) for r in table.collect()]
    want = plain_pii(rows)
    got = sorted(map(tuple, queries.op8_pii(spark, DATA).collect()))
    kinds = lambda spans: [sum(k == i for _, k, _ in spans) for i in range(4)]
    assert got == sorted((i, *kinds(b), hashlib.sha256(listed(b).encode()).hexdigest(), listed(s)) for (i, t) in rows for b, s in [want[i, t or ""]])
    assert any("term" in r[-1] for r in got)


def test_sharding_query_against_brute_force(spark, table):
    texts = {r.doc_id: (r.text or "").encode() for r in table.collect()}
    got = queries.op7_sharding(spark, DATA).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == sorted((i, len(t) + 1, zlib.crc32(t), "rows", None) for i, t in texts.items())
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(x == list(range(len(x))) for x in slots.values()) and {len(x) for x in slots.values()} <= {len(texts) // 8, -(-len(texts) // 8)}


def test_tokenizer_queries_against_the_library(spark, table):
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    word, byte = (Tokenizer.from_file(public_tokenizers.path(f"{n}.json")) for n in ("word_bpe_49k", "byte_bpe_50k"))
    for t in (word, byte):
        t.no_truncation()
        t.no_padding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {i: word.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    want = sorted((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(word.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items())
    assert sorted(map(tuple, queries.op4_word_bpe(spark, DATA).collect())) == want
    start, want = 0, []
    for i in sorted(texts):
        x = [*byte.encode(texts[i], add_special_tokens=False).ids, 0]
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, queries.op10_token_files(spark, DATA).collect())) == want


def test_stages_against_brute_force(spark, table):
    """Each stage over what its predecessor kept."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = {r.doc_id: r for r in table.collect()}
    model = quality.train_quality(table, labels)
    score = {i: 1 / (1 + exp(-model.logit(*quality.features((r.text or "").encode(), [r.n_chars], {})))) for i, r in docs.items()}
    kept = corpus_pipeline.quality_stage(spark, table, DATA)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, s in score.items() if s >= 0.3}

    rest = corpus_pipeline.near_dedup_stage(spark, kept, DATA)
    ids = sorted(r.doc_id for r in kept.collect())
    fps, root = {i: fingerprint(docs[i].text) for i in ids}, {i: i for i in ids}
    for a in ids:
        for b in ids:
            if root[a] != root[b] and (fps[a] ^ fps[b]).bit_count() <= 2:
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    ids = sorted(set(root.values()))
    assert sorted(map(tuple, rest.collect())) == [tuple(docs[i]) for i in ids]

    items = [WORDS.findall(lower(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {}
    for w in items:
        m = min(13, len(w))
        windows.setdefault(m, set()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1) if m)
    clean = corpus_pipeline.decontamination_stage(spark, rest, DATA)
    ids = [i for i in ids if not contaminated(docs[i].text, windows)]
    assert sorted(map(tuple, clean.collect())) == [tuple(docs[i]) for i in ids]

    safe = corpus_pipeline.pii_stage(spark, clean, DATA)
    spans = plain_pii([(i, docs[i].text) for i in ids])
    text = {i: cleaned(docs[i].text or "", spans[i, docs[i].text or ""][1]) for i in ids}
    assert safe.columns == table.columns and sorted((r.doc_id, r.text, r.n_chars) for r in safe.collect()) == [(i, text[i], len(text[i])) for i in ids]

    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded) for r in corpus_pipeline.token_stage(spark, safe, DATA).collect()}
    for i in ids:
        x = word.encode(text[i], add_special_tokens=False).ids
        assert got.pop(i) == (len(x), np.array(x, "<u4").tobytes(), word.decode(x, skip_special_tokens=False))
    assert not got


ODD = [
    (1, "Mail a.b@example.org. " + "good words stand here and there " * 4, "en", 3), (1, "Mail a.b@example.org. " + "good words stand here and there " * 4, "en", 3), (2, None, None, None), (None, None, None, None),
    (3, "", "", 0), (None, "no id here at all", "en", 1), (None, "no id here at all", "en", 1), (4, "word " * 60_000 + "10.0.0.1 " * 3000, "en", 9), (5, "   ", "en", 2), (4, "another text under the same id", "de", 4),
]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_stages_on_odd_input(spark, rows):
    extra = ("score", "predicted", "h", "every", "terms", "fp", "digest", "_text", "c0", "_c1", "n_words", "contaminated", "label")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").withColumns({c: F.lit(c) for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        left = got.collect()
        assert got.columns == docs.columns and len(left) <= len(rows) and all(r[c] == c for r in left for c in extra), name
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in left) == (sorted(["1", "4", "4", "2", "None"]) if rows else [])
        if name == "pii":
            assert len(left) == len(rows) and all("@" not in (r.text or "") and "10.0.0.1" not in (r.text or "") for r in left)
    tokens = corpus_pipeline.token_stage(spark, docs, DATA).collect()
    assert len(tokens) == len(rows) and sum(r.n_tokens == 0 for r in tokens) == (4 if rows else 0)
