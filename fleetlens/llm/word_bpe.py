"""BPE encoding and decoding through a lexicon of the corpus's frequent words."""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from fleetlens.llm.common import by_bytes, distinct_pieces, spell_out, written
from fleetlens.llm.lexicon import Lexicon, Merger

# Fixed values of the tokenizer file: its white space and its pattern of words.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = regex.compile(f"[{_WHITE}]+")
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
#: The library's own steps, for code points that Python's tables don't have yet.
NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
WORDS = pre_tokenizers.Split(Regex(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True)
#: str.split() also cuts here, the tokenizer doesn't.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


#: Letters that may be unknown; the ranges left out hold known ones only.
RARE = re.compile("[^\x00-\u02ff\u2010-\u205e\u20a0-\u20bf]+")


@functools.cache
def unknown() -> np.ndarray:
    """Edges of the ranges of code points that Python's Unicode tables don't have, noncharacters included, or whose place among marks the library's lack."""
    nfc = normalizers.NFC()
    around = ("q\u0301{}", "q{}\u0301", "q\u0316{}", "q{}\u0316", "q{}\u0334", "q\u0345{}", "q{}\u0345")  # marks of classes 230, 220, 1 and 240

    def foreign(c: int) -> bool:
        letter = chr(c)
        if unicodedata.combining(letter):
            return any(nfc.normalize_str(x) != unicodedata.normalize("NFC", x) for x in (a.format(letter) for a in around))
        return unicodedata.category(letter) == "Cn"

    edges, was = [], False
    for c in range(0x80, 0x110001):
        now = c < 0x110000 and foreign(c)
        if now != was:
            edges.append(c)
            was = now
    return np.array(edges, np.uint32)


def has_unknown(text: str) -> bool:
    rare = "".join(RARE.findall(text))
    return bool(rare) and bool((np.searchsorted(unknown(), np.frombuffer(rare.encode("utf-32-le", "surrogatepass"), "<u4"), "right") & 1).any())


def chunks_of(text: str) -> list[str]:
    """Stretches between white space, normalised and lower-cased as the tokenizer does, letter by letter."""
    if not text.isascii():
        if has_unknown(text):
            return [d for c in SPACE.split(text) if c for d in ([NORMAL.normalize_str(c)] if has_unknown(c) else chunks_of(c))]
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # else lower() would look at the neighbours
    text = text.lower()
    if any(c in text for c in ODD):
        return [c for c in SPACE.split(text) if c]
    return text.split()


def words_in(chunk: str) -> list[str]:
    """The tokenizer's words of one stretch."""
    if chunk.isalpha():
        return [chunk]
    if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
        return [chunk[:-1], chunk[-1]]
    if not chunk.isascii() and has_unknown(chunk):
        return [w for w, _ in WORDS.pre_tokenize_str(chunk)]
    return WORD.findall(chunk)


def frequent_words(docs: DataFrame, size: int, flush: int = 150_000) -> DataFrame:
    """(word, n): the most frequent words of all texts, ``size`` at most; ties are in or out together.

    Words are counted in tasks before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
            words.clear()
            return batch

        for b in batches:
            for part in by_bytes(b, 0, 2 << 20):
                chunks, number, _ = distinct_pieces(pa.array([" ".join(chunks_of(t)) if t else "" for t in part.column(0).to_pylist()], pa.string()))
                for c, n in zip(chunks, np.bincount(number, minlength=len(chunks)).tolist()):
                    for w in words_in(c):
                        words[w] += n
                if len(words) > flush:
                    yield out()
        yield out()
        pa.default_memory_pool().release_unused()

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    counts = written(counts.groupBy("word").agg(F.sum("n").alias("n")), "words").withColumn("step", F.floor(8 * F.log2("n")).cast("int"))
    # Steps of the logarithm: some hundreds of totals tell from which count on ``size`` words are enough.
    least, held = 1 << 30, 0
    for step, n in sorted(counts.groupBy("step").agg(F.count("*")).collect(), reverse=True):
        if held + n > size:
            break
        least, held = step, held + n
    return counts.where(F.col("step") >= least).select("word", "n")


def compile_lexicon(docs: DataFrame, tokenizer: str, size: int) -> str:
    """Name of the lexicon file, which Spark hands to every executor, also to those that come later.

    The file is written once by the driver and served from there; it holds ``size`` words at most.
    """
    words = [r[0] for r in frequent_words(docs, size).collect()]  # at most ``size`` rows
    merger = Merger(tokenizer)
    raw = [w.encode() for w in words]
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(SparkFiles.getRootDirectory(), name)  # Spark's own folder for such files
    Lexicon.write(path, raw, [merger.ids(w) for w in raw])
    docs.sparkSession.sparkContext.addFile(path)
    return name


class WordEncoder:
    """Whole texts to ids: frequent words by the lexicon, all others by exact merging; repeats are remembered."""

    def __init__(self, lexicon: Lexicon, merger: Merger, most: int = 60_000):
        self.lexicon, self.merger, self.most = lexicon, merger, most
        self.known: dict[str, bytes] = {}  # ids of a stretch between white space
        self.words: dict[str, bytes] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, merger.special)) + ")") if merger.special else None

    def learn(self, chunks: set[str]) -> None:
        words, known = self.words, self.known
        alone = [c for c in chunks if c.isalpha()]
        cut = {c: words_in(c) for c in chunks if not c.isalpha()}
        fresh = list({w for ws in (alone, *cut.values()) for w in ws if w not in words})
        raw = [w.encode() for w in fresh]
        number = self.lexicon.numbers(raw)
        frequent, others = np.flatnonzero(number >= 0), np.flatnonzero(number < 0).tolist()
        words.update(zip([fresh[i] for i in frequent.tolist()], self.lexicon.ids_of(number[frequent])))
        words.update(zip([fresh[i] for i in others], self.merger.many([raw[i] for i in others])))
        known.update(zip(alone, map(words.__getitem__, alone)))
        known.update(zip(cut, [b"".join(map(words.__getitem__, ws)) for ws in cut.values()]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; strings of special tokens are those tokens."""
        for memory in (self.known, self.words):
            if len(memory) > self.most:
                memory.clear()
        special, known = self.merger.special, self.known
        out: list[bytes] = [b""] * len(texts)
        plain, joined = [], []
        for i, text in enumerate(texts):
            if any([s in text for s in special]):
                parts = self.special.split(text)
                self.learn({c for p in parts if p not in special for c in chunks_of(p) if c not in known})
                out[i] = b"".join([pack_ids([special[p]]) if p in special else b"".join([known[c] for c in chunks_of(p)]) for p in parts])
            else:
                plain.append(i)
                joined.append(" ".join(chunks_of(text)))
        if plain:
            chunks, number, first = distinct_pieces(pa.array(joined, pa.string()))
            self.learn({c for c in chunks if c not in known})
            for i, ids in zip(plain, spell_out([known[c] for c in chunks], number, first, "<u4")):
                out[i] = ids
        return out


_encoders: dict[str, WordEncoder] = {}


def _encoder(name: str, tokenizer: str) -> WordEncoder:
    """One encoder for each worker process: later tasks know the words of earlier ones."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = WordEncoder(Lexicon(SparkFiles.get(name)), Merger(tokenizer))
    return _encoders[name]


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def decode(ids: list[bytes], names: pa.Array) -> pa.Array:
    """The tokenizer file names no decoder, so tokens are joined by spaces, special ones included."""
    edge = np.cumsum([0, *map(len, ids)]) // 4  # in tokens
    tokens = names.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), tokens), pa.scalar(" ", tokens.type))


def encode_decode(docs: DataFrame, tokenizer: str, size: int = 1 << 16, carry: list[str] | None = None, digest: bool = False) -> DataFrame:
    """Columns ``carry`` (default: doc_id), n_tokens, and ids and decoded, or with ``digest`` their SHA-256 in hex.

    ids is binary, little-endian unsigned 32-bit. The lexicon is compiled from word counts over all ``docs``; it only
    decides which words are looked up and which are merged, never the result. Null and empty texts have no tokens
    and decode to the empty text; repeated rows and null ids get a row each; an empty table compiles an empty lexicon.
    """
    carry = carry or ["doc_id"]
    name = compile_lexicon(docs, tokenizer, size)
    kinds = (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())) if digest else (("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("decoded", T.StringType()))
    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(n, t) for n, t in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, tokenizer)
        names = pa.array(encoder.merger.names, pa.large_string())
        for whole in batches:
            for b in by_bytes(whole, len(carry), 2 << 20):
                ids = encoder.encode([x or "" for x in b.column(len(carry)).to_pylist()])
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                decoded = decode(ids, names)
                if digest:
                    more = [pa.array([hashlib.sha256(x).hexdigest() for x in column], pa.string()) for column in (ids, decoded.cast(pa.large_binary()).to_pylist())]
                else:
                    more = [pa.array(ids, pa.binary()), decoded.cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], n, *more], schema.names)
        for memory in (encoder.known, encoder.words):  # an idle worker holds no more than the automaton and the merges
            memory.clear()
        pa.default_memory_pool().release_unused()

    return docs.select(*carry, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)
