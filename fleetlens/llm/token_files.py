"""Token ids in binary files: frequency ranks in byte-aligned variable-length codes with separate control bytes."""

from __future__ import annotations

import json
import math
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import by_bytes, joined, scratch_root

#: For each control byte, the lengths of the four codes that it governs, two bits each, lowest first.
LENGTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes): each value takes 1 to 4 bytes, its length minus one stands in two control bits."""
    values = values.astype("<u4")
    top = int(values.max(initial=0))
    held = np.ones((len(values), max(1, -(-top.bit_length() // 8))), bool)  # bytes that a value takes, of those that any takes
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    for place in range(1, held.shape[1]):
        np.greater_equal(values, 1 << 8 * place, out=held[:, place])
        code[: len(values)] += held[:, place]
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[:, : held.shape[1]][held]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of ``pack``: lengths by table lookup, then one gather for each byte place."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    end = np.cumsum(size, dtype=np.int64)
    start = end - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[start].astype(np.uint32)
    for place in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > place)
        out[longer] |= raw[start[longer] + place].astype(np.uint32) << np.uint32(8 * place)
    return out


#: Hardly a value of these files occurs twice, so a dictionary of values would be work for nothing.
UNIQUE = {"compression": "zstd", "parquet.enable.dictionary": "false"}


#: Kinds of bytes for ``cut_texts``: letters, digits, other signs, the apostrophe, bytes from 0x80 on, white space, and signs that
#: aren't white space everywhere.
LETTER, DIGIT, SIGN, QUOTE, HIGH, SPACE, UNSURE = range(7)
_KINDS = np.full(256, SIGN, np.uint8)
_KINDS[[i for i in range(128) if chr(i).isalpha()]] = LETTER
_KINDS[0x30:0x3A], _KINDS[0x27], _KINDS[0x80:], _KINDS[0x1C:0x20] = DIGIT, QUOTE, HIGH, UNSURE
_KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
#: For eight times a byte's kind and the next one's: 1 if pieces always end between them, 2 if they do unless the first ends a white-space letter.
_CUTS = np.zeros(256, np.uint8)
for _a, _nexts in ((LETTER, (DIGIT, SIGN, QUOTE, SPACE)), (DIGIT, (LETTER, SIGN, QUOTE, SPACE)), (SIGN, (LETTER, DIGIT, SPACE)), (QUOTE, (DIGIT, SPACE))):
    _CUTS[[8 * _a + b for b in _nexts]] = 1
_CUTS[8 * HIGH + SPACE] = 2
KINDS, CUTS = _KINDS.tobytes(), _CUTS.tobytes()
#: White space beyond ASCII, the last three bytes of each sign as a number (the last two where it has two).
WIDE = np.array([int.from_bytes(c.encode(), "big") for c in "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"])


def cut_texts(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """(pieces of all texts in order, number of pieces before each text, and of all).

    A cut stands only where the public pattern of byte-level BPE ends a piece whatever stands around, so the pieces can be
    encoded alone: between ASCII letters, digits and signs, but not behind an apostrophe, before white space behind something
    else, and behind a line end that stands alone. Runs of white space stay with what follows, signs beyond ASCII with their
    neighbours.
    """
    edge = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[edge[0] : edge[-1]] if whole is not None else np.zeros(0, np.uint8)
    edge = edge - edge[0]
    n = len(data)
    kind = np.frombuffer(data.tobytes().translate(KINDS), np.uint8)
    pair = kind[:-1] << 3
    pair |= kind[1:]
    cut = np.zeros(n + 1, np.uint8)  # before each byte
    cut[1:-1] = np.frombuffer(pair.tobytes().translate(CUTS), np.uint8)
    at = np.flatnonzero(cut == 2)
    at = at[(data[at - 1] <= 0xAF)]
    last = data[at - 1].astype(np.int64) | data[at - 2].astype(np.int64) << 8
    cut[at[np.isin(last, WIDE) | np.isin(last | data[at - 3].astype(np.int64) << 16, WIDE)]] = 0
    line = np.flatnonzero(data[:-1] == 10)
    cut[line[(cut[line] != 0) & (kind[line + 1] < HIGH)] + 1] = 1
    cut[edge] = 1
    start = np.flatnonzero(cut)
    pieces = pa.Array.from_buffers(pa.string(), len(start) - 1, [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(data)])
    return pieces, np.searchsorted(start, edge)


#: Longer pieces aren't held, so that memory doesn't grow with them.
SHORT = 64


class PieceEncoder:
    """Encodes whole texts with the tokenizers library, asking it once for each distinct piece of text.

    The public pattern of byte-level BPE cuts a text before it merges, so the ids of a text are those of its pieces
    (see ``cut_texts``). Pieces and their ids are held in two Arrow arrays, looked up and put together many at a time.
    Distinct words behind a space are encoded as one text of words that the tokens show again, other pieces one by one.
    Texts with a special token's string go to the library as they are.
    """

    def __init__(self, path: str, pattern: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = regex.compile(pattern).findall
        self.most = most
        spaced = np.zeros(1 << 16, bool)  # tokens that begin with a space
        spaced[[i for t, i in self.tokenizer.get_vocab().items() if t[0] == "\u0120"]] = True
        self.marks = {" ": spaced}
        # when too many were asked for since the last time, those that weren't go
        self.known, self.known_ids, self.asked = pa.array([], pa.string()), pa.array([], pa.binary()), np.zeros(0, bool)

    def _many(self, words: list[str], sign: str) -> list[bytes]:
        """Ids of sign + word for words of letters alone."""
        groups = [words[i : i + 64] for i in range(0, len(words), 64)]
        out: list[bytes] = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([sign + sign.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u2")
            edge = [*(2 * np.flatnonzero(self.marks[sign][ids])).tolist(), 2 * len(ids)]
            if len(edge) != len(group) + 1:
                raise RuntimeError("the tokens don't show where the words begin")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(edge, edge[1:])]
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, by the pieces that the pattern itself cuts."""
        cut = [self.pieces(x) for x in texts]
        fresh = list({p for pieces in cut for p in pieces})
        ids = {p: np.array(e.ids, "<u2").tobytes() for p, e in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False))}
        return [b"".join([ids[p] for p in pieces]) for pieces in cut]

    def _learn(self, fresh: list[str]) -> list[bytes]:
        """Ids of each piece."""
        worded = [x[0] == " " and x[1:].isalpha() for x in fresh]
        words = iter(self._many([x[1:] for x, w in zip(fresh, worded) if w], " "))
        others = iter(self._plain([x for x, w in zip(fresh, worded) if not w]))
        return [next(words) if w else next(others) for w in worded]

    def encode_array(self, texts: pa.Array) -> pa.BinaryArray:
        """Ids of each text as little-endian 16-bit integers."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        marked = {}
        for s in self.special:
            for i in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist():
                marked[i] = None
        if marked:
            for i in marked:
                marked[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u2").tobytes()
            hit = np.zeros(len(texts), bool)
            hit[list(marked)] = True
            texts = pc.if_else(pa.array(hit), "", texts)
        if self.asked.sum() > self.most:
            kept = pa.array(self.asked)
            self.known, self.known_ids, self.asked = self.known.filter(kept), self.known_ids.filter(kept), np.zeros(self.asked.sum(), bool)
        pieces, first = cut_texts(texts)
        coded = pieces.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        fresh = coded.dictionary.filter(place.is_null())
        place = pc.fill_null(place, -1).to_numpy().copy()
        place[place < 0] = len(self.known) + np.arange(len(fresh))
        fresh_ids = pa.array(self._learn(fresh.to_pylist()), pa.binary())
        ids = pa.concat_arrays([self.known_ids, fresh_ids]).take(pa.array(place)).take(coded.indices)
        self.asked[place[place < len(self.known)]] = True
        short = pc.less_equal(pc.binary_length(fresh), SHORT)
        self.known, self.known_ids = pa.concat_arrays([self.known, fresh.filter(short)]), pa.concat_arrays([self.known_ids, fresh_ids.filter(short)])
        self.asked = np.concatenate([self.asked, np.ones(len(self.known) - len(self.asked), bool)])
        edge = np.frombuffer(ids.buffers()[1], np.int32)[first]
        out = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(edge), ids.buffers()[2]])
        return pc.if_else(pa.array(hit), pa.array([marked.get(i) for i in range(len(texts))], pa.binary()), out) if marked else out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The same as a list."""
        return self.encode_array(texts).to_pylist()


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def _encoder(tokenizer: str, pattern: str) -> PieceEncoder:
    """One encoder for each worker process: later tasks know the pieces of earlier ones."""
    if (tokenizer, pattern) not in _encoders:
        _encoders[tokenizer, pattern] = PieceEncoder(tokenizer, pattern)
    return _encoders[tokenizer, pattern]


#: Bytes of a shard's ids, about; more bytes make more shards, not larger ones. A document counts ROW bytes besides its ids.
SHARD_BYTES, ROW = 128 << 20, 64


def shard_bounds(encoded: DataFrame, least: int, each: int = 32, seed: int = 10) -> np.ndarray:
    """Ids at which the encoded documents fall into ranges of about equal bytes: ``least`` ranges or one for each SHARD_BYTES.

    Only ids and sizes are read; rows are drawn by their size, about ``each`` for each range, and only these ids reach the
    driver. They shape the files, never what these hold.
    """
    rows = encoded.select("doc_id", F.col("size").alias("size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(least, total // SHARD_BYTES)
    drawn = rows.where((F.rand(seed) < F.col("size") * (each * shards / max(1, total))) & F.col("doc_id").isNotNull())
    seen = np.sort(drawn.select("doc_id").toArrow().column("doc_id").to_numpy())
    at = np.arange(1, shards) * len(seen) // shards
    return np.unique(seen[at[at < len(seen)]])


def in_shards(encoded: DataFrame, bounds: np.ndarray) -> DataFrame:
    """``encoded`` with the shard of each document: the range of ``bounds`` that its doc_id lies in (null: the first).

    The bounds below an id are counted in blocks of about the square root of their number, then within one block.
    """
    width = max(1, math.isqrt(len(bounds)))
    fixed = lambda values: F.from_json(F.lit(json.dumps(values.tolist())), "array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("doc_id")))
    rows = encoded.withColumn("_block", below(fixed(bounds[width - 1 :: width])))
    within = below(F.slice(fixed(bounds), F.col("_block") * width + 1, F.lit(width)))
    return rows.withColumn("shard", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("_block") * width + within)).drop("_block")


def encode_documents(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0, n_ids: int = 1 << 16) -> DataFrame:
    """(kind, doc_id, size, ids binary).

    Kind 0: 16-bit ids of every whole text with the end id behind them, and their bytes with ROW more; null counts as
    empty. Kind 1: one row for each task, how often it saw each id, as 64-bit integers.
    """
    tail = np.array([end_id], "<u2").tobytes()
    names = ["kind", "doc_id", "size", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, "<i8")
        for b in joined(batches, 1, 20 << 20):
            for part in by_bytes(b, 1, 20 << 20):
                ids = pc.binary_join_element_wise(_encoder(tokenizer, pattern).encode_array(part.column(1)), tail, b"")
                total += np.bincount(np.frombuffer(ids.buffers()[2], "<u2", np.frombuffer(ids.buffers()[1], np.int32)[len(ids)] // 2), minlength=n_ids)
                size = pc.add(pc.cast(pc.binary_length(ids), pa.int64()), ROW)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), part.column(0), size, ids], names)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "kind int, doc_id long, size long, ids binary")


def id_ranks(tallies: DataFrame, n_ids: int = 1 << 16) -> np.ndarray:
    """Ids in order of falling frequency over the whole corpus (ties: smaller id), from the rows of kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    counts = tallies.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    n = np.zeros(n_ids, np.int64)
    for i, c in counts.collect():  # a row for each token id
        n[i] = c
    return np.lexsort((np.arange(n_ids), -n))


SEGMENT = "shard int, segment int, start long, n_docs int, n_tokens long, doc_ids binary, no_id binary, lengths binary, control binary, data binary"


def write_token_files(encoded: DataFrame, path: str, by_rank: np.ndarray, partitions: int, segment_tokens: int = 1 << 19) -> None:
    """Write ids in ascending doc_id order (null first, ties by ids) as segments of about ``segment_tokens`` tokens.

    A shard is one range of doc_ids (see ``in_shards``). A segment holds the documents' ids and lengths, then the ranks of their tokens:
    control bytes and data bytes apart. ``start`` counts the shard's tokens before the segment.
    """
    rank_of = np.empty(len(by_rank), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = 0
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held, number, start = 0, 0, 0

        def segment() -> pa.RecordBatch:
            control, data = pack(rank_of[np.frombuffer(b"".join(tokens), "<u2")])
            lengths = np.array([len(x) // 2 for x in tokens], "<u4").tobytes()
            row = [shard, number, start, len(ids), held, np.array([x or 0 for x in ids], "<i8").tobytes(), np.packbits([x is None for x in ids]).tobytes(), lengths, control, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in SEGMENT.split(", ")])

        for b in batches:
            shard = b.column(2)[0].as_py() if b.num_rows else shard
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                tokens.append(x)
                held += len(x) // 2
                if held >= segment_tokens:
                    yield segment()
                    start, number, held, ids, tokens = start + held, number + 1, 0, [], []
        if ids:
            yield segment()

    ordered = encoded.repartitionById(partitions, F.col("shard")).sortWithinPartitions("doc_id", "ids")
    # Data bytes are codes already; a general compressor would gain little.
    ordered.select("doc_id", "ids", "shard").mapInArrow(run, SEGMENT).write.options(**UNIQUE).parquet(path)


def read_token_files(files: DataFrame, by_rank: np.ndarray, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the segments; start counts all tokens before.

    ids is binary, 32-bit integers; with ``digest`` its crc32 stands in its place as ids_crc32.
    """
    totals = dict(files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())  # a pair for each shard
    before, seen = {}, 0
    for shard in sorted(totals):
        before[shard], seen = seen, seen + totals[shard]
    table = by_rank.astype("<u4")
    last = "ids_crc32" if digest else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                raw = memoryview(table[unpack(r["control"], r["data"], r["n_tokens"])]).cast("B")
                n = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                end = np.cumsum(n)
                empty = np.unpackbits(np.frombuffer(r["no_id"], np.uint8))[: len(n)].astype(bool)
                cut = [raw[4 * (e - k) : 4 * e] for e, k in zip(end.tolist(), n.tolist())]
                ids = pa.array(list(map(zlib.crc32, cut)), pa.int64()) if digest else pa.array(list(map(bytes, cut)), pa.binary())
                columns = [pa.array(np.frombuffer(r["doc_ids"], "<i8"), pa.int64(), mask=empty), pa.array(before[r["shard"]] + r["start"] + end - n), pa.array(n), ids]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", last])

    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} " + ("long" if digest else "binary"))


def round_trip(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids or ids_crc32) of every document, as read back from token files in the shared folder.

    Null and empty texts hold the end id alone; repeated rows are written each; a null doc_id comes first; further
    columns are ignored; an empty table gives an empty file set and no rows.
    """
    spark = docs.sparkSession
    root = scratch_root(spark)
    encoded = f"{root}/ids-{uuid.uuid4().hex}"
    encode_documents(docs, tokenizer, pattern, end_id).write.options(**UNIQUE).partitionBy("kind").parquet(encoded)
    both = spark.read.schema("doc_id long, size long, ids binary, kind int").parquet(encoded)
    by_rank = id_ranks(both.where("kind = 1"))
    bounds = shard_bounds(both.where("kind = 0"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = f"{root}/tokens-{uuid.uuid4().hex}"
    write_token_files(in_shards(both.where("kind = 0"), bounds), path, by_rank, len(bounds) + 1)
    return read_token_files(spark.read.schema(SEGMENT).parquet(path), by_rank, digest)
