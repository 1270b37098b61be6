"""Benchmark decontamination by suffix arrays over the training texts."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.windows import running_total
from fleetlens.llm.common import scratch_root, utf8, words_of, written

WINDOW = 13
CHUNK = 16  # words that are compared at once; a window fits in
BLOCK = 1 << 20  # bytes of benchmark words in a block
#: Blocks that documents pass in one job; then the documents are written, and the blocks let go.
TOGETHER = 8


def _rows(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The CHUNK words from each start on; after a 0, where no match can pass, all are 0. ``text`` ends in CHUNK zeros."""
    rows = text[start[:, None] + np.arange(CHUNK)]
    rows[np.logical_or.accumulate(rows == 0, axis=1)] = 0
    return rows


def _keys(rows: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Rows as byte strings in the order of their words, behind the number of their group."""
    raw = rows.astype(">u4")
    if group is not None:
        raw = np.concatenate([group.astype(">u4")[:, None], raw], axis=1)
    return np.ascontiguousarray(raw).view(f"S{4 * raw.shape[1]}").ravel() if len(raw) else np.zeros(0, f"S{4 * raw.shape[1]}")


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal words that two sets of rows begin with."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def _padded(words: np.ndarray) -> np.ndarray:
    return np.concatenate([words, np.zeros(CHUNK, np.int32)]).astype(np.int32)


class SuffixArray:
    """Suffixes of a text of word ids in sorted order; the order beyond CHUNK words is found where it is asked for."""

    def __init__(self, text: np.ndarray, start: np.ndarray):
        keys = _keys(_rows(text, start))
        order = np.argsort(keys, kind="stable")
        self.text, self.start, self.keys = text, start[order], keys[order]

    def range(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")

    def longest(self, other: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, place): the longest match in this text for each suffix of ``other``, and where it stands.

        Each suffix is sought by binary search; its longest match is with a neighbour of its place. Where all words of
        a chunk agree, the suffixes that do are ordered by the next chunk and the search goes on among them.
        """
        length, place = np.zeros(len(position), np.int64), np.full(len(position), -1, np.int64)
        start, keys, group = self.start, self.keys, None
        live = np.arange(len(position))
        depth = 0
        while len(live) and len(start):
            rows = _rows(other, position[live] + depth)
            sought = _keys(rows, group)
            lo, hi = np.searchsorted(keys, sought, "left"), np.searchsorted(keys, sought, "right")
            for side in (lo, lo - 1):
                there = np.clip(side, 0, len(start) - 1)
                own = _rows(self.text, start[there] + depth)
                n = _common(rows, own)
                if group is not None:
                    n = np.where(groups[there] == group, n, 0)
                better = depth + n > length[live]
                length[live[better]], place[live[better]] = depth + n[better], start[there[better]]
            on = (hi > lo) & (rows[:, -1] != 0)
            if not on.any():
                break
            live, lo, hi = live[on], lo[on], hi[on]
            edge, group = np.unique(lo, return_inverse=True)  # equal ranges have equal starts
            end = np.zeros(len(edge), np.int64)
            end[group] = hi
            size = end - edge
            groups = np.repeat(np.arange(len(edge)), size)
            start = start[np.repeat(edge - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            depth += CHUNK
            keys = _keys(_rows(self.text, start + depth), groups)
            order = np.argsort(keys, kind="stable")
            start, keys, groups = start[order], keys[order], groups[order]
        return length, place


class TestBlock:
    """Some benchmark items, whole: their words one behind the other, a 0 behind each item."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str | None] = []
        edges, words = [0], []
        short = []
        for item, raw in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in raw.split()]
            short.append(len(own) < window)
            self.ids.append(item)
            words += [*own, 0]
            edges.append(len(words))
        text = np.array(words, np.int32)
        self.text, self.edge = _padded(text), np.array(edges, np.int64)
        self.suffixes = np.flatnonzero(text)
        self.item = np.searchsorted(self.edge, self.suffixes, "right") - 1
        left = self.edge[1:][self.item] - 1 - self.suffixes if len(self.suffixes) else self.suffixes
        opens = (left >= window) | (np.array(short, bool)[self.item] & (self.suffixes == self.edge[self.item])) if len(self.suffixes) else np.zeros(0, bool)
        at = np.flatnonzero(opens)
        rows = _rows(self.text, self.suffixes[at]) if len(at) else np.zeros((0, CHUNK), np.int32)
        rows[:, window:] = 0
        low = _keys(rows)
        self.low, first_of, number = np.unique(low, return_index=True, return_inverse=True)
        #: a suffix that opens each window, the window's words, and the items that hold it
        self.opening = at[first_of] if len(at) else at
        rows = rows[first_of] if len(at) else rows
        self.length = (rows != 0).sum(axis=1)
        held = np.unique(number * np.int64(max(1, len(self.ids))) + self.item[at]) if len(at) else np.zeros(0, np.int64)
        self.holder = held % max(1, len(self.ids))
        self.holder_from = np.searchsorted(held // max(1, len(self.ids)), np.arange(len(self.low) + 1))
        self.base = len(self.vocabulary) + 1
        self.double = self.pairs_of(self.text, self.suffixes)
        self.pairs = np.unique(self.double)
        self.single = np.unique(rows[self.length == 1, 0]) if len(rows) else np.zeros(0, np.int64)
        self._array: SuffixArray | None = None
        self._high: np.ndarray | None = None

    def pairs_of(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        return text[at].astype(np.int64) * self.base + text[at + 1]

    @property
    def array(self) -> SuffixArray:
        """The items' own suffix array, made in the task that asks first."""
        if self._array is None:
            self._array = SuffixArray(self.text, self.suffixes)
        return self._array

    @property
    def high(self) -> np.ndarray:
        """The last key that begins with each window."""
        if self._high is None:
            rows = self.low.view(">u4").reshape(-1, CHUNK).astype("<u4")
            self._high = _keys(np.where(rows == 0, np.uint32(0xFFFFFFFF), rows))
        return self._high

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_array": None, "_high": None}


def _among(values: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    if not len(allowed):
        return np.zeros(len(values), bool)
    at = np.searchsorted(allowed, values)
    return allowed[np.minimum(at, len(allowed) - 1)] == values


class TrainingShard:
    """Suffix array over the word ids of some documents.

    ``ids`` has a 0 for every word that no benchmark item has, and one behind each document, where no match can pass.
    It holds the suffixes that share two words with a test suffix, or the word of a one-word item.
    """

    def __init__(self, ids: np.ndarray, test: TestBlock):
        self.text = _padded(ids)
        known = np.flatnonzero(ids)
        pairs = test.pairs_of(self.text, known)
        some = ((self.text[known + 1] > 0) & _among(pairs, test.pairs)) | _among(self.text[known], test.single)
        self.array = SuffixArray(self.text, known[some])
        self.pairs = np.unique(pairs[some])

    def longest(self, test: TestBlock) -> tuple[np.ndarray, np.ndarray]:
        """(length, place) of the longest verbatim match of every test suffix; those without two words in common aren't sought."""
        length, place = np.zeros(len(test.suffixes), np.int64), np.full(len(test.suffixes), -1, np.int64)
        some = np.flatnonzero(_among(test.double, self.pairs) | _among(test.text[test.suffixes], test.single))
        length[some], place[some] = self.array.longest(test.text, test.suffixes[some])
        return length, place

    def places(self, test: TestBlock, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence of the windows whose suffix has a match that long: its range of the array."""
        window = np.flatnonzero(length[test.opening] >= test.length)
        lo, hi = self.array.range(test.low[window], test.high[window])
        count = np.maximum(hi - lo, 0)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(window, count), self.array.start[np.repeat(lo, count) + within]


def _intervals(covered: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of True, alternating."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).ravel()


def _shards(texts: list[bytes], test: TestBlock, words: int) -> Iterator[tuple[int, np.ndarray, TrainingShard]]:
    """(number of the first document, edges of the documents, shard) for every about ``words`` words."""
    get = test.vocabulary.get
    i = 0
    while i < len(texts):
        first, ids, edges = i, [], [0]
        while i < len(texts) and (i == first or len(ids) < words):
            ids += [get(w, 0) for w in words_of(texts[i])]
            ids.append(0)
            edges.append(len(ids))
            i += 1
        yield first, np.array(edges), TrainingShard(np.array(ids, np.int32), test)


def _scan(texts: list[bytes], test: TestBlock, words: int) -> Iterator[tuple[int, np.ndarray, list[str], int, int]]:
    """(words, covered runs, item ids, longest match, its start) of each text."""
    for _, edges, shard in _shards(texts, test, words):
        window, start = shard.places(test, shard.longest(test)[0])
        doc = np.searchsorted(edges, start, "right") - 1
        step = np.zeros(edges[-1] + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + test.length[window], -1)
        covered = np.cumsum(step)[:-1] > 0
        places, number = np.unique(start, return_inverse=True)
        length = np.zeros(len(places), np.int64)
        np.maximum.at(length, number, test.length[window])
        if len(places):  # a place of a whole window may go on; one of a shorter item is that item
            reach = test.array.longest(shard.text, places)[0]
            length = np.where(reach >= test.window, reach, length)
        hits = np.unique(doc * np.int64(max(1, len(test.low))) + window)
        hit_doc, hit_window = hits // max(1, len(test.low)), hits % max(1, len(test.low))
        at, at_place = np.searchsorted(hit_doc, np.arange(len(edges))), np.searchsorted(places, edges)
        for d in range(len(edges) - 1):
            own = hit_window[at[d] : at[d + 1]]
            n = int(edges[d + 1] - edges[d] - 1)
            if not len(own):
                yield n, np.zeros(0, np.int64), [], 0, -1
                continue
            names = {test.ids[p] for w in own for p in test.holder[test.holder_from[w] : test.holder_from[w + 1]]} - {None}
            best = at_place[d] + int(length[at_place[d] : at_place[d + 1]].argmax())
            yield n, _intervals(covered[edges[d] : edges[d + 1] - 1]), sorted(names), int(length[best]), int(places[best] - edges[d])


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, words) of every item that has words; equal rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [b" ".join(words_of(t)) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], ["item", "words"])

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "item string, words binary").where(F.octet_length("words") > 0).distinct()


def test_blocks(benchmark: DataFrame, window: int, block_bytes: int, together: int) -> Iterator[tuple[list[Broadcast], bool]]:
    """The benchmark in blocks of whole items, each fetched and broadcast alone, ``together`` at a time; True behind all but the last.

    Items stand in order of a hash, and a block takes those that begin within its ``block_bytes``, so it holds at most so much and
    one item more. Items are written once, by their block; blocks in which none begins don't exist.
    """
    spark = benchmark.sparkSession
    items = benchmark_items(benchmark).withColumn("bytes", F.octet_length("words").cast("long")).withColumn("place", F.struct(F.xxhash64("item", "words").alias("h"), "item", "words"))
    dealt = running_total(items, [], "place", "bytes", "behind").withColumn("block", F.floor((F.col("behind") - F.col("bytes")) / block_bytes))
    path = f"{scratch_root(spark)}/blocks-{uuid.uuid4().hex}"
    dealt.select("block", "item", "words").repartition("block").write.partitionBy("block").parquet(path)
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("words", T.BinaryType()), T.StructField("block", T.LongType())])
    stored = spark.read.schema(schema).parquet(path)
    blocks = sorted(r[0] for r in stored.select("block").distinct().collect())  # a number for each block_bytes of the benchmark
    if not blocks:
        yield [spark.sparkContext.broadcast(TestBlock([], window))], False
    held = []
    for k in blocks:
        rows = stored.where(F.col("block") == k).collect()
        order = sorted(((r.item, bytes(r.words)) for r in rows), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        held.append(spark.sparkContext.broadcast(TestBlock(order, window)))
        if len(held) == together or k == blocks[-1]:
            yield held, k != blocks[-1]
            held = []


def _united(parts: list[np.ndarray]) -> int:
    """Words covered by the union of several lists of runs."""
    runs = np.concatenate(parts).reshape(-1, 2)
    total, end = 0, -1
    for s, e in runs[np.argsort(runs[:, 0], kind="stable")].tolist():
        total += max(0, e - max(s, end))
        end = max(end, e)
    return total


def find_contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK, shard_words: int = 1 << 18) -> DataFrame:
    """Words of each document that stand inside a benchmark window, and the items they come from.

    A window is ``window`` (CHUNK at most) consecutive words of an item, or the whole of a shorter item. Training texts
    are cut into shards of about ``shard_words`` words inside the tasks that read them. In each shard's suffix array
    every test suffix is sought by binary search for its longest verbatim match; where that is as long as a window,
    the range of the array around it holds all the window's places. Documents are never shuffled. The benchmark is a
    query set: it is taken in blocks of about ``block_bytes``, of which TOGETHER are broadcast at once.

    Returns the columns ``carry`` (default: doc_id) and n_words, n_hit, n_items, items_sha256, contaminated, longest_match
    (words of the longest verbatim match of a window's length or more, 0 without), longest_at (its first word, null
    without), runs (starts and ends of the covered words, alternating;
    they may overlap between blocks) and items. Null and empty texts have no words; items without words never occur;
    windows of items without id count as hits but name no item; item ids count once however often they appear;
    repeated documents get a row each; an empty benchmark contaminates nothing; an empty table gives no rows.
    """
    if not 0 < window <= CHUNK:
        raise ValueError(f"a window has 1 to {CHUNK} words")
    carry = carry or ["doc_id"]
    k = len(carry)
    names = [f"c{i}" for i in range(k)]
    kept = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, carry)]
    state = [T.StructField("n", T.LongType()), T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()), T.StructField("at", T.LongType())]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), *state])
    empty = [F.lit(0).cast("long"), F.array().cast("array<bigint>"), F.array().cast("array<string>"), F.lit(0).cast("long"), F.lit(None).cast("long")]
    frame = docs.select(*(F.col(c).alias(n) for c, n in zip(carry, names)), F.col("text").cast("string").alias("text"), *(e.alias(f.name) for e, f in zip(empty, state)))
    for blocks, more in test_blocks(benchmark, window, block_bytes, TOGETHER):

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks, more=more) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                texts = utf8(b.column(k))
                n, (runs, items, longest, at) = [], [b.column(k + i).to_pylist() for i in range(2, 6)]
                for shared in blocks:
                    n = []
                    for d, (words, covered, names, length, place) in enumerate(_scan(texts, shared.value, shard_words)):
                        n.append(words)
                        if length:
                            runs[d] = [*runs[d], *covered.tolist()]
                            items[d] = sorted({*items[d], *names})
                            if not longest[d] or (-length, place) < (-longest[d], at[d]):
                                longest[d], at[d] = length, place
                text = b.column(k) if more else pa.nulls(b.num_rows, pa.string())
                made = zip((n, runs, items, longest, at), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.columns[:k], text, *(pa.array(x, t) for x, t in made)], schema.names)

        frame = frame.mapInArrow(run, schema)
        if more:
            frame = written(frame, "scanned")
            for shared in blocks:
                shared.unpersist()
    added = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("longest_match", T.LongType()), ("longest_at", T.LongType()), ("runs", T.ArrayType(T.LongType())), ("items", T.ArrayType(T.StringType()))]
    out = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(carry, kept)), *(T.StructField(n, t) for n, t in added)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, runs, items = (b.column(k + i).to_pylist() for i in range(1, 4))
            hit = [_united([np.array(r, np.int64)]) if r else 0 for r in runs]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            bad = [h > 0 and 20 * h >= n for h, n in zip(hit, words)]
            columns = [*b.columns[:k], b.column(k + 1), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_()), b.column(k + 4), b.column(k + 5), b.column(k + 2), b.column(k + 3)]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    return frame.mapInArrow(finish, out)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, block_bytes: int = BLOCK, shard_words: int = 1 << 18) -> DataFrame:
    """(item, item_at, length, doc_id, doc_at): the longest verbatim match over all documents of each test suffix that has one of ``least`` words.

    Suffixes whose match only continues that of the suffix before are left out. Tasks return the best of their shards;
    ties go to the smallest doc_id, then place. Null ids are kept as null; other oddities as in ``find_contamination``.
    """
    best = F.struct((-F.col("length")).alias("n"), "doc_id", "doc_at")
    schema = "item string, item_at long, length long, doc_id long, doc_at long"
    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], schema)
    for blocks, _ in test_blocks(benchmark, WINDOW, block_bytes, TOGETHER):

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = utf8(b.column(1))
                for test in (shared.value for shared in blocks):
                    item = np.array(test.ids, object)
                    for number, edges, shard in _shards(texts, test, shard_words):
                        length, place = shard.longest(test)
                        follows = np.zeros(len(length), bool)
                        follows[1:] = (np.diff(test.suffixes) == 1) & (length[:-1] == length[1:] + 1)
                        some = np.flatnonzero((length >= least) & ~follows)
                        doc = np.searchsorted(edges, place[some], "right") - 1
                        own = test.item[some]
                        columns = [pa.array(item[own], pa.string()), pa.array(test.suffixes[some] - test.edge[own]), pa.array(length[some]), b.column(0).take(pa.array(number + doc)), pa.array(place[some] - edges[doc])]
                        yield pa.RecordBatch.from_arrays(columns, ["item", "item_at", "length", "doc_id", "doc_at"])

        found = ids.mapInArrow(run, schema).groupBy("item", "item_at").agg(F.min(best).alias("b"))
        out = out.unionByName(written(found.select("item", "item_at", (-F.col("b.n")).alias("length"), "b.doc_id", "b.doc_at"), "longest"))
        for shared in blocks:
            shared.unpersist()
    # equal ids of items in several blocks
    return out.groupBy("item", "item_at").agg(F.min(best).alias("b")).select("item", "item_at", (-F.col("b.n")).alias("length"), "b.doc_id", "b.doc_at")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their own columns, whatever their names; see ``find_contamination`` for odd input."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    marked = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    kept = find_contamination(marked, benchmark, names).where("not contaminated")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
