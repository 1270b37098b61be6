"""Runs of words that repeat with a period, by the branching-tandem test over enhanced suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import by_bytes, utf8

EXPONENT = 4  # a run is at least so many periods long
LEAST = 6  # and so many words
#: Words whose suffix arrays are built at once; a longer text is built alone.
TOGETHER = 1 << 18
#: Words compared at once when a square is rotated; the last size repeats.
STRIDES = (1, 4, 16, 64)


class EnhancedSuffixArray:
    """Suffix array, its inverse and LCP values of several texts of symbols, one behind the other.

    Symbols of different texts count as different, so no two suffixes agree across texts or over a text's end. The order
    comes from prefix doubling, where suffixes that stand alone drop out; ``ranks[k]`` names the classes of suffixes that
    agree in their first 2^k symbols.
    """

    def __init__(self, symbols: np.ndarray, text: np.ndarray):
        n = len(symbols)
        key = text.astype(np.int64) * (int(symbols.max(initial=0)) + 1) + symbols
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[True], np.diff(key[order]) != 0]) if n else np.zeros(0, bool)
        rank = np.zeros(n + 1, np.int32)
        rank[n] = -1  # behind the last text
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        self.symbols = np.append(rank[:n], -1)  # equal where symbol and text are
        self.ranks = [rank]
        live = order[~(fresh & np.append(fresh[1:], True))] if n else order
        width = 1
        while len(live):
            rank = self.ranks[-1].copy()
            own = rank[live].astype(np.int64)
            key = own * (n + 2) + rank[np.minimum(live + width, n)] + 1
            by = np.argsort(key, kind="stable")
            live, own, key = live[by], own[by], key[by]
            fresh = np.concatenate([[True], np.diff(key) != 0])
            place = np.arange(len(live))
            opens = np.concatenate([[True], np.diff(own) != 0])
            within = place - np.maximum.accumulate(np.where(opens, place, 0))
            rank[live] = own + np.maximum.accumulate(np.where(fresh, place, 0)) - (place - within)
            self.ranks.append(rank)
            live = live[~(fresh & np.append(fresh[1:], True))]
            width *= 2
        self.inverse = self.ranks[-1][:n]
        self.array = np.empty(n, np.int64)
        self.array[self.inverse] = np.arange(n)
        self.lcp = np.zeros(n, np.int64)
        self.lcp[1:] = self.common(self.array[:-1], self.array[1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes from a and from b begin with in common (a and b differ)."""
        end = len(self.ranks[0]) - 1
        top = np.full(len(a), -1)
        some = np.arange(len(a))
        for k, rank in enumerate(self.ranks):
            some = some[rank[a[some]] == rank[b[some]]]
            if not len(some):
                break
            top[some] = k
        length = np.zeros(len(a), np.int64)
        for k in range(int(top.max(initial=-1)), -1, -1):
            at = np.flatnonzero(top >= k)
            x, y = np.minimum(a[at] + length[at], end), np.minimum(b[at] + length[at], end)
            length[at[(self.ranks[k][x] == self.ranks[k][y]) & (x < end) & (y < end)]] += 1 << k
        return length

    def halves(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(depth, begin, middle, end): LCP intervals cut in two, [begin, middle) and [middle, end) of the array.

        Suffixes of the two sides agree in exactly ``depth`` symbols, and each two suffixes that agree in some are on
        two sides once: an interval of several children is cut off child by child. Intervals of fewer than ``least``
        suffixes are left out.
        """
        value = self.lcp.tolist()
        begin, end = [0] * len(value), [len(value)] * len(value)
        stack: list[int] = []
        for k, d in enumerate(value):
            while stack and value[stack[-1]] >= d:
                end[stack.pop()] = k
            if d:
                begin[k] = stack[-1] if stack else last
                stack.append(k)
            else:
                last = k
        begin, end = np.array(begin, np.int64), np.array(end, np.int64)
        middle = np.flatnonzero((self.lcp > 0) & (end - begin >= least))
        return self.lcp[middle], begin[middle], middle, end[middle]

    def branching_squares(self, exponent: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) of squares that can't be shifted right and lie in a run of ``exponent`` periods.

        For each LCP interval the suffixes i of its smaller side are tried: is i + depth or i - depth, looked up in the
        inverse array, on the other side? Then the two stand a period apart and differ right behind the square.
        """
        depth, begin, middle, end = self.halves(exponent)
        left = middle - begin <= end - middle
        low, high = np.where(left, begin, middle), np.where(left, middle, end)
        # of a run's suffixes all but the last whole period's start with its square: one side has exponent - 1 of them
        some = np.maximum(middle - begin, end - middle) >= exponent - 1
        depth, low, high, begin, end, left = depth[some], low[some], high[some], np.where(left, middle, begin)[some], np.where(left, end, middle)[some], left[some]
        n = len(self.array)
        places, periods = [], []
        size = high - low
        total = np.cumsum(size)
        at = 0
        while at < len(size):  # some intervals at once, about TOGETHER suffixes
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 4 * TOGETHER, "right")))
            k = np.repeat(np.arange(at, to), size[at:to])
            i = self.array[np.arange(len(k)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to]) + low[k]]
            for shift in (1, -1):
                j = i + shift * depth[k]
                able = np.flatnonzero((j >= 0) & (j < n))
                there = self.inverse[j[able]]
                hit = able[(there >= begin[k[able]]) & (there < end[k[able]])]
                places.append(np.minimum(i[hit], j[hit]))
                periods.append(depth[k[hit]])
            at = to
        place, period = np.concatenate([*places, np.zeros(0, np.int64)]), np.concatenate([*periods, np.zeros(0, np.int64)])
        first = place - (exponent - 2) * period  # where the run's last ``exponent`` periods begin
        some = np.flatnonzero(first >= 0)
        some = some[self.common(first[some], first[some] + period[some]) == (exponent - 1) * period[some]]
        return place[some], period[some]

    def rotated(self, place: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How far each square can be rotated left: the symbols before it and before its second half agree so long."""
        far = np.zeros(len(place), np.int64)
        live = np.arange(len(place))
        stride = 0
        while len(live):
            step = STRIDES[min(stride, len(STRIDES) - 1)]
            stride += 1
            x = (place[live] - far[live])[:, None] - 1 - np.arange(step)
            same = (x >= 0) & (self.symbols[np.maximum(x, 0)] == self.symbols[np.maximum(x + period[live][:, None], 0)])
            whole = same.all(axis=1)
            far[live] += np.where(whole, step, same.argmin(axis=1))
            live = live[whole]
        return far


def runs_in(symbols: np.ndarray, text: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of several texts, ordered by start and period.

    The squares of a run end at the same place. They are rotated from the shortest on; a longer one that lies in a run
    found already, of a period that divides its own, is no run of its own.
    """
    esa = EnhancedSuffixArray(symbols, text)
    place, period = esa.branching_squares(exponent)
    end = place + 2 * period
    by = np.lexsort([period, end])
    place, period, end = place[by], period[by], end[by]
    fresh = np.concatenate([[True], (np.diff(end) != 0) | (np.diff(period) != 0)]) if len(end) else np.zeros(0, bool)
    place, period, end = place[fresh], period[fresh], end[fresh]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(end):
        opens = np.concatenate([[True], np.diff(end) != 0])
        first = np.flatnonzero(opens)
        start = place[first] - esa.rotated(place[first], period[first])
        found.append((start, end[first] - start, period[first]))
        of = np.cumsum(opens) - 1
        inside = (period % period[first][of] == 0) & (place >= start[of])
        rest = ~opens & ~inside
        place, period, end = place[rest], period[rest], end[rest]
    start, length, period = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    some = np.flatnonzero(length >= np.maximum(least, exponent * period))
    some = some[np.lexsort([period[some], start[some]])]
    return start[some], length[some], period[some]


def _batches(lists: list[list[bytes]], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` words."""
    at = 0
    while at < len(lists):
        to, words = at, 0
        while to < len(lists) and (to == at or words + len(lists[to]) <= most):
            words += len(lists[to])
            to += 1
        yield at, to
        at = to


def _found(lists: list[list[bytes]], exponent: int, least: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """(runs, collapsed text) of each list of words."""
    for at, to in _batches(lists, TOGETHER):
        own = lists[at:to]
        number: dict[bytes, int] = {}
        symbols = np.array([number.setdefault(w, len(number)) for words in own for w in words], np.int64)
        size = np.fromiter(map(len, own), np.int64, len(own))
        edge = np.concatenate([[0], np.cumsum(size)])
        start, length, period = runs_in(symbols, np.repeat(np.arange(len(own)), size), exponent, least)
        step = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(step, start + period, 1)
        np.add.at(step, start + length, -1)
        kept = np.cumsum(step)[:-1] == 0
        bounds = np.searchsorted(start, edge)
        for d, words in enumerate(own):
            a, b = bounds[d], bounds[d + 1]
            if a == b:
                yield [], b" ".join(words)
            else:
                runs = list(zip((start[a:b] - edge[d]).tolist(), length[a:b].tolist(), period[a:b].tolist()))
                yield runs, b" ".join([words[i] for i in np.flatnonzero(kept[edge[d] : edge[d + 1]]).tolist()])


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def collapse_runs(docs: DataFrame, carry: list[str] | None = None, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """Columns ``carry`` (default: doc_id), n_words, runs and collapsed of every document.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of consecutive words with smallest period q, of ``least`` words
    and ``exponent`` (3 at least) periods or more, that no neighbouring word extends. ``runs`` lists start (word number from
    0), length and period by start, then period; ``collapsed`` has the words that no run contains behind its first period,
    joined by single spaces. Texts are never shuffled; each is whole in one task, in time n log n whatever its repeats, and
    in memory of 4 bytes a word for each doubling up to the longest repeat within a text.

    Null and empty texts have no words, no runs and collapse to the empty text; repeated rows and null ids get a row each;
    an empty table gives no rows; columns that aren't in ``carry`` are ignored.
    """
    if exponent < 3 or least < 1:
        raise ValueError("a run has 3 periods and a word at least")
    carry = carry or ["doc_id"]
    names = [f"c{i}" for i in range(len(carry))]
    inner = T.StructType([*(T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, carry)), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, len(carry), 4 << 20):
                lists = [t.split() for t in utf8(b.column(len(carry)))]
                runs, collapsed = zip(*_found(lists, exponent, least))
                rows = [[dict(zip(RUN.names, r)) for r in rs] for rs in runs]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(list(map(len, lists)), pa.int64()), pa.array(rows, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], inner.names)

    out = docs.select(*(F.col(c).alias(n) for c, n in zip(carry, names)), F.col("text").cast("string").alias("_text")).mapInArrow(run, inner)
    return out.withColumnsRenamed(dict(zip(names, carry)))
