"""Fill-in-the-middle: texts cut at two ranks of their units, found in an indexable skip list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import by_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One node of EXPRESS reaches the lane above.
EXPRESS = 4


def _heights(low: int, high: int) -> np.ndarray:
    """Lanes above the bottom that the nodes before the units low to high - 1 reach: geometric, from a mixed rank; the head reaches all."""
    x = np.arange(low, high, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    height = np.zeros(high - low, np.int64)
    for k in range(1, 32):
        some = x % np.uint64(EXPRESS) == 0
        if not some.any():
            break
        height[some] = k
        x = np.where(some, x // np.uint64(EXPRESS), np.uint64(1))
    if not low:
        height[0] = 63
    return height


class Lanes:
    """The nodes of each express lane by their rank, and where each stands in the lane below.

    A node's height depends on its rank alone, so lists of all texts share these; they grow with the longest text met.
    """

    def __init__(self) -> None:
        self.known = 0
        self.nodes: list[np.ndarray] = []
        self.down: list[np.ndarray] = []

    def upto(self, n: int) -> None:
        if n < self.known:
            return
        size = max(2 * self.known, n + 1, 1 << 12)
        height = _heights(0, size)
        self.nodes = [np.flatnonzero(height >= k) for k in range(1, 1 + int(height[1:].max(initial=0)))]
        self.down = [self.nodes[0], *(np.searchsorted(a, b) for a, b in zip(self.nodes, self.nodes[1:]))]
        self.known = size


class IndexableSkipList:
    """Units of a text in order; each link of a lane carries how many units it passes and how many code points.

    ``sizes`` are the code points of each unit; None means one each. On the bottom lane a link passes one unit.
    """

    def __init__(self, n: int, sizes: np.ndarray | None, lanes: Lanes):
        lanes.upto(n)
        self.n, self.sizes, self.lanes = n, sizes, lanes
        before = None if sizes is None else np.concatenate([[0], np.cumsum(sizes)])
        self.width: list[tuple[np.ndarray, np.ndarray]] = []
        for nodes in lanes.nodes:
            own = np.append(nodes[: np.searchsorted(nodes, n)], n)
            if len(own) <= 2:  # the head's link alone
                break
            units = np.diff(own)
            self.width.append((units, units if before is None else np.diff(before[own])))

    def code_points(self, rank: int) -> int:
        """Code points before the unit number ``rank``: from the highest lane down, along each as far as its widths allow."""
        at = points = node = 0
        for lane in range(len(self.width) - 1, -1, -1):
            units, chars = self.width[lane]
            while node < len(units) and at + units[node] <= rank:
                at, points, node = at + int(units[node]), points + int(chars[node]), node + 1
            if at == rank:
                return points
            node = int(self.lanes.down[lane][node])
        while at < rank:
            points += 1 if self.sizes is None else int(self.sizes[at])
            at += 1
        return points


def _draw(seed: int, doc_id: Column, i: int) -> Column:
    """The i-th 8-digit group of the SHA-256 of seed:doc_id as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, carry: list[str] | None = None, unit: str | None = None, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """Columns ``carry`` (default: doc_id), n, form, prefix_chars, middle_chars, output.

    A text is cut into n units: its code points, or the matches of the pattern ``unit`` from left to right, which must
    cover it (what lies between matches belongs to the unit before). Four numbers h1 to h4 are drawn from the SHA-256 of
    ``seed``:doc_id. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger.
    Of 100 texts about ``rate`` are rearranged, of 100 of these ``spm`` with the suffix first ('spm', else 'psm'); a text
    that is empty or holds a sentinel stays as it is ('plain', with null lengths). Lengths are code points.

    Null counts as empty; a null id draws as the empty string; repeated ids draw alike; repeated rows get a row each; an
    empty table gives no rows; columns that aren't in ``carry`` are ignored.
    """
    carry = carry or ["doc_id"]
    k = len(carry)
    names = [f"c{i}" for i in range(k)]
    inner = T.StructType([*(T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, carry)), *(T.StructField(n, t) for n, t in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())))])
    pattern = None if unit is None else regex.compile(unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = Lanes()
        for whole in batches:
            for b in by_bytes(whole, k):
                rows = []
                for text, *draws in zip(*(b.column(k + i).to_pylist() for i in range(5))):
                    rows.append(_arranged(text or "", draws, pattern, lanes, rate, spm))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *columns], inner.names)

    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(carry, names)), F.col("text").cast("string").alias("_text"), *(_draw(seed, F.col("doc_id"), i).alias(f"_h{i}") for i in range(4)))
    return rows.mapInArrow(run, inner).withColumnsRenamed(dict(zip(names, carry)))


def _arranged(text: str, draws: list[int], pattern: regex.Pattern | None, lanes: Lanes, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    sizes = None
    n = len(text)
    if pattern is not None:
        starts = [m.start() for m in pattern.finditer(text)]
        starts[:1] = [0] if text else []
        sizes = np.diff(np.array([*starts, len(text)], np.int64)) if text else np.zeros(0, np.int64)
        n = len(sizes)
    if not text or draws[2] % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    units = IndexableSkipList(n, sizes, lanes)
    a, b = (units.code_points(r) for r in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(form: Column, output: Column) -> Column:
    """The text behind an output, from it and its form alone. Parts hold no sentinel, so each is met first where it was put."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        tail = F.substr(body, F.length(F.substring_index(body, second, 1)) + len(second) + 1)
        return F.substring_index(body, second, 1), F.substring_index(tail, MIDDLE, 1), F.substr(tail, F.length(F.substring_index(tail, MIDDLE, 1)) + len(MIDDLE) + 1)

    p, s, m = parts(PREFIX, SUFFIX)
    s2, p2, m2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)
