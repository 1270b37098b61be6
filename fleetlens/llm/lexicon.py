"""A minimal acyclic automaton over frequent words whose outputs lead to token ids, and exact BPE merging."""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence

import numpy as np


class Lexicon:
    """Words and their token ids in one memory-mapped file.

    The automaton shares prefixes and suffixes. Each arc carries the number of words that sort before it, so the sum
    along a word's path is the word's number, under which its ids are stored. Lookups walk all words at once.
    """

    @staticmethod
    def write(path: str, words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> None:
        order = sorted(range(len(words)), key=words.__getitem__)
        final, arcs = _minimal([words[i] for i in order])
        counts: dict[int, int] = {}

        def count(state: int) -> int:
            stack = [state]
            while stack:
                s = stack[-1]
                todo = [t for t in arcs[s].values() if t not in counts]
                if todo:
                    stack += todo
                else:
                    counts[s] = final[s] + sum(counts[t] for t in arcs[s].values())
                    stack.pop()
            return counts[state]

        count(0)
        number = {s: i for i, s in enumerate(counts.keys() - {0}, 1)} | {0: 0}
        key, target, add = [], [], []
        for s in sorted(number, key=number.get):
            before = int(final[s])
            for byte, t in sorted(arcs[s].items()):
                key.append(number[s] * 256 + byte)
                target.append(number[t])
                add.append(before)
                before += counts[t]
        ends = [0] * len(number)
        for s, i in number.items():
            ends[i] = int(final[s])
        own = [ids[i] for i in order]
        start = np.concatenate([[0], np.cumsum([len(x) for x in own])]) if own else np.zeros(1)
        parts = [key, target, add, ends, start, [i for x in own for i in x]]
        longest = max(map(len, words), default=0)
        with open(path, "wb") as f:
            np.array([longest, *map(len, parts)], "<i8").tofile(f)
            for p in parts:
                np.asarray(p, "<i8").tofile(f)

    def __init__(self, path: str):
        data = np.memmap(path, "<i8", mode="r")
        self.longest, *sizes = data[:7].tolist()
        edges = 7 + np.concatenate([[0], np.cumsum(sizes)])
        flat = data.view(np.ndarray)  # still mapped, without the subclass's cost at every access
        self.key, self.target, self.add, self.final, self.start, self.ids = (flat[a:b] for a, b in zip(edges, edges[1:]))

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word, or -1."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        out = np.full(n, -1, np.int64)
        if not len(self.key):
            return out
        live = np.flatnonzero((length > 0) & (length <= self.longest))
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        at = np.cumsum(length) - length
        state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for place in range(self.longest):
            live = live[length[live] > place]
            if not len(live):
                break
            want = state[live] * 256 + text[at[live] + place]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            found = self.key[arc] == want
            live, arc = live[found], arc[found]
            state[live] = self.target[arc]
            number[live] += self.add[arc]
            done = live[(length[live] == place + 1)]
            done = done[self.final[state[done]] == 1]
            out[done] = number[done]
        return out

    def ids_of(self, numbers: np.ndarray) -> list[bytes]:
        """Ids of the words with these numbers as little-endian 32-bit integers."""
        start = self.start[numbers]
        size = self.start[numbers + 1] - start
        end = np.cumsum(size)
        raw = self.ids[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)].astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip((4 * (end - size)).tolist(), (4 * end).tolist())]


def _minimal(words: list[bytes]) -> tuple[list[bool], list[dict[int, int]]]:
    """States (final, arcs) of the minimal automaton of sorted distinct words; state 0 is the start."""
    final: list[bool] = [False]
    arcs: list[dict[int, int]] = [{}]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (parent, byte, child) of the last word, not yet shared

    def share(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            arcs[parent][byte] = register.setdefault((final[child], tuple(arcs[child].items())), child)

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        share(common)
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            final.append(False)
            arcs.append({})
            arcs[state][byte] = len(final) - 1
            path.append((state, byte, len(final) - 1))
            state = len(final) - 1
        final[state] = True
        last = word
    share(0)
    return final, arcs


def byte_letters() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    fresh = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(fresh)) for b in range(256)]


#: Longer words are merged one by one.
MATRIX = 64
NONE = 1 << 60


class Merger:
    """Exact BPE merging of words: always the earliest-learnt pair, the leftmost first."""

    def __init__(self, tokenizer_json: str):
        with open(tokenizer_json, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {self.vocab[a] << 20 | self.vocab[b]: r << 20 | self.vocab[a + b] for r, (a, b) in enumerate(pairs)}
        order = sorted(self.merges)
        self.pairs, self.made = np.array([*order, NONE]), np.array([*map(self.merges.get, order), NONE])  # no pair is as large as the last
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]

    def ids(self, word: bytes) -> list[int]:
        if not word:
            return []
        inner = self.inner
        have = [inner[b] for b in word[:-1]]
        have.append(self.last[word[-1]])
        if len(have) > MATRIX:
            return self._long(have)
        get, none = self.merges.get, NONE
        rank = [get(a << 20 | b, none) for a, b in zip(have, have[1:])]
        while rank:
            low = min(rank)
            if low == none:
                break
            i = rank.index(low)
            have[i] = new = low & 0xFFFFF
            del have[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(new << 20 | have[i + 1], none)
            if i:
                rank[i - 1] = get(have[i - 1] << 20 | new, none)
        return have

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair of ids becomes, with its rank above it; NONE if it stays."""
        pair = left << 20 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.made[at], NONE)

    def many(self, words: Sequence[bytes], block: int = 1 << 15) -> list[bytes]:
        """``ids`` of each word as little-endian 32-bit integers; ``block`` words at a time bound the memory."""
        return [x for at in range(0, len(words), block) for x in self._block(words[at : at + block])]

    def _block(self, words: Sequence[bytes]) -> list[bytes]:
        """Words of as many ids stand in one matrix.

        A step merges one pair in every row, so what is left has one id less and meets the words that began with that
        many; rows without a pair are done.
        """
        out = [b""] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(length > MATRIX).tolist():
            out[i] = np.array(self.ids(words[i]), "<u4").tobytes()
        inner, last = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        order = np.argsort(length, kind="stable")
        edges = np.searchsorted(length[order], np.arange(MATRIX + 2))
        row = np.zeros(0, np.int64)
        have, rank = np.zeros((0, MATRIX + 1), np.int64), np.zeros((0, MATRIX), np.int64)
        for size in range(MATRIX, 0, -1):
            if len(row):  # one merge in every row that is left
                n = np.arange(len(row))
                best = rank.argmin(1)
                new = rank[n, best] & 0xFFFFF
                keep = np.ones(have.shape, bool)
                keep[n, best + 1] = False
                have = have[keep].reshape(len(row), size)
                have[n, best] = new
                keep = np.ones(rank.shape, bool)
                keep[n, best] = False
                rank = rank[keep].reshape(len(row), size - 1)
                a, b = np.flatnonzero(best > 0), np.flatnonzero(best < size - 1)
                rank[a, best[a] - 1] = self._merged(have[a, best[a] - 1], new[a])
                rank[b, best[b]] = self._merged(new[b], have[b, best[b] + 1])
            else:
                have, rank = have[:, :size], rank[:, : size - 1]
            if len(more := order[edges[size] : edges[size + 1]]):
                text = np.frombuffer(b"".join([words[i] for i in more.tolist()]), np.uint8).reshape(len(more), size)
                fresh = inner[text]
                fresh[:, -1] = last[text[:, -1]]
                row = np.concatenate([row, more])
                have = np.concatenate([have, fresh])
                rank = np.concatenate([rank, self._merged(fresh[:, :-1], fresh[:, 1:])])
            if not len(row):
                continue
            done = rank.min(1, initial=NONE) == NONE
            raw, step = have[done].astype("<u4").tobytes(), 4 * size
            for k, i in enumerate(row[done].tolist()):
                out[i] = raw[k * step : (k + 1) * step]
            row, have, rank = row[~done], have[~done], rank[~done]
        return out

    def _long(self, have: list[int]) -> list[int]:
        """The same by a heap, for words whose length squared would count."""
        n = len(have)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merges.get
        heap = [(m >> 20, i, have[i], have[i + 1], m & 0xFFFFF) for i in range(n - 1) if (m := get(have[i] << 20 | have[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if have[i] != a or j >= n or have[j] != b:
                continue
            have[i], have[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := get(new << 20 | have[k])) is not None:
                    heapq.heappush(heap, (m >> 20, i, new, have[k], m & 0xFFFFF))
            if (h := before[i]) >= 0 and (m := get(have[h] << 20 | new)) is not None:
                heapq.heappush(heap, (m >> 20, h, have[h], new, m & 0xFFFFF))
        return [x for x in have if x >= 0]
