"""Spikes and incidents of a host's samples, by the stretches between candidates.

A sample with an earlier one in the window has a baseline, their mean. It is quiet if the baseline is under the floor, high
if it reaches the threshold (the baseline and ``percent`` more), else low. A candidate is the stretch from a high sample to
its end: a quiet sample, a low one too long behind the last high one, or the first sample beyond its greatest age. Within a
candidate the spike fires at the first sample at which it has lasted, is high often enough, and the last event is
long enough ago. Between candidates an incident ends where samples stay below the threshold of its onset.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

import numpy as np


@dataclass(frozen=True)
class SpikeConfig:
    window_s: float = 1800
    percent: float = 50
    duration_s: float = 120
    coverage: float = 0.7
    floor: float = 1.0
    min_gap_s: float = 3600


@dataclass(frozen=True)
class IncidentConfig:
    recovery_s: float = 300
    deferred_s: float = 900
    min_gap_s: float = 3600


#: A dip may last this share of the duration; a candidate ends after so many durations.
DIP, STALE = 0.5, 4
NONE = -1.0


@dataclass
class Carry:
    """What goes from one stretch of a host's samples to the next, all numbers; NONE where there is nothing."""

    since: float = NONE  # the open candidate: its start, last high sample, high and all samples, peak
    last_high: float = NONE
    high: float = 0.0
    seen: float = 0.0
    peak: float = 0.0
    last: float = NONE  # the last accepted event
    limit: float = NONE  # the incident: its threshold, whether it is on, since when it is below, the follow-up's time
    on: float = 0.0
    below: float = NONE
    due: float = NONE

    def close(self) -> None:
        self.since, self.last_high, self.high, self.seen, self.peak = NONE, NONE, 0.0, 0.0, 0.0

    def numbers(self) -> list[float]:
        return [float(x) for x in astuple(self)]


EMPTY = Carry().numbers()
WIDTH = len(fields(Carry))


class Stretch:
    """Some samples of a host in order of time, the first ``before`` of them only to fill the window."""

    def __init__(self, t: np.ndarray, active: np.ndarray, before: int, cfg: SpikeConfig):
        low = np.searchsorted(t, t - cfg.window_s, "left")
        place = np.arange(len(t))
        total = np.concatenate([[0.0], np.cumsum(active)])
        n = place - low
        base = np.where(n > 0, (total[place] - total[low]) / np.maximum(n, 1), np.nan)[before:]
        self.t, self.active, self.cfg = t[before:], active[before:], cfg
        with np.errstate(invalid="ignore"):
            self.threshold = base * (100 + cfg.percent) / 100
            self.heard = ~np.isnan(base)
            quiet = self.heard & (base < cfg.floor)
            high = self.heard & ~quiet & (self.active >= self.threshold)
        self.low = self.heard & ~quiet & ~high
        self.high_at, self.heard_at = np.flatnonzero(high), np.flatnonzero(self.heard)
        self.highs, self.counted = np.cumsum(high), np.cumsum(high | self.low)
        self.high, self.quiet = high, quiet

    def __len__(self) -> int:
        return len(self.t)

    def candidate_end(self, at: int, since: float, last_high: float) -> int:
        """Where the candidate that is open at sample ``at`` ends; the number of samples if it doesn't."""
        n = len(self)
        old = self.heard_at[np.searchsorted(self.heard_at, max(at, int(np.searchsorted(self.t, since + STALE * self.cfg.duration_s, "right")))) :][:1]
        end = int(old[0]) if len(old) else n
        own = slice(at, end)
        seen = np.maximum.accumulate(np.where(self.high[own], self.t[own], last_high)) if end > at else np.zeros(0)
        over = np.flatnonzero(self.quiet[own] | (self.low[own] & (self.t[own] - seen > DIP * self.cfg.duration_s)))
        return at + int(over[0]) if len(over) else end

    def fires(self, at: int, end: int, carry: Carry, gap: float) -> int | None:
        """The first sample of a candidate's stretch at which it fires."""
        lasted = (self.t[at:end] - carry.since >= self.cfg.duration_s) & ((carry.last < 0) | (self.t[at:end] - carry.last >= gap)) & (self.high | self.low)[at:end]
        some = at + np.flatnonzero(lasted)
        high, seen = carry.high + self.highs[some] - self._before(self.highs, at), carry.seen + self.counted[some] - self._before(self.counted, at)
        ripe = some[high / np.maximum(seen, 1) >= self.cfg.coverage]
        return int(ripe[0]) if len(ripe) else None

    @staticmethod
    def _before(sums: np.ndarray, at: int) -> int:
        return int(sums[at - 1]) if at else 0

    def extend(self, carry: Carry, at: int, end: int) -> None:
        """Counts a candidate's samples from ``at`` to ``end``."""
        if end <= at:
            return
        high = at + np.flatnonzero(self.high[at:end])
        carry.high += len(high)
        carry.seen += int(self.counted[end - 1]) - self._before(self.counted, at)
        if len(high):
            carry.last_high, carry.peak = float(self.t[high[-1]]), max(carry.peak, float(self.active[high].max()))

    def recovers(self, at: int, end: int, carry: Carry, recovery_s: float) -> int | None:
        """The sample between candidates at which the incident ends; ``carry.below`` follows."""
        some = at + np.flatnonzero(self.heard[at:end])
        if not len(some):
            return None
        under = self.active[some] < carry.limit
        # of each sample below, when that began: behind the last one that isn't
        fresh = under & ~np.concatenate([[carry.below >= 0], under[:-1]])
        start = np.where(fresh, self.t[some], NONE)
        start = np.maximum.accumulate(np.concatenate([[carry.below], start]))[1:]
        over = np.flatnonzero(under & (self.t[some] - start >= recovery_s))
        if len(over):
            return int(some[over[0]])
        carry.below = float(start[-1]) if under[-1] else NONE
        return None


def events_in(s: Stretch, carry: Carry, incident: IncidentConfig | None = None) -> list[tuple[str, float, float, float, float]]:
    """(kind, onset, at, value, coverage) of the events of a stretch; ``carry`` moves to its end.

    Kinds are activity_spike (value: the peak) and, with ``incident``, activity_drop, where an incident ends, and deferred, the follow-up
    that an accepted spike plans, if neither a later one plans anew nor the end comes first (value: the sample's count).
    """
    out: list[tuple[str, float, float, float, float]] = []
    gap = incident.min_gap_s if incident else s.cfg.min_gap_s

    def follow_up(a: int, b: int) -> None:
        """The follow-up, if it comes due at one of the samples a to b - 1."""
        if carry.due >= 0:
            k = max(a, int(np.searchsorted(s.t, carry.due, "left")))
            if k < b:
                out.append(("deferred", NONE, carry.due, float(s.active[k]), NONE))
                carry.due = NONE

    at, n = 0, len(s)
    while at < n:
        if carry.since >= 0:
            carry.below = NONE
            end = s.candidate_end(at, carry.since, carry.last_high)
            fired = s.fires(at, end, carry, gap)
            if fired is None:
                s.extend(carry, at, end)
                if end < n:
                    carry.close()
                follow_up(at, end)
                at = end
                continue
            follow_up(at, fired)
            s.extend(carry, at, fired + 1)
            t = float(s.t[fired])
            out.append(("activity_spike", carry.since, t, carry.peak, carry.high / carry.seen))
            carry.close()
            carry.last = t
            if incident:
                carry.on, carry.due = 1.0, t + incident.deferred_s if incident.deferred_s > 0 else NONE
            at = fired + 1
            continue
        opens = s.high_at[np.searchsorted(s.high_at, at) :][:1]
        end = int(opens[0]) if len(opens) else n
        if carry.on and incident and incident.recovery_s > 0:
            over = s.recovers(at, end, carry, incident.recovery_s)
            if over is not None:
                follow_up(at, over)
                t = float(s.t[over])
                out.append(("activity_drop", NONE, t, float(s.active[over]), NONE))
                carry.on, carry.below, carry.due, carry.last = 0.0, NONE, NONE, t
        elif s.heard[at:end].any():
            carry.on, carry.below = 0.0, NONE
        follow_up(at, end)
        if end < n:
            carry.since = float(s.t[end])
            carry.last_high = carry.since
            if not carry.on:
                carry.limit = float(s.threshold[end])
        at = end
    return out


def settled_carry(carry: Carry, at: float, gap: float) -> list[float]:
    """The numbers that still matter for samples from ``at`` on, the same for states that act alike."""
    if carry.last >= 0 and at - carry.last >= gap:
        carry.last = NONE
    if not carry.on and carry.since < 0:
        carry.limit = NONE
    return carry.numbers()
