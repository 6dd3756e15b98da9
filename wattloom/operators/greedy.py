"""Greedy choice of moves for many customer-days at once, in the order in which they use limits that they share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SLOTS = 48
#: Energy below this is none (kWh).
LEAST = 1e-12
#: Customer-days that choose together before the first of them that lacks room is looked for: at most, and at first
#: where destinations have limits.
CHUNK, FIRST = 512, 16


@dataclass
class Days:
    """Customer-days of one city and day, in order: usage, factors (NaN where a slot is not valid) and floor by slot."""

    value: np.ndarray
    mef: np.ndarray
    floor: np.ndarray

    def __getitem__(self, at: slice) -> Days:
        return Days(self.value[at], self.mef[at], self.floor[at])


@dataclass
class Moves:
    """Of each customer-day its moves (columns), from slot t to slot s; q is 0 where there is none."""

    t: np.ndarray
    s: np.ndarray
    q: np.ndarray

    @classmethod
    def none(cls, n: int, rounds: int) -> Moves:
        return cls(np.zeros((n, rounds), np.int64), np.zeros((n, rounds), np.int64), np.zeros((n, rounds)))

    def into(self) -> np.ndarray:
        """Energy that comes into each slot of each customer-day, less what leaves it."""
        out = np.zeros((len(self.q), SLOTS))
        rows = np.arange(len(self.q))
        for k in range(self.q.shape[1]):
            np.add.at(out, (rows, self.s[:, k]), self.q[:, k])
            np.add.at(out, (rows, self.t[:, k]), -self.q[:, k])
        return out


def chosen(days: Days, quota: np.ndarray, window: int, rounds: int, region: np.ndarray, dest: np.ndarray | None, peaks: list[list[int]], fraction: float | None) -> Moves:
    """Of each customer-day its moves of the largest gain, one after the other, each from another slot: the gain is the
    difference of the factors times what can move, which is the usage above the floor, what is left of the peak share
    (fraction of the own usage of a group of peak slots), and room at the destination and in the region. Of equal gains
    the earliest t, then s. region, dest: rooms of each customer-day by itself; quota: its moves at most."""
    n = len(days.value)
    out = Moves.none(n, rounds)
    offsets = np.arange(-window, window + 1)
    to = np.arange(SLOTS)[:, None] + offsets
    inside = (to >= 0) & (to < SLOTS)
    to = np.clip(to, 0, SLOTS - 1)
    value, region = days.value.copy(), region.copy()
    room = None if dest is None else dest.copy()
    group = np.full(SLOTS, -1)
    for g, slots in enumerate(peaks):
        group[slots] = g
    peak = np.stack([fraction * days.value[:, slots].sum(axis=1) for slots in peaks], axis=1) if peaks else np.zeros((n, 0))
    used = np.zeros((n, SLOTS), bool)
    for k in range(rounds):
        most = np.where(used, 0.0, np.maximum(0.0, value - days.floor))
        if peaks:
            most = np.where(group >= 0, np.minimum(most, peak[:, group]), most)
        most = np.minimum(most, region[:, None])
        # only slots from which something can move are looked at
        row, source = np.nonzero((most > LEAST) & (k < quota)[:, None])
        if not len(row):
            break
        near, q = to[source], most[row, source][:, None]
        with np.errstate(invalid="ignore"):
            delta = days.mef[row, source][:, None] - days.mef[row[:, None], near]
            delta = np.where(inside[source] & (delta > LEAST), delta, 0.0)
            if room is not None:
                q = np.minimum(q, room[row[:, None], near])
                delta = np.where(q > LEAST, delta, 0.0)
            gain = delta * q
        at = gain.argmax(axis=1)
        top = gain[np.arange(len(row)), at]
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        best = np.repeat(np.maximum.reduceat(top, starts), np.diff(np.append(starts, len(row))))
        first = np.flatnonzero((top == best) & (top > 0))
        first = first[np.append(True, row[first][1:] != row[first][:-1])[: len(first)]]
        if not len(first):
            break
        i, t, s = row[first], source[first], near[first, at[first]]
        x = q[first, 0] if room is None else q[first, at[first]]
        out.t[i, k], out.s[i, k], out.q[i, k] = t, s, x
        value[i, t] -= x
        value[i, s] += x
        used[i, t] = True
        region[i] -= x
        if room is not None:
            room[i, s] -= x
        if peaks:
            on = group[t] >= 0
            peak[i[on], group[t[on]]] -= x[on]
    return out


def _needed(days: Days, window: int, rounds: int) -> np.ndarray:
    """Of each customer-day and slot, how much energy its moves could at most bring there: 0 where no slot of a higher
    factor is in reach; of one move the most that such a slot can give, of more all that any slot can."""
    spare = np.maximum(0.0, days.value - days.floor)
    out = np.zeros_like(spare)
    for d in range(1, window + 1):
        for to, source in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
            with np.errstate(invalid="ignore"):
                higher = days.mef[:, source] - days.mef[:, to] > LEAST
            out[:, to] = np.maximum(out[:, to], np.where(higher, spare[:, source] if rounds == 1 else spare.sum(axis=1, keepdims=True), 0.0))
    return out


def settled(days: Days, quota: np.ndarray, window: int, rounds: int, region: float, dest: np.ndarray | None, peaks: list[list[int]], fraction: float | None, work: list[int] | None = None) -> tuple[Moves, float, np.ndarray | None]:
    """(moves, room left in the region, at the destinations) when the customer-days choose one after the other.

    region: kWh that may still move; dest: usage that each slot may still take, own usage included. A chunk chooses
    with the rooms at its head; all before the first whose choice could differ, had it seen what those before it took,
    keep it, and the rest choose again. The first of a chunk always keeps its choice. Chunks are about twice as long as
    what was kept of the one before. work: gets the number of choices of each chunk.
    """
    n = len(days.value)
    out = Moves.none(n, rounds)
    at, size = 0, CHUNK if dest is None else FIRST
    while at < n and (region > LEAST or dest is not None):
        part = days[at : at + size]
        m = len(part.value)
        own = None if dest is None else np.maximum(0.0, dest - np.cumsum(part.value, axis=0))
        got = chosen(part, quota[at : at + m], window, rounds, np.full(m, region), own, peaks, fraction)
        q = got.q.sum(axis=1)
        before = np.cumsum(q) - q
        ok = q <= region - before
        into = None
        if dest is not None:
            into = got.into()
            now = np.maximum(0.0, dest - np.cumsum(part.value, axis=0) - (np.cumsum(into, axis=0) - into))
            ok &= ((now == own) | (np.minimum(now, own) >= _needed(part, window, rounds))).all(axis=1)
        ok[0] = True
        k = m if ok.all() else int(np.argmin(ok))
        out.t[at : at + k], out.s[at : at + k], out.q[at : at + k] = got.t[:k], got.s[:k], got.q[:k]
        region = max(0.0, region - float(q[:k].sum()))
        if dest is not None:
            dest = dest - part.value[:k].sum(axis=0) - into[:k].sum(axis=0)
        at += k
        size = min(CHUNK, 2 * size if k == m else k + k // 2 + 1)
        if work is not None:
            work.append(m)
    return out, region, dest
