"""Deficit round-robin over token queues, in closed form.

Every window gives each active queue a credit of its weight's share of the
window, a queue sends the whole tokens of its deficit, and the tokens that are
then missing come from the queues with the largest deficits left.  If each
credit is one token or more, a queue's tokens sent by the end of window w are
its credits up to then rounded down, or up for the largest remainders: the
state after any window follows from the weights alone.  So every task finds
the deficits at the windows its documents fall into and carries on from there.

When a queue holds less than its share of a window, a phase ends: what it has
left goes to the tail, and the weights of the others are renormalised.  The
tail (less than a window's share of each queue) fills whole windows in queue
order; its last part is cut into powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 1024  # windows looked at together


@dataclass(frozen=True)
class Phase:
    first: int  # its first window
    windows: int
    weights: tuple[int, ...]  # by queue; 0 where the queue is not active
    starts: tuple[int, ...]  # tokens each queue has sent before


@dataclass(frozen=True)
class Plan:
    size: int
    phases: tuple[Phase, ...]
    left: tuple[int, ...]  # tokens each queue has sent before the tail
    tail_at: tuple[int, ...]  # place of each queue's rest in the tail
    tail: tuple[int, ...]  # where the sequences of the tail end
    windows: int  # whole windows before the tail


def sent(phase: Phase, size: int, a: int, b: int) -> np.ndarray:
    """Tokens that each queue has sent in the phase after windows a .. b of
    it, a row per queue; at most BLOCK windows."""
    total = sum(phase.weights)
    each = [divmod(u * size, total) for u in phase.weights]
    base = [divmod(u * size * a, total) for u in phase.weights]
    w = np.arange(b - a + 1, dtype=np.int64)
    whole, rest = [], []
    for (dq, dr), (q, r) in zip(each, base):
        more, remainder = np.divmod(r + w * dr, total)
        whole.append(q + w * dq + more)
        rest.append(remainder)
    served, deficit = np.stack(whole), np.stack(rest)
    missing = size * (a + w) - served.sum(axis=0)
    rank = np.empty_like(deficit)
    order = np.argsort(-deficit, axis=0, kind="stable")
    np.put_along_axis(rank, order, np.arange(len(served))[:, None], axis=0)
    return served + (rank < missing)


def plan(tokens: list[int], weights: list[int], size: int) -> Plan:
    """The phases and the tail for queues of ``tokens`` tokens."""
    sent_before, phases, first = [0] * len(tokens), [], 0
    active = list(range(len(tokens)))
    while active:
        total = sum(weights[s] for s in active)
        lasts = {s: (tokens[s] - sent_before[s]) * total // (weights[s] * size) for s in active}
        n = min(lasts.values())
        if n:
            phase = Phase(first, n, tuple(w if s in active else 0 for s, w in enumerate(weights)), tuple(sent_before))
            gone = sent(phase, size, n, n)[:, 0]
            sent_before = [x + int(g) for x, g in zip(sent_before, gone)]
            phases.append(phase)
            first += n
        active = [s for s in active if (tokens[s] - sent_before[s]) * total // (weights[s] * size)]
    rest = [t - x for t, x in zip(tokens, sent_before)]
    tail_at = [sum(rest[:s]) for s in range(len(rest))]
    ends, left = [0], sum(rest)
    while left:
        ends.append(ends[-1] + (size if left >= size else 1 << (left.bit_length() - 1)))
        left = sum(rest) - ends[-1]
    return Plan(size, tuple(phases), tuple(sent_before), tuple(tail_at), tuple(ends[1:]), first)


def _cut(x0: np.ndarray, x1: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, from, to) of the parts of ranges that lie in each window
    between two bounds."""
    a, b = np.maximum(x0, bounds[0]), np.minimum(x1, bounds[-1])
    rows = np.flatnonzero(a < b)
    a, b = a[rows], b[rows]
    w0, w1 = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b, "left")
    n = w1 - w0
    row = np.repeat(np.arange(len(rows)), n)
    window = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w0, n)
    low, high = np.maximum(a[row], bounds[window]), np.minimum(b[row], bounds[window + 1])
    some = low < high
    return rows[row][some], window[some], low[some], high[some]


def places(p: Plan, queue: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, sequence, from, to, offset) of the parts of ranges of queue
    tokens, a stretch of windows at a time."""
    for phase in p.phases:
        total = sum(phase.weights)
        u = np.array(phase.weights)[queue]
        starts = np.array(phase.starts, dtype=np.int64)
        rows = np.flatnonzero((u > 0) & (x1 > starts[queue]))
        # in a float's accuracy, hence the margin of windows on both sides
        scale = total / (u[rows].astype(float) * p.size)
        low = (x0[rows] - starts[queue[rows]]) * scale
        high = (x1[rows] - starts[queue[rows]]) * scale
        low = np.floor(low - 2 - low * 1e-12).astype(np.int64).clip(0, phase.windows)
        high = np.ceil(high + 2 + high * 1e-12).astype(np.int64).clip(0, phase.windows)
        wanted = np.unique(np.concatenate([np.arange(a // BLOCK, -(-b // BLOCK)) for a, b in _merged(low, high)] or [np.zeros(0, np.int64)]))
        for block in wanted.tolist():
            a, b = block * BLOCK, min((block + 1) * BLOCK, phase.windows)
            in_block = rows[(low < b) & (high > a)]
            done = sent(phase, p.size, a, b)
            before = np.cumsum(np.diff(done, axis=1), axis=0) - np.diff(done, axis=1)
            for s in np.unique(queue[in_block]).tolist():
                of = in_block[queue[in_block] == s]
                bounds = done[s] + phase.starts[s]
                row, window, lo, hi = _cut(x0[of], x1[of], bounds)
                yield of[row], phase.first + a + window, lo, hi, before[s][window] + lo - bounds[window]
    left, tail_at = np.array(p.left, dtype=np.int64), np.array(p.tail_at, dtype=np.int64)
    rows = np.flatnonzero(x1 > left[queue])
    if len(rows):
        shift = tail_at[queue[rows]] - left[queue[rows]]
        bounds = np.array((0, *p.tail), dtype=np.int64)
        row, window, lo, hi = _cut(np.maximum(x0[rows], left[queue[rows]]) + shift, x1[rows] + shift, bounds)
        yield rows[row], p.windows + window, lo - shift[row], hi - shift[row], lo - bounds[window]


def _merged(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for k in np.argsort(low, kind="stable").tolist():
        if low[k] >= high[k]:
            continue
        if out and low[k] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(high[k]))
        else:
            out.append([int(low[k]), int(high[k])])
    return [(a, b) for a, b in out]
