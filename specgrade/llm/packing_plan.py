"""Bin packing of a length histogram.

The lengths are integers up to the sequence size, so the instance is a
histogram with at most that many rows, whatever the number of documents.  The
plan is a list of (lengths in one sequence, number of such sequences).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    lengths: tuple[int, ...]
    times: int


class _Stock:
    """Lengths still to be packed, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = {length: k for length, k in counts.items() if k > 0}

    def sizes(self, less: tuple[int, ...] = ()) -> list[int]:
        """Distinct lengths left, ascending, once the copies in ``less`` are gone."""
        return sorted(x for x, k in self.n.items() if k > less.count(x))

    def smallest(self, how_many: int, less: int) -> list[int]:
        """The ``how_many`` smallest items beside one copy of ``less``."""
        out: list[int] = []
        for x in sorted(self.n):
            k = self.n[x] - (x == less)
            out += [x] * min(k, how_many - len(out))
            if len(out) == how_many:
                break
        return out

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(self.n[x] // lengths.count(x) for x in set(lengths))

    def take(self, lengths: tuple[int, ...], times: int) -> Pattern:
        for x in lengths:
            self.n[x] -= times
            if not self.n[x]:
                del self.n[x]
        return Pattern(lengths, times)


def _dominating(stock: _Stock, j: int, size: int) -> tuple[int, ...] | None:
    """A set with item ``j`` that dominates every feasible set with ``j``, if
    one of the criteria proves it: whatever stands beside ``j`` elsewhere can
    be exchanged, item into larger slot, for what stands beside it here."""
    room = size - j
    beside = [x for x in stock.sizes((j,)) if x <= room]
    if not beside:
        return (j,)
    largest = beside[-1]
    if largest == room:  # any other company of j fits into that item's place
        return (j, largest)
    few = stock.smallest(3, j)
    if len(few) < 2 or few[0] + few[1] > room:  # one companion at most
        return (j, largest)
    if len(few) == 3 and sum(few) <= room:
        return None
    # two companions at most: the pairs (x, y), x >= y, that fit
    best_sum = best_y = 0
    for y in beside:
        if 2 * y > room:
            break
        x = max((x for x in beside if y <= x <= room - y and (x != y or stock.n[x] - (x == j) >= 2)), default=0)
        if x:
            best_sum, best_y = max(best_sum, x + y), max(best_y, y)
    if best_sum <= largest:  # both would fit into the largest one's place
        return (j, largest)
    second = [x for x in stock.sizes((j, largest)) if x <= room - largest]
    if second and best_y <= second[-1]:
        return (j, largest, second[-1])
    return None


def reduce_dominated(counts: dict[int, int], size: int) -> tuple[list[Pattern], dict[int, int]]:
    """Martello-Toth reduction: fix dominating sets, largest item first, until
    none is found.  Each fixed set lowers the optimum of the rest by one."""
    stock, fixed, changed = _Stock(counts), [], True
    while changed:
        changed = False
        for j in sorted(stock.n, reverse=True):
            while stock.n.get(j) and (found := _dominating(stock, j, size)):
                # the proof holds while all of the set's lengths last
                fixed.append(stock.take(found, stock.times(found)))
                changed = True
    return fixed, stock.n


def best_fit(counts: dict[int, int], size: int) -> list[Pattern]:
    """Best-fit decreasing, all equal items and equal sequences at a time."""
    rooms: dict[int, list[Pattern]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                rooms[size] = [Pattern((), left)]
                room = size
            pattern = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each = room // length  # best fit returns to a sequence while it can
            full = min(pattern.times, left // each)
            parts = [(each, full)] if full else []
            if full < pattern.times and (rest := left - full * each) and rest < each:
                parts.append((rest, 1))
            used = sum(t for _, t in parts)
            for k, t in parts:
                rooms.setdefault(room - k * length, []).append(Pattern(pattern.lengths + (length,) * k, t))
                left -= k * t
            if used < pattern.times and pattern.lengths:
                rooms.setdefault(room, []).append(Pattern(pattern.lengths, pattern.times - used))
    return [p for ps in rooms.values() for p in ps]


def plan(counts: dict[int, int], size: int) -> list[Pattern]:
    fixed, rest = reduce_dominated(counts, size)
    return fixed + best_fit(rest, size)
