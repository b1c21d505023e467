"""Longest runs of dependent work on arrays, by potentials that don't change along a row of work.

Between works that don't overlap, what a run has taken less the time at which it ends stays what it was: waiting fills the gap. So
along a row of such works that potential is a running maximum, whatever the row's length, and only links that cross from row to row
have to be followed, again as long as they raise something. The same holds backwards for the last moments at which works
could have ended, taken less the work before them in the row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Works in an order in which each row is together: ``order`` (works by place), ``place`` (its inverse), ``row`` (by place)."""

    order: np.ndarray
    place: np.ndarray
    row: np.ndarray


def rows_of(n: int, when: np.ndarray, source: np.ndarray, target: np.ndarray) -> Rows:
    """Rows along some of the links, each work being in one: of the links from a work the one to what starts first, if that
    work takes no other from one that starts later."""
    nearest = np.lexsort((when[target], source))
    source, target = source[nearest], target[nearest]
    one = np.append(True, source[1:] != source[:-1]) if len(source) else np.empty(0, bool)
    source, target = source[one], target[one]
    latest = np.lexsort((-when[source], target))
    source, target = source[latest], target[latest]
    one = np.append(True, target[1:] != target[:-1]) if len(target) else np.empty(0, bool)
    first = np.arange(n)
    first[target[one]] = source[one]
    while not np.array_equal(further := first[first], first):
        first = further
    order = np.lexsort((when, first))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    row = np.cumsum(np.append(False, first[order][1:] != first[order][:-1])) if n else np.empty(0, np.int64)
    return Rows(order, place, row)


#: Sums of two numbers below it have room in 64 bits.
FAR = 1 << 61


def _near(values: np.ndarray) -> np.ndarray:
    if len(values) and max(int(values.max()), -int(values.min())) >= FAR:
        raise OverflowError("times too far apart for 64 bits")
    return values


def running(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The running maximum along each row. Rows lie one above the other, so one running maximum serves all; where times are too far
    apart for so many rows, the values' ranks do."""
    if not len(values):
        return values
    least, spread = int(values.min()), int(values.max()) - int(values.min()) + 1
    if (int(row[-1]) + 1) * spread < FAR and abs(least) < FAR:
        base = row * spread - least
        return np.maximum.accumulate(values + base) - base
    known, rank = np.unique(values, return_inverse=True)
    base = row * np.int64(len(known) + 1)
    return known[np.maximum.accumulate(rank.astype(np.int64) + base) - base]


def until_as_high(level: np.ndarray, at: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each stretch from at to end, along which level doesn't fall, the first place that is as high as the value, or its end."""
    low, high = at.copy(), end.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        below = open_ & (level[np.minimum(middle, len(level) - 1)] < value)
        low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
    return low


def raised(values: np.ndarray, row: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The least values, none below the given ones, that never fall along a row and are at least the source's plus the weight at each
    link's target. Rounds follow the links of what was raised; a raise reaches on in its row to the first that is as high."""
    n = len(values)
    by = np.argsort(source, kind="stable")
    source, target, weight = source[by], target[by], _near(weight[by])
    begin = np.searchsorted(source, np.arange(n + 1))
    level = running(_near(values), row)
    links = np.arange(len(source))
    ends = np.searchsorted(row, row, side="right")
    while len(links):
        to, value = target[links], _near(level[source[links]] + weight[links])
        up = value > level[to]
        to, value = to[up], value[up]
        if not len(to):
            break
        length = until_as_high(level, to, ends[to], value) - to
        if int(length.sum()) <= n:
            at = np.repeat(to - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
            np.maximum.at(level, at, np.repeat(value, length))
            changed = np.unique(at)
        else:
            new = level.copy()
            np.maximum.at(new, to, value)
            new = running(new, row)
            changed = np.flatnonzero(new != level)
            level = new
        count = begin[changed + 1] - begin[changed]
        links = np.repeat(begin[changed] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    return level


def solve_arrays(start: np.ndarray, end: np.ndarray, ids: np.ndarray, source: np.ndarray, target: np.ndarray) -> dict[str, np.ma.MaskedArray]:
    """For deciding activities (arrays side by side) and links between their ids, which start in the links' direction: ``head``, the
    longest run of dependent work and waiting that ends with an activity; ``came_from``, the link it came by (the lowest id of
    equals); ``latest``, the last moment it could have ended without a later finish; ``free``, the least wait behind it; ``step``,
    its place on the chain that ends with the last work to end (greatest head, then id, of equals)."""
    n = len(ids)
    by_id = np.argsort(ids)
    source, target = (by_id[np.searchsorted(ids[by_id], x)] for x in (source, target))
    gap = start[target] - end[source]
    r = rows_of(n, start, source[gap >= 0], target[gap >= 0])
    s, e = start[r.order], end[r.order]
    u, v = r.place[source], r.place[target]
    along = (r.row[u] == r.row[v]) & (gap >= 0) if n else np.empty(0, bool)  # the row says it already
    potential = raised(-s, r.row, u[~along], v[~along], np.maximum(-gap, 0)[~along])
    so_far = np.cumsum(e - s)
    first = np.searchsorted(r.row, r.row)
    so_far -= (so_far - (e - s))[first] if n else 0
    finish = int(end.max(initial=0))
    back = n - 1
    next_in_row = v == u + 1
    # from the back, the last moments less the work so far in the row are a running minimum
    room = raised((so_far - finish)[::-1], (r.row[-1] - r.row)[::-1] if n else r.row, (back - v)[~(along & next_in_row)], (back - u)[~(along & next_in_row)], (so_far[u] - so_far[v] + (e - s)[v])[~(along & next_in_row)])[::-1]

    head, latest = np.empty(n, np.int64), np.empty(n, np.int64)
    head[r.order], latest[r.order] = potential + e, so_far - room
    attains = np.flatnonzero(potential[u] + np.maximum(-gap, 0) == potential[v])
    came = np.ma.masked_all(n, np.int64)
    attains = attains[np.lexsort((ids[source[attains]], target[attains]))]
    lowest = attains[np.append(True, target[attains][1:] != target[attains][:-1])] if len(attains) else attains
    came[target[lowest]] = ids[source[lowest]]
    free = np.ma.masked_all(n, np.int64)
    if len(source):
        by = np.argsort(source, kind="stable")
        at = np.flatnonzero(np.append(True, source[by][1:] != source[by][:-1]))
        free[source[by][at]] = np.minimum.reduceat(np.maximum(gap, 0)[by], at)
    step = np.ma.masked_all(n, np.int64)
    if n:
        before = np.full(n, -1)  # by place; a stretch that goes back place by place is taken at once
        before[r.place[target[lowest]]] = r.place[source[lowest]]
        stretch = np.maximum.accumulate(np.where(before == np.arange(n) - 1, 0, np.arange(n)))
        stretch[0] = 0
        chain, at = [], int(r.place[np.lexsort((ids, head, end))[-1]])
        while at >= 0:
            chain.append(np.arange(at, stretch[at] - 1, -1))
            at = int(before[stretch[at]])
        chain = np.concatenate(chain)[::-1]
        step[r.order[chain]] = np.arange(len(chain))
    return {"activity_id": np.ma.array(ids), "head": np.ma.array(head), "came_from": came, "latest": np.ma.array(latest), "free": free, "step": step}
