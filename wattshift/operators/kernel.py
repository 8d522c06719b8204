"""Numpy helpers run inside Spark tasks on one bounded chunk of a feature series.

A detection window is a run ``x[s..t]`` of at most ``w2 + 1`` features. Whether it shows an
event depends on its points only, so all windows that end in a chunk are judged together:
a sweep grows every window by one feature to the left at a time and keeps, per window, the
connected components of its neighbour graph. Arrays are laid out ``[offset, end]`` where
``offset = t - s``, so each numpy call works on the whole chunk.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

NONE = -1


def near_table(f1: np.ndarray, f2: np.ndarray, reach: int, eps: float) -> np.ndarray:
    """``near[d, q]``: do points ``q - d`` and ``q`` lie within ``eps``? NaN never does."""
    n = len(f1)
    near = np.zeros((reach + 1, n), dtype=bool)
    with np.errstate(invalid="ignore"):
        for d in range(1, min(reach, n - 1) + 1):
            dx = f1[d:] - f1[:-d]
            dy = f2[d:] - f2[:-d]
            near[d, d:] = np.sqrt(dx * dx + dy * dy) <= eps
    return near


def dense_minimum(longest: int, min_locality: float) -> np.ndarray:
    """Fewest members (two at least) that make a cluster of each time span dense."""
    members = np.arange(longest + 2, dtype=np.float64)
    fewest = np.full(longest + 1, longest + 1, dtype=np.int16)
    for span in range(1, longest + 1):
        enough = np.nonzero(members[2 : span + 1] / span >= min_locality)[0]
        if len(enough):
            fewest[span] = enough[0] + 2
    return fewest


def _quiet_ends(near: np.ndarray, pad: int, w2: int) -> np.ndarray:
    """Ends whose windows cannot hold an event: no point is cut off from both its time
    neighbours with two points left on either side."""
    n = near.shape[1]
    alone = np.zeros(n, dtype=np.int64)
    alone[1:-1] = ~near[1, 1:-1] & ~near[1, 2:]
    upto = np.concatenate(([0], np.cumsum(alone)))
    ends = np.arange(pad, n)
    low = np.maximum(ends - (w2 - 2), 0)
    return upto[np.maximum(ends - 1, 0)] - upto[np.minimum(low, np.maximum(ends - 1, 0))] <= 0


def window_intervals(f1, f2, w2: int, eps: float, min_locality: float):
    """Event interval of every window ending after the first ``w2`` (context) points.

    Returns two arrays ``[w2 + 1, ends]`` with the offsets (back from the end) of the first
    and last noise point between the chosen cluster pair, ``NONE`` where there is no event.
    """
    f1 = np.asarray(f1, dtype=np.float64)
    f2 = np.asarray(f2, dtype=np.float64)
    ends = len(f1) - w2
    first = np.full((w2 + 1, ends), NONE, dtype=np.int16)
    last = np.full((w2 + 1, ends), NONE, dtype=np.int16)
    near = near_table(f1, f2, w2, eps)
    busy = ~_quiet_ends(near, w2, w2)
    if not busy.any():
        return first, last
    fewest = dense_minimum(w2 + 1, min_locality)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], busy.view(np.int8), [0]))))
    for lo, hi in zip(edges[::2], edges[1::2]):
        _sweep(near, w2 + lo, w2 + hi, w2, fewest, first[:, lo:hi], last[:, lo:hi])
    return first, last


def _ends_of(links: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chains of links from ``at`` end; the chains are shortened on the way."""
    end = links[at]
    moving = np.flatnonzero(links[end] != end)
    while len(moving):
        step = links[end[moving]]
        end[moving] = step
        moving = moving[links[step] != step]
    links[at] = end
    return end


def _sweep(near, begin, stop, w2, fewest, first, last):
    """Judge the windows that end in ``[begin, stop)``, all of one length at a time.

    A component is named by its oldest offset. The point entering at offset ``k`` is the
    oldest of its window, so it names the component that it joins; ``parent`` leads from
    the names it replaced to it. ``below`` and ``above`` lead from an offset to the nearest
    noise point on that side. Tables are ``[offset, column]``, read by flat position.
    """
    width = stop - begin
    cols = np.arange(width)
    gap, late = np.nonzero(near[:, :stop])
    early = late - gap
    order = np.argsort(early, kind="stable")
    gap, early = gap[order], early[order]

    rows = w2 + 1
    parent = np.arange(rows * width)
    above = np.arange((rows + 1) * width)
    below = np.arange((rows + 1) * width)              # one row lower: row 0 means none
    ticket = np.empty(rows * width, dtype=np.intp)
    size = np.ones((rows, width), dtype=np.int16)
    newest = np.zeros((rows, width), dtype=np.int16)
    dense = np.zeros((rows, width), dtype=bool)
    flat_size, flat_newest, flat_dense = size.ravel(), newest.ravel(), dense.ravel()
    for k in range(1, rows):
        # Links of the entering points: to points already in the same window.
        lo, hi = np.searchsorted(early, (begin - k, stop - k))
        inside = np.flatnonzero(gap[lo:hi] <= k) + lo
        col = early[inside] + (k - begin)
        point = (k - gap[inside]) * width + col
        root = _ends_of(parent, point)
        # Every joined component once per column.
        ticket[root] = turn = np.arange(len(root))
        once = ticket[root] == turn
        root, column = root[once], col[once]
        parent[point] = k * width + col
        parent[root] = k * width + column
        np.add.at(size[k], column, flat_size[root])
        newest[k] = k
        np.minimum.at(newest[k], column, flat_newest[root])
        flat_dense[root] = False
        dense[k] = (size[k] >= 2) & (size[k] >= fewest[k - newest[k] + 1])
        # Points that are noise no longer: the joined single ones, and those that join.
        single = root[flat_size[root] == 1]
        joins = k * width + np.flatnonzero(size[k] > 1)
        for gone in (single, joins):
            above[gone] = gone + width
            below[gone + width] = gone
        if k >= 4:
            _choose(dense[: k + 1], above, below, flat_newest, cols, first[k], last[k])


def _choose(dense, above, below, flat_newest, cols, first, last):
    """First pair of dense clusters, in time order, with noise strictly between them."""
    rows, width = dense.shape
    at = np.flatnonzero(dense.ravel())                 # by offset, so late starts come first
    if not len(at):
        return
    start = at // width
    col = at - start * width
    # Next noise in time after each cluster's newest member = greatest noise offset below it.
    follow = _ends_of(below, flat_newest[at].astype(np.intp) * width + col) // width - 1
    latest = np.full(width, rows)
    latest[col[::-1]] = start[::-1]                    # the last write per column stays
    valid = follow > latest[col]
    if not valid.any():
        return
    opening = np.full(width, NONE)
    opening[col[valid]] = follow[valid]                # oldest valid start wins
    after = start < opening[col]
    second = np.full(width, NONE)
    second[col[after]] = start[after]                  # the next dense cluster behind it
    found = cols[opening != NONE]
    first[found] = opening[found]
    last[found] = _ends_of(above, (second[found] + 1) * width + found) // width


def backward_pass(first: np.ndarray, last: np.ndarray):
    """Interval kept after dropping leading points while an event remains visible.

    The kept cut of window (k, t) is the start of the run of event windows that ends at k.
    """
    hit = first != NONE
    fresh = hit.copy()
    fresh[1:] &= ~hit[:-1]
    offsets = np.arange(first.shape[0])[:, None]
    kept = np.maximum.accumulate(np.where(fresh, offsets, 0), axis=0)
    cols = np.arange(first.shape[1])
    return np.where(hit, first[kept, cols], NONE), np.where(hit, last[kept, cols], NONE)


def follow_starts(first, last, w2: int, starts: dict[int, int]):
    """Follow detection windows through a chunk from one or more window starts.

    ``starts`` maps a window start, relative to the chunk's first row (0 or negative), to a
    bit mask of the chains that enter with it; chains that reach the same start merge.
    Returns ``(moves, exits)``: each move is ``(t, new_start, first, last, mask)`` with
    ``first = None`` for a restart without event; ``exits`` lists ``(start, mask)``.
    """
    ends = first.shape[1]
    first, last = backward_pass(first, last)
    at_k, at_t = np.nonzero(first != NONE)
    stride = ends + w2 + 1
    keys = np.sort((at_t - at_k + w2) * stride + at_t).tolist()
    pending: list[dict[int, int]] = [{} for _ in range(ends)]
    moves, exits = [], []

    def schedule(start: int, after: int, mask: int) -> None:
        base = (start + w2) * stride
        i = bisect_right(keys, base + after)
        t = start + w2
        if i < len(keys) and keys[i] < base + stride:
            t = min(t, keys[i] - base)
        if t >= ends:
            exits.append((start, mask))
        else:
            pending[t][start] = pending[t].get(start, 0) | mask

    for start, mask in starts.items():
        schedule(start, -1, mask)
    for t in range(ends):
        for start, mask in pending[t].items():
            a = int(first[t - start, t])
            if a == NONE:
                moves.append((t, t + 1, None, None, mask))
                schedule(t + 1, t, mask)
            else:
                begin, end = t - a + 1, t - int(last[t - start, t]) + 1
                moves.append((t, end, begin, end, mask))
                schedule(end, t, mask)
    return moves, exits
