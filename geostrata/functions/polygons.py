"""Kernels on rings of vertices: exact overlap of polygons with holes, simplification, outlines of cells.

A polygon is a list of rings (n x 2 arrays without a closing vertex); inside is what an odd number of rings encloses.
"""

from __future__ import annotations

import numpy as np

#: Numbers of a slab table, at most.
_TABLE = 1 << 21


def ring_area(ring: np.ndarray) -> float:
    """Shoelace area, positive counter-clockwise."""
    if len(ring) < 3:
        return 0.0
    p = ring - ring[0]
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def _lines(rings: list[np.ndarray]) -> np.ndarray:
    """left x, right x, slope and intercept of every edge that isn't upright."""
    a = np.concatenate([np.asarray(r, float) for r in rings])
    b = np.concatenate([np.roll(np.asarray(r, float), -1, axis=0) for r in rings])
    wide = a[:, 0] != b[:, 0]
    a, b = a[wide], b[wide]
    slope = (b[:, 1] - a[:, 1]) / (b[:, 0] - a[:, 0])
    return np.stack((np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0]), slope, a[:, 1] - slope * a[:, 0]))


def _meets(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Places on the x axis where edges of two sets cross."""
    turn = e[2][:, None] - f[2][None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (f[3][None, :] - e[3][:, None]) / turn
    low, high = np.maximum(e[0][:, None], f[0][None, :]), np.minimum(e[1][:, None], f[1][None, :])
    return x[(turn != 0) & (x > low) & (x < high)]


def overlap(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[float, float]:
    """Areas that both polygons hold, and that either holds.

    The plane is cut into upright slabs at all vertices and crossings. No two edges cross within a slab, so what a
    polygon holds of it has the area of its middle line's length times the slab's width.
    """
    origin = np.asarray(a[0], float).min(0)
    one, two = _lines([r - origin for r in a]), _lines([r - origin for r in b])
    both = np.concatenate((one, two), axis=1)
    cuts = np.unique(np.concatenate((both[0], both[1], _meets(both, both))))
    if len(cuts) < 2:
        return 0.0, 0.0
    middle, width = (cuts[:-1] + cuts[1:]) / 2, np.diff(cuts)
    own = np.arange(both.shape[1]) < one.shape[1]
    shared = either = 0.0
    step = max(1, _TABLE // both.shape[1])
    for k in range(0, len(middle), step):
        x = middle[k : k + step, None]
        y = np.where((both[0] < x) & (x < both[1]), both[2] * x + both[3], np.inf)
        order = np.argsort(y, axis=1)
        y, first = np.take_along_axis(y, order, 1), own[order]
        live = np.isfinite(y)
        in_one, in_two = np.cumsum(first & live, axis=1) % 2 == 1, np.cumsum(~first & live, axis=1) % 2 == 1
        length = np.where(live[:, 1:], np.diff(np.where(live, y, 0.0), axis=1), 0.0)
        shared += float(((length * (in_one & in_two)[:, :-1]).sum(1) * width[k : k + step]).sum())
        either += float(((length * (in_one | in_two)[:, :-1]).sum(1) * width[k : k + step]).sum())
    return shared, either


def iou(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Exact intersection over union; 0 where a polygon has no area."""
    low, high = np.maximum(a[0].min(0), b[0].min(0)), np.minimum(a[0].max(0), b[0].max(0))
    if (high <= low).any():
        return 0.0
    shared, either = overlap(a, b)
    return shared / either if either > 0 else 0.0


#: Edges that aren't upright of two polygons, at most, whose overlap is worked out together with others'.
_FEW = 24


def ious(a: tuple[list, list, list], b: tuple[list, list, list]) -> np.ndarray:
    """``iou`` of many pairs: each side gives, for every pair, flat x, flat y and the rings' sizes. Pairs of few edges are worked out together, as many edges at a time."""
    n = len(a[0])
    out, (one, low, high), (two, low_b, high_b) = np.zeros(n), _flat_edges(*a), _flat_edges(*b)
    # as in ``iou``: outer rings whose boxes don't meet share nothing, and a's lower corner is the origin
    meet = ~(np.minimum(high, high_b) <= np.maximum(low, low_b)).any(1)
    both = np.concatenate((one, two))
    own = np.arange(len(both)) < len(one)
    both[:, 1:] -= np.tile(low[both[:, 0].astype(int)], 2)
    both, own = both[wide := both[:, 1] != both[:, 3]], own[wide]
    order = np.argsort(both[:, 0], kind="stable")
    both, own = both[order], own[order]
    edges = np.bincount(both[:, 0].astype(int), minlength=n)
    start = np.cumsum(edges) - edges
    finite = np.ones(n, bool)
    finite[both[~np.isfinite(both).all(1), 0].astype(int)] = False
    finite &= np.isfinite(low).all(1) & np.isfinite(low_b).all(1)
    for e in np.unique(edges[meet & finite & (edges <= _FEW)]):
        these = np.flatnonzero(meet & finite & (edges == e))
        step = max(1, _TABLE // max(1, (2 * e + e * (e - 1) // 2) * e))
        for k in range(0, len(these) if e else 0, step):
            rows = start[these[k : k + step], None] + np.arange(e)
            shared, either = _overlaps(both[rows, 1:], own[rows])
            out[these[k : k + step]] = np.divide(shared, either, out=np.zeros(len(rows)), where=either > 0)
    for i in np.flatnonzero(~finite | (meet & (edges > _FEW))):
        rings = ([*np.split(np.stack((s[0][i], s[1][i]), axis=1), np.cumsum(s[2][i])[:-1])] for s in (a, b))
        out[i] = iou(*rings)
    return out


def _flat_edges(x: list, y: list, sizes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair, x, y and the next vertex's x, y of every edge; least and greatest corner of each pair's first ring."""
    rings = np.concatenate(sizes).astype(int)
    at = np.stack((np.concatenate(x), np.concatenate(y)), axis=1).astype(float)
    end = np.cumsum(rings)
    after = np.arange(1, len(at) + 1)
    after[(end - 1)[rings > 0]] = (end - rings)[rings > 0]
    count = [len(s) for s in sizes]
    points = np.repeat(np.repeat(np.arange(len(x)), count), rings)
    first = np.cumsum(count) - count
    begin, stop = (end - rings)[first], end[first]
    outer = np.repeat(np.arange(len(x)), stop - begin)
    inner = np.arange(len(outer)) - np.repeat(np.cumsum(stop - begin) - (stop - begin), stop - begin) + np.repeat(begin, stop - begin)
    heads = np.cumsum(stop - begin) - (stop - begin)
    return np.column_stack((points, at, at[after])), np.minimum.reduceat(at[inner], heads), np.maximum.reduceat(at[inner], heads)


def _overlaps(edges: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``overlap`` of pairs with equally many edges (pair, edge, x y x y), own those of the first polygon; slabs between equal cuts have no width."""
    x1, y1, x2, y2 = np.moveaxis(edges, 2, 0)
    slope = (y2 - y1) / (x2 - x1)
    left, right, base = np.minimum(x1, x2), np.maximum(x1, x2), y1 - slope * x1
    i, j = np.triu_indices(edges.shape[1], 1)
    turn = slope[:, i] - slope[:, j]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (base[:, j] - base[:, i]) / turn
    met = (turn != 0) & (x > np.maximum(left[:, i], left[:, j])) & (x < np.minimum(right[:, i], right[:, j]))
    cuts = np.sort(np.concatenate((left, right, np.where(met, x, left[:, :1])), axis=1), axis=1)
    middle, width = ((cuts[:, :-1] + cuts[:, 1:]) / 2)[:, :, None], np.diff(cuts, axis=1)
    y = np.where((left[:, None] < middle) & (middle < right[:, None]), slope[:, None] * middle + base[:, None], np.inf)
    order = np.argsort(y, axis=2)
    y, first = np.take_along_axis(y, order, 2), np.take_along_axis(np.broadcast_to(own[:, None], y.shape), order, 2)
    live = np.isfinite(y)
    in_one, in_two = np.cumsum(first & live, axis=2) % 2 == 1, np.cumsum(~first & live, axis=2) % 2 == 1
    length = np.where(live[:, :, 1:], np.diff(np.where(live, y, 0.0), axis=2), 0.0)
    shared, either = ((length * held[:, :, :-1]).sum(2) * width for held in (in_one & in_two, in_one | in_two))
    return shared.sum(1), either.sum(1)


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """The ring with the vertices that its chords miss by more than the tolerance; one with fewer than three of them stays as it is.

    The chords start between the least and the greatest vertex (by x, then y), so the result doesn't depend on where
    the ring begins. In every round each chord takes the vertex farthest from it in, all chords at once.
    """
    if len(ring) < 4 or tolerance <= 0:
        return ring
    turn = np.lexsort((ring[:, 1], ring[:, 0]))
    line = np.roll(ring, -turn[0], axis=0)
    line = np.concatenate((line, line[:1]))
    place = np.arange(len(line))
    kept = np.array([0, (turn[-1] - turn[0]) % len(ring), len(ring)])
    while True:
        chord = np.clip(np.searchsorted(kept, place, side="right") - 1, 0, len(kept) - 2)
        start, end = line[kept[chord]], line[kept[chord + 1]]
        along, off = end - start, line - start
        length = np.hypot(along[:, 0], along[:, 1])
        across = np.abs(along[:, 0] * off[:, 1] - along[:, 1] * off[:, 0])
        far = np.where(length > 0, across / np.where(length > 0, length, 1), np.hypot(off[:, 0], off[:, 1]))
        far[kept] = 0
        order = np.lexsort((place, -far, chord))
        first = order[np.concatenate(([True], chord[order][1:] != chord[order][:-1]))]
        new = first[far[first] > tolerance]
        if not len(new):
            break
        kept = np.union1d(kept, new)
    kept = kept[:-1]
    return np.roll(ring, -turn[0], axis=0)[kept] if len(kept) >= 3 else ring


def contours(values: np.ndarray, level: float) -> list[np.ndarray]:
    """Closed lines (row, col) around cells at or above a level, the field padded with zeros; high cells lie to the left."""
    v = np.pad(values.astype(float), 1)
    high = v >= level
    code = high[:-1, :-1] * 1 + high[:-1, 1:] * 2 + high[1:, 1:] * 4 + high[1:, :-1] * 8
    # edges of a square: 0 bottom, 1 right, 2 top, 3 left; from, to for each code, split at saddles
    steps = {1: [(0, 3)], 2: [(1, 0)], 3: [(1, 3)], 4: [(2, 1)], 5: [(0, 3), (2, 1)], 6: [(2, 0)], 7: [(2, 3)], 8: [(3, 2)], 9: [(0, 2)], 10: [(1, 0), (3, 2)], 11: [(1, 2)], 12: [(3, 1)], 13: [(0, 1)], 14: [(3, 0)]}

    def key(r: int, c: int, edge: int) -> tuple[int, int, int]:
        return (r + (edge == 2), c, 0) if edge in (0, 2) else (r, c + (edge == 1), 1)

    def point(r: int, c: int, upright: int) -> tuple[float, float]:
        a, b = v[r, c], v[r + upright, c + 1 - upright]
        t = (level - a) / (b - a) if b != a else 0.5
        return (r + t * upright - 1, c + t * (1 - upright) - 1)

    follow = {}
    for r, c in zip(*np.nonzero((code > 0) & (code < 15)), strict=True):
        for a, b in steps[int(code[r, c])]:
            follow[key(r, c, a)] = key(r, c, b)
    out = []
    while follow:
        start = at = next(iter(follow))
        line = []
        while at in follow:
            line.append(point(*at))
            at = follow.pop(at)
        if at == start and len(line) >= 3:
            out.append(np.array(line))
    return out
