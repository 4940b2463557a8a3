"""Exact nearest neighbours along a raster row whose columns have donors."""

from __future__ import annotations

import numpy as np


def nearest_donors(cols: np.ndarray, row: int, at: np.ndarray, drow: np.ndarray) -> np.ndarray:
    """For each of the sorted cols the number of the donor (at[k], drow[k]), with at sorted, that is nearest to (row, col); ties go to the smaller row, then column.

    Both the first and the last of the nearest donors never move back as the column grows. So the middle column of a
    run of columns looks between the first of the column before the run and the last of the column behind it, and
    all runs of one depth are looked up together: W log W distances for a row, and log W steps.
    """
    n, m = len(cols), len(at)
    up = (drow - row) ** 2
    rank = np.empty(m, np.int64)
    rank[np.lexsort((at, drow))] = np.arange(m)
    best, first, last = np.zeros(n, np.int64), np.zeros(n + 2, np.int64), np.full(n + 2, m - 1, np.int64)  # shifted by one: fences at both ends
    low, high = np.array([0]), np.array([n])
    while len(low):
        mid = (low + high) // 2
        begin, end = first[low], last[high + 1]
        sizes = end - begin + 1
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        run = np.repeat(np.arange(len(mid)), sizes)
        place = np.arange(len(run)) - starts[run] + begin[run]
        d2 = (cols[mid][run] - at[place]) ** 2 + up[place]
        tied = d2 == np.minimum.reduceat(d2, starts)[run]
        best_rank = np.minimum.reduceat(np.where(tied, rank[place], m), starts)
        first[mid + 1] = np.minimum.reduceat(np.where(tied, place, m), starts)
        last[mid + 1] = np.maximum.reduceat(np.where(tied, place, -1), starts)
        best[mid] = best_rank
        low, high = np.concatenate((low, mid + 1)), np.concatenate((mid, high))
        low, high = low[low < high], high[low < high]
    by_rank = np.empty(m, np.int64)
    by_rank[rank] = np.arange(m)
    return by_rank[best]
