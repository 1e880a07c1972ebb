"""Minimum-cost assignment of a small matrix."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one choice of as many pairs as the shorter side has, whose costs add up to the least.

    Rows are added one after another; each is let in by the shortest path through the choices so far, with the duals of rows
    and columns kept so that no reduced cost is negative. Costs have to be finite.
    """
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    row_dual, column_dual = np.zeros(n), np.zeros(m)
    holder = np.full(m, -1)
    for start in range(n):
        distance, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, way, end = start, 0.0, -1
        entered, at = [start], -1
        while True:
            through = way + cost[row] - row_dual[row] - column_dual
            closer = ~done & (through < distance)
            distance[closer], before[closer] = through[closer], at
            at = int(np.where(done, np.inf, distance).argmin())
            way = distance[at]
            done[at] = True
            if holder[at] < 0:
                end = at
                break
            row = int(holder[at])
            entered.append(row)
        # rows and columns on the way get the slack that the path has used
        columns = np.flatnonzero(done)
        for r in entered:
            held = np.flatnonzero(holder == r)
            row_dual[r] += way - (distance[held[0]] if len(held) else 0.0)
        column_dual[columns] -= way - distance[columns]
        while end >= 0:
            previous = before[end]
            holder[end] = holder[previous] if previous >= 0 else start
            end = previous
    return sorted((int(r), c) for c, r in enumerate(holder) if r >= 0)


def heaviest_pairs(weight: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of a one-to-one choice with the greatest total weight, of pairs that weigh `least` or more; others stay alone."""
    if not weight.size:
        return []
    allowed = weight >= least
    return [(r, c) for r, c in assign(np.where(allowed, -weight, 0.0)) if allowed[r, c]]
