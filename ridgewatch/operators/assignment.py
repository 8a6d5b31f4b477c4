"""Optimal one-to-one assignment by shortest augmenting paths with potentials."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of row and column with the least total cost; every row or every column is in a pair."""
    cost = np.asarray(cost, dtype=np.float64)
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    rows, columns = cost.shape
    row_price, column_price = np.zeros(rows), np.zeros(columns)
    row_of = np.full(columns, -1)
    for new in range(rows):
        best, came_from = np.full(columns, np.inf), np.full(columns, -1)
        open_columns = np.ones(columns, dtype=bool)
        row, column, visited = new, -1, [(new, -1)]
        while True:
            reduced = cost[row] - row_price[row] - column_price
            better = open_columns & (reduced < best)
            best[better], came_from[better] = reduced[better], column
            column = int(np.where(open_columns, best, np.inf).argmin())
            step = best[column]
            for seen_row, seen_column in visited:
                row_price[seen_row] += step
                if seen_column >= 0:
                    column_price[seen_column] -= step
            best[open_columns] -= step
            open_columns[column] = False
            if row_of[column] < 0:
                break
            row = int(row_of[column])
            visited.append((row, column))
        while column >= 0:
            before = int(came_from[column])
            row_of[column] = new if before < 0 else row_of[before]
            column = before
    return sorted((int(r), c) for c, r in enumerate(row_of) if r >= 0)
