"""Small matrix steps on a correlation matrix that Spark has already aggregated."""

from __future__ import annotations

import numpy as np


def _usable(matrix: np.ndarray, cols: list[str]) -> tuple[np.ndarray, list[str]]:
    """Drop constant columns, whose correlations are undefined."""
    keep = [i for i in range(len(cols)) if not np.isnan(matrix[i, i])]
    return matrix[np.ix_(keep, keep)], [cols[i] for i in keep]


def variance_inflation(matrix: np.ndarray, n: int, cols: list[str]) -> list[tuple[str, float]]:
    """Each column with its variance inflation factor; none for fewer than three columns or hardly more rows."""
    matrix, kept = _usable(matrix, cols)
    if len(kept) < 3 or n < len(kept) + 2:
        return []
    out = []
    for i, c in enumerate(kept):
        rest = [j for j in range(len(kept)) if j != i]
        beta = np.linalg.lstsq(matrix[np.ix_(rest, rest)], matrix[rest, i], rcond=None)[0]
        r2 = float(matrix[rest, i] @ beta)
        out.append((c, 1.0 / (1.0 - r2) if r2 < 1.0 - 1e-12 else float("inf")))
    return out


def partial_correlations(matrix: np.ndarray, n: int, cols: list[str]) -> list[tuple[str, str, float]]:
    """Each pair of columns with its correlation given all others."""
    matrix, kept = _usable(matrix, cols)
    if n < 4 or len(kept) < 2:
        return []
    inverse = np.linalg.pinv(matrix)
    scale = np.sqrt(np.diag(inverse))
    partial = -inverse / np.outer(scale, scale)
    return [(kept[i], kept[j], float(partial[i, j])) for i in range(len(kept)) for j in range(i + 1, len(kept))]
