"""Sparse hashed linear models: design matrices, proximal training, scoring."""

from __future__ import annotations

import numpy as np


class Rows:
    """A sparse design matrix: row ``row[k]`` has ``value[k]`` (None: 1) at ``column[k]``."""

    def __init__(self, n: int, row: np.ndarray, column: np.ndarray, value: np.ndarray | None = None):
        self.n, self.row, self.column, self.value = n, row, column, value

    def _valued(self, x: np.ndarray) -> np.ndarray:
        if self.value is not None:
            x *= self.value
        return x

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self._valued(weights[self.column]), self.n)

    def back(self, residual: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, self._valued(residual[self.row]), width)

    def norm(self, width: int, rounds: int = 12) -> float:
        """The largest eigenvalue of its Gram matrix, by power iteration from a fixed start."""
        v, size = np.ones(width) / max(width, 1) ** 0.5, 1.0
        for _ in range(rounds):
            v = self.back(self.dot(v), width)
            size = float(np.linalg.norm(v))
            if not size:
                return 1.0
            v /= size
        return size


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: Rows, target: np.ndarray, width: int, l1: float, swapped: Rows | None = None, penalty: float = 0.0, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean logistic loss against ``target`` (0 to 1) plus ``l1 * |weights|``
    plus ``penalty * mean((swapped . weights) ** 2)``, where a row of ``swapped`` is what a swap of words changes.

    Accelerated proximal gradient descent; deterministic.
    """
    n = max(rows.n, 1)
    step = 1 / (0.25 * (rows.norm(width) * 1.1 + n) / n + (2 * penalty * swapped.norm(width) * 1.1 / swapped.n if swapped is not None and swapped.n else 0))
    w, bias = np.zeros(width), float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6))) if rows.n else 0.0
    y, yb, t = w, bias, 1.0
    for _ in range(rounds):
        residual = logistic(rows.dot(y) + yb) - target
        slope = rows.back(residual, width) / n
        if swapped is not None and swapped.n:
            slope += 2 * penalty * swapped.back(swapped.dot(y), width) / swapped.n
        moved = y - step * slope
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        new_bias = yb - step * float(residual.sum()) / n
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, yb = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w, bias


def compact(columns: np.ndarray, least: float, most: int) -> np.ndarray:
    """The columns (sorted) seen at least ``least`` times, at most the ``most`` most frequent."""
    found, n = np.unique(columns, return_counts=True)
    found, n = found[n >= least], n[n >= least]
    if len(found) > most:
        keep = np.lexsort((found, -n))[:most]
        found = found[keep]
    return np.sort(found)


def chosen(columns: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column its place in the sorted ``among``, and whether it is there."""
    if not len(among):
        return np.zeros(len(columns), np.int64), np.zeros(len(columns), bool)
    at = np.minimum(np.searchsorted(among, columns), len(among) - 1)
    return at, among[at] == columns


def design(counts: np.ndarray, columns: np.ndarray, among: np.ndarray, values: np.ndarray | None = None, step: int = 1 << 20) -> Rows:
    """Rows of ``counts[i]`` columns each, cut to those in ``among``; a stretch at a time, so that little besides the result is held."""
    ends = np.cumsum(counts)
    parts = []
    for lo in range(0, len(columns), step):
        at, there = chosen(columns[lo : lo + step], among)
        place = np.flatnonzero(there)
        parts.append((np.searchsorted(ends, place + lo, "right"), at[place], values[lo : lo + step][place] if values is not None else None))
    none = np.zeros(0, np.int64)
    row, column = (np.concatenate([none, *(p[k] for p in parts)]) for k in range(2))
    return Rows(len(counts), row, column, np.concatenate([np.zeros(0), *(p[2] for p in parts)]) if values is not None else None)
