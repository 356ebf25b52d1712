"""The k best rows of many questions at a time."""

from __future__ import annotations

import numpy as np


class Best:
    """The k best rows of every question so far: arrays of (at most k) x questions."""

    def __init__(self, k: int):
        self.k, self.held = k, None

    def add(self, order: list[np.ndarray], columns: list[np.ndarray]) -> None:
        """``order``: sort keys, least first, the last one first; rows x questions like ``columns``."""
        rows = self._first([*order, *columns], len(order))
        if self.held is not None:
            rows = self._first([np.concatenate(p) for p in zip(self.held, rows)], len(order))
        self.held, self.keys = rows, len(order)

    def _first(self, rows: list[np.ndarray], keys: int) -> list[np.ndarray]:
        top = np.lexsort(rows[:keys], axis=0)[: self.k]
        return [np.take_along_axis(x, top, axis=0) for x in rows]

    def columns(self) -> list[np.ndarray]:
        return self.held[self.keys :]
