"""A minimal perfect hash over distinct 64-bit keys, as numpy arrays.

Levels of bit tables: keys that hit a cell alone stay there, the others go to
the next level.  The index of a key is the number of set bits before its cell,
so n keys have the indexes 0 to n - 1.  Looking up a foreign key gives -1 or
some index; callers compare a fingerprint that they store at the index.
"""

from __future__ import annotations

import numpy as np

from leafline.llm.arrays import mix

ROOM = 2  # cells per key in a level


class PerfectHash:
    def __init__(self, keys: np.ndarray) -> None:
        """``keys`` are distinct uint64 values."""
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, before, salt = keys, 0, 1
        while len(rest):
            cells = ROOM * len(rest) + 1
            at = self._cell(rest, salt, cells)
            alone = np.bincount(at, minlength=cells) == 1
            # rank of each cell: the set bits before it, over all levels
            rank = before + np.cumsum(alone) - alone
            self.levels.append((salt, alone, rank.astype(np.int64)))
            before += int(alone.sum())
            rest = rest[~alone[at]]
            salt += 1
        self.size = before

    @staticmethod
    def _cell(keys: np.ndarray, salt: int, cells: int) -> np.ndarray:
        return (mix(keys + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(cells)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for salt, alone, rank in self.levels:
            if not len(open_):
                break
            at = self._cell(keys[open_], salt, len(alone))
            hit = alone[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out
