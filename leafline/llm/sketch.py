"""A count-min sketch that grows with the data: blocks send their part, shards merge ranges of cells and answer.

A partition sketch counts a block's distinct keys, saturated at two; it goes
out as the sorted used cells, two or three bytes each.  A shard adds the sketches
of all blocks for its range of cells, and tells each block for each cell it
sent whether the merged count reaches two.  Counts are never too low, so no
repeated key is lost.  The width follows the number of keys.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from leafline.llm import arrays as A
from leafline.llm.spread import packed

def pack_sorted(values: np.ndarray, width: int = 2) -> bytes:
    """Increasing non-negative integers as steps of ``width`` bytes; an all-ones step goes on in the next one."""
    full = (1 << 8 * width) - 1
    steps = np.diff(values.astype(np.int64), prepend=0)
    wide = steps // full
    out = np.full(len(steps) + int(wide.sum()), full, np.uint32)
    out[np.cumsum(wide + 1) - 1] = steps - wide * full
    return out.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpack_sorted(raw: bytes, width: int = 2) -> np.ndarray:
    steps = np.zeros((len(raw) // width, 4), np.uint8)
    steps[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    steps = steps.view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.int64)[steps != (1 << 8 * width) - 1]


class Sketch:
    def __init__(self, keys: float, shards: int, depth: int, room: int = 4, width: int = 2) -> None:
        """``keys``: about how many there are; ``room``: cells per key in each of the ``depth`` rows, at least; ``width``: bytes of a step."""
        self.width = width
        self.bits = max(16, math.ceil(math.log2(max(1.0, keys * room))))
        self.shards = shards
        self.depth = depth
        self.bounds = np.array([-(-s * (1 << self.bits) // shards) for s in range(shards + 1)], np.int64)

    def _cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return (A.mix(keys ^ np.uint64(0xA0761D6478BD642F * (row + 1) % 2**64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def send(self, block: int, keys: np.ndarray, twice: np.ndarray) -> pa.Table:
        """A block's sketch.  ``keys`` are distinct; ``twice``: those that the block itself counts twice or more."""
        out: dict[str, list] = {"shard": [], "block": [], "kind": [], "cells": []}
        for row in range(self.depth):
            cell = self._cells(keys, row)
            order = np.argsort(cell)
            cell, more = cell[order], twice[order]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
            count = np.add.reduceat(1 + more.astype(np.int64), first) if len(first) else first
            cell = cell[first]
            cuts = np.searchsorted(cell, self.bounds)
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[s], cuts[s + 1])
                out["shard"].append(s)
                out["block"].append(block)
                out["kind"].append(row)
                out["cells"].append(pack_sorted(2 * (cell[part] - self.bounds[s]) + (count[part] > 1), self.width))
        return packed(out)

    def merge(self, group: pa.Table) -> pa.Table:
        """A shard's answers: a bit for each cell that a block sent."""
        out: dict[str, list] = {"block": [], "shard": [], "kind": [], "bits": []}
        shard = group.column("shard")[0].as_py()
        rows = group.column("kind").to_numpy()
        for row in np.unique(rows).tolist():
            part = group.filter(pa.array(rows == row))
            sent = part.column("cells").to_pylist()
            values = [unpack_sorted(raw, self.width) for raw in sent]
            every = np.sort(np.concatenate(values))
            cell = every >> 1
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            # the count of a cell: its blocks, or twice for a block that counts it twice (the last value of a cell)
            last = np.append(first[1:], len(cell)) - 1
            used, twice = cell[first], (last > first) | (every[last] & 1).astype(bool)
            for block, value in zip(part.column("block").to_pylist(), values):
                out["block"].append(block)
                out["shard"].append(shard)
                out["kind"].append(row)
                out["bits"].append(np.packbits(twice[np.searchsorted(used, value >> 1)]).tobytes())
        return packed(out)

    def repeated(self, keys: np.ndarray, answers: pa.Table) -> np.ndarray:
        """Which of a block's keys are estimated to count two or more, in every row."""
        told = {(k, s): b for k, s, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "bits")))}
        out = np.ones(len(keys), bool)
        for row in range(self.depth):
            cell = self._cells(keys, row)
            used = np.unique(cell)
            flag = np.zeros(len(used), bool)
            cuts = np.searchsorted(used, self.bounds)
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                flag[cuts[s] : cuts[s + 1]] = np.unpackbits(np.frombuffer(told[row, s], np.uint8))[: cuts[s + 1] - cuts[s]]
            out &= flag[np.searchsorted(used, cell)]
        return out


SENT = "shard int, block int, kind int, cells binary"
ANSWERED = "block int, shard int, kind int, bits binary"
