"""Texts of an Arrow batch as numpy arrays: words, lines, windows and their 64-bit fingerprints.

All functions work on a chunk: the UTF-8 bytes of consecutive texts (null texts
are empty) and the offsets between them.  A chunk holds whole texts, as many as
fit in ``CHUNK`` bytes and at least one, so memory follows the longest text.

Fingerprints are polynomials over a ring of 2**64 with a random value per byte,
taken from prefix sums, and finished by a mixer; equal strings have equal
fingerprints, different ones differ but for a chance of about 2**-64 for each
pair.  That holds for ranges of bytes, words or values of less than 512: longer
ones can be written so that they agree in such a ring whatever the values are
(doubled strings), so ranges of ``LONG`` bytes and more are digested instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
LONG = 256  # bytes from which a range is digested

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xC2B2AE3D27D4EB4F}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse in the ring of 2**64."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        base = _BASE[kind]
        size = max(n, CHUNK + 4096)
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[kind] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) of a string column; offsets start at 0 and have one entry more than rows."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for part in parts:
        if part.null_count:
            part = part.fill_null("")
        kind = np.int64 if pa.types.is_large_string(part.type) else np.int32
        bounds = np.frombuffer(part.buffers()[1], kind)[part.offset : part.offset + len(part) + 1].astype(np.int64) if len(part) else np.zeros(1, np.int64)
        data = np.frombuffer(part.buffers()[2], np.uint8) if len(part) and part.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(part):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield row + at, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
            at = end
        row += len(part)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the bytes' terms; ``span`` turns differences into fingerprints."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers("byte", len(data))[0], out=out[1:])
    return out


def span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of the byte ranges [start, end); ranges of ``LONG`` bytes and more are digests of ``data``."""
    inverse = powers("byte", len(sums))[1]
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if data is not None:
        for i in np.flatnonzero(ends - starts >= LONG).tolist():
            h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words before each text (one entry more than texts)."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    after = np.append(inside, False)
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def windows(values: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of k consecutive values, and where they start; none crosses a text.

    ``first``: number of values before each text.
    """
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ahead, inverse = powers("word", n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * ahead, out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    whole = np.ones(n, bool)
    for back in range(1, k):  # a window may not start in the last k - 1 values of a text
        at = first[1:] - back
        whole[at[at >= first[:-1]]] = False
    at = np.flatnonzero(whole[: n - k + 1])
    return h[at], at


def counts(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags (or the sum of values) lie between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each value, from the number of values before each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that brings equal keys together, and where each run of equal keys starts in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)


def spread_on(flags: np.ndarray, k: int) -> np.ndarray:
    """Positions covered by the k-long windows that start where the flags are set; windows lie within the array."""
    steps = np.zeros(len(flags) + k + 1, np.int64)
    steps[: len(flags)] += flags
    steps[k : k + len(flags)] -= flags
    return np.cumsum(steps)[: len(flags)] > 0
