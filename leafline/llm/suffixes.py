"""Suffix-array dedup of bytes: blockwise suffix sorting with a difference cover.

Suffixes are dealt to buckets by content: the bucket of a suffix is that of the
least ``ANCHOR``-byte string within its first ``LENGTH`` bytes, so equal
strings are in one bucket.  The suffixes of one anchor are neighbours in their
text and travel as one stretch of it.  Anchors that do not repeat anywhere (by
a sketch that never misses) leave the sort, as their suffixes are unique.

A bucket is sorted on its own, whatever the size of the corpus: by leading
bytes and, where suffixes tie on ``PERIOD`` bytes or more, by the ranks of
cover samples at the shift that brings both into the difference cover.
Neighbours that agree on ``LENGTH`` bytes are one class, whose first member
stays.

Defined results: null and empty texts have no bytes; texts shorter than
``LENGTH`` lose nothing; a null id stands before all others; rows of one
doc_id follow one another in the order of their texts, so of repeated rows all
but one lose what they share; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafline.llm import arrays as A
from leafline.llm.sketch import ANSWERED, SENT, Sketch, pack_sorted, unpack_sorted
from leafline.llm.spread import deal, in_blocks, ordered, packed, profile, slots, small_batches

LENGTH = 100
PERIOD = 57
COVER = np.array([0, 1, 3, 13, 32, 36, 43, 52])  # every difference modulo PERIOD is that of two members
ANCHOR = 44
BLOCK = 4 << 20  # bytes of text in a block
BUCKETS = 4  # suffix buckets per shuffle partition
_LOCAL = -1  # kind of rows that a block sends to itself

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: for two positions modulo PERIOD, a shift that brings both into the cover
SHIFT = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


class Texts:
    """Consecutive texts as one byte string."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.sums = A.prefix(data)
        size = np.diff(offsets)
        self.left = (np.repeat(offsets[1:], size) - np.arange(len(data))).astype(np.int32)  # bytes to the text's end

    @classmethod
    def of(cls, texts: pa.ChunkedArray) -> Texts:
        _, data, offsets = next(A.chunks(texts.combine_chunks(), 1 << 62))
        return cls(data, offsets)

    def prints(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return A.span(self.sums, at, at + length)

    def places(self) -> np.ndarray:
        """Every byte's place in its text."""
        size = np.diff(self.offsets)
        return (np.arange(len(self.data)) - np.repeat(self.offsets[:-1], size)).astype(np.int32)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, and the first and the number of the suffixes that each one stands for (neighbours of each other)."""
        n = len(self.data)
        suffix = np.flatnonzero(self.left >= LENGTH)
        if not len(suffix):
            return suffix, suffix, suffix
        bits = np.uint64(int(n).bit_length())
        h = self.sums[ANCHOR:] - self.sums[:-ANCHOR]
        h *= A.powers("byte", n + 1)[1][: len(h)]
        # the hash above, the place below: the least value is the leftmost of the least strings
        least = (A.mix(h) >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        reach = LENGTH - ANCHOR + 1
        step = 1
        while 2 * step <= reach:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[: len(least) - (reach - step)], least[reach - step :])
        anchor = (least[suffix] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (suffix[1:] != suffix[:-1] + 1)]))
        return anchor[first], suffix[first], np.diff(np.append(first, len(suffix)))


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian number."""
    return np.ndarray(len(data) - 7, ">u8", data, strides=(1,))[at].astype(np.uint64)


def sort_texts(data: np.ndarray, at: np.ndarray, length: int, prints: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``length`` bytes (or some more), and the group (its first place) of each place.

    Only suffixes that still tie look at further bytes; with ``prints``, only
    those in groups of more than one class.  A step sorts numbers of 64 bits:
    the group above, and as many further bytes as there is room for.
    """
    order = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    place, seen = order, 0
    while seen < length:
        place = _open(place, order, group, prints)
        if not len(place):
            break
        old = group[place]
        rank = np.cumsum(np.concatenate([[0], old[1:] != old[:-1]])).astype(np.uint64)
        more = (64 - int(rank[-1]).bit_length()) // 8
        key = _words(data, at[order[place]] + seen)
        if more < 8:
            key = key >> np.uint64(64 - 8 * more) | rank << np.uint64(8 * more)
        by = np.argsort(key)
        order[place] = order[place][by]
        key = key[by]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        group[place] = np.repeat(place[start], np.diff(np.append(start, len(place))))
        seen += more
    return order, group


def classes(texts: Texts, at: np.ndarray) -> np.ndarray:
    """For each suffix (increasing positions) the first one that agrees with it on LENGTH bytes."""
    first = np.empty(len(at), np.int64)
    data = np.append(texts.data, np.zeros(2 * LENGTH + 16, np.uint8))
    place = texts.places()
    lead = texts.data[at]
    for byte in np.unique(lead).tolist():
        part = np.flatnonzero(lead == byte)
        here = at[part]
        prints = texts.prints(here, LENGTH)
        order = sort_suffixes(data, here, prints, place)
        ordered_ = prints[order]
        runs = np.flatnonzero(np.concatenate([[True], ordered_[1:] != ordered_[:-1]]))
        out = np.empty(len(order), np.int64)
        out[order] = np.repeat(np.minimum.reduceat(here[order], runs), np.diff(np.append(runs, len(order))))
        first[part] = out
    return first


def sort_suffixes(data: np.ndarray, at: np.ndarray, prints: np.ndarray, place_in_text: np.ndarray) -> np.ndarray:
    """An order in which suffixes that agree on LENGTH bytes (equal prints) are neighbours."""
    order, group = sort_texts(data, at, PERIOD, prints)
    place = _open(np.arange(len(at)), order, group, prints)
    if not len(place):
        return order
    # ranks of the cover samples that the tied suffixes can meet
    tied = at[order[place]]
    near = np.unique((tied[:, None] + _steps(place_in_text[tied] % PERIOD)).ravel())
    by, rank_at = sort_texts(data, near, LENGTH)
    rank = np.empty(len(near), np.int64)
    rank[by] = rank_at
    while len(place):
        start_of, members = group[place], order[place]
        start = np.flatnonzero(np.concatenate([[True], start_of[1:] != start_of[:-1]]))
        size = np.diff(np.append(start, len(place)))
        mine = at[members]
        pivot = np.repeat(mine[start + size // 2], size)
        shift = SHIFT[place_in_text[mine] % PERIOD, place_in_text[pivot] % PERIOD]
        side = np.sign(rank[np.searchsorted(near, mine + shift)] - rank[np.searchsorted(near, pivot + shift)])
        by = np.lexsort((side, start_of))
        order[place] = members[by]
        side = side[by]
        new = np.ones(len(place), bool)
        new[1:] = (side[1:] != side[:-1]) | (start_of[1:] != start_of[:-1])
        run = np.flatnonzero(new)
        group[place] = np.repeat(place[run], np.diff(np.append(run, len(place))))
        place = _open(place, order, group, prints)
    return order


def _steps(rest: np.ndarray) -> np.ndarray:
    """From positions modulo PERIOD, the steps to the next cover position of each residue."""
    return (COVER[None, :] - rest[:, None]) % PERIOD


def _open(place: np.ndarray, order: np.ndarray, group: np.ndarray, prints: np.ndarray | None) -> np.ndarray:
    """Of whole groups' places those whose group holds more than one class (without ``prints``: more than one suffix)."""
    if not len(place):
        return place
    of = group[place]
    same = of[1:] == of[:-1]
    start = np.concatenate([[0], np.flatnonzero(~same) + 1])
    size = np.diff(np.append(start, len(place)))
    if prints is None:
        wide = size > 1
    else:
        p = prints[order[place]]
        steps = np.concatenate([[0], np.cumsum((p[1:] != p[:-1]) & same)])
        wide = steps[start + size - 1] > steps[start]
    return place[np.repeat(wide, size)]


def _runs(at: np.ndarray) -> bytes:
    """Increasing positions as the places where runs of neighbours begin and end."""
    if not len(at):
        return b""
    gap = np.flatnonzero(np.diff(at) > 1)
    edges = np.empty(2 * len(gap) + 2, np.int64)
    edges[0], edges[-1] = at[0], at[-1] + 1
    edges[1:-1:2] = at[gap] + 1
    edges[2::2] = at[gap + 1]
    return pack_sorted(edges)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    bounds, total = profile(docs, BLOCK)
    shards = slots(spark)
    buckets = BUCKETS * shards
    # cells so many that steps between a block's cells fill about 22 of 24 bits
    sketch = Sketch(total * 2 / (LENGTH - ANCHOR), shards, depth=1, room=max(64, (1 << 21) // (len(bounds) + 1)), width=3)
    blocks = in_blocks(docs, bounds)

    def send(group: pa.Table) -> pa.Table:
        _, _, column = ordered(group)
        texts = Texts.of(column)
        names = texts.prints(texts.anchors()[0], ANCHOR)
        order, runs = A.groups(names)
        return sketch.send(group.column("block")[0].as_py(), names[order[runs]], np.diff(np.append(runs, len(order))) > 1)

    def stretches(group: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, column = ordered(group)
        texts, number = Texts.of(column), group.column("block")[0].as_py()
        anchor, first, size = texts.anchors()
        names = texts.prints(anchor, ANCHOR)
        again = np.flatnonzero(sketch.repeated(names, answers)) if len(names) else np.zeros(0, np.int64)
        first, size, names = first[again], size[again], names[again]
        # stretches that stand earlier in the block: all their suffixes do
        order, runs = A.groups(texts.prints(first, size + LENGTH - 1))
        new = np.zeros(len(order), bool)
        new[order[runs]] = True
        own = _runs(_ranges(first[~new], size[~new]))
        first, size, names = first[new], size[new], names[new]
        parts = deal(names, buckets)
        text = [texts.data[_ranges(first[i], size[i] + LENGTH - 1)].tobytes() for _, i in parts]
        return packed(
            {
                "shard": [s for s, _ in parts] + [number % buckets],
                "block": [number] * (len(parts) + 1),
                "kind": [0] * len(parts) + [_LOCAL],
                "at": [pack_sorted(first[i]) for _, i in parts] + [own],
                "sizes": [size[i].astype(np.uint8).tobytes() for _, i in parts] + [b""],
                "bytes": text + [b""],
            }
        )

    def sort_bucket(group: pa.Table) -> pa.Table:
        group = group.sort_by([("kind", "descending"), ("block", "ascending")])
        kind, block = group.column("kind").to_numpy(), group.column("block").to_pylist()
        asked = int((kind != _LOCAL).sum())
        local = group.slice(asked)
        out = {"block": local.column("block").to_pylist(), "kind": [_LOCAL] * local.num_rows, "at": local.column("at").to_pylist()}
        if asked:
            group = group.slice(0, asked)
            at = [unpack_sorted(x) for x in group.column("at").to_pylist()]
            size = np.frombuffer(b"".join(group.column("sizes").to_pylist()), np.uint8).astype(np.int64)
            data = np.frombuffer(b"".join(group.column("bytes").to_pylist()), np.uint8)
            offsets = np.concatenate([[0], np.cumsum(size + LENGTH - 1)])
            texts = Texts(data, offsets)
            suffix = np.flatnonzero(texts.left >= LENGTH)
            later = classes(texts, suffix) < suffix
            cuts = np.cumsum([0] + [len(x) for x in at])
            ends = np.concatenate([[0], np.cumsum(size)])
            for i in range(asked):
                part = slice(cuts[i], cuts[i + 1])
                start = _ranges(at[i], size[part])
                out["block"].append(block[i])
                out["kind"].append(0)
                out["at"].append(_runs(np.unique(start[later[ends[cuts[i]] : ends[cuts[i + 1]]]])))
        return packed(out)

    def cut(group: pa.Table, answers: pa.Table) -> pa.Table:
        _, given, column = ordered(group)
        _, data, offsets = next(A.chunks(column.combine_chunks(), 1 << 62))
        n = len(data)
        steps = np.zeros(n + 1, np.int32)
        for raw in answers.column("at").to_pylist():
            at = unpack_sorted(raw)
            steps[at[::2]] += 1
            steps[at[1::2]] -= 1
        gone = A.spread_on(np.cumsum(steps)[:n] > 0, LENGTH)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edge = offsets[:-1][np.diff(offsets) > 0]
        begins[edge] = gone[edge]
        raw = data[~gone].tobytes()
        bound = (offsets - np.concatenate([[0], np.cumsum(gone)])[offsets]).tolist()
        return pa.table(
            {
                "doc_id": given, "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(A.counts(gone, offsets)), "n_spans": pa.array(A.counts(begins, offsets)),
                "kept": pa.array([raw[a:b] for a, b in zip(bound, bound[1:])], pa.binary()),
            }
        )

    answers = blocks.groupBy("block").applyInArrow(send, SENT).groupBy("shard").applyInArrow(lambda group: sketch.merge(group), ANSWERED)
    sent = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(stretches, "shard int, block int, kind int, at binary, sizes binary, bytes binary")
    found = sent.groupBy("shard").applyInArrow(sort_bucket, "block int, kind int, at binary")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
