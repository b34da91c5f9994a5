"""Paging a corpus (W14): chunks of blocks are functions of the room that is left on a page.

The rules say where a block goes from the room above the lower margin.  Only
the first page of a chunk depends on the room that it is entered with: from the
line that opens the next page on, everything is known.  So a chunk is a table
of ranges of room, each of which either shifts the room or opens a page at a
certain line, and the rest follows from that line.  Chunks are worked out side
by side; a document's tables are then applied one after the other, which takes
one search a chunk.  Lengths are whole micropoints, so sums do not depend on
where a document is cut.

What a gap keeps free for the blocks after it is read from running sums of
their needs; a chunk is told the needs that follow it, as far as a page reaches.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.operators.ordering import whole
from leafline.runtime import cut_lineage

POINT = 1_000_000
CHUNK = 16_384  # blocks
IMAGE_GAP = 8 * POINT  # below an image, and what an image needs at least
ROW_NEED = 16 * POINT  # of the first row of a table
LEAST = -(1 << 60)

KEYS = ["doc", "no_doc", "chunk"]
PLACED = "doc_id bigint, block_no int, line_no int, page_no int, y double, page_count int"
_HEADS = "doc bigint, no_doc boolean, chunk bigint, needs array<bigint>, closed boolean"
_HALOS = "doc bigint, no_doc boolean, chunk bigint, needs array<bigint>"
_MAPS = (
    "doc bigint, no_doc boolean, chunk bigint, low array<bigint>, pages array<bigint>, room array<bigint>, shifts array<boolean>, ink array<bigint>, "
    "new_pages bigint, new_room bigint, new_ink bigint"
)
_ENTRIES = "doc bigint, no_doc boolean, chunk bigint, page bigint, entry bigint, page_count int"

#: a page opens at a line of a block; -1: before the block, after a break; -2: the first page, which no gap comes before
Start = tuple[int, int]


class Chunk:
    """Blocks in order, with the needs of those that follow them."""

    def __init__(self, box: int, breaks: list[bool], before: list[int], heights: list[list[int]], tail: list[int], after: list[int], needs: list[int], coming: list[int]):
        self.box, self.breaks, self.before, self.heights, self.tail, self.after = box, breaks, before, heights, tail, after
        sums, seen, last = [0], [], []
        for need in needs:
            if need > 0:
                sums.append(sums[-1] + need)
            seen.append(len(sums) - 1)
        for need in coming:
            sums.append(sums[-1] + need)
        end = len(sums)
        for i in range(len(needs) - 1, -1, -1):
            last.append(end)
            if breaks[i]:
                end = seen[i] + 1
        self.sums, self.seen, self.last = sums, seen, last[::-1]  # needs before and up to a block, and up to the next break
        self.known: dict[Start, tuple[int, int, int]] = {}

    def _fits(self, i: int, gap: int, room: int) -> bool:
        """Whether a gap at block i leaves room for all that would still fit without it."""
        if room < gap:
            return False
        base = self.sums[self.seen[i]]
        kept = self.sums[bisect_right(self.sums, base + room, self.seen[i], self.last[i]) - 1] - base
        return room - gap >= kept

    def page(self, i: int, line: int, room: int, opens: bool, out: list | None = None, number: int = 0) -> tuple[Start | None, int, bool]:
        """One page from a place on: where the next one opens (None at the end of the chunk), the room left, and whether ink is on it."""
        inked = False
        while i < len(self.breaks):
            if self.breaks[i]:
                return (i + 1, -1), room, inked
            heights = self.heights[i]
            if line < 0:
                gap, line = self.before[i] if line == -1 else 0, 0
                if gap > 0 and self._fits(i, gap, room - (heights[0] if heights else 0)):
                    room -= gap
            for k in range(line, len(heights)):
                if room < heights[k] and not opens:
                    return (i, k), room, inked
                if out is not None:
                    out.append((i, k, number, room))
                room, inked, opens = room - heights[k], True, False
            room -= self.tail[i]
            if self.after[i] > 0 and self._fits(i, self.after[i], room):
                room -= self.after[i]
            i, line = i + 1, -1
        return None, room, inked

    def first_ink(self) -> Start | None:
        return next(((i, -2) for i, (b, h) in enumerate(zip(self.breaks, self.heights)) if h and not b), None)

    def rest(self, start: Start) -> tuple[int, int, int]:
        """From a page that opens at ``start``: further pages, room at the end, and the last of these pages with ink (0 is the first, -1 none)."""
        walked: list[tuple[Start, bool]] = []
        while start not in self.known:
            following, room, inked = self.page(start[0], start[1], self.box, start[1] >= 0)
            if following is None:
                self.known[start] = (0, room, 0 if inked else -1)
                break
            walked.append((start, inked))
            start = following
        pages, room, ink = self.known[start]
        for start, inked in reversed(walked):
            pages, ink = pages + 1, ink + 1 if ink >= 0 else 0 if inked else -1
            self.known[start] = (pages, room, ink)
        return pages, room, ink

    def ranges(self) -> list[tuple[int, int, int, bool, int]]:
        """(least room, pages, room or shift of room, whether it is a shift, last page with ink) for entering with any room."""
        low, high, shift = np.array([LEAST]), np.array([self.box]), np.array([0])
        found: list[tuple[int, Start | None, int, bool]] = []
        inked = False

        def gap(i: int, size: int, first: int) -> None:
            nonlocal low, high, shift
            sums = np.array(self.sums[self.seen[i] : self.last[i]])
            sums = sums - sums[0]
            begin, end = sums + size, np.append(sums[1:], 1 << 61)
            edges = first + np.stack([begin, end], 1)[begin < end].ravel()[:-1]  # the gap is made from an edge to the next one
            a, c = low - shift, high - shift
            n = np.searchsorted(edges, a, "right")
            more = np.searchsorted(edges, c, "right") - n
            owner = np.repeat(np.arange(len(a)), more + 1)
            q = np.arange(len(owner)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
            at = n[owner] + q
            edge = np.append(edges, 0)
            a = np.where(q == 0, a[owner], edge[at - 1])
            c = np.where(q == more[owner], c[owner], edge[np.minimum(at, len(edges))] - 1)
            shift = shift[owner]
            low, high, shift = a + shift, c + shift, shift + np.where(at % 2 == 1, size, 0)
            keep = np.ones(len(low), bool)
            keep[1:] = (shift[1:] != shift[:-1]) | (low[1:] != high[:-1] + 1)
            high = np.maximum.reduceat(high, np.flatnonzero(keep))
            low, shift = low[keep], shift[keep]

        def opened(start: Start, upto: int) -> None:
            """Rooms below ``upto`` open a page."""
            nonlocal low, high, shift
            below = low - shift < upto
            found.extend((x, start, 0, inked) for x in low[below].tolist())
            low = np.maximum(low, upto + shift)
            left = low <= high
            low, high, shift = low[left], high[left], shift[left]

        for i, heights in enumerate(self.heights):
            if not len(low):
                break
            if self.breaks[i]:
                opened((i + 1, -1), 1 << 61)
                break
            if self.before[i] > 0:
                gap(i, self.before[i], heights[0] if heights else 0)
            for k, height in enumerate(heights):
                opened((i, k), height)
                shift, inked = shift + height, True
            shift = shift + self.tail[i]
            if self.after[i] > 0 and len(low):
                gap(i, self.after[i], 0)
        found.extend((x, None, s, inked) for x, s in zip(low.tolist(), shift.tolist()))
        out = []
        for least, start, by, ink in sorted(found, key=lambda f: f[0]):
            if start is None:
                out.append((least, 0, by, True, 0 if ink else -1))
            else:
                pages, room, last = self.rest(start)
                out.append((least, pages + 1, room, False, last + 1 if last >= 0 else 0 if ink else -1))
        return out


def _chunks(table: pa.Table, bounds: np.ndarray, box: int) -> Iterator[tuple[int, int, Chunk]]:
    columns = {c: table.column(c).to_pylist() for c in ("breaks", "before", "heights", "tail", "after", "need", "needs")}
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        part = {c: v[a:b] for c, v in columns.items()}
        yield a, b, Chunk(box, part["breaks"], part["before"], part["heights"], part["tail"], part["after"], part["need"], part["needs"][0] or [])


def _heads(box: int):
    """The needs at the start of each chunk, as far as a page or to the first break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole(batches, KEYS):
            breaks, needs = table.column("breaks").to_numpy(), table.column("need").to_numpy()
            keys = [table.column(k).take(pa.array(bounds[:-1])).combine_chunks() for k in KEYS]
            lists, closed = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                at = np.flatnonzero(breaks[a:b])
                own = needs[a : a + at[0]] if len(at) else needs[a:b]
                own = own[own > 0]
                n = int(np.searchsorted(np.cumsum(own), box, "right")) + 1
                lists.append(own[:n].tolist())
                closed.append(bool(len(at)) or n <= len(own))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(lists, pa.list_(pa.int64())), pa.array(closed)], [*KEYS, "needs", "closed"])

    return run


def _halos(box: int):
    """The needs that follow each chunk, from the heads of the chunks after it; chunks come last first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, coming = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if doc != (row["doc"], row["no_doc"]):
                    doc, coming = (row["doc"], row["no_doc"]), []
                out.append({**{k: row[k] for k in KEYS}, "needs": coming})
                coming = row["needs"] + ([] if row["closed"] else coming)
                n = int(np.searchsorted(np.cumsum(coming), box, "right")) + 1
                coming = coming[:n]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc", pa.int64()), ("no_doc", pa.bool_()), ("chunk", pa.int64()), ("needs", pa.list_(pa.int64()))]))

    return run


def _maps(box: int):
    longs = pa.list_(pa.int64())
    schema = pa.schema([
        ("doc", pa.int64()), ("no_doc", pa.bool_()), ("chunk", pa.int64()), ("low", longs), ("pages", longs), ("room", longs), ("shifts", pa.list_(pa.bool_())), ("ink", longs),
        ("new_pages", pa.int64()), ("new_room", pa.int64()), ("new_ink", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole(batches, KEYS):
            keys = {k: table.column(k).to_pylist() for k in KEYS}
            first = table.column("first").to_pylist()
            out = []
            for a, _, chunk in _chunks(table, bounds, box):
                # the first chunk of a document is entered without a page
                ranges = [] if first[a] else chunk.ranges()
                start = chunk.first_ink()
                pages, room, ink = chunk.rest(start) if start else (-1, 0, -1)
                names = ("low", "pages", "room", "shifts", "ink")
                out.append({**{k: v[a] for k, v in keys.items()}, **{n: [r[c] for r in ranges] for c, n in enumerate(names)}, "new_pages": pages, "new_room": room, "new_ink": ink})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's page and room on entry, and a row with a null chunk for the page count of a document."""
    schema = pa.schema([("doc", pa.int64()), ("no_doc", pa.bool_()), ("chunk", pa.int64()), ("page", pa.int64()), ("entry", pa.int64()), ("page_count", pa.int32())])
    doc, page, room, ink = None, -1, 0, -1

    def end() -> list[dict]:
        return [] if doc is None else [{"doc": doc[0], "no_doc": doc[1], "page_count": max(1, ink + 1)}]

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if doc != (row["doc"], row["no_doc"]):
                out.extend(end())
                doc, page, room, ink = (row["doc"], row["no_doc"]), -1, 0, -1
            out.append({**{k: row[k] for k in KEYS}, "page": page, "entry": room})
            if page < 0:
                if row["new_pages"] >= 0:
                    page, room, ink = row["new_pages"], row["new_room"], row["new_ink"]
            else:
                r = bisect_right(row["low"], room) - 1
                ink = page + row["ink"][r] if row["ink"][r] >= 0 else ink
                page, room = page + row["pages"][r], room - row["room"][r] if row["shifts"][r] else row["room"][r]
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist(end(), schema)


def _places(box: int, bottom: int, alone: bool):
    """Pages and places of all lines; ``alone``: chunks are documents, which also get a row with their page count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole(batches, KEYS):
            n = table.num_rows
            page, entry = ([-1] * n, [0] * n) if alone else (table.column(c).to_pylist() for c in ("page", "entry"))
            numbers, docs = table.column("block_no").combine_chunks(), table.column("doc_id").combine_chunks()
            rows: list[tuple[int, int, int, int]] = []
            counts: list[tuple[int, int]] = []
            for a, _, chunk in _chunks(table, bounds, box):
                out: list[tuple[int, int, int, int]] = []
                number, room, start = page[a], entry[a], (0, -1)
                opens = False
                if number < 0:
                    start, number, room = chunk.first_ink(), 0, box
                while start is not None:
                    start, room, _ = chunk.page(start[0], start[1], room, opens, out, number)
                    number, room, opens = number + 1, box, start is not None and start[1] >= 0
                rows.extend((a + i, k, p, r) for i, k, p, r in out)
                counts.append((a, out[-1][2] + 1 if out else 1))
            at, lines, pages, rooms = (np.array([r[c] for r in rows], np.int64) for c in range(4))
            yield pa.RecordBatch.from_arrays(
                [docs.take(pa.array(at)), numbers.take(pa.array(at)), pa.array(lines.astype(np.int32)), pa.array(pages.astype(np.int32)), pa.array((rooms + bottom) / POINT), pa.nulls(len(rows), pa.int32())],
                names,
            )
            if alone:
                none = [pa.nulls(len(counts), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.float64())]
                yield pa.RecordBatch.from_arrays([docs.take(pa.array([c[0] for c in counts])), *none, pa.array([c[1] for c in counts], pa.int32())], names)

    names = ["doc_id", "block_no", "line_no", "page_no", "y", "page_count"]
    return run


def _micro(c: Column) -> Column:
    return F.round(c * POINT).cast("long")


def paginate(blocks: DataFrame, height: float = 841.89, margin_top: float = 72.0, margin_bottom: float = 72.0, chunk: int = CHUNK) -> DataFrame:
    """Page and top edge of every line, image and table row; one summary row per document.

    ``blocks`` is (doc_id, block_no, kind para|empty|break|image|row, heights
    ARRAY<DOUBLE>, size, line_mult, space_before, space_after, opens_table).
    A line that does not fit opens a page; a gap is made only if all that would
    fit after it without the gap still fits.  The summary row has NULL
    ``block_no`` and the final ``page_count``: trailing blank pages are gone, and
    a document without content has one notice page.

    Blocks are shuffled and written once, by document and chunk, so a document of any
    length is many tasks; what passes between its chunks is a short table each.
    Documents whose blocks are all in the first chunk take one pass.
    """
    box, bottom = round((height - margin_top - margin_bottom) * POINT), round(margin_bottom * POINT)
    kind, line = F.col("kind"), _micro(F.col("size") * F.col("line_mult"))
    solid, empty = kind.isin("row", "image"), kind == "empty"
    before, after = _micro(F.col("space_before")), _micro(F.col("space_after"))
    tall = F.transform("heights", lambda h: _micro(h))
    none = F.array().cast("array<long>")
    need = F.when(kind.isin("break", "empty"), 0).when(kind == "image", IMAGE_GAP).when(kind == "row", F.when(F.col("opens_table"), ROW_NEED).otherwise(0)).otherwise(line)
    rows = blocks.select(
        F.coalesce("doc_id", F.lit(0).cast("long")).cast("long").alias("doc"), F.col("doc_id").isNull().alias("no_doc"), F.floor(F.col("block_no") / chunk).cast("long").alias("chunk"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("block_no").cast("int").alias("block_no"), (kind == "break").alias("breaks"),
        F.when(solid, 0).when(empty, before + after + line).otherwise(before).alias("before"),
        F.when(empty | (kind == "break"), none).when(solid, F.slice(tall, 1, 1)).otherwise(tall).alias("heights"),
        F.when(kind == "image", IMAGE_GAP).otherwise(0).cast("long").alias("tail"), F.when(solid | empty, 0).otherwise(after).alias("after"), need.cast("long").alias("need"),
    ).repartition(*KEYS)
    in_order = [*KEYS, "block_no"]
    # several passes read the blocks, so they are written once
    rows = cut_lineage(rows)
    # most documents are one chunk, and need nothing from others
    far = cut_lineage(rows.where(F.col("chunk") != 0).select("doc", "no_doc").distinct())
    alone = far.isEmpty()
    near = (rows if alone else rows.join(far, ["doc", "no_doc"], "left_anti")).withColumn("needs", F.array().cast("array<long>"))
    near = near.sortWithinPartitions(*in_order).mapInArrow(_places(box, bottom, True), PLACED)
    if alone:
        return near
    rows = rows.join(far, ["doc", "no_doc"], "left_semi")
    heads = rows.select(*in_order, "breaks", "need").sortWithinPartitions(*in_order).mapInArrow(_heads(box), _HEADS)
    halos = heads.repartition("doc", "no_doc").sortWithinPartitions("doc", "no_doc", F.col("chunk").desc()).mapInArrow(_halos(box), _HALOS)
    first = heads.groupBy("doc", "no_doc").agg(F.min("chunk").alias("first_chunk"))
    sides = halos.join(first, ["doc", "no_doc"]).select(*KEYS, "needs", (F.col("chunk") == F.col("first_chunk")).alias("first"))
    told = rows.join(sides, KEYS)
    maps = told.sortWithinPartitions(*in_order).mapInArrow(_maps(box), _MAPS)
    entries = maps.repartition("doc", "no_doc").sortWithinPartitions("doc", "no_doc", "chunk").mapInArrow(_entries, _ENTRIES)
    states = entries.where(F.col("chunk").isNotNull()).drop("page_count")
    placed = told.join(states, KEYS).sortWithinPartitions(*in_order).mapInArrow(_places(box, bottom, False), PLACED)
    shown = lambda t: F.lit(None).cast(t)
    counts = entries.where(F.col("chunk").isNull()).select(
        F.when(~F.col("no_doc"), F.col("doc")).alias("doc_id"), shown("int").alias("block_no"), shown("int").alias("line_no"), shown("int").alias("page_no"), shown("double").alias("y"), "page_count"
    )
    return near.union(placed).union(counts)
