"""Hard negatives by angular triangle filtering.

A vector of real numbers becomes integers, floor(256 * x); a score is an
integer inner product.  Each row stores its norm and its angles to a few
reference directions.  For an anchor a and a row x, every direction r gives
``|angle(a, r) - angle(x, r)| <= angle(a, x) <= angle(a, r) + angle(x, r)``
(and the sum of all three is no more than a full turn), so the cosine lies in
an interval; times the norms, and widened by more than any rounding, these are
bounds of the score.  Positives are looked for where the upper bound reaches
the least of the best lower bounds, negatives where the bounds overlap one of
the anchor's windows; only these pairs are scored.

Equal rows are one row with a number of copies.  Rows are cut into blocks of
one label and alike angles, anchors into smaller blocks; blocks are dealt to a
grid of cells, so a cell holds a bounded number of either, and a label, vector
or id of any share of the rows is many blocks.  Cells send the few best of an
anchor on, never its candidates.

Defined results: rows with a null label or vector, or a null or non-finite
component, take no part; a null id is below all others and comes back as null;
missing components of a shorter vector are zeros; a vector of zeros scores
zero; equal scores and ids are in no further order, as their result is equal;
repeated anchors give repeated results; scores that 64 bits cannot hold are an
error; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafline.llm.spread import NO_ID, keep, slots, small_batches

REFERENCES = 8  # directions: the vectors of the rows with the least hashes
ROWS = 2048  # of a block
ANCHORS = 256  # of a block of anchors
CELL = 16  # blocks of either kind in a cell, about
TURN = 1e-6  # radians: more than the rounding of an angle
PAIRS = 1 << 18  # scored at once

ROW = "id long, label long, anchor boolean, wide boolean, vec binary"
USED = "id long, label long, wide boolean, vec binary, copies long, anchors long"
BLOCK = "block long, label long, n int, dim int, ids binary, copies binary, vecs binary, norms binary, angles binary"


def integers(vector: np.ndarray) -> np.ndarray:
    """floor(256 * x) of doubles, as doubles, which hold these integers exactly."""
    return np.floor(256.0 * vector)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("vector")
        values, bounds = integers(lists.values.to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0, lists.offsets.to_numpy().tolist()
        # equal vectors are equal bytes: one zero, and none at the end
        each = [values[a:b][: np.flatnonzero(values[a:b])[-1:].sum() + 1] for a, b in zip(bounds, bounds[1:])]
        wide = [bool(np.abs(v).max(initial=0) >= 2**15) for v in each]
        raw = [v.astype(np.float64 if w else np.int16).tobytes() if v.any() else b"" for v, w in zip(each, wide)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("anchor"), pa.array(wide), pa.array(raw, pa.binary())], ["id", "label", "anchor", "wide", "vec"])


def _vectors(raw: list[bytes], wide: list[bool]) -> np.ndarray:
    """Rows of doubles, filled up with zeros."""
    parts = [np.frombuffer(r, np.float64 if w else np.int16) for r, w in zip(raw, wide)]
    out = np.zeros((len(parts), max(map(len, parts), default=0)))
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def _angles(vectors: np.ndarray, norms: np.ndarray, directions: list[np.ndarray]) -> np.ndarray:
    """Angles to the directions; right angles for vectors of zeros, whose norm makes their bounds exact."""
    out = np.empty((len(vectors), len(directions)))
    for k, r in enumerate(directions):
        d = min(vectors.shape[1], len(r))
        cosine = (vectors[:, :d] @ r[:d]) / np.where(norms > 0, norms, 1) / np.linalg.norm(r)
        out[:, k] = np.arccos(np.clip(cosine, -1, 1))
    return out


def _measure(directions: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch.column("vec").to_pylist(), batch.column("wide").to_pylist())
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            angles = _angles(vectors, norms, directions)
            near = angles.argmin(axis=1)
            extra = [pa.array(norms), pa.array([a.tobytes() for a in angles], pa.binary()), pa.array(near.astype(np.int32)), pa.array(angles[np.arange(len(near)), near])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "norm", "angles", "near", "angle"])

    return run


def _blocks(size: int):
    """Consecutive rows of one label as blocks."""

    def pack(number: int, label: int, rows: list[dict]) -> dict:
        vectors = _vectors([r["vec"] for r in rows], [r["wide"] for r in rows])
        ids = np.array([NO_ID if r["id"] is None else r["id"] for r in rows], np.int64)
        return {
            "block": number, "label": label, "n": len(rows), "dim": vectors.shape[1], "ids": ids.tobytes(), "copies": np.array([r["copies"] for r in rows], np.int64).tobytes(),
            "vecs": vectors.tobytes(), "norms": np.array([r["norm"] for r in rows]).tobytes(), "angles": b"".join(r["angles"] for r in rows),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "copies", "vecs", "norms", "angles"))])
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == size or held[0]["label"] != row["label"]):
                    yield pa.RecordBatch.from_pylist([pack(number, held[0]["label"], held)], schema)
                    number, held = number + 1, []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([pack(number, held[0]["label"], held)], schema)

    return run


def _in_blocks(rows: DataFrame, size: int) -> DataFrame:
    key = ["label", "near", "angle", "id", "vec"]
    dealt = rows.repartitionByRange(slots(rows.sparkSession), *key[:4]).sortWithinPartitions(*key)
    return keep(dealt.select("id", "label", "wide", "vec", "copies", "norm", "angles").mapInArrow(_blocks(size), BLOCK))


class _Block:
    """A block's arrays."""

    def __init__(self, row: dict):
        array = lambda c, kind=np.float64: np.frombuffer(row[c], kind)
        self.block, self.label, self.n = row["block"], row["label"], row["n"]
        self.ids, self.copies, self.norms = array("ids", np.int64), array("copies", np.int64), array("norms")
        self.vectors = array("vecs").reshape(self.n, row["dim"])
        self.angles = array("angles").reshape(self.n, -1)
        self.most = float(np.abs(self.vectors).max(initial=0))

    def bounds(self, other: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores that each row can have with each row of the other block."""
        apart, together = np.zeros((self.n, other.n)), np.full((self.n, other.n), np.pi)
        for k in range(self.angles.shape[1]):
            a, x = self.angles[:, k, None], other.angles[None, :, k]
            np.maximum(apart, np.abs(a - x), out=apart)
            both = a + x
            np.minimum(together, np.minimum(both, 2 * np.pi - both), out=together)
        norms = self.norms[:, None] * other.norms[None, :]
        slack = 1 + 1e-9 * norms
        low = norms * np.cos(np.minimum(np.pi, together + TURN)) - slack
        return low, norms * np.cos(np.maximum(0, apart - TURN)) + slack

    def scores(self, other: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Integer scores of pairs of rows."""
        d = min(self.vectors.shape[1], other.vectors.shape[1])
        largest = self.most * other.most * max(d, 1)
        kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else object
        a, x = self.vectors[:, :d].astype(kind), other.vectors[:, :d].astype(kind)
        if kind is object:
            exact = [sum(int(p) * int(q) for p, q in zip(a[p_], x[q_])) for p_, q_ in zip(i, j)]
            if any(not -(2**63) <= s < 2**63 for s in exact):
                raise OverflowError("a score does not fit 64 bits")
            return np.array(exact, np.int64)
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), PAIRS):
            out[at : at + PAIRS] = np.einsum("pd,pd->p", a[i[at : at + PAIRS]], x[j[at : at + PAIRS]])
        return out


def _read(table: pa.Table) -> list[_Block]:
    return [_Block(row) for row in table.to_pylist()]


def _best(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first ``most`` of each group, by score (greatest first) and id."""
    order = np.lexsort((ids, -scores, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < most]


FOUND = "block long, row int, window int, score long, id long, copies long"


def _found(parts: list[tuple], most: int) -> pa.Table:
    """The best of a cell: (anchor block, anchor, window, score, id, copies) arrays, cut to ``most`` for each anchor and window."""
    columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(6)]
    key = np.unique(np.stack(columns[:3]), axis=1, return_inverse=True)[1].ravel() if parts else columns[0]
    best = _best(key, columns[3], columns[4], most)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table({name: pa.array(c[best], kind) for name, c, kind in zip(("block", "row", "window", "score", "id", "copies"), columns, kinds)})


def _positives(most: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts, others = [], _read(rows)
        for a in _read(anchors):
            for x in others:
                if x.label != a.label:
                    continue
                low, high = a.bounds(x)
                # one row more, as the anchor itself may be among the best
                k = min(most + 1, x.n)
                least = np.partition(low, x.n - k, axis=1)[:, x.n - k] if x.n > most else np.full(a.n, -np.inf)
                i, j = np.nonzero(high >= least[:, None])
                scores = a.scores(x, i, j)
                best = _best(i, scores, x.ids[j], most + 1)
                i, j, scores = i[best], j[best], scores[best]
                d = min(a.vectors.shape[1], x.vectors.shape[1])
                same = (a.ids[i] == x.ids[j]) & (a.vectors[i, :d] == x.vectors[j, :d]).all(axis=1) & (a.norms[i] == x.norms[j])
                copies = x.copies[j] - same
                left = copies > 0
                parts.append(tuple(c[left] for c in (np.full(len(i), a.block), i, np.zeros(len(i), np.int64), scores, x.ids[j], copies)))
        return _found(parts, most)

    return run


def _negatives(most: int, low_percent: int, high_percent: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts, others = [], _read(rows)
        for row in anchors.to_pylist():
            a = _Block(row)
            # windows of scores by anchor; all of them are tested with all bounds
            at, first, last, positive = [], [], [], []
            for w in row["windows"]:
                lo, hi = -(-low_percent * w["score"] // 100), high_percent * w["score"] // 100
                if lo <= hi:
                    at.append(w["row"]), first.append(lo), last.append(hi), positive.append(w["window"])
            if not at:
                continue
            at, first, last, positive = (np.array(v) for v in (at, first, last, positive))
            for x in others:
                if x.label == a.label:
                    continue
                low, high = a.bounds(x)
                wanted = np.zeros((a.n, x.n), bool)
                for r, lo, hi in zip(at.tolist(), first, last):
                    wanted[r] |= (high[r] >= lo) & (low[r] <= hi)
                i, j = np.nonzero(wanted)
                scores = a.scores(x, i, j)
                bounds = np.searchsorted(i, np.arange(a.n + 1))
                for r, lo, hi, k in zip(at.tolist(), first, last, positive):
                    mine = slice(bounds[r], bounds[r + 1])
                    inside = (scores[mine] >= lo) & (scores[mine] <= hi)
                    s, who = scores[mine][inside], j[mine][inside]
                    best = _best(np.zeros(len(s), np.int64), s, x.ids[who], most)
                    s, who = s[best], who[best]
                    parts.append((np.full(len(s), a.block), np.full(len(s), r), np.full(len(s), k), s, x.ids[who], x.copies[who]))
        return _found(parts, most)

    return run


def _few_first(found: DataFrame, most: int) -> DataFrame:
    """Of each anchor and window the first ``most`` rows, copies counted: place from 1, score and id."""
    order = [F.col("score").desc(), F.col("id")]
    ranked = found.withColumn("at", F.row_number().over(Window.partitionBy("block", "row", "window").orderBy(*order))).filter(F.col("at") <= most)
    before = F.coalesce(F.sum("copies").over(Window.partitionBy("block", "row", "window").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("before", before).filter(F.col("before") < most)
    places = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(most)))
    return ranked.select("block", "row", "window", "score", "id", F.explode(places.cast("array<int>")).alias("place"))


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors`` is (id, label, vector, anchor).  An anchor's positives are its
    first ``positives`` other rows of its label; for each of them the first
    ``negatives`` rows of other labels are found whose score is ``low`` to
    ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = vectors.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    used = used.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.coalesce("anchor", F.lit(False)).alias("anchor"), F.col("vector").cast("array<double>").alias("vector"))
    rows = keep(used.mapInArrow(_pack, ROW).groupBy("id", "label", "wide", "vec").agg(F.count("*").alias("copies"), F.count_if("anchor").alias("anchors")))
    few = rows.filter(F.octet_length("vec") > 0).orderBy(F.xxhash64("vec"), "vec").select("wide", "vec").limit(REFERENCES).collect()
    directions = [_vectors([r.vec], [r.wide])[0] for r in few]
    measured = rows.mapInArrow(_measure(directions), f"{USED}, norm double, angles binary, near int, angle double") if directions else rows.selectExpr("*", "CAST(0 AS DOUBLE) norm", "CAST('' AS BINARY) angles", "0 near", "CAST(0 AS DOUBLE) angle")
    measured = keep(measured)
    anchors, others = _in_blocks(measured.filter("anchors > 0").withColumn("copies", F.col("anchors")), ANCHORS), _in_blocks(measured, ROWS)
    n_anchors, n_others = (max(1, -(-df.count() // CELL)) for df in (anchors, others))
    group = lambda n, name: F.pmod(F.hash("block"), F.lit(n)).alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    columns = ["block", "label", "n", "dim", "ids", "copies", "vecs", "norms", "angles"]

    # positives: cells of one label
    left = anchors.select(F.col("label").alias("at"), group(n_anchors, "u"), every(n_others, "v"), *columns).groupBy("at", "u", "v")
    right = others.select(F.col("label").alias("at"), group(n_others, "v"), every(n_anchors, "u"), *columns).groupBy("at", "u", "v")
    near = left.cogroup(right).applyInArrow(_positives(positives), FOUND)
    best = keep(_few_first(near, positives))

    # negatives: windows of the different scores of an anchor's positives
    windows = best.groupBy("block", "row", "score").agg(F.min("place").alias("window"))
    per_block = windows.groupBy("block").agg(F.collect_list(F.struct("row", "window", "score")).alias("windows"))
    left = anchors.join(per_block, "block").select(group(n_anchors, "u"), every(n_others, "v"), *columns, "windows").groupBy("u", "v")
    right = others.select(group(n_others, "v"), every(n_anchors, "u"), *columns).groupBy("u", "v")
    far = left.cogroup(right).applyInArrow(_negatives(negatives, low, high), FOUND)
    hard = _few_first(far, negatives).select("block", "row", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"), F.col("place").alias("rank"), "window")

    window = windows.select("block", "row", "score", "window")
    who = anchors.mapInArrow(_names, "block long, row int, anchor_id long, times long")
    pairs = best.drop("window").join(window, ["block", "row", "score"]).select("block", "row", "window", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = pairs.join(hard, ["block", "row", "window"]).join(who, ["block", "row"]).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(shown("anchor_id"), shown("positive_id"), "rank", shown("negative_id"), "positive_score", "negative_score")


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row["block"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.frombuffer(row["ids"], np.int64)), pa.array(np.frombuffer(row["copies"], np.int64))],
                ["block", "row", "anchor_id", "times"],
            )
