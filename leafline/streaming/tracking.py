"""Shape tracking and rate limiting over keyed event streams.

Each rule is one step function on a small state. The batch form streams sorted
partitions through it, the streaming form keeps the state in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafline.streaming.replay import KEPT, replay

LOST_AFTER = 160
TRACKED = "source_id bigint, seq bigint, t bigint, corners array<double>, stable boolean"
TRACK_STATE = "previous array<double>, anchor array<double>, pending array<double>, last_seen bigint, since bigint"
RATE_STATE = "last_kept bigint, average double"

Corners = list[float]  # x0, y0, x1, y1, x2, y2, x3, y3
TrackState = tuple[Corners | None, Corners | None, Corners | None, int, int]

EMPTY_TRACK: TrackState = (None, None, None, 0, -1)


def _distance(a: Corners | None, b: Corners | None) -> float:
    if a is None or b is None:
        return 1.0
    return max(math.hypot(a[i] - b[i], a[i + 1] - b[i + 1]) for i in (0, 2, 4, 6))


def _align(points: Corners, reference: Corners | None) -> Corners:
    """The cyclic shift of the corners nearest to the reference; the first wins ties."""
    if reference is None:
        return points
    shifts = [points[2 * k:] + points[:2 * k] for k in range(4)]
    return min(shifts, key=lambda s: sum((p - q) ** 2 for p, q in zip(s, reference)))


def track_step(state: TrackState, corners: Corners | None, score: float, now: int) -> tuple[TrackState, Corners | None, bool]:
    """Next state, the shape to show, and whether it is stable."""
    previous, anchor, pending, seen, since = state
    if previous is not None and (now < seen or now - seen > LOST_AFTER):
        previous, anchor, pending, seen, since = EMPTY_TRACK
    if corners is None:
        return (previous, None, None, seen, -1), previous, False
    raw = _align(corners, previous)
    moved = _distance(previous, raw)
    if previous is not None and moved > 0.12 and (pending is None or _distance(pending, raw) > 0.025):
        return (previous, None, raw, seen, -1), previous, False
    if score < 0.7:
        anchor, since = None, -1
    elif anchor is None or _distance(anchor, raw) > 0.009:
        anchor, since = raw, now
    if previous is None or moved > 0.12:
        shown = raw
    else:
        tau = 85 if moved < 0.004 else max(16, 85 / (1 + moved * 180))
        weight = 1 - math.exp(-max(1, now - seen) / tau)
        shown = [p + weight * (r - p) for p, r in zip(previous, raw)]
    stable = since >= 0 and now - since >= 220
    return (shown, anchor, None, now, since), shown, stable


def rate_step(state: tuple[int | None, float], now: int, cost: float) -> tuple[tuple[int | None, float], bool]:
    """Next state and whether the event is kept."""
    kept: list[int] = []
    return replay([now], [cost], *state, kept), bool(kept)


def sessions(df: DataFrame, gap: int = LOST_AFTER, bucket: int = 3_600_000) -> DataFrame:
    """Rows with ``session``: the start time of their run without a pause above ``gap``.

    Two levels: windows inside (source, time bucket), then one summary row per
    bucket carries the last time and the last start over. A hot source spreads
    over its buckets.
    """
    d = df.withColumn("_b", F.floor(F.col("t") / bucket))
    ends = d.groupBy("source_id", "_b").agg(F.max("t").alias("_last"))
    by_bucket = Window.partitionBy("source_id").orderBy("_b")
    ends = ends.select("source_id", "_b", F.lag("_last").over(by_bucket).alias("_carried"))
    local = Window.partitionBy("source_id", "_b").orderBy("t", "seq")
    d = d.join(ends, ["source_id", "_b"])
    before = F.coalesce(F.lag("t").over(local), F.col("_carried"))
    d = d.withColumn("_start", F.when(before.isNull() | (F.col("t") - before > gap), F.col("t")))
    starts = d.groupBy("source_id", "_b").agg(F.max("_start").alias("_s"))
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("source_id", "_b", F.max("_s").over(earlier).alias("_open"))
    d = d.join(starts, ["source_id", "_b"])
    running = F.max("_start").over(local.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("session", F.coalesce(running, F.col("_open"))).drop("_b", "_carried", "_start", "_open")


def _stream_groups(
    df: DataFrame, keys: list[str], schema: str, empty: Any, step: Callable[[Any, Any], tuple[Any, tuple | None]]
) -> DataFrame:
    """Sorted partitions through ``step``; memory is one Arrow batch and one state."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, empty
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, state = key, empty
                state, result = step(state, row)
                if result is not None:
                    out.append(result)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, "t", "seq").mapInPandas(read, schema)


def _corners_of(row) -> Corners | None:
    return None if row.corners is None else [float(v) for v in row.corners]


def _track_row(state: TrackState, row) -> tuple[TrackState, tuple]:
    state, shown, stable = track_step(state, _corners_of(row), row.score, row.t)
    return state, (row.source_id, row.seq, row.t, shown, stable)


def _rate_row(state, row) -> tuple[Any, tuple | None]:
    state, kept = rate_step(state, row.t, row.cost)
    return state, (row.source_id, row.seq, row.t, row.cost) if kept else None


def track_batch(frames: DataFrame) -> DataFrame:
    """R1 over a table: (source_id, seq, t, corners ARRAY<DOUBLE> or NULL, score).

    A pause longer than the expiry always starts afresh, so each session is
    independent and one source runs in as many tasks as it has sessions.
    """
    f = sessions(frames.select("source_id", "seq", "t", "corners", "score"))
    return _stream_groups(f, ["source_id", "session"], TRACKED, EMPTY_TRACK, _track_row)


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["t", "seq"], kind="stable")


def _track_group(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now: TrackState = EMPTY_TRACK
    if state.exists:
        now = tuple(list(v) if isinstance(v, (list, tuple)) else v for v in state.get)
    out = []
    for row in _ordered(frames).itertuples(index=False):
        now, result = _track_row(now, row)
        out.append(result)
    state.update(now)
    yield pd.DataFrame(out, columns=["source_id", "seq", "t", "corners", "stable"])


def track_stream(frames: DataFrame) -> DataFrame:
    """R1 on a stream of (source_id, seq, ts TIMESTAMP, corners, score); ``t`` is ``ts`` in milliseconds.

    Rows of a trigger are applied in time order; older ones than the last seen
    reset the track, however late they are: no watermark drops them.  The state
    holds the time last seen, from which the track expires; one small state
    stays for every source, as a timeout would end tracks by when frames arrive.
    """
    f = frames.withColumn("t", F.unix_millis("ts"))
    return f.groupBy("source_id").applyInPandasWithState(
        _track_group, TRACKED, TRACK_STATE, "append", GroupStateTimeout.NoTimeout
    )


def _rate_group(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(state.get) if state.exists else (None, 0.0)
    out = []
    for row in _ordered(frames).itertuples(index=False):
        now, result = _rate_row(now, row)
        if result is not None:
            out.append(result)
    state.update(now)
    yield pd.DataFrame(out, columns=["source_id", "seq", "t", "cost"])


def rate_limit_stream(events: DataFrame) -> DataFrame:
    """R3 on a stream of (source_id, seq, t, cost)."""
    return events.groupBy("source_id").applyInPandasWithState(
        _rate_group, KEPT, RATE_STATE, "append", GroupStateTimeout.NoTimeout
    )
