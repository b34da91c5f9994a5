"""Rate limit over a table, chunk by chunk of time.

Whether an event is kept depends on the time of the last kept event and on a
running cost.  Both are forgotten: an event 80 ms after another is kept whatever
came before, and each kept event takes a fifth of what is left of older costs
away, down to the last bit.  So the state at the end of a chunk hangs on little
more than how long before the chunk an event was kept.

First, every chunk is replayed for all of these 80 lags at once, from a guessed
cost; replays that have come to one state go on as one.  The tables of a source
are applied one after the other and give every chunk a state to start from.
Then the chunks are replayed from these states, and the state at the end of
each is compared with that at the start of the next one.  Where they differ the
later chunk is replayed again.  When all agree, the first chunk is right, hence
the second, and so on: the result is that of one pass over the source.  Chunks
too short to forget a cost may differ for long; their sources end as one stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafline.operators.ordering import whole
from leafline.runtime import cut_lineage

LEAST, MOST = 33, 80  # milliseconds between kept events
CHUNK = 600_000  # milliseconds of events in a chunk
ROUNDS = 4  # after which sources that still differ are replayed in one pass each

KEYS = ["source", "no_source", "chunk"]
KEPT = "source_id bigint, seq bigint, t bigint, cost double"
_TABLE = "source bigint, no_source boolean, chunk bigint, begin bigint, last array<bigint>, average array<double>"
_STATE = "source bigint, no_source boolean, chunk bigint, last bigint, average double"
_STATES = pa.schema([("source", pa.int64()), ("no_source", pa.bool_()), ("chunk", pa.int64()), ("last", pa.int64()), ("average", pa.float64())])


def interval(average: float) -> int:
    """The least time between kept events at a running cost."""
    scaled = average * 1.4 + 0.5
    return MOST if scaled >= MOST else int(scaled // 1) if scaled >= LEAST else LEAST


def mean(average: float, cost: float) -> float:
    """The running cost after a kept event."""
    return cost if average == 0 else average * 0.8 + cost * 0.2


def replay(times: list[int], costs: list[float], last: int | None, average: float, kept: list[int] | None = None) -> tuple[int | None, float]:
    """The state after events; ``kept`` gets the places of those that are kept."""
    due = None if last is None else last + interval(average)
    for i, t in enumerate(times):
        if due is None or t >= due:
            last, average = t, mean(average, costs[i])
            due = t + interval(average)
            if kept is not None:
                kept.append(i)
    return last, average


def all_lags(times: list[int], costs: list[float], guess: float) -> list[tuple[int, float] | None]:
    """For events that were kept 1, 2, ... 80 ms before the first one: the state at the end, or None if no event is kept."""
    due = {lag: times[0] - lag + interval(guess) for lag in range(1, MOST + 1)}
    # replays by state; the first kept event brings all that keep it to one state
    running: dict[tuple[int, float], list[int]] = {}
    for i, (t, cost) in enumerate(zip(times, costs)):
        if not due and len(running) == 1:
            ((state, lags),) = running.items()
            running = {replay(times[i:], costs[i:], *state): lags}
            break
        moved: dict[tuple[int, float], list[int]] = {}
        for state, lags in running.items():
            now = (t, mean(state[1], cost)) if t - state[0] >= interval(state[1]) else state
            moved[now] = moved.get(now, []) + lags
        first = [lag for lag, at in due.items() if t >= at]
        for lag in first:
            del due[lag]
        if first:
            now = (t, mean(guess, cost))
            moved[now] = moved.get(now, []) + first
        running = moved
    ends: dict[int, tuple[int, float]] = {lag: state for state, lags in running.items() for lag in lags}
    return [ends.get(lag) for lag in range(1, MOST + 1)]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("source", pa.int64()), ("no_source", pa.bool_()), ("chunk", pa.int64()), ("begin", pa.int64()), ("last", pa.list_(pa.int64())), ("average", pa.list_(pa.float64()))])
    for table, bounds in whole(batches, KEYS):
        c = {k: table.column(k).to_pylist() for k in (*KEYS, "t", "cost", "guess", "opens")}
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            times, costs = c["t"][a:b], c["cost"][a:b]
            ends = [replay(times, costs, None, 0.0)] if c["opens"][a] else all_lags(times, costs, c["guess"][a])
            out.append({k: c[k][a] for k in KEYS} | {"begin": times[0], "last": [e and e[0] for e in ends], "average": [e and e[1] for e in ends]})
        yield pa.RecordBatch.from_pylist(out, schema)


def _guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each chunk starts with, by the tables of the chunks before it."""
    source, last, average = None, None, 0.0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if source != (row["source"], row["no_source"]):
                source, last, average = (row["source"], row["no_source"]), None, 0.0
            out.append({**{k: row[k] for k in KEYS}, "last": last, "average": average})
            lag = 0 if last is None else min(MOST, row["begin"] - last) - 1
            if row["last"][lag] is not None:
                last, average = row["last"][lag], row["average"][lag]
        yield pa.RecordBatch.from_pylist(out, _STATES)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the end of each chunk, from the one that it is told."""
    for table, bounds in whole(batches, KEYS):
        c = {k: table.column(k).to_pylist() for k in (*KEYS, "t", "cost", "last", "average")}
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            last, average = replay(c["t"][a:b], c["cost"][a:b], c["last"][a], c["average"][a])
            out.append({k: c[k][a] for k in KEYS} | {"last": last, "average": average})
        yield pa.RecordBatch.from_pylist(out, _STATES)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, bounds in whole(batches, KEYS):
        c = {k: table.column(k).to_pylist() for k in ("t", "cost", "last", "average")}
        rows: list[int] = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            kept: list[int] = []
            replay(c["t"][a:b], c["cost"][a:b], c["last"][a], c["average"][a], kept)
            rows.extend(a + i for i in kept)
        some = table.select(["source_id", "seq", "t", "cost"]).take(pa.array(np.array(rows, np.int64)))
        yield from some.combine_chunks().to_batches()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over sorted sources, with one state in memory."""
    source, last, average = None, None, 0.0
    for batch in batches:
        c = {k: batch.column(k).to_pylist() for k in ("source", "no_source", "t", "cost")}
        keep = []
        for i, key in enumerate(zip(c["source"], c["no_source"])):
            if key != source:
                source, last, average = key, None, 0.0
            before = last
            last, average = replay(c["t"][i : i + 1], c["cost"][i : i + 1], last, average)
            if last != before:
                keep.append(i)
        yield batch.select(["source_id", "seq", "t", "cost"]).take(pa.array(np.array(keep, np.int64)))


def rate_limit_batch(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """R3 over a table: kept rows of (source_id, seq, t, cost).

    Of events of one time only the first can be kept, so they combine before
    the shuffle.  Events are shuffled once, by source and chunk, and written to
    the checkpoint folder; a source of any size is as many tasks as it has
    chunks, and sources of one chunk are streamed as they are.  Events without a time or cost are left out.
    """
    e = events.where(F.col("t").isNotNull() & F.col("cost").isNotNull()).select(
        F.coalesce("source_id", F.lit(0).cast("long")).cast("long").alias("source"), F.col("source_id").isNull().alias("no_source"), F.floor(F.col("t") / chunk).cast("long").alias("chunk"),
        F.col("t").cast("long").alias("t"), F.struct("seq", F.col("cost").cast("double").alias("cost")).alias("event"),
    )
    e = e.groupBy(*KEYS, "t").agg(F.min("event").alias("event")).select(*KEYS, "t", "event.seq", "event.cost")
    chunks = e.groupBy(*KEYS).agg(F.sum("cost").alias("sum"), F.count("*").alias("n"))
    sources = chunks.groupBy("source", "no_source").agg(F.min("chunk").alias("start"), F.max("chunk").alias("end"), (F.sum("sum") / F.sum("n")).alias("guess"))
    named = F.when(~F.col("no_source"), F.col("source")).alias("source_id")
    long = cut_lineage(sources.where(F.col("start") != F.col("end")))
    short = e.select("*", named) if long.isEmpty() else e.join(long, ["source", "no_source"], "left_anti").select("*", named)
    brief = short.repartition("source", "no_source").sortWithinPartitions("source", "no_source", "t").mapInArrow(_streamed, KEPT)
    if long.isEmpty():
        return brief
    rows = e.join(long, ["source", "no_source"]).withColumn("opens", F.col("chunk") == F.col("start")).drop("start", "end")
    rows = cut_lineage(rows.withColumn("source_id", named).repartition(*KEYS))

    def over(told: DataFrame, run, schema: str) -> DataFrame:
        return told.sortWithinPartitions(*KEYS, "t").mapInArrow(run, schema)

    in_order = ["source", "no_source", "chunk"]
    tables = over(rows, _tables, _TABLE).repartition("source", "no_source").sortWithinPartitions(*in_order)
    states = cut_lineage(tables.mapInArrow(_guessed, _STATE))
    following = Window.partitionBy("source", "no_source").orderBy("chunk")
    links = states.select(*KEYS, F.lead("chunk").over(following).alias("next"))
    todo, late = states, None
    for _ in range(ROUNDS):
        ends = over(rows.join(todo, KEYS), _ends, _STATE).join(links, KEYS).where(F.col("next").isNotNull())
        ends = ends.select("source", "no_source", F.col("next").alias("chunk"), F.col("last").alias("true_last"), F.col("average").alias("true_average"))
        same = F.col("last").eqNullSafe(F.col("true_last")) & F.col("average").eqNullSafe(F.col("true_average"))
        todo = cut_lineage(states.join(ends, KEYS).where(~same).select(*KEYS, F.col("true_last").alias("last"), F.col("true_average").alias("average")))
        if todo.isEmpty():
            break
        # chunks that start otherwise than was told are replayed
        states = cut_lineage(states.join(todo.select(*KEYS), KEYS, "left_anti").unionByName(todo))
    else:
        late = todo.select("source", "no_source").distinct()
        states = states.join(late, ["source", "no_source"], "left_anti")
    kept = brief.union(over(rows.join(states, KEYS), _kept, KEPT))
    if late is None:
        return kept
    streams = rows.join(late, ["source", "no_source"]).repartition("source", "no_source").sortWithinPartitions("source", "no_source", "t")
    return kept.union(streams.mapInArrow(_streamed, KEPT))
