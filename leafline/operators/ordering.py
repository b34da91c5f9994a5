"""Positions inside a key that may be very large."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafline.runtime import cut_lineage, ship


def chunked_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, name: str
) -> DataFrame:
    """0-based position of each row within ``keys``, ranked in two levels.

    ``chunk`` must not decrease along ``order``. Rows are ranked inside
    (keys, chunk); only one row per chunk is ordered per key to get the offset,
    so one hot key spreads over as many tasks as it has chunks.
    """
    keys = list(keys)
    d = df.withColumn("_chunk", chunk)
    sizes = d.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    ranked = d.withColumn("_local", F.row_number().over(local))
    return (
        ranked.join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_off") + F.col("_local") - 1)
        .drop("_chunk", "_off", "_local")
    )


def whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of sorted rows that end where a key ends, and the bounds of their keys."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        new = np.zeros(rest.num_rows, bool)
        new[0] = True
        for key in keys:
            values = rest.column(key).combine_chunks()
            here, before = values.slice(1), values.slice(0, len(values) - 1)
            other = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(here.is_null(), before.is_null()))
            new[1:] |= other.to_numpy(zero_copy_only=False)
        bounds = np.flatnonzero(new)
        if len(bounds) > 1:
            yield rest.slice(0, int(bounds[-1])), bounds
            rest = rest.slice(int(bounds[-1]))
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


# ---------------------------------------------------------------- rows that lie together

#: input bytes that one partition of gathered rows is made for
PART_BYTES = 4 << 20


def laid_by(df: DataFrame) -> tuple[str, ...]:
    """Columns whose equal rows are known to lie next to each other in one partition; none if that is not known."""
    return df.__dict__.get("_laid", ())


def laid(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, known to hold the rows of equal ``keys`` next to each other in one partition."""
    df._laid = tuple(keys)
    return df


def still(df: DataFrame, before: DataFrame) -> DataFrame:
    """``df``, made of ``before`` row by row (columns, filters, generators), so its rows lie as they did."""
    return laid(df, laid_by(before)) if set(laid_by(before)) <= set(df.columns) else df


def deal(df: DataFrame, keys: Sequence[str], like: DataFrame | None = None) -> DataFrame:
    """Rows of equal ``keys`` in one partition, of twice as many as the session asks for, or more by the bytes read (of ``like``, to match it).

    Spark takes a number of its own for a shuffle that it may change while it runs, so none is taken for one of these.
    """
    size = int(str((df if like is None else like)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 50 else 0  # Spark takes what it cannot tell for very large
    parts = max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // PART_BYTES))
    return df.repartition(parts, *keys)


def gather(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of equal ``keys`` next to each other; done before they are taken apart, so that larger rows need not move."""
    return laid(deal(df, keys).sortWithinPartitions(*keys), keys)


def _ranks(column: pa.ChunkedArray, down: bool) -> list[np.ndarray]:
    """Arrays that sort as Spark sorts the column: nulls least, NaN above all numbers."""
    kind = column.type
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        column, kind = pc.rank(column.combine_chunks(), "ascending", null_placement="at_start", tiebreaker="dense").cast(pa.int64()), pa.int64()
    null = column.is_null().to_numpy() if column.null_count else np.zeros(len(column), bool)
    if pa.types.is_integer(kind):
        value, odd = pc.fill_null(column, 0).to_numpy().astype(np.int64), np.where(null, -1, 0)
    else:
        value = column.to_numpy().astype(float)
        odd = np.where(null, -1, np.where(np.isnan(value), 1, 0))
        value = np.where(odd == 0, value, 0.0)
    out = [odd, value] if odd.any() else [value]
    return [-r for r in out] if down else out


def _ids(table: pa.Table, held: Sequence[str], at: np.ndarray) -> list[tuple]:
    return list(zip(*(table.column(c).combine_chunks().take(pa.array(at)).to_pylist() for c in held)))


class _Riders:
    """Rows that lead a partition, to be handed out with the rows of their keys."""

    def __init__(self, batches: Iterator[pa.RecordBatch], held: Sequence[str]):
        self.batches, self.held, self.home, self.at, self.of = batches, list(held), None, {}, None
        self.table: pa.Table | None = None

    def rest(self) -> Iterator[pa.RecordBatch]:
        """The rows behind the riders."""
        found: list[pa.Table] = []
        for batch in self.batches:
            if batch.num_rows and self.home is None:
                self.home = batch.column("_home")[0]
            if batch.num_rows and not pc.all(pc.equal(batch.column("_home"), self.home)).as_py():
                raise RuntimeError("rows and the rows that ride with them were dealt to different partitions")
            rides = batch.column("_rides")
            if self.table is None and rides.true_count:
                found.append(pa.Table.from_batches([batch.filter(rides)]))
                batch = batch.filter(pc.invert(rides))
            if rides.false_count and batch.num_rows:
                if self.table is None:
                    self._take(found, batch.schema)
                elif rides.true_count:
                    raise RuntimeError("a row that rides came after the rows of its partition")
                yield batch

    def _take(self, found: list[pa.Table], schema: pa.Schema) -> None:
        self.table = pa.concat_tables(found) if found else schema.empty_table()
        number = [self.at.setdefault(id_, len(self.at)) for id_ in _ids(self.table, self.held, np.arange(self.table.num_rows))]
        order = np.argsort(number, kind="stable")
        self.table = self.table.combine_chunks().take(pa.array(order, pa.int64()))
        self.of = np.searchsorted(np.array(number, np.int64)[order], np.arange(len(self.at) + 1))

    def of_keys(self, table: pa.Table, first: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        """Riders of the keys that begin at the rows ``first``, and the number of the key of each."""
        known = [(group, self.at[id_]) for group, id_ in enumerate(_ids(table, self.held, first)) if id_ in self.at]
        group, number = (np.array(c, np.int64) for c in zip(*known)) if known else (np.zeros(0, np.int64),) * 2
        many = self.of[number + 1] - self.of[number]
        rows = np.arange(many.sum()) + np.repeat(self.of[number] - (np.cumsum(many) - many), many)
        return self.table.take(pa.array(rows, pa.int64())), np.repeat(group, many)


def arranged(
    batches: Iterator[pa.RecordBatch], held: Sequence[str], keys: Sequence[str], order: Sequence[tuple[str, bool]], riders: bool = False
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole ``held`` keys, sorted by ``keys`` and ``order`` (column, descending), and the first rows of their keys."""
    ride = _Riders(batches, held) if riders else None
    for table, bounds in whole(ride.rest() if ride else batches, list(held)):
        n = table.num_rows
        first = bounds[bounds < n]
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        if ride:
            more, of = ride.of_keys(table, first)
            table, group = pa.concat_tables([table, more]), np.append(group, of)
            n = table.num_rows
        ranks = [group]
        for key in keys:
            if key not in held:
                ranks += _ranks(table.column(key), False)
        inner = [r for name, down in order for r in _ranks(table.column(name), down)]
        at = np.lexsort((ranks + inner)[::-1])
        if (np.diff(at) != 1).any():
            table = table.combine_chunks().take(pa.array(at))
        new = np.zeros(n, bool)
        new[0] = True
        for rank in ranks:
            new[1:] |= np.diff(rank[at]) != 0
        yield table, np.flatnonzero(new)


def _dealt_alike(df: DataFrame, riders: DataFrame, held: Sequence[str]) -> DataFrame | None:
    """In each partition the riders of its keys, then the rows of ``df``; nothing if Spark does not place both by these keys."""

    def parted(rows: DataFrame):
        found = rows._jdf.queryExecution().sparkPlan().outputPartitioning()
        return found if found.getClass().getSimpleName() == "HashPartitioning" else None

    dealt = parted(df)
    if dealt is None or dealt.numPartitions() == int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return None
    parts = dealt.numPartitions()
    home = F.pmod(F.hash(*held), F.lit(parts)).alias("_home")
    first = riders.repartition(parts, *held).select("*", F.lit(True).alias("_rides"), home)
    both = first.unionByName(df.select("*", F.lit(False).alias("_rides"), home), allowMissingColumns=True)
    found = parted(both)
    if found is None or found.numPartitions() != parts or found.expressions().size() != len(held):
        return None
    return both


def page_pass(
    df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], read: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]],
    schema: StructType, riders: DataFrame | None = None,
) -> DataFrame:
    """``read`` over tables of whole ``keys``, sorted by ``keys`` and ``order`` (column, descending).

    Rows that already lie by some of the keys are sorted a few keys at a time
    where they are; others are shuffled and sorted by Spark. ``read`` gives its rows
    key after key, so its result lies as its input does. ``riders`` are
    few rows with some of the columns of ``df`` that ``read`` gets among the rows of
    their key; keys that only riders have may be left out.
    """
    keys, order = list(keys), list(order)
    held = laid_by(df)
    ship(df.sparkSession)
    if held and set(held) <= set(keys):
        rows = df if riders is None else _dealt_alike(df, riders, held)
        if rows is not None:
            carried = riders is not None

            def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for table, bounds in arranged(batches, held, keys, order, carried):
                    yield from read(table, bounds)

            return laid(rows.mapInArrow(place, schema), held)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole(batches, keys):
            yield from read(table, bounds)

    both = df if riders is None else df.unionByName(riders, allowMissingColumns=True)
    ordered = both.repartition(*keys).sortWithinPartitions(*keys, *[F.desc(c) if down else F.asc(c) for c, down in order])
    return laid(ordered.mapInArrow(one, schema), keys)


def cut_packed(df: DataFrame) -> DataFrame:
    """``cut_lineage`` of rows written in compressed batches, a fraction of their size; they lie as they did."""
    schema = df.schema
    ship(df.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0):
                yield from pa.ipc.open_stream(rows.as_buffer())

    return still(cut_lineage(df.mapInArrow(pack, "rows binary")).mapInArrow(unpack, schema), df)


def shared(df: DataFrame) -> DataFrame:
    """``df``, the same to all who read it: Spark makes a shuffle once for readers only if they take the same columns of it."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches

    return still(df.mapInArrow(same, df.schema), df)


def bundled(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row for each of the ``keys`` with its ``fields`` as arrays, which take less room on their way than rows; ``unbundled`` takes them apart."""
    keys, fields = list(keys), list(fields)
    schema = df.select(*keys, *[F.array(c).alias(c) for c in fields]).schema

    def bundle(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = bounds[bounds < table.num_rows]
        ends = pa.array(np.append(first, table.num_rows), pa.int32())
        out = {k: table.column(k).combine_chunks().take(pa.array(first)) for k in keys}
        out |= {c: pa.ListArray.from_arrays(ends, table.column(c).combine_chunks()) for c in fields}
        yield from pa.table(out).to_batches()

    return page_pass(still(df.select(*keys, *fields), df), keys, [], bundle, schema)


def unbundled(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.inline_outer(F.arrays_zip(*fields)).alias(*fields))
