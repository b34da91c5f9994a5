"""How the operators of this package deal work out: blocks of documents, shards of keys, shared folders.

A block is a range of doc_ids, so of two blocks the one with the smaller number
holds the smaller ids.  Blocks pre-aggregate: a block tells a shard each of its
keys once, however many rows hold it, so a key of a third of all rows costs its
shard one entry per block.  Shards answer to blocks, and a block's texts are
next to the answers by one co-partitioned cogroup.  No key's rows ever meet in
one task, and nothing grows in the driver but one boundary per block.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.runtime import ship

BLOCK_BYTES = 8 << 20  # text a block holds, about
NO_ID = -(2**63)
ARROW_ROWS = 256  # rows per Arrow batch: very long texts may come together


def slots(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def small_batches(spark: SparkSession) -> None:
    """Ready the session for functions over Arrow batches: few rows each, as rows are whole texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there; survives lost executors.

    The folder is ``spark.checkpoint.dir`` of the session.  Only a local master
    may run without one; then a new folder is taken.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir names no shared folder")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark removes the shuffle files of every query that has ended.

    For operators of many rounds: each of them writes its result with ``keep``,
    so the files that led to it would only fill the disks until the driver
    happens to collect its garbage.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def profile(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[list[int], int]:
    """Boundaries of the blocks (increasing doc_ids) and the bytes of all texts, by one aggregation."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * slots(spark), math.ceil(total / block_bytes))
    steps = [i / blocks for i in range(1, blocks)]
    bounds = docs.agg(F.percentile_approx("doc_id", steps, 100 * blocks)).first()[0] or []
    return sorted(set(bounds)), total


def in_blocks(docs: DataFrame, bounds: list[int], carried: Column | None = None) -> DataFrame:
    """(block, doc_id, text), and ``carried`` as a column of that name, one partition of the exchange for several blocks; a null doc_id is in block 0."""
    block: Column = F.lit(0)
    names = [] if carried is None else ["carried"]
    docs = docs.select("doc_id", "text", *[carried.alias(n) for n in names])
    if bounds:
        # the number of boundaries at or below the id: first among every step-th one, then between two of these
        step = math.isqrt(len(bounds)) + 1
        below = F.size(F.filter(_longs(bounds[step - 1 :: step]), lambda b: b <= F.col("doc_id")))
        near = F.slice(_longs(bounds), F.col("below") * step + 1, step)
        docs = docs.select("doc_id", "text", *names, below.alias("below"))
        block = F.coalesce(F.col("below") * step + F.size(F.filter(near, lambda b: b <= F.col("doc_id"))), F.lit(0))
        block = F.when(F.col("doc_id").isNull(), 0).otherwise(block)
    return docs.select(block.cast("int").alias("block"), "doc_id", "text", *names).repartition(slots(docs.sparkSession), "block")


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<long>")


def in_order(group: pa.Table) -> pa.Table:
    return group.take(pc.sort_indices(group, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))


def ordered(group: pa.Table) -> tuple[np.ndarray, pa.ChunkedArray, pa.ChunkedArray]:
    """A block's ids (a null one below all others), ids as they are, and texts, in an order that does not hang on how rows arrived."""
    group = in_order(group)
    ids = group.column("doc_id")
    return ids.fill_null(NO_ID).to_numpy(), ids, group.column("text")


def deal(keys: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """Positions of the keys (increasing) by shard; shards without a key are left out."""
    shard = (keys >> np.uint64(40)) % np.uint64(shards)
    order = np.argsort(shard.astype(np.uint32), kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
    return [(s, order[bounds[s] : bounds[s + 1]]) for s in np.flatnonzero(np.diff(bounds)).tolist()]


def packed(columns: dict[str, list]) -> pa.Table:
    """A table of int and binary columns."""
    return pa.table({k: pa.array(v, pa.int32() if k in ("shard", "block", "kind") else pa.binary()) for k, v in columns.items()})


def few(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if its counted rows are no more than ``most``."""
    return F.broadcast(rows) if rows.count() <= most else rows


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder that checkpoints go to; the caller writes there with Spark."""
    keep(spark.range(0))  # names the folder, if no query has yet
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"
