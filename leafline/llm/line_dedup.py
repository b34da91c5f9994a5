"""Line dedup: documents probe sharded perfect-hash tables of line counts instead of joining lines.

Blocks of documents send the fingerprints of their distinct long line keys to
shards.  A shard builds a minimal perfect hash over its distinct fingerprints,
which indexes compact arrays (a short fingerprint, a saturated count of
documents, the last block that holds the key); the keys of each block are
looked up in them, and two bits a key go back: common, and held by a later
block.  A key of every document costs its shard one entry per block.

Defined results: a null or empty text is one empty line; rows of one doc_id
count as one document, and each gives a row; a null id is one document below
all others; keys are cut at ASCII white space, so a line of other white space
has a key; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm import arrays as A
from leafline.llm.mph import PerfectHash
from leafline.llm.spread import deal, in_blocks, in_order, ordered, packed, profile, slots, small_batches

MIN_LENGTH = 20  # code points of a key
MIN_DOCUMENTS = 3


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (an empty text has one empty line), and the number of lines before each text."""
    breaks = np.flatnonzero(data == 10)
    text = np.searchsorted(offsets, breaks, "right") - 1
    n = 1 + np.bincount(text, minlength=len(offsets) - 1)
    before = np.concatenate([[0], np.cumsum(n)])
    starts = np.empty(before[-1], np.int64)
    ends = np.empty(before[-1], np.int64)
    starts[before[:-1]] = offsets[:-1]
    ends[before[1:] - 1] = offsets[1:]
    at = np.arange(len(breaks)) + text  # the line that each break ends
    ends[at] = breaks
    starts[at + 1] = breaks + 1
    return starts, ends, before


def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines as in ``_lines``, which of them have a key that is long enough, and those keys' fingerprints."""
    starts, ends, before = _lines(data, offsets)
    word_at, word_end, _ = A.words(data, offsets)
    low = np.searchsorted(word_at, starts)
    high = np.searchsorted(word_at, ends)
    full = np.flatnonzero(high > low)
    a, b = word_at[low[full]], word_end[high[full] - 1]
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    long = points[b] - points[a] >= MIN_LENGTH
    lower = A.LOWER[data]
    return starts, ends, before, full[long], A.span(A.prefix(lower), a[long], b[long], lower)


def _block_keys(ids: np.ndarray, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a block (increasing), how many documents hold each, and the largest id that does."""
    keys, holders = [], []
    for row, data, offsets in A.chunks(texts):
        _, _, before, line, key = line_keys(data, offsets)
        keys.append(key)
        holders.append(ids[row + np.searchsorted(before, line, "right") - 1])
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    holder = np.concatenate(holders) if holders else np.zeros(0, np.int64)
    order = np.lexsort((holder, key))
    key, holder = key[order], holder[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (holder[1:] != holder[:-1])
    key, holder = key[new], holder[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(key)) - 1
    return key[first], last - first + 1, holder[last] if len(key) else holder


def dedup_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, carried: Column | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every document, and ``carried`` of its row as a column of that name."""
    spark = docs.sparkSession
    small_batches(spark)
    bounds, _ = profile(docs)
    shards = slots(spark)
    blocks = in_blocks(docs, bounds, carried)
    carries = carried is not None

    def send(group: pa.Table) -> pa.Table:
        ids, _, texts = ordered(group)
        key, count, _ = _block_keys(ids, texts)
        count = np.minimum(count, min_documents).astype(np.uint8)
        parts = deal(key, shards)
        block = group.column("block")[0].as_py()
        return packed({"shard": [s for s, _ in parts], "block": [block] * len(parts), "keys": [key[i].tobytes() for _, i in parts], "counts": [count[i].tobytes() for _, i in parts]})

    def answer(group: pa.Table) -> pa.Table:
        blocks_, sizes = group.column("block").to_numpy(), []
        keys = [np.frombuffer(x, np.uint64) for x in group.column("keys").to_pylist()]
        counts = [np.frombuffer(x, np.uint8) for x in group.column("counts").to_pylist()]
        sizes = [len(x) for x in keys]
        key = np.concatenate(keys)
        distinct = np.unique(key)
        table = PerfectHash(distinct)
        at = table.index(distinct)
        prints = np.empty(table.size, np.uint16)
        prints[at] = distinct.astype(np.uint16)  # the low bits, which neither the shard nor the cell is taken from directly
        total = np.zeros(table.size, np.int64)
        last = np.full(table.size, -1, np.int32)
        at = table.index(key)
        np.add.at(total, at, np.concatenate(counts))
        np.maximum.at(last, at, np.repeat(blocks_, sizes))
        total = np.minimum(total, min_documents).astype(np.uint8)
        out = []
        for block, asked in zip(blocks_.tolist(), keys):
            at = table.index(asked)
            common = (prints[at] == asked.astype(np.uint16)) & (total[at] >= min_documents)
            out.append(np.packbits(np.concatenate([common, last[at] > block])).tobytes())
        return packed({"block": blocks_.tolist(), "shard": group.column("shard").to_pylist(), "bits": out})

    def drop(group: pa.Table, answers: pa.Table) -> pa.Table:
        group = in_order(group)
        ids, given, texts = ordered(group)
        key, _, largest = _block_keys(ids, texts)
        common, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
        told = dict(zip(answers.column("shard").to_pylist(), answers.column("bits").to_pylist()))
        for shard, at in deal(key, shards):
            bits = np.unpackbits(np.frombuffer(told[shard], np.uint8))[: 2 * len(at)].astype(bool)
            common[at], later[at] = bits[: len(at)], bits[len(at) :]
        n_lines, n_dropped, kept = [], [], []
        for row, data, offsets in A.chunks(texts):
            starts, ends, before, line, found = line_keys(data, offsets)
            at = np.searchsorted(key, found)
            holder = ids[row + np.searchsorted(before, line, "right") - 1]
            gone = np.zeros(len(starts), bool)
            gone[line] = common[at] & (later[at] | (holder < largest[at]))
            n_lines.append(np.diff(before))
            n_dropped.append(A.counts(gone, before))
            raw = data.tobytes()
            for i, dropped in enumerate(n_dropped[-1].tolist()):
                if dropped:
                    stay = np.flatnonzero(~gone[before[i] : before[i + 1]]) + before[i]
                    kept.append(b"\n".join([raw[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist())]).decode())
                else:
                    kept.append(raw[offsets[i] : offsets[i + 1]].decode())
        out = pa.table({"doc_id": given, "n_lines": pa.array(np.concatenate(n_lines)), "n_dropped": pa.array(np.concatenate(n_dropped)), "kept_text": pa.array(kept, pa.string())})
        return out.append_column("carried", group.column("carried")) if carries else out

    schema = "doc_id long, n_lines long, n_dropped long, kept_text string"
    if carries:
        schema += f", carried {blocks.schema['carried'].dataType.simpleString()}"
    sent = blocks.groupBy("block").applyInArrow(send, "shard int, block int, keys binary, counts binary")
    answers = sent.groupBy("shard").applyInArrow(answer, "block int, shard int, bits binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(drop, schema)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, less the lines that others repeat; n_chars, if there, is that of the new text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = dedup_lines(docs, carried=F.struct(*[F.col(c) for c in others]) if others else None)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[(new[c] if c in new else F.col(c) if c == "doc_id" else F.col("carried")[c]).alias(c) for c in docs.columns])
