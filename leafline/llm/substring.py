"""Substring dedup over words: a count-min prefilter, then exact groups of the windows estimated repeated.

Blocks of documents send partition sketches of their distinct windows; shards
merge them and answer (see ``sketch``).  A second pass sends only the windows
whose estimate is two or more, once a block, by a 96-bit fingerprint, and its
shard tells a block which of them an earlier block holds as well.  Blocks are
ranges of doc_ids, so an earlier block has the smaller ids.

Defined results: null and empty texts have no words and an empty kept text;
rows of one doc_id are one document to each other, none removes words of the
other, and each gives a row; a null id is below all others; texts shorter than
a window lose nothing; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafline.llm import arrays as A
from leafline.llm.sketch import ANSWERED, SENT, Sketch, pack_sorted, unpack_sorted
from leafline.llm.spread import deal, in_blocks, ordered, packed, profile, slots, small_batches

WINDOW = 50
BYTES_PER_WORD = 6  # only to set the sketch's width
_LOCAL = -1  # kind of rows that a block sends to itself
_SECOND = np.uint64(0x8CB92BA72F3D8DD7)


def _windows(ids: np.ndarray, texts: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a block: fingerprint, 32 more bits, the word they start at (counted over the block), the holder."""
    keys, second, at_, holder, words = [], [], [], [], 0
    for row, data, offsets in A.chunks(texts):
        starts, ends, first = A.words(data, offsets)
        word = A.span(A.prefix(data), starts, ends, data)
        key, at = A.windows(word, first, k)
        keys.append(key)
        second.append((A.windows(A.mix(word ^ _SECOND), first, k)[0] >> np.uint64(32)).astype(np.uint32))
        at_.append(at + words)
        holder.append(ids[row + np.searchsorted(first, at, "right") - 1])
        words += len(starts)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(keys, np.uint64), join(second, np.uint32), join(at_, np.int64), join(holder, np.int64)


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by one space) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    bounds, total = profile(docs)
    shards = slots(spark)
    sketch = Sketch(total / BYTES_PER_WORD, shards, depth=2)
    blocks = in_blocks(docs, bounds)

    def send(group: pa.Table) -> pa.Table:
        ids, _, texts = ordered(group)
        key, _, _, holder = _windows(ids, texts, window)
        order, runs = A.groups(key)
        # a block counts a window twice if two of its documents hold it
        low = np.minimum.reduceat(holder[order], runs) if len(runs) else holder
        high = np.maximum.reduceat(holder[order], runs) if len(runs) else holder
        return sketch.send(group.column("block")[0].as_py(), key[order[runs]], low < high)

    def candidates(group: pa.Table, answers: pa.Table) -> pa.Table:
        ids, _, texts = ordered(group)
        key, second, at, holder = _windows(ids, texts, window)
        maybe = np.flatnonzero(sketch.repeated(key, answers)) if len(key) else np.zeros(0, np.int64)
        key, second, at, holder = key[maybe], second[maybe], at[maybe], holder[maybe]
        order, runs = A.groups(key)
        size = np.diff(np.append(runs, len(order)))
        first = np.minimum.reduceat(holder[order], runs) if len(runs) else holder
        later = np.empty(len(key), bool)  # another document of the block holds it before
        later[order] = holder[order] > np.repeat(first, size)
        block = group.column("block")[0].as_py()
        own = pack_sorted(at[later])
        key, second, at = key[~later], second[~later], at[~later]
        parts = deal(key, shards)
        return packed(
            {
                "shard": [s for s, _ in parts] + [block % shards],
                "block": [block] * (len(parts) + 1),
                "kind": [0] * len(parts) + [_LOCAL],
                "at": [pack_sorted(at[i]) for _, i in parts] + [own],
                "keys": [key[i].tobytes() for _, i in parts] + [b""],
                "second": [second[i].tobytes() for _, i in parts] + [b""],
            }
        )

    def exact(group: pa.Table) -> pa.Table:
        block, at, kind = group.column("block").to_numpy(), group.column("at").to_pylist(), group.column("kind").to_numpy()
        asked = np.flatnonzero(kind != _LOCAL)
        keys = [np.frombuffer(group.column("keys")[i].as_py(), np.uint64) for i in asked.tolist()]
        second = [np.frombuffer(group.column("second")[i].as_py(), np.uint32) for i in asked.tolist()]
        again = _held_before(np.repeat(block[asked], [len(x) for x in keys]), np.concatenate(keys), np.concatenate(second)) if len(asked) else np.zeros(0, bool)
        cuts = np.cumsum([0] + [len(x) for x in keys])
        for j, i in enumerate(asked.tolist()):
            at[i] = pack_sorted(unpack_sorted(at[i])[again[cuts[j] : cuts[j + 1]]])
        return packed({"block": block.tolist(), "at": at})

    def cut(group: pa.Table, answers: pa.Table) -> pa.Table:
        ids, given, texts = ordered(group)
        told = [unpack_sorted(x) for x in answers.column("at").to_pylist()]
        again = np.sort(np.concatenate(told)) if told else np.zeros(0, np.int64)
        n_words, n_removed, kept, words = [], [], [], 0
        for _, data, offsets in A.chunks(texts):
            starts, ends, first = A.words(data, offsets)
            flags = np.zeros(len(starts), bool)
            flags[again[np.searchsorted(again, words) : np.searchsorted(again, words + len(starts))] - words] = True
            gone = A.spread_on(flags, window)
            stay = np.flatnonzero(~gone)
            length = ends[stay] - starts[stay] + 1
            # every word with the byte after it, which becomes a space
            put = np.cumsum(length)
            raw = np.append(data, np.uint8(32))[np.repeat(starts[stay] - (put - length), length) + np.arange(put[-1] if len(put) else 0)]
            raw[put - 1] = 32
            bound = np.concatenate([[0], put])[np.searchsorted(stay, first)].tolist()
            text = raw.tobytes()
            kept += [text[a : max(a, b - 1)].decode() for a, b in zip(bound, bound[1:])]
            n_words.append(np.diff(first))
            n_removed.append(A.counts(gone, first))
            words += len(starts)
        return pa.table({"doc_id": given, "n_words": pa.array(np.concatenate(n_words)), "n_removed": pa.array(np.concatenate(n_removed)), "kept_text": pa.array(kept, pa.string())})

    answers = blocks.groupBy("block").applyInArrow(send, SENT).groupBy("shard").applyInArrow(lambda group: sketch.merge(group), ANSWERED)
    sent = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(candidates, "shard int, block int, kind int, at binary, keys binary, second binary")
    found = sent.groupBy("shard").applyInArrow(exact, "block int, at binary")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def _held_before(block: np.ndarray, key: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which (key, second) pairs an earlier block has sent as well."""
    order = np.lexsort((block, second, key))
    k, s, b = key[order], second[order], block[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    runs = np.flatnonzero(new)
    out = np.empty(len(k), bool)
    out[order] = b > np.repeat(b[runs], np.diff(np.append(runs, len(k))))
    return out
