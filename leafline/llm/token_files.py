"""Token ids in Parquet files that can be read in part.

Documents are dealt to shards by ranges of doc_id and written in that order,
one list of ids a document.  Ids are dictionary encoded (their dictionary is
the part of the vocabulary that a row group uses) or delta encoded; the other
columns increase slowly and are delta encoded.  Row groups, pages and the rows
of a page have stated limits, and the writer leaves a column and an offset
index for every page.  So counts and places are read without a token, and the
ids of a few documents are read from their pages alone.

A shard knows the places of its documents within it; ``shards`` gives the
number of ids before each shard.  No pass orders all documents at one place.

The tokenizers library sees each different piece of text once: pieces end
before single spaces between two characters that are no white space, where
byte-level pre-tokens always end.

Defined results: null and empty texts have no ids but the end id; a null
doc_id comes first; rows of one doc_id follow one another as they are read, and
are split over shards like any others; a text of any length is
encoded whole; an empty table gives files without rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.llm.spread import few, slots, small_batches

SHARD_BYTES = 64 << 20  # text of a shard, about
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 512
JOINED = 20_000  # new pieces that the library sees as one text
REMEMBERED = 1_200_000  # pieces a worker remembers, to save time only
CHARACTERS = 1 << 20  # of the texts that are encoded together, but for a longer text

_WHITE = [chr(c) for c in range(0x3001) if chr(c) != " " and (chr(c).isspace() or unicodedata.category(chr(c)).startswith("Z"))]
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: pieces that are encoded on their own: with white space besides single line feeds, empty, or with a special token
_ODD = re.compile(r"[^\S\n]|\n\n|^\n|\n\Z|^$|<\|")


def pieces(text: str) -> list[str]:
    """The text cut at single spaces between characters that are no white space; the spaces are left out."""
    plain = "  " not in text and text[:1] != " " and text[-1:] != " " and not any(w in text and (f" {w}" in text or f"{w} " in text) for w in _WHITE)
    return text.split(" ") if plain else _CUT.split(text)


class Encoder:
    """Ids of texts by the tokenizers library, with a memory of pieces.

    New pieces are joined by line feeds into one text for the library: a line
    feed before a space or a word is a pre-token, and an id, of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.feed = self._ids("\n")[0]
        self._forget()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _forget(self) -> None:
        # pieces at the start of a text, and pieces after a space, by their place below
        self.first: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: list[str], space: str, slot: dict[str, int]) -> None:
        # printable text has no white space but spaces, and no line feeds
        plain = [p for p in new if p.isprintable() and p and "<|" not in p]
        self._joined(plain, space, slot, np.arange)
        if len(plain) == len(new):
            return
        rest = [p for p in new if not p.isprintable() or not p or "<|" in p]
        lined = [p for p in rest if _ODD.search(p) is None]
        self._joined(lined, space, slot, lambda n: np.cumsum(np.fromiter((p.count("\n") + 1 for p in lined), np.int64, n)) - 1, len(lined))
        odd = [p for p in rest if _ODD.search(p) is not None]
        if odd:
            each = [self._ids(space + p) for p in odd]
            self._add(odd, slot, np.concatenate(each), np.cumsum([len(e) for e in each]))

    def _joined(self, pieces: list[str], space: str, slot: dict[str, int], last_feeds: Callable[[int], np.ndarray], most: int = JOINED) -> None:
        """Learn pieces as one text; ``last_feeds`` counts the line feeds before the one that follows each of them."""
        for at in range(0, len(pieces), max(1, most)):
            some = pieces[at : at + most]
            ids = self._ids(space + ("\n" + space).join(some))
            feeds, last = np.flatnonzero(ids == self.feed), last_feeds(len(some))
            if len(feeds) != last[-1]:
                raise AssertionError("the vocabulary joins line feeds to words")
            after = feeds[last[:-1]]
            self._add(some, slot, np.delete(ids, after), np.append(after - np.arange(len(after)), len(ids) - len(after)))

    def _add(self, pieces: list[str], slot: dict[str, int], ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(self.ends) - 1
        slot.update(zip(pieces, range(n, n + len(pieces))))
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + ends])

    def _slots(self, pieces: list[str], space: str, slot: dict[str, int]) -> np.ndarray:
        at = np.fromiter(map(slot.get, pieces, repeat(-1)), np.int64, len(pieces))
        missed = np.flatnonzero(at < 0).tolist()
        if missed:
            words = [pieces[i] for i in missed]
            self._learn(list(dict.fromkeys(words)), space, slot)
            at[missed] = [slot[w] for w in words]
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        if len(self.ends) > REMEMBERED:
            self._forget()
        cut = [pieces(t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        first = np.cumsum(sizes) - sizes
        flat = list(chain.from_iterable(cut))
        inner = np.ones(len(flat), bool)
        inner[first] = False
        at = np.empty(len(flat), np.int64)
        at[~inner] = self._slots([c[0] for c in cut], "", self.first)
        at[inner] = self._slots(list(chain.from_iterable(map(islice, cut, repeat(1), repeat(None)))), " ", self.spaced)
        starts, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        ids = self.ids[np.repeat(starts - total[:-1], n) + np.arange(total[-1])]
        return ids, np.diff(np.append(total[first], total[-1]))


@cache
def _encoder(path: str) -> Encoder:
    """A worker's own, so that what it has learned serves its next task."""
    return Encoder(path)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, seq, offset = _encoder(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            at = 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= CHARACTERS:
                    size, end = size + len(texts[end]), end + 1
                ids, n = encoder.encode(texts[at:end])
                bounds = np.concatenate([[0], np.cumsum(n)])
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                rows = end - at
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, rows), pa.array(np.full(rows, shard, np.int32)), pa.array(np.arange(seq, seq + rows, dtype=np.int64)),
                        pa.array(offset + bounds[:-1]), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    ],
                    ["doc_id", "shard", "seq", "offset", "n_tokens", "ids"],
                )
                seq, offset, at = seq + rows, offset + int(bounds[-1]), end

    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, encoding: str = "dictionary",
    shard_bytes: int = SHARD_BYTES, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
) -> None:
    """Encode the texts and write ``folder``/tokens and ``folder``/shards, in ascending order of doc_id.

    ``encoding`` of the ids is "dictionary" or "delta".
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding: {encoding}")
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(slots(spark), math.ceil(total / shard_bytes))
    # the row number lets a doc_id of very many rows end in several shards
    dealt = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    dealt = dealt.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = dealt.mapInArrow(_encode(tokenizer, end_id), "doc_id long, shard int, seq long, offset long, n_tokens long, ids array<int>")
    options = {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
    }
    rows.write.options(**options).parquet(f"{folder}/tokens")
    sizes = metadata(spark, folder).groupBy("shard").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row a shard
    sizes.select("shard", "documents", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first")).write.parquet(f"{folder}/shards")


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, seq, offset and n_tokens of every document, without its ids."""
    return spark.read.parquet(f"{folder}/tokens").drop("ids")


def places(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start (the ids of all documents before it) and n_tokens; with the ids themselves if asked for."""
    rows = spark.read.parquet(f"{folder}/tokens")
    shards = few(spark.read.parquet(f"{folder}/shards").select("shard", "first"))
    return rows.join(shards, "shard").select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", *["ids"] * ids)


def tokens_of(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of some documents: row groups and pages without them are not read."""
    return spark.read.parquet(f"{folder}/tokens").filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, bounds = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers, read from the files."""
    small_batches(spark)
    return places(spark, folder, ids=True).mapInArrow(_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
