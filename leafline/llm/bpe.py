"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes.

Texts are cut into pre-tokens by class runs of their code points (the split
rule of the public rank files: contractions; an optional space and letters,
numbers or others; white space, whose last character goes on its own or with
what follows).  A first tier looks all pre-tokens of a chunk up at once; only
the distinct ones that it misses are merged, lowest rank first.

Defined results: null and empty texts have no ids; repeated rows are encoded
each; a text of any length is encoded whole, in time n log n even for one long
pre-token; extra columns are ignored.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafline.llm import arrays as A
from leafline.llm.mph import PerfectHash
from leafline.llm.spread import small_batches

REMEMBERED = 150_000  # merged pre-tokens a worker remembers, twice over, to save time only

LETTER, NUMBER, OTHER, WHITE = 1, 2, 3, 0


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(x[0], OTHER) for x in map(unicodedata.category, map(chr, range(0x110000)))), np.uint8, 0x110000)
    # the code points of white space in Unicode
    table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    return table


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens start, over all texts of a chunk."""
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _classes()[cp]
    n = len(cp)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at, offsets)] = True
    edge = edge[:n]
    run = edge.copy()
    run[0] = True
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # text after white space: the last white character stands alone, or joins if it is a space
    after = np.flatnonzero(run[1:] & ~edge[1:] & (kind[1:] != WHITE) & (kind[:-1] == WHITE)) + 1
    start[after - 1] = True
    start[after] = cp[after - 1] != 32
    # contractions: an apostrophe that no space joins, then one of s t m d re ve ll
    quote = np.flatnonzero((cp[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~edge[1:])
    one = cp[quote + 1]
    room = quote + 2 < n
    two = np.where(room, cp[np.minimum(quote + 2, n - 1)], 0)
    two = np.where(room & ~edge[np.minimum(quote + 2, n - 1)], two, 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[quote[short | long] + 1] = False
    rest = np.concatenate([quote[short] + 2, quote[long] + 3])
    start[rest[rest < n]] = True
    return at[start]


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """The ids of one pre-token: a heap of neighbouring pairs over linked bytes, lowest rank and leftmost first.

    ``pairs``: the rank of each pair of bytes at 256 * first + second, or -1.
    """
    n = len(piece)
    shift = n.bit_length()
    mask = (1 << shift) - 1
    valid = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]  # rank of the pair that starts at i, or -1
    valid.append(-1)
    heap = [r << shift | i for i, r in enumerate(valid) if r >= 0]
    heapify(heap)
    end = list(range(1, n + 1))  # where the part that starts at i ends
    left = list(range(-1, n - 1))
    get = ranks.get
    while heap:
        key = heappop(heap)
        i = key & mask
        if valid[i] != key >> shift:
            continue  # one of its parts has been merged since
        j = end[i]
        k = end[i] = end[j]
        valid[j] = valid[i] = -1
        if k < n:
            left[k] = i
            x = get(piece[i : end[k]], -1)
            if x >= 0:
                valid[i] = x
                heappush(heap, x << shift | i)
        p = left[i]
        if p >= 0:
            x = valid[p] = get(piece[p:k], -1)
            if x >= 0:
                heappush(heap, x << shift | p)
    out, i = [], 0
    while i < n:
        k = end[i]
        out.append(ranks[piece[i:k]])
        i = k
    return out


class Vocabulary:
    def __init__(self, tokens: list[bytes]) -> None:
        self.ranks = {t: r for r, t in enumerate(tokens)}
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.bounds = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum([len(t) for t in tokens], out=self.bounds[1:])
        prints = A.span(A.prefix(self.bytes), self.bounds[:-1], self.bounds[1:], self.bytes)
        self.hash = PerfectHash(prints)
        at = self.hash.index(prints)
        self.print = np.zeros(len(tokens), np.uint64)
        self.rank = np.zeros(len(tokens), np.uint32)
        self.print[at] = prints
        self.rank[at] = np.arange(len(tokens), dtype=np.uint32)
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.merged: dict[int, list[int]] = {}
        self.older: dict[int, list[int]] = {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, and the number of ids before each text (one entry more than texts)."""
        starts = pre_tokens(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        prints = A.span(A.prefix(data), starts, ends, data)
        at = self.hash.index(prints)
        hit = self.print[at] == prints  # index -1 gives the last entry, whose print differs then
        missed = np.flatnonzero(~hit)
        distinct, where, of = np.unique(prints[missed], return_index=True, return_inverse=True)
        found = []
        raw = data.tobytes()
        first = missed[where]
        for h, a, b in zip(distinct.tolist(), starts[first].tolist(), ends[first].tolist()):
            ids = self.merged.get(h)
            if ids is None:
                if len(self.merged) >= REMEMBERED:
                    self.merged, self.older = {}, self.merged
                ids = self.merged[h] = self.older.get(h) or merge(raw[a:b], self.ranks, self.pairs)
            found.append(ids)
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum()))
        size = np.ones(len(starts), np.int64)
        size[missed] = length[of]
        before = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        ids = np.empty(before[-1], np.uint32)
        ids[before[:-1][hit]] = self.rank[at[hit]]
        if len(missed):
            source = (np.cumsum(length) - length)[of]
            ids[_ranges(before[missed], length[of])] = flat[_ranges(source, length[of])]
        return ids, before[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and where each text's bytes start and end."""
        length = self.bounds[ids.astype(np.int64) + 1] - self.bounds[ids]
        before = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(length, out=before[1:])
        return self.bytes[_ranges(self.bounds[ids], length)], before[bounds]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(int(lengths.sum()))


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(name: str, tokens) -> Vocabulary:
    """A worker builds the tables of a rank file once."""
    if name not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[name] = Vocabulary(tokens.value)
    return _vocabularies[name]


def _binary(data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    width = data.itemsize
    cuts = (bounds * width).tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every whole text.

    ``path``: a rank file, whose tokens are broadcast; their number is fixed and
    does not depend on the data.  ``decoded`` adds the bytes that the ids stand for.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokens = spark.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, tokens)
        for batch in batches:
            sizes, packed, texts = [], [], []
            for _, data, offsets in A.chunks(batch.column("text")):
                ids, bounds = vocabulary.encode(data, offsets)
                sizes.append(np.diff(bounds))
                packed += _binary(ids, bounds)
                if decoded:
                    texts += _binary(*vocabulary.decode(ids, bounds))
            columns = [batch.column("doc_id"), pa.array(np.concatenate(sizes or [np.zeros(0, np.int64)])), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.binary())] * decoded, ["doc_id", "n_tokens", "ids", "decoded"][: 3 + decoded])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded bytes of the column ids; null ids are none."""
    spark = encoded.sparkSession
    small_batches(spark)
    tokens = spark.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, tokens)
        for batch in batches:
            each = [np.frombuffer(x or b"", np.uint32) for x in batch.column("ids").to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
            ids = np.concatenate(each) if each else np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_binary(*vocabulary.decode(ids, bounds)), pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
