"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents of equal shingle sets are one node.  A node is posted under each of
its (coordinate, minimum) pairs; postings that no other node shares are
skipped, and so is a node with fewer shared postings than the match threshold.
Of the others a prefix of the rarest postings is enough: two nodes with
``MATCH`` equal coordinates share one of the first ``m - MATCH + 1`` of either.

A list of few open nodes is turned into pairs, no more than ``SHORT`` for each
posting; a longer one is not.  First, members that share less than the needed
part of their shingles with all members of long lists together leave these
lists.  Then a list has a leader, the node with its key whose postings are the
most shared, and every member is compared with it on full sets.  Pairs that are
in one component by then need no comparison.  A pair of two components must
agree outside the leader's set: if x and y have J(x, y) >= p / 100 and all they
share is in the leader, then the sum of their sizes is so small that x shares
enough with the leader (``need``).  So lists of several components are dealt
anew by the shingles outside the leader, again with skips, prefixes and
leaders, twice; what is left then is compared, part by part.  Histograms of
shingles rule out most pairs before full sets are sent.

At J = 0.8 the 64 coordinates agree in 51 places on average; fewer than 32
(``MATCH``) have a chance below 1e-8.  What is posted is linear in the input.

Defined results: null, empty and word-less texts have an empty set and stand
alone; fewer words than a shingle make one shingle; rows of one doc_id may be
in several classes and give a row each; a null id is never a class id unless
all ids of the class are null; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.llm import arrays as A
from leafline.llm.components import components
from leafline.llm.spread import freed_shuffles, keep, small_batches

COORDINATES = 64
MATCH = 32
SALTS = 16
BUCKETS = 128  # of a set's histogram
DEALINGS = 2  # of lists to leaders; then what is left is compared
SMALLEST = 8  # members of a list that are compared with its open ones whatever they share
SHORT = 6  # lists of no more open nodes are turned into pairs, and all lists when they have no more pairs for each node of the input

_TURN = np.random.Generator(np.random.PCG64(515)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the distinct shingles of each text (increasing within a text), and how many stand before each text."""
    starts, ends, first = A.words(data, offsets)
    lower = A.LOWER[data]
    word = A.span(A.prefix(lower), starts, ends, lower)
    prints, at = A.windows(word, first, k)
    text = np.searchsorted(first, at, "right") - 1
    n = np.diff(first)
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        # the whole sequence is the one shingle
        whole, _ = A.windows(word[first[i] : first[i + 1]], np.array([0, n[i]]), int(n[i]))
        prints, text = np.append(prints, whole ^ np.uint64(n[i])), np.append(text, i)
    order = np.lexsort((prints, text))
    prints, text = prints[order], text[order]
    new = np.ones(len(prints), bool)
    new[1:] = (prints[1:] != prints[:-1]) | (text[1:] != text[:-1])
    prints, text = prints[new], text[new]
    return prints, np.searchsorted(text, np.arange(len(offsets)))


def _names(prints: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One fingerprint for each set."""
    total = np.zeros(len(prints) + 1, np.uint64)
    np.cumsum(A.mix(prints ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return A.mix(total[before[1:]] - total[before[:-1]] + np.diff(before).astype(np.uint64)).astype(np.int64)


def _keys(prints: np.ndarray, before: np.ndarray, coordinates: int) -> np.ndarray:
    """For each non-empty set its coordinates: the least turned shingle, told apart by the coordinate's number."""
    full = before[:-1][np.diff(before) > 0]
    out = np.empty((len(full), coordinates), np.uint64)
    for c in range(coordinates):
        out[:, c] = A.mix(np.minimum.reduceat((prints ^ _TURN[c]) * _TURN[c], full) + np.uint64(c)) if len(full) else 0
    return out.view(np.int64)


def _describe(k: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in A.chunks(batch.column("text")):
                prints, before = shingle_sets(data, offsets, k)
                n = np.diff(before)
                keys = _keys(prints, before, coordinates)
                bounds = np.concatenate([[0], np.cumsum(np.where(n > 0, coordinates, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(n)), pa.array(n), pa.array(_names(prints, before), mask=n == 0), lists], ["doc_id", "n_shingles", "node", "keys"]
                )

    return run


def _histogram(prints: np.ndarray) -> bytes | None:
    """How many shingles fall into each bucket; None for sets so large that it says nothing."""
    return np.bincount((prints % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).astype(np.uint8).tobytes() if len(prints) < 256 else None


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in A.chunks(batch.column("text")):
                prints, before = shingle_sets(data, offsets, k)
                each = [prints[a:b] for a, b in zip(before.tolist(), before[1:].tolist())]
                columns = [pa.array(_names(prints, before)), pa.array([e.tobytes() for e in each], pa.binary()), pa.array(np.diff(before)), pa.array([_histogram(e) for e in each], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingles", "size", "histogram"])

    return run


def _possible(percent: int):
    """Pairs whose shingles by bucket allow a link: they share no more than the lesser count of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pc.and_(batch.column("x_h").is_valid(), batch.column("y_h").is_valid())
            known = batch.filter(some)
            x, y = (np.frombuffer(b"".join(known.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS) for c in ("x_h", "y_h"))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            total = known.column("x_n").to_numpy() + known.column("y_n").to_numpy()
            yield known.filter(pa.array(100 * most >= percent * (total - most))).select(["x", "y"])
            yield batch.filter(pc.invert(some)).select(["x", "y"])

    return run


def links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) among pairs (x, y); full sets go only to pairs that their histograms do not rule out."""
    left = sets.select(F.col("node").alias("x"), F.col("size").alias("x_n"), F.col("histogram").alias("x_h"))
    right = sets.select(F.col("node").alias("y"), F.col("size").alias("y_n"), F.col("histogram").alias("y_h"))
    sized = pairs.join(left, "x").join(right, "y").filter(100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
    left_over = sized.select("x", "y", "x_n", "y_n", "x_h", "y_h").mapInArrow(_possible(percent), "x long, y long")
    return keep(compare(left_over, sets).filter(_linked(percent)).select(F.col("x").alias("u"), F.col("y").alias("v")))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, rest, bounds = [], [], [0]
        for x, y in zip(batch.column("x_set"), batch.column("y_set")):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(b, a)
            inside = b[np.minimum(at, len(b) - 1)] == a
            shared.append(int(inside.sum()))
            rest.append(a[~inside])
            bounds.append(bounds[-1] + len(rest[-1]))
        outside = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(rest).view(np.int64) if rest else np.zeros(0, np.int64)))
        sizes = [pa.array([len(v.as_buffer()) // 8 for v in batch.column(c)], pa.int64()) for c in ("x_set", "y_set")]
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), *sizes, pa.array(shared, pa.int64()), outside], ["x", "y", "x_size", "y_size", "shared", "rest"])


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, raw in zip(batch.column("node").to_pylist(), batch.column("shingles")):
            prints = np.frombuffer(raw.as_buffer(), np.int64)
            for at in range(0, len(prints), 1 << 16):
                some = prints[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), node)), pa.array(np.full(len(some), len(prints))), pa.array(some)], ["node", "size", "s"])


def _may_link(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of some nodes those that can have a link among them.

    A link of x needs percent of all of x's shingles in another set, so x stays
    only if so many of its shingles stand in two sets; what leaves takes its
    shingles along, so this is done again while half of them leave.
    """
    before = nodes.count()
    while True:
        spelled = sets.join(nodes, "node", "left_semi").mapInArrow(_spell, "node long, size long, s long")
        common = spelled.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1").select("s")
        shared = spelled.join(common, "s").groupBy("node").agg(F.count("*").alias("n"), F.first("size").alias("size"))
        nodes = keep(shared.filter(100 * F.col("n") >= percent * F.col("size")).select("node"))
        after = nodes.count()
        if not after or 2 * (before - after) < before:
            return nodes
        before = after


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For pairs (x, y) of nodes: sizes, shared shingles, and x's shingles outside y, all on full sets."""
    left = sets.select(F.col("node").alias("x"), F.col("shingles").alias("x_set"))
    right = sets.select(F.col("node").alias("y"), F.col("shingles").alias("y_set"))
    # the sorted join by y splits a hot leader's rows over tasks
    return pairs.join(left, "x").join(right, "y").select("x", "y", "x_set", "y_set").mapInArrow(_compare, "x long, y long, x_size long, y_size long, shared long, rest array<long>")


def _linked(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.col("x_size") + F.col("y_size") - F.col("shared"))


def _shared_postings(posts: DataFrame) -> DataFrame:
    """Postings of keys that two nodes or more have, one of them open, with the number n of nodes."""
    counts = posts.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("o"))
    return posts.join(counts.filter("n > 1 AND o").select("key", "n"), "key")


def _held(posts: DataFrame) -> DataFrame:
    """Per list and node its shared postings, rarest first, and their weight; nodes with fewer postings than they need are skipped."""
    held = posts.groupBy("list", "node").agg(
        F.sort_array(F.collect_list(F.struct("n", "key"))).alias("p"), F.max("need").alias("need"), F.max("open").alias("open"), F.sum("n").alias("weight")
    )
    return keep(held.filter(~F.col("open") | (F.size("p") >= F.col("need"))))


def _members(held: DataFrame) -> DataFrame:
    """(key, node, open): the rarest m - need + 1 postings of open nodes, all of the others."""
    cut = F.when(F.col("open"), F.slice("p", F.lit(1), F.size("p") - F.col("need").cast("int") + 1)).otherwise(F.col("p"))
    return held.select("node", "open", F.explode(cut).alias("p")).select("node", "open", "p.key")


def links(described: DataFrame, docs: DataFrame, k: int, percent: int, match: int) -> DataFrame:
    """Edges (u, v) between nodes, so that nodes are connected by them exactly if they are by all links."""
    known = described.filter("node IS NOT NULL")
    nodes = keep(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")))
    posts = nodes.select(F.lit(0).cast("long").alias("list"), "node", F.lit(True).alias("open"), F.lit(match).cast("long").alias("need"), F.explode("keys").alias("key"))
    held = _held(_shared_postings(posts))
    wanted = held.select("node").join(nodes, "node").select("node", "doc_id")
    texts = docs.join(wanted.select("doc_id"), docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
    sets = keep(texts.mapInArrow(_sets(k), "node long, shingles binary, size long, histogram binary").filter("octet_length(shingles) > 0").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    near = sets  # the sets of nodes that lists of many open nodes still hold
    found: list[DataFrame] = []
    pending: list[DataFrame] = []  # pairs that are compared together, once their links are asked for
    enough, tried, deals = SHORT * nodes.count(), False, 0
    while True:
        members = keep(_members(held))
        load = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("open").cast("long")).alias("o")).filter("n > 1 AND o > 0")
        n_pairs = F.least(F.col("n") * F.col("n"), F.col("o") * F.col("n"))
        load = keep(load.select("key", (F.col("o") <= SHORT).alias("short"), n_pairs.alias("n_pairs")))
        # what is left of long lists is compared at once as soon as it is linear in the nodes, or after two dealings
        left = load.filter("NOT short").agg(F.sum("n_pairs")).first()[0] or 0
        last = left <= enough or deals == DEALINGS
        if last:
            load = load.withColumn("short", F.lit(True))
        # lists of few pairs: each open node with the others, so many at a time as are linear in the nodes
        few_pairs = members.join(load.filter("short").select("key"), "key")
        x = few_pairs.filter("open").select("key", F.col("node").alias("x"))
        y = few_pairs.select("key", F.col("node").alias("y"), F.col("open").alias("y_open"))
        parts = 1 + left // max(1 << 20, 4 * enough) if last else 1
        for part in range(parts):
            some = x if parts == 1 else x.filter(F.pmod(F.xxhash64("x"), F.lit(parts)) == part)
            pending.append(some.join(y, "key").filter("x < y OR (x > y AND NOT y_open)").select("x", "y"))
            if parts > 1:
                _settle(pending, found, near if deals > 1 else sets, percent)
        if last:
            _settle(pending, found, near if deals > 1 else sets, percent)
            break
        many_open = load.filter("NOT short").select("key")
        if not tried:
            # members of long lists that share too little with all others go, and the lists are looked at again
            tried = True
            able = _may_link(keep(members.join(many_open, "key").select("node").distinct()), sets, percent)
            held = keep(held.join(able, "node"))
            # leaders are of the nodes that are held, and all that is dealt anew is of these lists
            near = keep(sets.join(able, "node", "left_semi"))
            continue
        # the others: each member with the list's leader, of all nodes that have the key
        all_posts = held.select("node", "weight", F.explode("p.key").alias("key")).join(many_open, "key")
        leaders = all_posts.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("y"))
        pairs = members.join(many_open, "key").join(leaders, "key").filter("node != y").select(F.col("node").alias("x"), "y").distinct()
        judged = keep(compare(pairs, near).withColumn("linked", _linked(percent)))
        found.append(judged.filter("linked").select(F.col("x").alias("u"), F.col("y").alias("v")))
        if deals:
            _settle(pending, found, sets, percent)
        held, more = _deal_anew(judged, percent, found, deals == 0)
        pending.append(more)
        deals += 1
    return reduce(DataFrame.union, found)


def _settle(pending: list[DataFrame], found: list[DataFrame], sets: DataFrame, percent: int) -> None:
    """Compare the pairs that wait, each of them once."""
    if pending:
        found.append(links_of(reduce(DataFrame.union, pending).distinct(), sets, percent))
        pending.clear()


def _deal_anew(judged: DataFrame, percent: int, found: list[DataFrame], first: bool) -> tuple[DataFrame, DataFrame]:
    """Postings by shingles outside the leader, for lists whose members are not of one component yet, and pairs to compare.

    Pairs of one component need no comparison.  The open members of a list are
    those outside the component that most of its members are in, so every pair
    of two components has an open member.

    J(x, y) >= p / 100 needs shared >= p / (100 + p) * (|x| + |y|).  Of what an
    open x shares with y, at most |x & leader| is in the leader.  For a y of
    size s or more, x and y so share ``need`` shingles outside; s is the size of
    the list's ninth smallest member, or the least for which that is one at
    least.  Smaller members are compared directly: eight, and those few others.
    """
    judged = judged.withColumnRenamed("y", "leader")
    if first:
        # the leader and those linked to it, before any others are known to be connected
        placed = judged.withColumn("root", F.when(F.col("linked"), F.col("leader")).otherwise(F.col("x")))
        going = placed.filter("NOT linked").select("leader", F.col("leader").alias("main")).distinct()
    else:
        roots = components(reduce(DataFrame.union, found)).withColumnRenamed("node", "x")
        placed = judged.join(roots, "x", "left").withColumn("root", F.coalesce("root", "x"))
        most = placed.groupBy("leader", "root").agg(F.count("*").alias("n")).groupBy("leader").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"))
        going = most.filter("roots > 1").select("leader", F.col("top.root").alias("main"))
    members = placed.join(going, "leader").withColumn("open", F.col("root") != F.col("main"))
    members = keep(members.select("leader", "x", "x_size", "shared", "open", "root", "rest"))
    by_size = Window.partitionBy("leader").orderBy("x_size", "x")
    smallest = keep(members.select("leader", "x", "x_size", "root", F.row_number().over(by_size).alias("rank")).filter(F.col("rank") <= SMALLEST + 1))
    floor = smallest.groupBy("leader").agg(F.max(F.when(F.col("rank") > SMALLEST, F.col("x_size"))).alias("floor"))
    ratio = F.ceil(F.col("x_size") * percent / 100)
    sure = F.floor(F.col("shared") * (100 + percent) / percent).cast("long") - F.col("x_size") + 1
    members = members.join(floor, "leader").withColumn("floor", F.coalesce("floor", F.lit(2**40))).withColumn("sure", sure).withColumn("ratio", ratio)
    size = F.greatest("ratio", "floor", "sure")
    need = F.greatest(F.lit(1), F.ceil((F.col("x_size") + size) * percent / (100 + percent)).cast("long") - F.col("shared"))
    members = members.withColumn("need", need)
    asking = members.filter("open").select("leader", "x", "sure", "ratio", "floor", F.col("root").alias("x_root"))
    low = smallest.filter(F.col("rank") <= SMALLEST).select("leader", F.col("x").alias("y"), F.col("x_size").alias("other"), "root")
    direct = asking.join(low, "leader").filter("other >= ratio AND x_root != root").select("x", "y")
    between = members.select("leader", F.col("x").alias("y"), F.col("x_size").alias("other"), "root")
    more = asking.filter("sure > floor AND sure > ratio").join(between, "leader").filter("other >= floor AND other < sure AND other >= ratio AND x_root != root").select("x", "y")
    posts = members.select(F.col("leader").alias("list"), F.col("x").alias("node"), "open", "need", F.explode("rest").alias("s"))
    return _held(_shared_postings(posts.select("list", "node", "open", "need", F.xxhash64("list", "s").alias("key")))), direct.union(more)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES, match: int = MATCH) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the class) and kept for every document."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    described = keep(docs.mapInArrow(_describe(shingle, coordinates), "doc_id long, n_shingles long, node long, keys array<long>"))
    with freed_shuffles(docs.sparkSession):
        roots = components(links(described, docs, shingle, percent, match))
    least = described.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    classes = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    table = classes.join(first, "root").select("node", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = described.select("doc_id", "n_shingles", "node", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt"))
    joined = salted.join(table, ["node", "salt"], "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, that stand for their class; all rows of such a doc_id stay."""
    kept = near_duplicates(docs, shingle, percent).filter("kept").select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["stays"]), "left_semi")
