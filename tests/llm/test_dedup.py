"""Line, substring, suffix and near-duplicate operators against plain versions."""

import random

import brute
import pytest

from leafline.llm import line_dedup, minhash, substring, suffixes


@pytest.fixture(scope="module")
def rows():
    return brute.table()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def bag(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def test_lines(docs, rows, none):
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert bag(got) == bag(brute.line_dedup(rows))
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_keep_the_other_columns(docs, rows):
    got = line_dedup.without_repeated_lines(docs)
    assert got.columns == docs.columns
    assert bag((r.doc_id, r.text, r.source, r.carried) for r in got.collect()) == bag((a[0], b[3], a[3], a[9]) for a, b in zip(rows, brute.line_dedup(rows)))


def test_substrings(docs, rows, none):
    for window in (50, 3):
        got = substring.dedup_substrings(docs, window).select("doc_id", "n_words", "n_removed", "kept_text").collect()
        assert bag(got) == bag(brute.substrings(rows, window))
    assert substring.dedup_substrings(none).count() == 0


def test_bytes(spark, none):
    rows = [r for r in brute.table(9) if r[1] is None or len(r[1]) < 50_000] + [(900, "ab" * 400, *[None] * 10), (901, "q" * 99, *[None] * 10), (902, "zab" + "ab" * 300, *[None] * 10)]
    docs = spark.createDataFrame(rows, brute.SCHEMA).repartition(4)
    got = suffixes.dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert bag((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == bag(brute.byte_repeats(rows))
    assert suffixes.dedup_bytes(none).count() == 0


def test_cover_meets_all_shifts():
    cover = set(suffixes.COVER.tolist())
    for a in range(suffixes.PERIOD):
        for b in range(suffixes.PERIOD):
            d = int(suffixes.SHIFT[a][b])
            assert (a + d) % suffixes.PERIOD in cover and (b + d) % suffixes.PERIOD in cover


def test_long_ties_are_sorted_by_cover_ranks():
    import numpy as np

    rng = random.Random(4)
    stem = bytes(rng.randrange(97, 123) for _ in range(90))
    parts = [stem + bytes(rng.randrange(97, 100) for _ in range(rng.randint(10, 60))) for _ in range(80)] * 2
    texts = suffixes.Texts(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
    at = np.flatnonzero(texts.left >= suffixes.LENGTH)
    first, raw = {}, texts.data.tobytes()
    want = [first.setdefault(raw[i : i + suffixes.LENGTH], i) for i in at.tolist()]
    assert suffixes.classes(texts, at).tolist() == want


def hub_rows(seed, n):
    """Copies of one text that differ more and more from it, and copies of such copies."""
    rng = random.Random(seed)
    base = brute.prose(rng, 120)
    texts = []
    for i in range(n):
        copy = list(base if i % 3 or not texts else rng.choice(texts).split())
        for _ in range(rng.choice((0, 1, 2, 4, 7, 12))):
            copy[rng.randrange(len(copy))] = "".join(brute.prose(rng, 3))
        if i % 11 == 0:
            del copy[rng.randrange(len(copy)) :][: rng.randint(1, 30)]
        texts.append(" ".join(copy))
    return [(i, t, *[None] * 10) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, none, k):
    got = minhash.near_duplicates(docs, k).select("doc_id", "n_shingles", "component_id").collect()
    assert bag(got) == bag(brute.near(rows, k))
    if k == 5:
        assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("short", [0, 3, 10**9])
def test_near_duplicates_around_a_hub(spark, monkeypatch, short):
    monkeypatch.setattr(minhash, "SHORT", short)  # 0: lists are always dealt to leaders anew
    rows = hub_rows(11, 150)
    got = minhash.near_duplicates(spark.createDataFrame(rows, brute.SCHEMA), 4).select("doc_id", "n_shingles", "component_id").collect()
    assert bag(got) == bag(brute.near(rows, 4))


def test_rounds_leave_no_shuffle_files(spark):
    # the files of every round stayed until the driver collected its garbage
    import glob
    import time

    from leafline.llm.spread import freed_shuffles, keep

    def files():
        return set(glob.glob(f"{spark.conf.get('spark.local.dir', '/tmp')}/blockmgr-*/*/shuffle_*"))

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(setting, None)
    with freed_shuffles(spark):
        counts = keep(spark.range(10_000).selectExpr("id % 100 AS k").groupBy("k").count())
        assert counts.count() == 100
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(setting, None) == was


def test_rounds_run_with_freed_shuffles(spark, docs, monkeypatch):
    seen = []
    links = minhash.links
    monkeypatch.setattr(minhash, "links", lambda described, *rest: seen.append(described.sparkSession.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")) or links(described, *rest))
    minhash.near_duplicates(docs, shingle=4)
    assert seen == ["true"]
