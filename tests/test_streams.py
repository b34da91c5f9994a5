"""Tracker and rate limit: known sequences, and stream equal to batch."""

import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from leafline.streaming import intake, replay, tracking as R

BOX = [0.22, 0.3, 0.61, 0.28, 0.64, 0.7, 0.2, 0.72]


def shift(points, dx):
    return [v + dx if i % 2 == 0 else v for i, v in enumerate(points)]


def run(frames):
    state, out = R.EMPTY_TRACK, []
    for corners, score, t in frames:
        state, shown, stable = R.track_step(state, corners, score, t)
        out.append((shown, stable))
    return out


def far(a, b):
    return max(abs(x - y) for x, y in zip(a, b))


@pytest.mark.parametrize("speed", [0.002, 0.004, 0.006])
def test_a_drifting_box_is_followed(speed):
    frames = [(shift(BOX, i * speed), 0.85, 5_000 + 40 * i) for i in range(12)]
    for (shown, _), (true, _, _) in zip(run(frames), frames):
        assert far(shown, true) < 4 * speed


def test_the_order_of_corners_does_not_matter():
    still = [(BOX, 0.85, 40 * i) for i in range(6)]
    turned = [(BOX[2 * (i % 4) :] + BOX[: 2 * (i % 4)], 0.85, 40 * i) for i in range(6)]
    assert all(far(a[0], b[0]) < 1e-9 for a, b in zip(run(still), run(turned)))


def test_one_far_box_is_held_back_and_a_gap_ends_the_track():
    still = [(BOX, 0.85, 40 * i) for i in range(8)]
    shown = run(still)[-1][0]
    elsewhere = [0.02, 0.05, 0.18, 0.05, 0.18, 0.2, 0.02, 0.2]
    got = run([*still, (elsewhere, 0.85, 320), (None, 0.0, 360), (None, 0.0, 800)])[8:]
    assert far(got[0][0], shown) < 1e-9 and not got[0][1]
    assert got[1][0] is not None and got[2][0] is None


def test_noise_is_damped():
    rng = random.Random(17)
    noise = [rng.uniform(-0.0012, 0.0012) for _ in range(60)]
    got = run([(shift(BOX, n), 0.85, 40 * i) for i, n in enumerate(noise)])
    spread = lambda values: sum(v * v for v in values)
    assert spread(s[0] - BOX[0] for s, _ in got[15:]) < 0.6 * spread(noise[15:])


def test_a_box_is_stable_only_after_a_while_and_not_after_a_gap():
    flags = [s for _, s in run([(BOX, 0.85, 50 * i) for i in range(12)] + [(None, 0.0, 1500), (BOX, 0.85, 1550)])]
    first = flags.index(True)
    assert 0 < first < 12 and all(flags[first:12]) and not any(flags[12:])


def random_frames(n=3, length=120, seed=7):
    rng, rows, seq = random.Random(seed), [], 0
    for source in range(n):
        t = 1_700_000_000_000
        for _ in range(length):
            t += rng.choice([0, 5, 33, 33, 60, 170, 400])
            corners = None if rng.random() < 0.15 else shift(BOX, rng.choice([0.0, 0.001, 0.002, 0.01, 0.14, 0.15]))
            rows.append((source, seq, t, corners, rng.choice([0.6, 0.8, 0.9]), float(rng.randint(1, 90))))
            seq += 1
    return rows


SCHEMA = "source_id bigint, seq bigint, t bigint, corners array<double>, score double, cost double"


def key(rows):
    def flat(r):
        return tuple(tuple(round(x, 9) for x in v) if isinstance(v, (list, tuple)) else v for v in r)

    return sorted((flat(r) for r in rows), key=lambda r: r[1])


def expected_tracks(rows):
    out, states = [], {}
    for s, seq, t, corners, score, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        states[s], shown, stable = R.track_step(states.get(s, R.EMPTY_TRACK), corners, score, t)
        out.append((s, seq, t, shown, stable))
    return key(out)


def test_track_batch_equals_one_pass_per_source(spark):
    rows = random_frames()
    df = spark.createDataFrame(rows, SCHEMA)
    assert key(R.track_batch(df).collect()) == expected_tracks(rows)
    small = R.sessions(df, bucket=1000).select("source_id", "seq", "session").collect()
    whole = R.sessions(df, bucket=10**15).select("source_id", "seq", "session").collect()
    assert sorted(small) == sorted(whole)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def stream_of(spark, df, folder, pieces):
    """A file stream that brings ``df`` in time order over several triggers."""
    for i in range(pieces):
        df.where(F.col("piece") == i).drop("piece").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.drop("piece").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def finish(query):
    query.processAllAvailable()
    query.stop()


def test_track_stream_equals_batch(spark, folder):
    rows = random_frames(n=2, length=60)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_millis("t"))
    low, high = min(r[2] for r in rows), max(r[2] for r in rows) + 1
    pieces = df.withColumn("piece", F.floor((F.col("t") - low) * 3 / (high - low)))
    s = stream_of(spark, pieces.drop("t", "cost"), folder, 3)
    q = R.track_stream(s).writeStream.format("memory").queryName("tracks").outputMode("append").option(
        "checkpointLocation", f"{folder}/cp").start()
    finish(q)
    assert key(spark.table("tracks").collect()) == expected_tracks(rows)


def test_a_frame_an_hour_late_resets_the_track(spark, folder):
    start, hour = 1_700_000_000_000, 3_600_000
    rows = [(1, i, start + hour + 40 * i, BOX, 0.9, 0) for i in range(5)]
    # Spark judges lateness by the watermark of the trigger before, so another trigger stands between
    rows += [(1, 5, start + 2 * hour, BOX, 0.9, 1), (1, 6, start + 2 * hour + 40, BOX, 0.9, 2), (1, 7, start + hour, shift(BOX, 0.15), 0.9, 3)]
    df = spark.createDataFrame(rows, "source_id bigint, seq bigint, t bigint, corners array<double>, score double, piece int")
    s = stream_of(spark, df.withColumn("ts", F.timestamp_millis("t")).drop("t"), folder, 4)
    q = R.track_stream(s).writeStream.format("memory").queryName("late").outputMode("append").option(
        "checkpointLocation", f"{folder}/cp").start()
    finish(q)
    got = {r.seq: r for r in spark.table("late").collect()}
    assert sorted(got) == list(range(8))
    assert far(got[7].corners, shift(BOX, 0.15)) < 1e-9 and not got[7].stable


def test_rate_limit_stream_equals_batch(spark, folder):
    rows = random_frames(n=2, length=60, seed=3)
    df = spark.createDataFrame(rows, SCHEMA).drop("corners", "score")
    low, high = min(r[2] for r in rows), max(r[2] for r in rows) + 1
    s = stream_of(spark, df.withColumn("piece", F.floor((F.col("t") - low) * 3 / (high - low))), folder, 3)
    q = R.rate_limit_stream(s).writeStream.format("memory").queryName("kept").outputMode("append").option(
        "checkpointLocation", f"{folder}/cp").start()
    finish(q)
    assert key(spark.table("kept").collect()) == key(replay.rate_limit_batch(df).collect())


def expected_rate(rows):
    """Kept events of one pass over each source, stated anew."""
    kept, last, average = [], {}, {}
    for source, seq, t, cost in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])):
        wait = max(33, min(80, math.floor(average.get(source, 0.0) * 1.4 + 0.5)))
        if source in last and t - last[source] < wait:
            continue
        before = average.get(source, 0.0)
        last[source], average[source] = t, cost if before == 0 else before * 0.8 + cost * 0.2
        kept.append((source, seq, t, cost))
    return kept


@pytest.mark.parametrize("chunk", [2_000, 30_000])
def test_rate_limit_by_chunks_is_one_pass(spark, chunk):
    rng, rows, seq = random.Random(chunk), [], 0
    # dense, regular, sparse, and free costs; phases and last bits that never meet
    kinds = {1: ([1, 2, 3, 7], None), 2: ([16, 17], [25.0]), 3: ([5, 33, 60, 170, 9000], None), 4: ([1], [30.0, 35.5]), None: ([20, 40], [0.0, 50.0]), 6: ([0, 0, 1], [20.0])}
    for source, (steps, costs) in kinds.items():
        t = rng.randint(-10**6, 10**6)
        for _ in range(700):
            t, seq = t + rng.choice(steps), seq + 1
            rows.append((source, seq, t, rng.choice(costs) if costs else rng.uniform(0.1, 90)))
    df = spark.createDataFrame(rows, "source_id bigint, seq bigint, t bigint, cost double").repartition(6)
    got = [tuple(r) for r in replay.rate_limit_batch(df, chunk).collect()]
    assert sorted(got, key=lambda r: r[1]) == sorted(expected_rate(rows), key=lambda r: r[1])


def test_rate_interval_bounds():
    state, kept = (None, 0.0), []
    for t in range(0, 400, 10):
        state, ok = R.rate_step(state, t, 100.0)
        kept += [t] if ok else []
    assert kept == [0, 80, 160, 240, 320] and math.isclose(state[1], 100.0)


def test_intake_stream_keeps_versions(spark, folder):
    schema = "lib_id bigint, batch_id bigint, file_no bigint, name string, mime string, size bigint, created_at bigint"
    rows = [(1, b, f, f"f{b}-{f}.docx" if f else "p.png", "", 10 * (f + 1) if f < 3 else 0, b * 10 + f) for b in range(2) for f in range(4)]
    rows.append((1, 9, 0, "huge.pdf", "application/pdf", 200 * 1024 * 1024, 99))
    df = spark.createDataFrame(rows, schema).withColumn("piece", F.when(F.col("batch_id") == 0, 0).otherwise(1))
    q = intake.start_intake(stream_of(spark, df, folder, 2), f"{folder}/lib", f"{folder}/cp", availableNow=True)
    q.awaitTermination()
    got = intake.LibraryStore(spark, f"{folder}/lib").read().orderBy("created_at").collect()
    assert [(r.name, r.tool) for r in got] == [
        ("p.png", "scan"), ("f0-1.docx", "docx-pdf"), ("f0-2.docx", "docx-pdf"), ("p.png", "scan"), ("f1-1.docx", "docx-pdf"), ("f1-2.docx", "docx-pdf")
    ]
    # a new stream on the same store adds to it
    more = spark.createDataFrame([(1, 5, 0, "late.pdf", "", 7, 500), (2, 5, 0, "two.pdf", "", 7, 500)], schema).withColumn("piece", F.lit(0))
    q = intake.start_intake(stream_of(spark, more, f"{folder}/again", 1), f"{folder}/lib", f"{folder}/cp2", availableNow=True)
    q.awaitTermination()
    assert sorted(r.name for r in intake.LibraryStore(spark, f"{folder}/lib").read().collect())[:3] == ["f0-1.docx", "f0-2.docx", "f1-1.docx"]
    assert intake.LibraryStore(spark, f"{folder}/lib").read().count() == 8


def names(store):
    return sorted((r.lib_id, r.name) for r in store.read().collect())


def test_store_commits_touch_their_buckets_and_repeat_safely(spark, folder):
    from pathlib import Path

    def files(*rows):
        return spark.createDataFrame([(lib, batch, 0, name, "", 10, batch) for lib, batch, name in rows], "lib_id bigint, batch_id bigint, file_no bigint, name string, mime string, size bigint, created_at bigint")

    store = intake.LibraryStore(spark, f"{folder}/lib", buckets=8)
    assert names(store) == []
    store.commit(files(*[(i, 1, f"a{i}.pdf") for i in range(20)]), "s", 0)
    before = {p: p.stat().st_mtime_ns for p in Path(folder, "lib/data").rglob("*.parquet")}
    assert len({p.parent.parent.name for p in before}) > 3
    store.commit(files((3, 2, "b.pdf")), "s", 1)
    assert {p: p.stat().st_mtime_ns for p in before if p.exists()} == before  # no other bucket is written
    now = names(store)
    assert (3, "b.pdf") in now and len(now) == 21
    # the epoch again, after a restart: the same store
    store.commit(files((3, 2, "b.pdf")), "s", 1)
    assert names(store) == now
    # a commit that ended before its manifest does not count
    half = Path(folder, "lib/manifest/version=3")
    half.mkdir()
    assert names(store) == now
    for k in range(3, 7):
        store.commit(files((3, k, f"c{k}.pdf")), "t", k)
    assert len(names(store)) == 25
    assert len([p for p in Path(folder, "lib/manifest").iterdir()]) == 2
    versions = [p for p in Path(folder, "lib/data").glob("bucket=*/version=*")]
    assert len([p for p in versions if p.name != "version=1"]) == 2
    store.commit(files(), "t", 9)
    assert len(names(store)) == 25
