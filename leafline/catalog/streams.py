"""Batch forms of the stream operators (R1 to R4) over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafline.catalog.documents import micros
from leafline.catalog.registry import query, table
from leafline.streaming import intake as N
from leafline.streaming import tracking as R
from leafline.streaming.replay import rate_limit_batch

_FRAMES_SQL = """frames AS (SELECT user_id AS source_id, event_id AS seq, cast(floor(epoch(ts) / 600) AS bigint) AS t, event_type <> 'error' AS detected, value / 5000 AS dx, 0.6 + (event_id % 5) / 10.0::double AS score, value FROM events)"""


def frames(spark, sf):
    dx = F.col("value") / 5000
    corners = F.array(0.15 + dx, F.lit(0.15), 0.7 + dx, F.lit(0.15), 0.7 + dx, F.lit(0.8), 0.15 + dx, F.lit(0.8))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), F.floor(micros() / 600_000_000).alias("t"),
        F.when(F.col("event_type") != "error", corners).alias("corners"), (0.6 + (F.col("event_id") % 5) / 10.0).alias("score"),
        F.col("value").alias("cost"),
    )


_TRACK_SQL = f"""WITH RECURSIVE {_FRAMES_SQL},
seqd AS MATERIALIZED (SELECT *, 0.15 + dx AS xa, 0.7 + dx AS xb, row_number() OVER (PARTITION BY source_id ORDER BY t, seq) AS i FROM frames),
walk AS (
  SELECT source_id, cast(0 AS bigint) AS i, cast(NULL AS bigint) AS seq, cast(0 AS bigint) AS t, cast(NULL AS double) AS pa, cast(NULL AS double) AS pb, cast(NULL AS double) AS na, cast(NULL AS double) AS nb,
    cast(NULL AS double) AS ha, cast(NULL AS double) AS hb, cast(0 AS bigint) AS seen, cast(-1 AS bigint) AS since, false AS stable FROM (SELECT DISTINCT source_id FROM seqd)
  UNION ALL
  SELECT source_id, i, seq, t,
    CASE WHEN NOT detected OR held THEN pa WHEN jump THEN xa ELSE pa + (1 - exp(-greatest(1, t - seen) / tau)) * (xa - pa) END,
    CASE WHEN NOT detected OR held THEN pb WHEN jump THEN xb ELSE pb + (1 - exp(-greatest(1, t - seen) / tau)) * (xb - pb) END,
    CASE WHEN NOT detected OR held OR score < 0.7 THEN NULL WHEN moved_on THEN xa ELSE na END, CASE WHEN NOT detected OR held OR score < 0.7 THEN NULL WHEN moved_on THEN xb ELSE nb END,
    CASE WHEN detected AND held THEN xa END, CASE WHEN detected AND held THEN xb END, CASE WHEN NOT detected OR held THEN seen ELSE t END,
    CASE WHEN NOT detected OR held OR score < 0.7 THEN -1 WHEN moved_on THEN t ELSE since END,
    detected AND NOT held AND score >= 0.7 AND CASE WHEN moved_on THEN false ELSE since >= 0 AND t - since >= 220 END
  FROM (SELECT *, pa IS NOT NULL AND mv > 0.12 AND (ha IS NULL OR greatest(abs(ha - xa), abs(hb - xb)) > 0.025) AS held, pa IS NULL OR mv > 0.12 AS jump,
      na IS NULL OR greatest(abs(na - xa), abs(nb - xb)) > 0.009 AS moved_on, CASE WHEN mv < 0.004 THEN 85 ELSE greatest(16, 85 / (1 + mv * 180)) END AS tau
    FROM (SELECT *, CASE WHEN pa IS NULL THEN 1 ELSE greatest(abs(pa - xa), abs(pb - xb)) END AS mv
      FROM (SELECT s.source_id, s.i, s.seq, s.t, s.detected, s.xa, s.xb, s.score, CASE WHEN lost THEN NULL ELSE pa END AS pa, CASE WHEN lost THEN NULL ELSE pb END AS pb, CASE WHEN lost THEN NULL ELSE na END AS na, CASE WHEN lost THEN NULL ELSE nb END AS nb,
          CASE WHEN lost THEN NULL ELSE ha END AS ha, CASE WHEN lost THEN NULL ELSE hb END AS hb, CASE WHEN lost THEN 0 ELSE seen END AS seen, CASE WHEN lost THEN -1 ELSE since END AS since
        FROM (SELECT w.*, n.t AS nt, w.pa IS NOT NULL AND (n.t < w.seen OR n.t - w.seen > 160) AS lost FROM walk w JOIN seqd n ON n.source_id = w.source_id AND n.i = w.i + 1) w
        JOIN seqd s ON s.source_id = w.source_id AND s.i = w.i + 1) a) b) c)
SELECT source_id, seq, t, pa AS x0, pb AS x1, stable FROM walk WHERE i > 0"""


@query("r1_track_quads", _TRACK_SQL)
def r1(spark, sf):
    return R.track_batch(frames(spark, sf)).select(
        "source_id", "seq", "t", F.get("corners", F.lit(0)).alias("x0"), F.get("corners", F.lit(2)).alias("x1"), "stable"
    )


@query("r2_stable_flag", f"SELECT source_id, count(*) FILTER (stable) AS stable_frames, count(x0) AS shown FROM ({_TRACK_SQL}) GROUP BY 1")
def r2(spark, sf):
    return R.track_batch(frames(spark, sf)).groupBy("source_id").agg(
        F.count_if("stable").alias("stable_frames"), F.count("corners").alias("shown")
    )


@query("r3_rate_limit", f"""WITH RECURSIVE {_FRAMES_SQL},
seqd AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t, seq) AS i FROM frames),
walk AS (SELECT source_id, i, seq, t, value AS cost, t AS last, value AS average, true AS kept FROM seqd WHERE i = 1
  UNION ALL SELECT source_id, i, seq, t, cost, CASE WHEN ok THEN t ELSE last END, CASE WHEN NOT ok THEN average WHEN average = 0 THEN cost ELSE average * 0.8 + cost * 0.2 END, ok
  FROM (SELECT s.source_id, s.i, s.seq, s.t, s.value AS cost, w.last, w.average, s.t - w.last >= greatest(33, least(80, floor(w.average * 1.4 + 0.5))) AS ok FROM walk w JOIN seqd s ON s.source_id = w.source_id AND s.i = w.i + 1))
SELECT source_id, seq, t, cost FROM walk WHERE kept""")
def r3(spark, sf):
    return rate_limit_batch(frames(spark, sf))


@query("r4_library_intake", """WITH f AS (SELECT user_id AS lib_id, event_id // 40 AS batch_id, event_id % 40 AS file_no, event_type || '-' || event_id || (['.pdf', '.docx', '.png'])[event_id % 3 + 1] AS name, CASE WHEN event_id % 2 = 0 THEN 'application/pdf' ELSE '' END AS mime,
  CASE WHEN event_id % 13 = 0 THEN 0 ELSE cast(round(value * 100) AS bigint) END AS size, epoch_us(ts) AS created_at FROM events),
ok AS (SELECT * FROM f QUALIFY sum(size) OVER (PARTITION BY lib_id, batch_id) <= 12000),
k AS (SELECT lib_id, batch_id || '-' || file_no AS item_id, name, CASE WHEN mime <> '' THEN mime WHEN ends_with(name, '.docx') THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN ends_with(name, '.png') THEN 'image/jpeg' ELSE 'application/pdf' END AS mime,
  CASE WHEN ends_with(name, '.png') THEN 'scan' WHEN ends_with(name, '.docx') THEN 'docx-pdf' ELSE 'view' END AS tool, created_at, size, true AS stored, batch_id * 4294967296 + file_no AS seq FROM ok WHERE size > 0),
r AS (SELECT *, row_number() OVER w AS rn, sum(size) OVER w AS total FROM k WHERE size <= 60000 WINDOW w AS (PARTITION BY lib_id ORDER BY created_at DESC, seq DESC))
SELECT * EXCLUDE (rn, total) FROM r WHERE rn <= 15 AND total <= 60000""")
def r4(spark, sf):
    k = F.col("event_id")
    end = F.get(F.array(F.lit(".pdf"), F.lit(".docx"), F.lit(".png")), (k % 3).cast("int"))
    files = table(spark, sf, "events").select(
        F.col("user_id").alias("lib_id"), F.floor(k / 40).alias("batch_id"), (k % 40).alias("file_no"),
        F.concat("event_type", F.lit("-"), k.cast("string"), end).alias("name"), F.when(k % 2 == 0, "application/pdf").otherwise("").alias("mime"),
        F.when(k % 13 == 0, 0).otherwise(F.round(F.col("value") * 100).cast("long")).alias("size"), micros().alias("created_at"),
    )
    empty = N.accept_files(files.where(F.lit(False)))
    return N.library_intake(empty, files, max_batch=12_000, max_items=15, max_bytes=60_000)
