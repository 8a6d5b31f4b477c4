"""Streams give what the batch operators give on the same rows."""

import random
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from ridgewatch.operators import entities, selection, telemetry, tracking
from ridgewatch.streaming import live

SELECTION = "run_id bigint, frame_id bigint, ts timestamp, t_s double, sharpness double, motion_score double, similarity_score double"


def streamed(spark, rows, schema, parts, build, tmp_path):
    """Feeds rows as files, one a micro-batch, and a last row far ahead that moves the watermark past all others."""
    folder = tmp_path / "in"
    size = -(-len(rows) // parts)
    for k in range(parts):
        out = tmp_path / f"part{k}"
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(str(out))
        folder.mkdir(exist_ok=True)
        for file in out.glob("*.parquet"):
            shutil.copy(file, folder / f"{k:03d}-{file.name}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"t{uuid.uuid4().hex[:8]}"
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def test_live_selection_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    base = 1_700_000_000
    plain = [(run, k, k * 0.1, rng.uniform(50, 400), rng.random(), rng.uniform(0.7, 1)) for k in range(60) for run in (1, 2)]
    timed = spark.createDataFrame(plain, "run_id bigint, frame_id bigint, t_s double, sharpness double, motion_score double, similarity_score double")
    timed = timed.withColumn("ts", F.timestamp_micros((base * 1_000_000 + F.col("t_s") * 1e6).cast("bigint"))).select("run_id", "frame_id", "ts", "t_s", "sharpness", "motion_score", "similarity_score")
    rows = [tuple(r) for r in timed.collect()]
    later = timed.limit(1).select(F.lit(99).alias("a"), F.timestamp_seconds(F.lit(base + 10_000)).alias("ts")).first().ts
    shuffled = rows[:]
    rng.shuffle(shuffled)
    fed = shuffled + [(99, 0, later, 0.0, 0.0, 0.0, 1.0), (99, 1, later, 0.0, 0.0, 0.0, 1.0)]
    rules = selection.SelectionRules()
    got = streamed(spark, fed, SELECTION, 3, lambda s: live.live_selection(s, rules, "1 hour"), tmp_path)
    want = selection.select_frames(timed, rules).collect()
    assert {(r.run_id, r.frame_id, r.reason) for r in got if r.run_id != 99} == {(r.run_id, r.frame_id, r.reason) for r in want}


SIGHTING = "run_id bigint, class_name string, track_id bigint, lat double, lon double, confidence double, is_stationary boolean, thermal_delta double, error_radius_m double, timestamp_ms double, hits bigint, ts timestamp"


def test_live_entities_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    plain = [(1, rng.choice(["human", "animal"]), k, 27.7 + rng.uniform(0, 3e-4), 85.3 + rng.uniform(0, 3e-4), rng.random(), False, None, 2.0, k * 100.0, 2) for k in range(80)]
    df = spark.createDataFrame(plain, SIGHTING.rsplit(", ", 1)[0]).withColumn("ts", F.timestamp_millis((1_700_000_000_000 + F.col("timestamp_ms")).cast("bigint")))
    rows = [tuple(r) for r in df.collect()]
    later = df.select(F.timestamp_seconds(F.lit(1_700_100_000)).alias("ts")).first().ts
    rng.shuffle(rows)
    end = (99, "none", 0, 0.0, 0.0, 0.0, False, None, 0.0, 0.0, 1, later)
    far = (98, "none", 0, 0.0, 0.0, 0.0, False, None, 0.0, 0.0, 1, later.replace(year=later.year + 1))
    got = streamed(spark, [*rows, end, far], SIGHTING, 3, lambda s: live.live_entities(s, delay="1 hour"), tmp_path)
    seen = sorted((r.class_name, r.local_id, r.observation_count, round(r.latitude, 9)) for r in got if r.run_id == 1)
    want = sorted((r.class_name, r.local_id, r.observation_count, round(r.latitude, 9)) for r in entities.cluster(df).collect())
    assert seen == want


def stamped(df):
    return df.withColumn("ts", F.timestamp_micros((1_700_000_000_000_000 + F.col("t_ms") * 1000).cast("bigint")))


POSED = "run_id bigint, side int, t_ms double, frame_id bigint, lat double, lon double, altitude_agl double, pitch double, roll double, yaw double, ts timestamp"


def test_live_pose_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    samples = [(run, 1, t, None, 27 + rng.random(), 85 + rng.random(), 50 + rng.random(), -60.0, rng.random(), rng.uniform(0, 360)) for run in (1, 2) for t in (50.0, 90.0, 130.0, 180.0, 900.0, 2500.0)]
    frames = [(run, 0, float(t), k, *(None,) * 6) for run in (1, 2, 3) for k, t in enumerate((10, 50, 70, 100, 130, 300, 1800, 2600))]
    df = stamped(spark.createDataFrame(samples + frames, POSED.rsplit(", ", 1)[0]))
    rows = [tuple(r) for r in df.collect()]
    rng.shuffle(rows)
    late = [(99, 0, 0.0, 0, *(None,) * 6, rows[0][-1].replace(year=rows[0][-1].year + k)) for k in (1, 2)]
    got = streamed(spark, [*rows, *late], POSED, 3, lambda s: live.live_pose(s, 100.0, "1 hour"), tmp_path)
    asked = df.where("side = 0").select("run_id", "frame_id", F.col("t_ms").alias("pts_ms"))
    want = telemetry.synchronise(asked, df.where("side = 1").select("run_id", "t_ms", *telemetry.POSE), 100.0)
    names = ("run_id", "frame_id", *telemetry.POSE, "delta_ms", "is_synced")
    plain = lambda found: sorted(tuple(r[c] for c in names) for r in found if r.run_id != 99)
    assert plain(got) == plain(want.collect())


MESSAGES = "run_id bigint, msg_id bigint, t_ms double, msg_type string, lat_e7 bigint, lon_e7 bigint, alt_mm bigint, roll_rad double, pitch_rad double, yaw_rad double, ts timestamp"


def test_live_fusion_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        kind = rng.choice(["GLOBAL_POSITION_INT", "ATTITUDE", "HEARTBEAT"])
        place = (277_000_000 + k, 853_000_000, 50_000) if kind == "GLOBAL_POSITION_INT" else (None,) * 3
        rows.append((k % 2, k, k * 30.0, kind, *place, *((0.1, -1.2, -k / 9) if kind == "ATTITUDE" else (None,) * 3)))
    df = stamped(spark.createDataFrame(rows, MESSAGES.rsplit(", ", 1)[0]))
    fed = [tuple(r) for r in df.collect()]
    rng.shuffle(fed)
    late = [(99, 0, 0.0, "HEARTBEAT", *(None,) * 6, fed[0][-1].replace(year=fed[0][-1].year + k)) for k in (1, 2)]
    got = streamed(spark, [*fed, *late], MESSAGES, 3, lambda s: live.live_fusion(s, delay="1 hour"), tmp_path)
    want = telemetry.fuse_messages(df).collect()
    plain = lambda found: sorted((r.run_id, r.msg_id, r.t_ms, *(round(r[c], 9) for c in telemetry.POSE)) for r in found if r.run_id != 99)
    assert plain(got) == plain(want) and len(want) > 10


DETECTION = "x1 double, y1 double, x2 double, y2 double, confidence double, class_name string, thermal_delta double"


def test_live_tracks_equal_batch(spark, tmp_path):
    rng = random.Random(7)
    flight = [(run, k, k * 40.0, [(x, x, x + 30.0, x + 40.0, rng.random(), "human", None) for x in (10.0 + 2 * k, 300.0 - k)][: rng.randint(0, 2)]) for run in (1, 2) for k in range(25)]
    df = stamped(spark.createDataFrame(flight, f"run_id bigint, frame_id bigint, timestamp_ms double, detections array<struct<{DETECTION.replace(' ', ':').replace(',:', ',')}>>").withColumn("t_ms", F.col("timestamp_ms"))).drop("t_ms")
    fed = [tuple(r) for r in df.collect()]
    rng.shuffle(fed)
    late = [(99, 0, 0.0, [], fed[0][-1].replace(year=fed[0][-1].year + k)) for k in (1, 2)]
    settings = tracking.TrackerSettings(legacy_lost=False)
    got = streamed(spark, [*fed, *late], df.schema, 3, lambda s: live.live_tracks(s, settings, "1 hour"), tmp_path)
    plain = df.select("run_id", "frame_id", "timestamp_ms", F.posexplode_outer("detections").alias("det_no", "d")).select("run_id", "frame_id", "timestamp_ms", "det_no", "d.*")
    want = tracking.track(plain, settings).collect()
    key = lambda found: sorted((r.run_id, r.frame_id, r.track_id, r.hits, r.status, r.x1, r.y2) for r in found if r.run_id != 99)
    assert key(got) == key(want) and len(want) > 30


def test_top_level_fields():
    assert live._top_level("a int, b array<struct<c:int,d:int>>, e map<string,int>") == ["a int", "b array<struct<c:int,d:int>>", "e map<string,int>"]


def test_rates_are_windowed(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", "human", 0.5) for s in range(0, 50, 10)] + [("2024-01-01 01:00:00", "human", 0.1)]
    df = spark.createDataFrame(rows, "t string, class_name string, confidence double").withColumn("ts", F.to_timestamp("t")).drop("t")
    fed = [tuple(r) for r in df.select("class_name", "confidence", "ts").collect()]
    got = streamed(spark, fed, "class_name string, confidence double, ts timestamp", 2, live.detection_rates, tmp_path)
    assert [(r.detections, r.mean_confidence) for r in got] == [(5, pytest.approx(0.5))]


def test_progress_callback(spark, tmp_path):
    from ridgewatch.streaming.progress import ProgressCallback

    seen = []
    listener = ProgressCallback(lambda name, rows, rate: seen.append(rows))
    spark.streams.addListener(listener)
    try:
        streamed(spark, [(1,), (2,)], "a int", 2, lambda s: s, tmp_path)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert seen and max(seen) == 2
