"""Order-dependent operators against plain loops, and edge cases."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgewatch.operators import detections, entities, evaluation, selection, telemetry, tracking, triage
from ridgewatch.operators.assignment import assign
from ridgewatch.plans import catalog
from ridgewatch.plans.views import view
from ridgewatch.sources import readers, sinks


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = map(int, rng.integers(1, 6, 2))
        cost = rng.random((n, m)) if rng.random() < 0.7 else rng.integers(0, 3, (n, m)).astype(float)
        pairs = assign(cost)
        wide = cost if n <= m else cost.T
        best = min(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide)))
        assert len(pairs) == min(n, m) and abs(sum(cost[r, c] for r, c in pairs) - best) < 1e-9


def pose_at(samples, q, tolerance):
    """The as-of rule in a loop."""
    before, after = [s for s in samples if s[0] < q], [s for s in samples if s[0] >= q]
    if not samples:
        return (0.0,) * 6, math.inf
    if not before or not after:
        end = after[0] if not before else before[-1]
        return end[1:], abs(q - end[0])
    a, b = before[-1], after[0]
    delta, gap = min(abs(q - a[0]), abs(q - b[0])), b[0] - a[0]
    if gap > 5 * tolerance:
        return (a if abs(q - a[0]) <= abs(q - b[0]) else b)[1:], delta
    alpha = (q - a[0]) / gap
    out = [x + alpha * (y - x) for x, y in zip(a[1:], b[1:])]
    turn = (b[6] - a[6] + 180) % 360 - 180
    out[5] = (a[6] + alpha * turn) % 360
    return tuple(round(v, 7 if k < 2 else 2) for k, v in enumerate(out)), round(delta, 2)


@pytest.mark.parametrize("slice_ms", [50.0, 1e9])
def test_interpolation(spark, slice_ms):
    rng = random.Random(4)
    samples = {run: sorted((round(rng.uniform(0, 3000), 1), *(round(rng.uniform(0, 300), 3) for _ in range(6))) for _ in range(n)) for run, n in ((1, 40), (2, 1), (3, 0))}
    frames = [(run, k, round(rng.uniform(-200, 3200), 1)) for k in range(150) for run in samples] + [(1, 999, samples[1][3][0])]
    rows = [(run, *s) for run, own in samples.items() for s in own]
    got = telemetry.synchronise(
        spark.createDataFrame(frames, "run_id bigint, frame_id bigint, pts_ms double"),
        spark.createDataFrame(rows, "run_id bigint, t_ms double, lat double, lon double, altitude_agl double, pitch double, roll double, yaw double"),
        100.0, slice_ms=slice_ms,
    ).collect()
    assert len(got) == len(frames)
    asked = {(r, f): q for r, f, q in frames}
    for row in got:
        pose, delta = pose_at(samples[row.run_id], asked[row.run_id, row.frame_id], 100.0)
        assert [row[c] for c in telemetry.POSE] == pytest.approx(pose, abs=1e-6)
        assert row.delta_ms == pytest.approx(delta, abs=0.011) and row.is_synced == (delta <= 100.0)


def test_dropping_unsynced_frames(spark):
    frames = spark.createDataFrame([(1, 1, 0.0), (1, 2, 9000.0)], "run_id bigint, frame_id bigint, pts_ms double")
    sample = spark.createDataFrame([(1, 0.0, *(1.0,) * 6)], "run_id bigint, t_ms double, lat double, lon double, altitude_agl double, pitch double, roll double, yaw double")
    assert [r.frame_id for r in telemetry.synchronise(frames, sample, drop_unsynced=True).collect()] == [1]


def test_selection_rules(spark):
    rng = random.Random(5)
    rows = [(run, k, k * 0.1, rng.uniform(50, 400), rng.random(), rng.uniform(0.7, 1)) for run in range(3) for k in range(200)]
    df = spark.createDataFrame(rows, "run_id bigint, frame_id bigint, t_s double, sharpness double, motion_score double, similarity_score double")
    rules = selection.SelectionRules()
    expected = set()
    for run in range(3):
        last = None
        for _, k, t, sharp, motion, near in (r for r in rows if r[0] == run):
            if reason := rules.reason(None if last is None else t - last, sharp, motion, near):
                expected.add((run, k, reason))
                last = t
    assert {(r.run_id, r.frame_id, r.reason) for r in selection.select_frames(df, rules).collect()} == expected


FLIGHT = "run_id bigint, frame_id bigint, timestamp_ms double, det_no bigint, x1 double, y1 double, x2 double, y2 double, confidence double, class_name string, thermal_delta double"


def boxes_at(frame, x, y, confidence=0.85, number=0, w=60, h=120):
    return (1, frame, frame * 33.3, number, x, y, x + w, y + h, confidence, "human", None)


def test_one_moving_target_keeps_one_id(spark):
    df = spark.createDataFrame([boxes_at(k, 500.0 + 5 * k, 400.0 + 4 * k) for k in range(40)], FLIGHT)
    last = tracking.latest(tracking.track(df)).collect()
    assert [(r.track_id, r.is_confirmed, r.hits) for r in last] == [(1, True, 40)]


def test_occlusion_keeps_the_id(spark):
    frames = [(1, k, k * 33.3) for k in range(36)]
    seen = [boxes_at(k, 500.0 + 3 * k, 400.0, 0.85 if k < 15 else 0.45) for k in range(36) if not 15 <= k <= 22]
    df = tracking.with_empty_frames(spark.createDataFrame(frames, "run_id bigint, frame_id bigint, timestamp_ms double"), spark.createDataFrame(seen, FLIGHT))
    rows = tracking.track(df).collect()
    assert {r.track_id for r in rows} == {1} and {r.frame_id for r in rows} == set(range(36))
    assert {r.status for r in rows if 15 <= r.frame_id <= 22} == {"LOST"}


def test_noise_is_never_confirmed(spark):
    rows = [boxes_at(0, 100.0, 100.0), boxes_at(3, 900.0, 100.0), boxes_at(4, 900.0, 100.0), (1, 9, 300.0, None, *(None,) * 7)]
    assert not any(r.is_confirmed for r in tracking.track(spark.createDataFrame(rows, FLIGHT)).collect())


def test_lost_tracks_end_unless_legacy(spark):
    rows = [boxes_at(0, 100.0, 100.0)] + [(1, k, k * 33.3, None, *(None,) * 7) for k in range(1, 10)]
    df = spark.createDataFrame(rows, FLIGHT)
    ages = {legacy: tracking.track(df, tracking.TrackerSettings(max_lost=3, legacy_lost=legacy)).agg(F.max("frame_id")).first()[0] for legacy in (True, False)}
    assert ages == {True: 9, False: 3}


def nms_loop(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], *r[2:6])):
        def iou(a, b):
            w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
            meet = max(0, w) * max(0, h)
            return meet / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - meet)
        if all(iou(r, k) <= 0.45 for k in kept):
            kept.append(r)
    return {r[1] for r in kept}


def test_suppression(spark):
    rng = random.Random(6)
    rows = []
    for k in range(120):
        x, y = rng.uniform(0, 60), rng.uniform(0, 60)
        rows.append((k % 4, k, x, y, x + rng.uniform(20, 40), y + rng.uniform(20, 40), rng.random(), "human"))
    df = spark.createDataFrame(rows, "frame_id bigint, det_no bigint, x1 double, y1 double, x2 double, y2 double, confidence double, class_name string").withColumn("run_id", F.lit(1))
    got = {r.det_no for r in detections.non_maximum_suppression(df).collect()}
    assert got == set().union(*(nms_loop([r for r in rows if r[0] == f]) for f in range(4)))


def test_detector_plug_point(spark):
    frames = spark.createDataFrame([(1, 1)], "run_id bigint, frame_id bigint")

    def detector(tiles):
        return tiles.select("*", F.col("tile_no").cast("bigint").alias("det_no"), *[F.lit(v).alias(c) for c, v in (("x1", 10.0), ("y1", 10.0), ("x2", 50.0), ("y2", 90.0), ("confidence", 0.5))], F.when(F.col("tile_no") == 0, 0).otherwise(30).alias("class_id"), F.when(F.col("tile_no") == 0, "person").otherwise("boat").alias("class_name"))

    rows = detections.detect(frames, detector, 3840, 2160).collect()
    assert [(r.class_name, r.x1) for r in rows] == [("human", 10.0)]


SIGHTINGS = "run_id bigint, class_name string, track_id bigint, lat double, lon double, confidence double, is_stationary boolean, thermal_delta double, error_radius_m double, timestamp_ms double, hits bigint"


def cluster_loop(rows, radius):
    found = []
    for r in rows:
        near = [(entities.metres(r[3], r[4], e["lat"], e["lon"]), k) for k, e in enumerate(found) if e["class"] == r[1]]
        near = [x for x in near if x[0] <= radius]
        if near:
            e = found[min(near)[1]]
            total = e["conf"] + r[5]
            a, b = (e["conf"] / total, r[5] / total) if total else (0.5, 0.5)
            e["lat"], e["lon"] = a * e["lat"] + b * r[3], a * e["lon"] + b * r[4]
            e["conf"], e["n"], e["hits"] = max(e["conf"], r[5]), e["n"] + 1, e["hits"] + r[10]
        else:
            found.append({"class": r[1], "lat": r[3], "lon": r[4], "conf": r[5], "n": 1, "hits": r[10]})
    return sorted((e["class"], round(e["lat"], 9), round(e["lon"], 9), e["n"], e["hits"]) for e in found)


@pytest.mark.parametrize("lat", [27.7, 84.0, -89.99])
def test_clustering(spark, lat):
    rng = random.Random(7)
    rows = [
        (1, rng.choice(["human", "animal"]), k, lat + rng.uniform(0, 0.0006), 85.3 + rng.uniform(0, 0.0006), rng.choice([0.0, rng.random()]), False, rng.choice([None, 3.0]), 2.0, k * 10.0, rng.randint(1, 5))
        for k in range(300)
    ]
    got = entities.cluster(spark.createDataFrame(rows, SIGHTINGS), 8.0).collect()
    assert sorted((r.class_name, round(r.latitude, 9), round(r.longitude, 9), r.observation_count, r.total_hits) for r in got) == cluster_loop(rows, 8.0)
    assert sorted(r.entity_id for r in got) == list(range(1, len(got) + 1))


def test_radius_join_of_all_runs(spark, tmp_path):
    rng = random.Random(5)
    orders = [(k, rng.randrange(400), f"2024-01-{1 + k % 28:02d}") for k in range(1, 301)]
    df = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, day string")
    df.select("o_orderkey", "o_custkey", F.to_timestamp("day").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    rows = [(r.run_id, r.track_id, r.class_name, r.lat, r.lon) for r in view(spark, str(tmp_path), "sightings_v").collect()]
    wanted = {(*a[:2], *b[:2]) for a in rows for b in rows if a[:2] < b[:2] and a[2] == b[2] and entities.metres(*a[3:], *b[3:]) <= 8.0}
    got = catalog.radius_join(spark, str(tmp_path)).collect()
    assert len(got) == len(wanted) and {tuple(r[:4]) for r in got} == wanted
    assert len({r.left_run for r in got}) > 2


def test_raycast_keeps_rays_near_the_horizon(spark, tmp_path):
    df = spark.createDataFrame([(419, 1, "view", 103_680_000, 5.0), (60, 1, "view", 103_680_000, 5.0)], "event_id bigint, user_id bigint, event_type string, us bigint, value double")
    df.withColumn("ts", F.timestamp_micros("us")).drop("us").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(r.ground_distance_m for r in catalog.raycast(spark, str(tmp_path)).collect())
    assert len(got) == 2 and got[1] > 20 * 35.0


def test_confirmation_falls_back_to_all(spark):
    df = spark.createDataFrame([(1, 1), (1, 5), (2, 1)], "run_id bigint, total_hits bigint")
    assert sorted(tuple(r) for r in entities.confirmed(df).collect()) == [(1, 5), (2, 1)]


def test_record_merging_takes_the_first_in_reach(spark):
    rows = [(1, "human", 0, 10, 27.7, 85.3, 0.5, 0.4, 2, 10.0), (1, "human", 1, 11, 27.70010, 85.3, 0.4, 0.9, 3, 5.0), (1, "human", 2, 12, 27.70004, 85.3, 0.9, 0.8, 4, 20.0), (1, "animal", 3, 13, 27.7, 85.3, 0.9, 0.8, 4, 20.0)]
    df = spark.createDataFrame(rows, "run_id bigint, class_name string, place bigint, track_id bigint, latitude double, longitude double, confidence double, triage_score double, hits bigint, last_detected_ms double")
    got = {r.track_id: r for r in entities.merge_records(df).collect()}
    assert set(got) == {10, 11, 13}
    assert (got[10].hits, got[10].confidence, got[10].triage_score, got[10].best_record, got[10].last_detected_ms) == (6, 0.9, 0.8, 12, 20.0)


def test_greedy_matching(spark):
    pairs = [(1, 0, 0, 0.9), (1, 0, 1, 0.6), (1, 1, 0, 0.8), (1, 1, 1, 0.55), (1, 2, 1, 0.7), (2, 0, 0, 0.3), (2, 1, 0, 0.5)]
    df = spark.createDataFrame([(run, *p) for p in pairs for run in (7, 8)], "run_id bigint, frame_id bigint, pred_no bigint, gt_no bigint, iou double")
    got = {(r.run_id, r.frame_id, r.pred_no, r.gt_no) for r in evaluation.greedy_matches(df).collect()}
    assert got == {(run, *p) for p in ((1, 0, 0), (1, 1, 1), (2, 1, 0)) for run in (7, 8)}


def test_metrics_of_runs(spark):
    made = spark.createDataFrame([(2, 1, 1), (2, 1, 2)], "run_id bigint, frame_id bigint, pred_no bigint")
    truth = spark.createDataFrame([(2, 1, 1, 5), (3, 1, 1, 5)], "run_id bigint, frame_id bigint, gt_no bigint, entity_id bigint")
    match = spark.createDataFrame([(2, 1, 1, 1, 0.9)], "run_id bigint, frame_id bigint, pred_no bigint, gt_no bigint, iou double")
    frames = spark.createDataFrame([(1, 1, 0.0, 5.0), (2, 1, 0.0, 7.0)], "run_id bigint, frame_id bigint, timestamp_ms double, latency_ms double")
    rows = {r.run_id: r for r in evaluation.metrics(made, truth, match, frames).collect()}
    assert {k: (r.true_positives, r.false_positives, r.false_negatives, r.total_frames_evaluated) for k, r in rows.items()} == {1: (0, 0, 0, 1), 2: (1, 1, 0, 1), 3: (0, 0, 1, 0)}
    assert (rows[1].recall_at_50, rows[3].mean_latency_ms, rows[3].acceptance_verdict, rows[2].acceptance_verdict) == (0.0, 0.0, "FAILED", "PASSED")
    assert evaluation.metrics(*(df.limit(0) for df in (made, truth, match, frames))).count() == 0


def test_later_truth_replaces_earlier(spark):
    rows = spark.createDataFrame([(1, 1, 1, "old"), (1, 1, 2, "new"), (2, 1, 1, "only")], "run_id bigint, frame_id bigint, line bigint, box string")
    assert {(r.run_id, r.box) for r in evaluation.last_of_each(rows, ["run_id", "frame_id"], ["line"]).collect()} == {(1, "new"), (2, "only")}


def test_runs_do_not_mix(spark):
    boxes = [(run, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9, "human") for run in (1, 2)]
    df = spark.createDataFrame(boxes, "run_id bigint, frame_id bigint, det_no bigint, x1 double, y1 double, x2 double, y2 double, confidence double, class_name string")
    assert detections.non_maximum_suppression(df).count() == 2
    truth = spark.createDataFrame([(2, 1, 1, 0.0, 0.0, 10.0, 10.0)], "run_id bigint, frame_id bigint, gt_no bigint, gx1 double, gy1 double, gx2 double, gy2 double")
    made = df.withColumnRenamed("det_no", "pred_no")
    match = evaluation.greedy_matches(evaluation.overlaps(made, truth))
    assert [(r.run_id, r.iou) for r in match.collect()] == [(2, 1.0)]
    assert [r.run_id for r in evaluation.false_positives(made, match).collect()] == [1]
    assert evaluation.false_negatives(truth, match).count() == 0


def test_metadata_precedence_and_thermal_dropout(spark):
    frames = spark.createDataFrame([(1, 5.0, True, 3), (2, None, True, 0), (3, None, False, None)], "frame_id bigint, lat double, image boolean, nonzero bigint")
    default = {"lat": 0.0, "is_synced": False}
    assert [(r.lat, r.is_synced) for r in detections.with_metadata(frames, {}, default).orderBy("frame_id").collect()] == [(5.0, False), (0.0, False), (0.0, False)]
    assert [r.lat for r in detections.with_metadata(frames, {"lat": 9.0}, default).collect()] == [9.0] * 3
    assert [r.v for r in frames.orderBy("frame_id").select(detections.thermal_valid(F.col("image"), F.col("nonzero")).alias("v")).collect()] == [True, False, False]


def test_unpacked_detections(spark):
    df = spark.createDataFrame([(1.0, None, None), (2.0, 0.9, "0"), (3.0, 0.1, "dog")], "x1 double, conf double, cls string")
    assert [(r.confidence, r.class_name) for r in detections.unpacked(df).orderBy("x1").collect()] == [(0.5, "human"), (0.9, "human"), (0.1, "animal")]


def test_report_texts(spark):
    row = spark.range(1).select(sinks.utc_text(F.lit(1_700_000_000)).alias("t"), sinks.data_url(F.lit(b"abc")).alias("u"), sinks.data_url(F.lit(b"")).alias("n")).first()
    assert (row.t, row.u, row.n) == ("2023-11-14 22:13:20 UTC", "data:image/png;base64,YWJj", None)
    summary = spark.createDataFrame([(1, 600, 60)], "run_id bigint, candidates bigint, selected bigint")
    done = selection.selection_report(summary, F.lit(4.0), F.lit(30.0)).first()
    assert (done.processing_speed_fps, done.realtime_speedup) == (150.0, 5.0)
    assert spark.range(1).select(triage.throughput(F.lit(10), F.lit(0.0))).first()[0] == 10_000.0


def test_label_splits(spark, tmp_path):
    for name in ("train/images/a.jpg", "train/images/b.PNG", "train/labels/a.txt", "valid/labels/c.txt", "valid/images/c.jpeg", "notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("0 1 1 1 1\n")
    got = {(r.split, r.images, r.labels) for r in readers.label_splits(spark, str(tmp_path)).collect()}
    assert got == {("train", 2, 1), ("val", 1, 1)}


def test_final_tracks_are_the_last_rows(spark):
    rng = __import__("random").Random(6)
    rows = [(run, k, k * 40.0, d, x, x, x + 30, x + 40, rng.random(), "human", None) for run in (1, 2) for k in range(60) for d in range(rng.randint(0, 4)) for x in (rng.uniform(0, 400),)]
    df = spark.createDataFrame(rows, FLIGHT)
    settings = tracking.TrackerSettings(max_lost=4, legacy_lost=False)
    last = tracking.latest(tracking.track(df, settings)).collect()
    assert sorted(map(str, last)) == sorted(map(str, tracking.track(df, settings, final_only=True).collect())) and len(last) > 20


def test_message_fusion_ignores_other_types(spark):
    rows = [(1, 0, 0.0, "GLOBAL_POSITION_INT", 277000000, 853000000, 50000, None, None, None), (1, 1, 50.0, "ATTITUDE", None, None, None, 0.1, -1.5, -0.2), (1, 2, 60.0, "HEARTBEAT", *(None,) * 6)]
    df = spark.createDataFrame(rows, "run_id bigint, msg_id bigint, t_ms double, msg_type string, lat_e7 bigint, lon_e7 bigint, alt_mm bigint, roll_rad double, pitch_rad double, yaw_rad double")
    got = telemetry.fuse_messages(df).collect()
    assert [(r.msg_id, r.t_ms, r.lat) for r in got] == [(1, 25.0, 27.7)] and 348 < got[0].yaw < 349
    assert telemetry.fuse_messages(df, every_message=True).count() == 2


def test_telemetry_reader(spark, tmp_path):
    (tmp_path / "t.csv").write_text(" Timestamp_MS ,LAT,lon,altitude_agl,pitch,roll,yaw,extra\n10,1,2,3,4,5,6,x\n20,oops,2,3,4,5,6,x\n5,1,2,3,4,5,6,x\n")
    assert sorted(r.timestamp_ms for r in readers.read_telemetry(spark, str(tmp_path / "t.csv")).collect()) == [5.0, 10.0]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_telemetry(spark, str(tmp_path / "bad.csv"))


def test_absent_outputs(spark, tmp_path):
    assert readers.read_geojson(spark, str(tmp_path / "none.json")).count() == 0
    assert readers.read_metrics(spark, str(tmp_path / "none.json")).first().mean_latency_ms == 0.0


def export_rows(spark):
    rows = [(1, 7, 0, "human", 27.7, 85.3, 0.9, True, 6.5, 2.0, 10), (1, 8, 1, "animal", 27.8, 85.4, 0.6, False, None, 3.0, 2)]
    df = spark.createDataFrame(rows, "run_id bigint, track_id bigint, place bigint, class_name string, latitude double, longitude double, confidence double, is_stationary boolean, thermal_delta double, error_radius_m double, hits bigint")
    more = {"first_detected_ts": F.lit(0.0), "last_detected_ts": F.lit(1.0), "crop_bbox": F.array(F.lit(1.0)), "full_frame_path": F.lit("a\\b.jpg"), "raw_crop_path": F.lit(None).cast("string"), "annotated_crop_path": F.lit("c.jpg")}
    return triage.records(df).withColumns(more)


def test_exports(spark, tmp_path):
    rows = export_rows(spark)
    document = json.loads(open(sinks.write_geojson(rows, str(tmp_path / "s.geojson"))).read())
    first, second = document["features"]
    assert first["geometry"]["coordinates"] == [85.3, 27.7] and first["properties"]["full_frame_path"] == "a/b.jpg"
    assert second["properties"]["thermal_delta_c"] is None and second["properties"]["urgency_level"] == "LOW_PRIORITY"
    back = readers.read_geojson(spark, str(tmp_path / "s.geojson"))
    assert [r.track_id for r in back.orderBy("track_id").collect()] == [7, 8]
    kml = open(sinks.write_kml(rows, str(tmp_path / "s.kml"))).read()
    assert kml.count("<Placemark>") == 2 and "+6.5°C" in kml and "N/A" in kml
    assert "#e63946" in open(sinks.write_map(rows, str(tmp_path / "s.html"))).read()
    assert sinks.write_queue(rows, str(tmp_path / "q.csv")).endswith(".csv")
    assert triage.feature_of(rows, 8).first().track_id == 8 and triage.feature_of(rows, 99).first().track_id == 7
    sinks.reset_outputs(str(tmp_path))
    assert json.loads((tmp_path / "survivors.geojson").read_text())["features"] == []


def test_label_scan(spark, tmp_path):
    for split, text in (("train", "0 0.5 0.5\n1 0.1 0.1\nx 1\n"), ("valid", "1 0.2 0.2\n")):
        folder = tmp_path / split / "labels"
        folder.mkdir(parents=True)
        (folder / "a.txt").write_text(text)
    rows = readers.read_labels(spark, str(tmp_path))
    assert {(r.class_id, r.boxes) for r in readers.label_histogram(rows).collect()} == {(0, 1), (1, 2)}
    assert {r.split for r in rows.collect()} == {"train", "val"}


def test_paired_streams(spark):
    rgb, thermal = readers.frame_table(spark, 6, 25.0), readers.frame_table(spark, 3, 25.0)
    assert readers.paired_streams(rgb, thermal, 2).count() == 2
    assert readers.paired_streams(rgb, thermal, 2, stop_with_thermal=False).count() == 3
    assert readers.frame_table(spark, 2, float("nan")).agg(F.max("pts_ms")).first()[0] == pytest.approx(1000 / 30)


def test_empty_tables(spark):
    assert tracking.track(spark.createDataFrame([], FLIGHT)).count() == 0
    assert entities.cluster(spark.createDataFrame([], SIGHTINGS)).count() == 0


def audit_flight():
    """Sixty frames: a human who stands still and is hidden in three of them, and an animal that walks from frame 10."""
    frames, seen, truth = [], [], []
    for k in range(60):
        t = k * 1000 / 30
        frames.append((1, k, t, 30.0))
        truth.append((k, 1, 1, 1900.0, 1050.0, 1950.0, 1120.0))
        if not 20 <= k <= 22:
            dx, dy = float(k % 3 - 1), float(k % 2 - 1)
            seen.append((1, k, t, 0, 1900 + dx, 1050 + dy, 1950 + dx, 1120 + dy, 0.88 if k < 20 else 0.42 if k == 23 else 0.85, "human", 6.8))
        if k >= 10:
            x = 2400 + (k - 10) * 4.0
            truth.append((k, 2, 2, x, 1200.0, x + 80, 1270.0))
            seen.append((1, k, t, 1, x, 1200.0, x + 80, 1270.0, 0.79, "animal", 1.2))
    return frames, seen, truth


def test_audit_flight(spark):
    frames, seen, truth = audit_flight()
    frames = spark.createDataFrame(frames, "run_id bigint, frame_id bigint, timestamp_ms double, latency_ms double")
    rows = tracking.track(tracking.with_empty_frames(frames, spark.createDataFrame(seen, FLIGHT)))
    made = rows.withColumn("pred_no", F.col("track_id"))
    truth = spark.createDataFrame(truth, "frame_id bigint, gt_no bigint, entity_id bigint, gx1 double, gy1 double, gx2 double, gy2 double").withColumn("run_id", F.lit(rows.first().run_id))
    match = evaluation.greedy_matches(evaluation.overlaps(made, truth))
    m = evaluation.metrics(made, truth, match, frames, rows).first()
    assert (m.total_gt_instances, m.true_positives, m.false_positives, m.false_negatives) == (110, 110, 0, 0)
    assert (m.recall_at_50, m.precision_at_50, m.f1_score, m.fp_per_minute) == (1.0, 1.0, 1.0, 0.0)
    assert (m.gt_unique_entities, m.predicted_unique_tracks, m.deduplication_accuracy) == (2, 2, 1.0)
    assert (m.total_frames_evaluated, m.video_duration_seconds, m.acceptance_verdict) == (60, 1.97, "PASSED")
    sure = made.where("status <> 'LOST'")
    assert evaluation.greedy_matches(evaluation.overlaps(sure, truth)).count() == 107


def test_whole_mission(spark):
    from ridgewatch.plans.mission import run_mission

    frames, seen, _ = audit_flight()
    frames = spark.createDataFrame(frames, "run_id bigint, frame_id bigint, timestamp_ms double, latency_ms double")
    flown = readers.fallback_telemetry(spark, 60, 30.0).agg(F.max("timestamp_ms")).first()[0]
    assert flown == pytest.approx(59 * 1000 / 30)
    hover = [(1, k * 100.0, 27.717245, 85.324012, 50.0, -75.0, 0.0, 45.0) for k in range(21)]
    pose = spark.createDataFrame(hover, "run_id bigint, t_ms double, lat double, lon double, altitude_agl double, pitch double, roll double, yaw double")
    done = run_mission(frames, pose, spark.createDataFrame(seen, FLIGHT))
    records = {r.class_name: r for r in done.records.collect()}
    assert set(records) == {"human", "animal"} and records["human"].status == "STATIONARY"
    assert records["human"].urgency_level == "CRITICAL_RESCUE" and records["human"].rank == 1
    row = done.summary.first()
    assert (row.processed_frames, row.total_ground_entities, row.humans, row.animals, row.mean_latency) == (60, 2, 1, 1, 30.0)
    assert row.latency_acceptance_status == "PASSED"
    halved = run_mission(frames, pose, spark.createDataFrame(seen, FLIGHT), every=2)
    assert halved.summary.first().processed_frames == 30
    nothing = run_mission(frames, pose, spark.createDataFrame([], FLIGHT)).summary.first()
    assert (nothing.records, nothing.total_ground_entities) == (0, 0)


def test_selection_from_images(spark):
    rng = np.random.default_rng(3)
    scenes = [rng.integers(0, 255, (24, 32, 3)).astype(np.uint8) for _ in range(2)]
    blurred = np.full((24, 32, 3), 90, np.uint8)
    shown = [scenes[0]] * 4 + [scenes[1]] * 3 + [blurred] * 3 + [scenes[1]] * 12
    df = spark.createDataFrame([(1, k, k * 0.2 + (0.01 if k else 0), im.tobytes(), 32) for k, im in enumerate(shown)], "run_id bigint, frame_id bigint, t_s double, image binary, width int")
    got = [(r.frame_id, r.reason) for r in selection.select_from_images(df).orderBy("frame_id").collect()]
    assert got[:2] == [(0, selection.ANCHOR), (4, selection.MOTION)]
    assert all(reason == selection.KEEPALIVE for _, reason in got[2:]) and 7 not in dict(got)
