"""Scalar functions: literal cases and properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgewatch.functions import boxes, geo, pixels, scoring
from ridgewatch.functions.boxes import Box
from ridgewatch.functions.exact import exact_round
from ridgewatch.operators import selection
from ridgewatch.operators.entities import metres


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_exact_round_is_text_rounding(spark):
    rng = random.Random(1)
    values = [2.675, 0.1235, 1e-9, -2.5, 0.0005, 123456.7895, *(rng.uniform(-1000, 1000) for _ in range(300))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 3, 7):
        got = [r[0] for r in df.select(exact_round(F.col("x"), digits)).collect()]
        assert got == [round(v, digits) for v in values]


def test_exact_round_keeps_odd_values(spark):
    got = one(spark, exact_round(F.lit(float("inf")), 2), exact_round(F.lit(float("nan")), 2))
    assert got[0] == float("inf") and math.isnan(got[1])


def test_nadir_and_oblique_rays(spark):
    straight = geo.cast_pixel(*map(F.lit, (1920.0, 1080.0, 27.7, 85.3, 50.0, -90.0, 0.0, 0.0)))
    spot = one(spark, straight.alias("s")).s
    assert metres(27.7, 85.3, spot.latitude, spot.longitude) < 0.05 and spot.below_horizon
    slanted = geo.cast_pixel(*map(F.lit, (1920.0, 1080.0, 27.7, 85.3, 50.0, -45.0, 0.0, 0.0)))
    spot = one(spark, slanted.alias("s")).s
    assert abs(spot.ground_distance_m - 50) < 0.1 and spot.latitude > 27.7
    up = geo.cast_pixel(*map(F.lit, (1920.0, 1080.0, 27.7, 85.3, 50.0, 10.0, 0.0, 0.0)))
    spot = one(spark, up.alias("s")).s
    assert not spot.below_horizon and spot.ground_distance_m > 1e6


def test_error_budget(spark):
    model = geo.ErrorModel()
    low, high = one(spark, model.radius(F.lit(30.0), F.lit(0.0)), model.radius(F.lit(100.0), F.lit(0.0)))
    assert 1.9 <= low <= 2.2 and 3.1 <= high <= 3.4


def test_angles_take_the_short_way(spark):
    a, b, c = one(spark, *(geo.blend_angle(F.lit(x), F.lit(y), F.lit(0.5)) for x, y in ((350.0, 10.0), (10.0, 350.0), (0.0, 180.0))))
    assert (a, b) == (0.0, 0.0) and c in (90.0, 270.0)


def test_overlap_properties(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        a, b = ([rng.uniform(0, 50), rng.uniform(0, 50)] for _ in range(2))
        rows.append((*a, a[0] + rng.uniform(1, 30), a[1] + rng.uniform(1, 30), *b, b[0] + rng.uniform(1, 30), b[1] + rng.uniform(1, 30)))
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, gx1 double, gy1 double, gx2 double, gy2 double")
    a, b = Box.of(), Box(*(F.col(f"g{c}") for c in ("x1", "y1", "x2", "y2")))
    for r in df.select(boxes.iou(a, b).alias("ab"), boxes.iou(b, a).alias("ba"), boxes.iou(a, a).alias("aa"), boxes.giou_cost(a, b).alias("cost"), boxes.giou_cost(a, a).alias("same")).collect():
        assert 0 <= r.ab <= 1 and abs(r.ab - r.ba) < 1e-12 and abs(r.aa - 1) < 1e-12
        assert 0 <= r.cost <= 1 and abs(r.same) < 1e-12


def test_degenerate_boxes(spark):
    flat = Box(*map(F.lit, (5.0, 5.0, 5.0, 5.0)))
    assert one(spark, boxes.iou(flat, flat))[0] == 0.0


def test_tiles():
    assert boxes.tile_starts(3840, 1280, 0.12) == [0, 1126, 2252, 2560]
    assert boxes.tile_starts(2160, 960, 0.12) == [0, 844, 1200]
    assert len(boxes.tile_starts(3840, 640, 0.2)) * len(boxes.tile_starts(2160, 640, 0.2)) == 32
    assert boxes.tile_starts(500, 640, 0.2) == [0]


def test_centre_round_trip(spark):
    box = Box(*map(F.lit, (10.0, 20.0, 40.0, 80.0)))
    back = boxes.from_centre(boxes.to_centre(box))
    assert tuple(one(spark, back.x1, back.y1, back.x2, back.y2)) == (10.0, 20.0, 40.0, 80.0)


def test_class_names(spark):
    rows = [(0, "x", "human"), (5, "Survivor", "human"), (16, "thing", "animal"), (9, "cattle", "animal"), (9, "Boat", "boat")]
    df = spark.createDataFrame(rows, "i int, n string, e string")
    assert all(r[0] == r[1] for r in df.select(boxes.mapped_class(F.col("i"), F.col("n"))["class_name"], "e").collect())


@pytest.mark.parametrize("case,score,level", [((0.90, True, 6.5, 10), 0.9, "CRITICAL_RESCUE"), ((0.60, False, 0.0, 2), 0.21, "LOW_PRIORITY"), ((0.6, False, None, 2), 0.21, "LOW_PRIORITY")])
def test_triage_cases(spark, case, score, level):
    confidence, still, thermal, hits = case
    s = scoring.triage_score(F.lit(confidence), F.lit(still), F.lit(thermal).cast("double"), F.lit(hits))
    assert tuple(one(spark, s, scoring.urgency_level(s))) == (score, level)


def test_frame_scores_without_a_frame_before(spark):
    none = F.lit(None).cast("double")
    assert tuple(one(spark, scoring.motion_score(none, none), scoring.similarity_score(none, none))) == (1.0, 0.0)


def test_candidate_interval(spark):
    assert [one(spark, selection.candidate_interval(F.lit(f)))[0] for f in (30.0, 25.0, 2.0, 12.5, 17.5)] == [6, 5, 1, 2, 4]


def test_pixel_statistics(spark):
    flat, edge = bytes([7] * 64), bytes(([0] * 4 + [200] * 4) * 8)
    df = spark.createDataFrame([(flat, 8), (edge, 8), (None, 8), (bytes(64), 8)], "data binary, width int")
    rows = [r.s for r in df.select(pixels.image_statistics("data", "width").alias("s")).collect()]
    assert rows[0].sharpness == 0 and rows[0].brightness == 7 and rows[1].sharpness > 0 and rows[1].contrast == 100
    assert rows[2].sharpness is None and rows[3].nonzero == 0


def test_thermal_delta():
    image = np.zeros((100, 100))
    image[40:60, 40:60] = 90
    assert pixels.thermal_delta(image, (40, 40, 60, 60)) == round(90 - 90 * 400 / 1600, 2)
    assert pixels.thermal_delta(image, (200, 200, 210, 210)) is None


def test_area_resize_keeps_the_mean():
    image = np.random.default_rng(1).integers(0, 255, (90, 160, 3))
    small = pixels.area_resize(image, 64)
    assert small.shape == (36, 64, 3) and small.mean() == pytest.approx(image.mean())
    assert pixels.area_resize(image, 640).shape == image.shape


def test_likeness_sees_hue():
    image = np.zeros((8, 8, 3), np.uint8)
    image[..., 0] = 200
    other = np.zeros((8, 8, 3), np.uint8)
    other[..., 2] = 76  # about as bright
    assert pixels.likeness(image, other)[1] == pytest.approx((200 + 76) / 3)


def test_likeness_and_change():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 255, (20, 30, 3)).astype(np.uint8)
    assert pixels.likeness(image, image) == (pytest.approx(1.0), 0.0) and pixels.change(image, image) == (0.0, 0.0)
    other = np.zeros_like(image)
    assert pixels.likeness(image, other)[0] < 0.9 and pixels.change(image, other)[0] > 0.5
    assert pixels.likeness(image, None) == (None, None) and pixels.change(image, image[:5]) == (None, None)


def test_evidence_crops(spark):
    image = np.zeros((10, 20, 3), np.uint8)
    df = spark.createDataFrame([(image.tobytes(), 20, 2, 2, 8, 8), (None, None, 0, 0, 5, 5)], "data binary, width int, x1 int, y1 int, x2 int, y2 int")
    rows = [r.c for r in df.select(pixels.evidence_crops("data", "width", "x1", "y1", "x2", "y2").alias("c")).collect()]
    assert all(r.raw_crop[:4] == b"\x89PNG" and r.annotated_crop[:4] == b"\x89PNG" for r in rows)
    assert rows[0].raw_crop != rows[0].annotated_crop and rows[0].raw_crop != rows[1].raw_crop
