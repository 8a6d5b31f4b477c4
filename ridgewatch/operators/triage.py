"""Triage records from survivors or entities, their rank and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgewatch.functions import scoring
from ridgewatch.functions.geo import Camera, ErrorModel, cast_pixel


def geolocated(tracks: DataFrame, confirmed_only: bool = True, camera: Camera = Camera(), errors: ErrorModel = ErrorModel()) -> DataFrame:
    """Tracks that aren't lost, cast to the ground through their box's centre.

    tracks: also the frame's pose; without one the aircraft is 50 m high and looks straight down.
    """
    wanted = tracks.where((F.col("status") != "LOST") & (F.col("is_confirmed") | (not confirmed_only)))
    pose = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    spot = cast_pixel(
        (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, pose("lat", 0.0), pose("lon", 0.0),
        pose("altitude_agl", 50.0), pose("pitch", -90.0), pose("roll", 0.0), pose("yaw", 0.0), camera, errors,
    )
    return wanted.withColumn("spot", spot).select("*", "spot.*").drop("spot")


def records(rows: DataFrame, hits: Column | None = None) -> DataFrame:
    """rows (confidence, is_stationary, thermal_delta, ...) with triage_score, urgency_level, urgency_color, status."""
    score = scoring.triage_score(
        F.col("confidence"), F.col("is_stationary"), F.col("thermal_delta"), F.coalesce(hits if hits is not None else F.col("hits"), F.lit(3))
    )
    scored = rows.withColumn("triage_score", score)
    return scored.withColumns(
        {
            "urgency_level": scoring.urgency_level(F.col("triage_score")),
            "urgency_color": scoring.urgency_color(F.col("triage_score")),
            "status": scoring.movement_status(F.col("is_stationary")),
        }
    )


def entity_records(entities: DataFrame) -> DataFrame:
    """Records of entities: place is their rank."""
    return records(
        entities.select(
            "run_id", F.col("entity_id").cast("bigint").alias("track_id"), "class_name", "latitude", "longitude",
            F.col("best_confidence").alias("confidence"), "is_stationary", "thermal_delta", "error_radius_m",
            F.col("first_detected_ms").alias("first_detected_ts"), F.col("last_detected_ms").alias("last_detected_ts"),
            F.col("total_hits").alias("hits"), F.col("rank").cast("bigint").alias("place"),
        )
    )


def rank(scored: DataFrame, tie: str) -> DataFrame:
    own = Window.partitionBy("run_id").orderBy(F.desc("triage_score"), tie)
    return scored.withColumn("rank", F.row_number().over(own))


def counts(scored: DataFrame) -> DataFrame:
    """Per run: records by urgency, movement and class."""
    level = lambda name: F.count_if(F.col("urgency_level") == name)
    return scored.groupBy("run_id").agg(
        F.count("*").alias("records"), level("CRITICAL_RESCUE").alias("critical"), level("MODERATE_SEARCH").alias("moderate"),
        level("LOW_PRIORITY").alias("low"), F.count_if("is_stationary").alias("stationary"), F.count_if(~F.col("is_stationary")).alias("mobile"),
        F.count_if(F.col("class_name") == "human").alias("humans"), F.count_if(F.col("class_name") == "animal").alias("animals"),
    )


def throughput(frames: Column, seconds: Column) -> Column:
    """Frames a second of a mission's run time."""
    return frames / F.greatest(F.lit(0.001), seconds)


def nearest(features: DataFrame, lat: float, lon: float) -> DataFrame:
    """The feature nearest to a clicked point, by plain distance in degrees."""
    return features.orderBy(F.hypot(F.col("latitude") - lat, F.col("longitude") - lon), "track_id").limit(1)


def feature_of(features: DataFrame, track_id: int) -> DataFrame:
    """The feature of a track, or the first of the queue where it has none."""
    return features.orderBy(F.desc(F.col("track_id") == track_id), F.desc("triage_score"), "place").limit(1)
