"""The mission: frames, telemetry and detections to ranked, merged records and a summary.

A chain of lazy plans. Runs are independent, so each step's unit of parallelism is a run or less; what a step hands to
the next one is small next to its input (detections, then live tracks, then sightings, then entities).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgewatch.functions.exact import exact_round
from ridgewatch.functions.geo import Camera
from ridgewatch.functions.scoring import GUARDRAIL
from ridgewatch.operators import entities, evaluation, selection, telemetry, tracking, triage

#: The mission's own thresholds, which differ from the tracker's defaults.
TRACKER = tracking.TrackerSettings(high=0.35, low=0.15, cost_high=0.60, cost_low=0.50)


@dataclass(frozen=True)
class Mission:
    tracks: DataFrame
    sightings: DataFrame
    entities: DataFrame
    records: DataFrame
    summary: DataFrame


def run_mission(
    frames: DataFrame, samples: DataFrame, detections: DataFrame, every: int = 1, camera: Camera = Camera(),
    tracker: tracking.TrackerSettings = TRACKER, radius_m: float = 8.0, min_hits: int = 3, tolerance_ms: float = 100.0,
    latency_target_ms: float = 300.0,
) -> Mission:
    """frames: run_id, frame_id, timestamp_ms and, where known, latency_ms; samples: run_id, t_ms and a pose;
    detections: tracking.INPUT's columns. Frames without telemetry nearby are used and carry is_synced.
    """
    used = selection.stride(frames.withColumn("frame_idx", F.col("frame_id")), every)
    timed = used.withColumn("pts_ms", F.col("timestamp_ms"))
    pose = telemetry.synchronise(timed, samples, tolerance_ms).drop("timestamp_ms")
    tracks = tracking.track(tracking.with_empty_frames(used, detections), tracker)
    located = triage.geolocated(tracks.join(pose, ["run_id", "frame_id"], "left"), True, camera)
    sightings = located.select(
        "run_id", "class_name", F.col("track_id").cast("bigint").alias("track_id"), F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"), "confidence", "is_stationary", "thermal_delta", "error_radius_m", "timestamp_ms",
        F.col("hits").cast("bigint").alias("hits"),
    )
    found = entities.cluster(sightings, radius_m)
    listed = entities.ranked_entities(entities.confirmed(found, min_hits))
    made = triage.entity_records(listed)
    merged = entities.merge_records(made.withColumn("last_detected_ms", F.col("last_detected_ts")), radius_m)
    records = merged.withColumn("last_detected_ts", F.col("last_detected_ms")).drop("last_detected_ms")
    records = triage.rank(records, "place")
    return Mission(tracks, sightings, found, records, _summary(frames, used, found, records, min_hits, latency_target_ms))


def _summary(frames: DataFrame, used: DataFrame, found: DataFrame, records: DataFrame, min_hits: int, target: float) -> DataFrame:
    """One row a run: frames, latency where known, clustering and triage counts, and the guardrail."""
    total = frames.groupBy("run_id").agg(
        F.count("*").alias("total_video_frames"),
        exact_round((F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000.0, 2).alias("video_duration_sec"),
    )
    latency = used if "latency_ms" in used.columns else used.withColumn("latency_ms", F.lit(None).cast("double"))
    timed = latency.groupBy("run_id").agg(F.count("*").alias("processed_frames"), *evaluation.latency_aggregates())
    out = total.join(timed, "run_id", "left")
    for part in (entities.clustering_statistics(found, min_hits), triage.counts(records)):
        out = out.join(part, "run_id", "left")
    rounded = {f"{k}_latency": exact_round(F.col(f"{k}_latency"), 2) for k in ("mean", "p95", "min", "max")}
    counts = [c for c in out.columns if c not in ("run_id", "video_duration_sec", *rounded)]
    return out.na.fill(0, counts).withColumns(rounded).withColumns(
        {
            "recommender_guardrail_status": F.lit(GUARDRAIL),
            "latency_acceptance_status": F.when(F.col("mean_latency") < target, "PASSED").otherwise("FAILED"),
        }
    )
