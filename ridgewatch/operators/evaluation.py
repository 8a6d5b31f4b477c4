"""Evaluation against ground truth: overlap pairs, greedy matching, listings and metrics."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgewatch.functions.boxes import Box, iou
from ridgewatch.functions.exact import exact_round
from ridgewatch.functions.scoring import GUARDRAIL
from ridgewatch.operators.fold import fold_sorted


#: Frames are numbered within their run.
FRAME = ("run_id", "frame_id")


def last_of_each(truth: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last in order: a later entry for a frame replaces earlier ones."""
    own = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return truth.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def overlaps(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Overlapping pairs of a run's frame: run_id, frame_id, pred_no, gt_no, iou.

    predictions: run_id, frame_id, pred_no, x1 to y2; truth: run_id, frame_id, gt_no, gx1 to gy2.
    """
    truth_box = Box(*(F.col(f"g{c}") for c in ("x1", "y1", "x2", "y2")))
    met = predictions.join(truth, list(FRAME)).withColumn("iou", iou(Box.of(), truth_box))
    return met.where("iou > 0").select(*FRAME, "pred_no", "gt_no", "iou")


def greedy_matches(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """run_id, frame_id, pred_no, gt_no, iou: predictions in order, each with the free truth that it overlaps most.

    A prediction whose best free truth overlaps too little matches none, and leaves that truth free.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def step(state: dict, row: dict) -> Iterator[tuple]:
        if row["pred_no"] == state["done"] or row["gt_no"] in state["taken"]:
            return
        state["done"] = row["pred_no"]  # its first free truth is its best one
        if row["iou"] >= least:
            state["taken"].add(row["gt_no"])
            yield *(row[k] for k in FRAME), row["pred_no"], row["gt_no"], row["iou"]

    return fold_sorted(
        pairs, list(FRAME), ["pred_no", F.desc("iou"), "gt_no"], lambda row: {"done": None, "taken": set()}, step,
        f"run_id {kinds['run_id']}, frame_id {kinds['frame_id']}, pred_no {kinds['pred_no']}, gt_no {kinds['gt_no']}, iou double",
    )


def false_positives(predictions: DataFrame, matches: DataFrame) -> DataFrame:
    return predictions.join(matches, [*FRAME, "pred_no"], "left_anti")


def false_negatives(truth: DataFrame, matches: DataFrame) -> DataFrame:
    return truth.join(matches, [*FRAME, "gt_no"], "left_anti")


def metrics(
    predictions: DataFrame, truth: DataFrame, matches: DataFrame, frames: DataFrame, tracks: DataFrame | None = None,
    recall_target: float = 0.90, latency_target_ms: float = 300.0,
) -> DataFrame:
    """A row of evaluation metrics for each run that has frames, predictions or truth.

    truth: also entity_id; frames: timestamp_ms, latency_ms; tracks: track_id and is_confirmed (else no tracks).
    """
    hits = matches.groupBy("run_id").agg(F.count("*").alias("tp"))
    asked = predictions.groupBy("run_id").agg(F.count("*").alias("n_pred"))
    there = truth.groupBy("run_id").agg(F.count("*").alias("n_gt"), F.count_distinct("entity_id").alias("entities"))
    clock = frames.groupBy("run_id").agg(
        F.count("*").alias("frames"), F.min_by("timestamp_ms", "frame_id").alias("begin"), F.max_by("timestamp_ms", "frame_id").alias("end"),
        *latency_aggregates(),
    )
    made = tracks if tracks is not None else predictions.select("run_id", F.lit(None).alias("track_id"), F.lit(False).alias("is_confirmed"))
    seen = made.groupBy("run_id").agg(
        F.count_distinct(F.when(F.col("is_confirmed"), F.col("track_id"))).alias("sure"),
        F.count_distinct("track_id").alias("all_tracks"),
    )
    one = clock
    for part in (asked, there, hits, seen):  # a row for each run
        one = one.join(part, "run_id", "full")
    zero = ("tp", "n_pred", "n_gt", "entities", "frames", "mean_latency", "p95_latency", "max_latency", "sure", "all_tracks")
    one = one.na.fill(0, list(zero)).withColumn("entities", F.greatest(F.lit(1), "entities"))
    tp, fp, fn = F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_gt") - F.col("tp")
    recall, precision = tp / F.greatest(F.lit(1), tp + fn), tp / F.greatest(F.lit(1), tp + fp)
    f1 = 2 * precision * recall / F.greatest(F.lit(1e-6), precision + recall)
    span = (F.col("end") - F.col("begin")) / 1000.0
    seconds = F.greatest(F.lit(1.0), F.when(F.col("end") > F.col("begin"), span).otherwise(F.col("frames") / 30.0))
    tracked = F.when(F.col("sure") > 0, F.col("sure")).otherwise(F.col("all_tracks"))
    off = F.abs(tracked - F.col("entities")) / F.col("entities")
    passed = (recall >= recall_target) & (F.col("mean_latency") <= latency_target_ms)
    return one.select(
        "run_id", F.col("n_gt").alias("total_gt_instances"), tp.alias("true_positives"), fp.alias("false_positives"),
        fn.alias("false_negatives"), exact_round(recall, 4).alias("recall_at_50"),
        exact_round(precision, 4).alias("precision_at_50"), exact_round(f1, 4).alias("f1_score"),
        exact_round(fp / (seconds / 60.0), 2).alias("fp_per_minute"), F.col("entities").alias("gt_unique_entities"),
        tracked.alias("predicted_unique_tracks"),
        exact_round(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), off)), 4).alias("deduplication_accuracy"),
        exact_round(F.col("mean_latency"), 2).alias("mean_latency_ms"),
        exact_round(F.col("p95_latency"), 2).alias("p95_latency_ms"),
        exact_round(F.col("max_latency"), 2).alias("max_latency_ms"),
        F.col("frames").alias("total_frames_evaluated"), exact_round(seconds, 2).alias("video_duration_seconds"),
        F.lit(GUARDRAIL).alias("recommender_guardrail_status"),
        F.when(passed, "PASSED").otherwise("FAILED").alias("acceptance_verdict"),
    )


def latency_aggregates(column: str = "latency_ms") -> list:
    """Mean, 95th percentile, least and most latency; 0 without rows."""
    return [
        F.coalesce(a, F.lit(0.0)).alias(n)
        for a, n in (
            (F.avg(column), "mean_latency"), (F.percentile(column, 0.95), "p95_latency"),
            (F.min(column), "min_latency"), (F.max(column), "max_latency"),
        )
    ]
