"""Frame selection: the rules in their order over a run's candidates, which depend on what was selected before."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewatch.functions import pixels
from ridgewatch.functions.exact import exact_round
from ridgewatch.operators.fold import fold_sorted

ANCHOR, MOTION, NOVEL, KEEPALIVE = (
    "initial_video_anchor", "significant_motion_and_scene_change", "novel_scene_content", "periodic_coverage_keepalive",
)


@dataclass(frozen=True)
class SelectionRules:
    min_gap: float = 0.2
    max_gap: float = 2.0
    blur: float = 100.0
    similarity: float = 0.90
    motion: float = 0.20

    def reason(self, since: float | None, sharpness: float, motion: float, similarity: float) -> str | None:
        """Why a candidate is selected, or None. since: seconds since the last selected one."""
        if since is None:
            return ANCHOR
        if since < self.min_gap or sharpness < self.blur:
            return None
        if similarity < self.similarity:
            return MOTION if motion >= self.motion else NOVEL
        return KEEPALIVE if since >= self.max_gap else None


def stride(frames: DataFrame, every: int) -> DataFrame:
    """Every n-th frame by its index."""
    return frames.where(F.col("frame_idx") % every == 0)


def candidate_interval(fps: Column, sample_fps: float = 5.0) -> Column:
    """Frames from one candidate to the next; ties round to even."""
    return F.greatest(F.lit(1), F.bround(fps / sample_fps, 0).cast("int"))


def select_frames(candidates: DataFrame, rules: SelectionRules = SelectionRules()) -> DataFrame:
    """Selected frames (run_id, frame_id, t_s, reason). candidates: also sharpness, motion_score, similarity_score."""

    def step(last: list, row: dict) -> Iterator[tuple]:
        since = None if last[0] is None else row["t_s"] - last[0]
        reason = rules.reason(since, row["sharpness"], row["motion_score"], row["similarity_score"])
        if reason is not None:
            last[0] = row["t_s"]
            yield row["run_id"], row["frame_id"], row["t_s"], reason

    columns = ["run_id", "frame_id", "t_s", "sharpness", "motion_score", "similarity_score"]
    return fold_sorted(
        candidates.select(*columns), ["run_id"], ["t_s", "frame_id"], lambda row: [None], step,
        "run_id bigint, frame_id bigint, t_s double, reason string",
    )


def select_from_images(frames: DataFrame, rules: SelectionRules = SelectionRules(), proxy_width: int = 640) -> DataFrame:
    """Selected frames with their scores, from pixels: run_id, frame_id, t_s, image (three bytes a pixel), width.

    Motion is measured against the candidate before, similarity against the last selected frame; both are kept small.
    """

    def start(row: dict) -> dict:
        return {"before": None, "chosen": None, "last": None}

    def step(state: dict, row: dict) -> Iterator[tuple]:
        image = pixels.area_resize(pixels.colour(row["image"], row["width"]), proxy_width)
        grey = pixels.to_grey(image)
        sharpness, mean, deviation = pixels.laplacian_variance(grey), float(grey.mean()), float(grey.std())
        share, moved = pixels.change(image, state["before"])
        alike, off = pixels.likeness(image, state["chosen"])
        motion = 1.0 if share is None else round(min(1.0, 0.7 * (share * 5) + 0.3 * (moved / 255.0 * 3)), 4)
        near = 0.0 if alike is None else round(min(1.0, max(0.0, 0.6 * max(0.0, alike) + 0.4 * max(0.0, 1 - off / 128.0))), 4)
        state["before"] = image
        reason = rules.reason(None if state["last"] is None else row["t_s"] - state["last"], sharpness, motion, near)
        if reason is None:
            return
        state["chosen"], state["last"] = image, row["t_s"]
        bright, contrast = round(max(0.0, 1 - abs(mean - 128) / 128), 4), round(min(1.0, deviation / 64), 4)
        quality = 0.5 * min(1.0, sharpness / max(3 * rules.blur, 1.0)) + 0.25 * bright + 0.25 * contrast
        score = 0.4 * quality + 0.35 * (1 - near) + 0.25 * motion
        yield row["run_id"], row["frame_id"], row["t_s"], reason, sharpness, bright, contrast, motion, near, score

    return fold_sorted(
        frames.select("run_id", "frame_id", "t_s", "image", "width"), ["run_id"], ["t_s", "frame_id"], start, step,
        "run_id bigint, frame_id bigint, t_s double, reason string, sharpness_score double, brightness_score double, "
        "contrast_score double, motion_score double, similarity_score double, selection_score double",
    )


def selection_report(summary: DataFrame, processing_s: Column, fps: Column) -> DataFrame:
    """selection_summary with the processing speed in frames a second and how many times real time that is."""
    speed = F.when(processing_s > 0, F.col("candidates") / processing_s).otherwise(0.0)
    return summary.withColumns(
        {
            "processing_speed_fps": exact_round(speed, 1),
            "realtime_speedup": exact_round(speed / F.greatest(fps, F.lit(1.0)), 2),
        }
    )


def selection_summary(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """Per run: candidates, selected frames, reduction in per cent and selected frames per second of its span."""
    all_rows = candidates.groupBy("run_id").agg(
        F.count("*").alias("candidates"), (F.max("t_s") - F.min("t_s")).alias("span_s")
    )
    chosen = selected.groupBy("run_id").agg(F.count("*").alias("selected"))
    n = F.coalesce("selected", F.lit(0))
    return all_rows.join(chosen, "run_id", "left").select(
        "run_id", "candidates", n.alias("selected"),
        F.when(F.col("candidates") > 0, 100.0 * (F.col("candidates") - n) / F.col("candidates")).otherwise(0.0).alias("reduction_pct"),
        F.when(F.col("span_s") > 0, n / F.col("span_s")).otherwise(0.0).alias("selected_fps"),
    )
