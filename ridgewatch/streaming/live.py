"""Structured Streaming variants: live synchronisation, message fusion, tracking, clustering and selection.

The stateful ones keep, for each key, the same state object as the batch fold and feed it rows in event order. Rows
of one micro-batch are sorted; an event is held back until the watermark has passed it, so late rows up to the delay
still take their place and a replayed stream equals the batch result. State is pickled bytes for each key.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ridgewatch.operators import entities, selection, telemetry, tracking


def ordered_fold(
    stream: DataFrame,
    keys: list[str],
    event_time: str,
    order: list[str],
    start: Callable[[dict], Any],
    step: Callable[[Any, dict], Iterable[tuple]],
    schema: str,
    delay: str = "0 seconds",
    finish: Callable[[Any], Iterable[tuple]] | None = None,
    close_after: str | None = None,
) -> DataFrame:
    """fold_sorted over a stream: each key's rows in order of event_time (a timestamp) and order.

    Rows wait in state until the watermark passes them. A key whose rows have all been folded is closed, with finish,
    when the watermark is close_after (milliseconds) beyond its last row; without close_after it stays open.
    """
    names = [part.split()[0] for part in _top_level(schema)]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {"fold": None, "begun": False, "waiting": []}
        out: list[tuple] = []
        for frame in frames:
            frame = frame.astype(object).where(frame.notna(), None)
            held["waiting"] += frame.to_dict("records")
        mark = state.getCurrentWatermarkMs()
        at = lambda row: pd.Timestamp(row[event_time]).value // 1_000_000
        held["waiting"].sort(key=lambda row: (row[event_time], *(row[c] for c in order)))
        ready = [row for row in held["waiting"] if at(row) <= mark]
        held["waiting"] = held["waiting"][len(ready) :]
        for row in ready:
            if not held["begun"]:
                held["fold"], held["begun"] = start(row), True
            out.extend(step(held["fold"], row))
            held["last"] = at(row)
        idle = held["begun"] and not held["waiting"] and state.hasTimedOut
        if idle and close_after is not None:
            if finish is not None:
                out.extend(finish(held["fold"]))
            state.remove()
        else:
            state.update((pickle.dumps(held),))
            wait = at(held["waiting"][0]) if held["waiting"] else held.get("last", mark) + int(close_after or 0)
            if held["waiting"] or close_after is not None:
                state.setTimeoutTimestamp(max(wait, mark + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    marked = stream.withWatermark(event_time, delay)
    return marked.groupBy(*keys).applyInPandasWithState(
        run, StructType.fromDDL(schema), StructType.fromDDL("state binary"), "append", GroupStateTimeout.EventTimeTimeout
    )


def _top_level(schema: str) -> list[str]:
    """The fields of a DDL schema, without those nested in them."""
    out, depth, begin = [], 0, 0
    for place, letter in enumerate(schema):
        depth += (letter == "<") - (letter == ">")
        if letter == "," and not depth:
            out.append(schema[begin:place].strip())
            begin = place + 1
    return [*out, schema[begin:].strip()]


def live_selection(stream: DataFrame, rules: selection.SelectionRules, delay: str = "0 seconds") -> DataFrame:
    """Selected frames of a stream (run_id, frame_id, ts, t_s, sharpness, motion_score, similarity_score)."""

    def step(last: list, row: dict) -> Iterator[tuple]:
        since = None if last[0] is None else row["t_s"] - last[0]
        reason = rules.reason(since, row["sharpness"], row["motion_score"], row["similarity_score"])
        if reason is not None:
            last[0] = row["t_s"]
            yield row["run_id"], row["frame_id"], row["t_s"], reason

    return ordered_fold(
        stream, ["run_id"], "ts", ["frame_id"], lambda row: [None], step,
        "run_id bigint, frame_id bigint, t_s double, reason string", delay,
    )


def live_tracks(stream: DataFrame, settings: tracking.TrackerSettings, delay: str = "0 seconds") -> DataFrame:
    """Tracks of a stream of frames: run_id, frame_id, ts, timestamp_ms and detections, an array of their structs."""

    def step(tracker: tracking.Tracker, row: dict) -> Iterator[tuple]:
        found = [d.asDict() if hasattr(d, "asDict") else dict(d) for d in (row["detections"] if row["detections"] is not None else [])]
        yield from tracking.rows_of(tracker.update(found), row["run_id"], row["frame_id"], row["timestamp_ms"])

    return ordered_fold(
        stream, ["run_id"], "ts", ["frame_id"], lambda row: tracking.Tracker(settings), step, tracking.OUTPUT, delay
    )


def live_entities(stream: DataFrame, radius_m: float = 8.0, still_m: float = 3.0, delay: str = "0 seconds", close_after_ms: int = 60_000) -> DataFrame:
    """Entities of a stream of sightings (entities.SIGHTING and ts), given out when their run and class have ended."""

    def step(state: entities.Clustering, row: dict) -> tuple:
        state.see(row)
        return ()

    return ordered_fold(
        stream, ["run_id", "class_name"], "ts", ["track_id"], lambda row: entities.Clustering(radius_m, still_m), step,
        entities.ENTITY, delay, lambda state: state.rows(), str(close_after_ms),
    )


def pose_between(before: dict | None, after: dict | None, at: float, tolerance_ms: float) -> tuple[dict, float]:
    """telemetry.interpolated for one frame: the pose and delta_ms. before is earlier, after at or later than at."""
    none = dict.fromkeys(telemetry.POSE, 0.0)
    if before is None or after is None:
        held = after if before is None else before
        return (none, math.inf) if held is None else ({k: held[k] or 0.0 for k in telemetry.POSE}, abs(at - held["t_ms"]))
    gap, to_before, to_after = after["t_ms"] - before["t_ms"], abs(at - before["t_ms"]), abs(at - after["t_ms"])
    if gap > 5 * tolerance_ms:
        held = before if to_before <= to_after else after
        return {k: held[k] or 0.0 for k in telemetry.POSE}, min(to_before, to_after)
    share = max(0.0, min(1.0, (at - before["t_ms"]) / gap)) if gap > 0 else 0.0
    out = {}
    for k in telemetry.POSE:
        step = after[k] - before[k]
        if k == "yaw":
            step = (step + 180.0) % 360.0 - 180.0
        mixed = before[k] + share * step
        out[k] = round(mixed % 360.0 if k == "yaw" else mixed, 7 if k in ("lat", "lon") else 2)
    return out, round(min(to_before, to_after), 2)


def live_pose(stream: DataFrame, tolerance_ms: float = 100.0, delay: str = "0 seconds", close_after_ms: int = 60_000) -> DataFrame:
    """synchronise() over one stream of both: run_id, ts, side (0 frame, 1 sample), t_ms, frame_id (null for samples) and
    telemetry.POSE. A frame is given out when the next sample has come, or the run has ended.

    State: the last sample and the frames since.
    """

    def given(state: dict, after: dict | None) -> Iterator[tuple]:
        for run_id, frame_id, at in state["frames"]:
            pose, delta = pose_between(state["sample"], after, at, tolerance_ms)
            yield run_id, frame_id, *pose.values(), delta, delta <= tolerance_ms
        state["frames"] = []

    def step(state: dict, row: dict) -> Iterator[tuple]:
        if row["side"] == 0:
            state["frames"].append((row["run_id"], int(row["frame_id"]), row["t_ms"]))
            return
        yield from given(state, row)
        state["sample"] = {k: row[k] for k in ("t_ms", *telemetry.POSE)}

    pose = ", ".join(f"{k} double" for k in telemetry.POSE)
    return ordered_fold(
        stream, ["run_id"], "ts", ["side"], lambda row: {"sample": None, "frames": []}, step,
        f"run_id bigint, frame_id bigint, {pose}, delta_ms double, is_synced boolean", delay,
        lambda state: given(state, None), str(close_after_ms),
    )


def live_fusion(stream: DataFrame, gap_ms: float = 100.0, delay: str = "0 seconds", every_message: bool = False) -> DataFrame:
    """fuse_messages() over a stream: run_id, ts, msg_id, t_ms, msg_type and the raw fields. State: the two last messages."""
    kinds = ("GLOBAL_POSITION_INT", "ATTITUDE")

    def step(state: dict, row: dict) -> Iterator[tuple]:
        if row["msg_type"] in kinds:
            state[row["msg_type"]] = row
        elif not every_message:
            return
        p, a = (state.get(kind) for kind in kinds)
        if p and a and abs(p["t_ms"] - a["t_ms"]) <= gap_ms:
            number = lambda r, k: r[k] or 0.0
            yield (
                row["run_id"], row["msg_id"], (p["t_ms"] + a["t_ms"]) / 2, number(p, "lat_e7") / 1e7,
                number(p, "lon_e7") / 1e7, number(p, "alt_mm") / 1000.0, math.degrees(number(a, "pitch_rad")),
                math.degrees(number(a, "roll_rad")), math.degrees(number(a, "yaw_rad")) % 360.0,
            )

    return ordered_fold(
        stream, ["run_id"], "ts", ["msg_id"], lambda row: {}, step,
        "run_id bigint, msg_id bigint, t_ms double, lat double, lon double, altitude_agl double, pitch double, "
        "roll double, yaw double", delay,
    )


def detection_rates(stream: DataFrame, width: str = "1 minute", delay: str = "10 seconds") -> DataFrame:
    """Detections by class in tumbling windows of event time: a rate metric for the live view."""
    return (
        stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "class_name")
        .agg(F.count("*").alias("detections"), F.avg("confidence").alias("mean_confidence"))
    )
