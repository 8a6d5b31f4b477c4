"""Multi-object tracking: constant-velocity filters and two-stage optimal assignment, frame after frame.

Frames of a run depend on each other, runs don't; so runs are the unit of parallelism, and a run is streamed. Frames
without detections must be rows too (with a null det_no), for tracks age in them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgewatch.operators.assignment import assign
from ridgewatch.operators.fold import fold_sorted

#: Centres that a track remembers.
HISTORY = 60
MEASUREMENT_NOISE = np.diag([1.0, 1.0, 10.0, 1.0]).astype(np.float32)
STEP_NOISE = np.diag([0.01] * 4 + [0.0001] * 4).astype(np.float32)
START_SPREAD = np.diag([10.0] * 4 + [1000.0] * 4).astype(np.float32)
MOVE = np.eye(8, dtype=np.float32) + np.eye(8, k=4, dtype=np.float32)


def measured(box: tuple[float, ...]) -> np.ndarray:
    """Centre, aspect and height of a box."""
    w, h = max(1.0, box[2] - box[0]), max(1.0, box[3] - box[1])
    return np.array([box[0] + w / 2, box[1] + h / 2, w / h, h], dtype=np.float32)


class MotionFilter:
    """A Kalman filter over centre, aspect and height and their change per frame, in single precision."""

    def __init__(self, box: tuple[float, ...]) -> None:
        self.mean = np.concatenate([measured(box), np.zeros(4, np.float32)])
        self.spread = START_SPREAD.copy()

    def advance(self) -> None:
        if self.mean[6] + self.mean[2] <= 0:
            self.mean[6] = 0
        self.mean = MOVE @ self.mean
        self.spread = MOVE @ self.spread @ MOVE.T + STEP_NOISE

    def correct(self, box: tuple[float, ...]) -> None:
        seen = self.spread[:4, :4] + MEASUREMENT_NOISE
        try:
            gain = np.linalg.solve(seen.T, self.spread[:, :4].T).T
        except np.linalg.LinAlgError:
            gain = self.spread[:, :4] @ np.linalg.pinv(seen)
        self.mean = self.mean + gain @ (measured(box) - self.mean[:4])
        self.spread = self.spread - gain @ self.spread[:4]

    def box(self) -> tuple[float, ...]:
        cx, cy, aspect, h = (float(v) for v in self.mean[:4])
        w = float(self.mean[2] * self.mean[3])
        x1, y1 = float(cx - w / 2), float(cy - h / 2)
        return round(x1, 2), round(y1, 2), round(x1 + w, 2), round(y1 + h, 2)


def giou_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(1 - GIoU) / 2 of every box in a with every box in b, in single precision."""
    a, b = a.astype(np.float32)[:, None], b.astype(np.float32)[None]
    size = np.maximum(0, np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]))
    meet = size[..., 0] * size[..., 1]
    areas = [(x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1]) for x in (a, b)]
    union = areas[0] + areas[1] - meet
    span = np.maximum(a[..., 2:], b[..., 2:]) - np.minimum(a[..., :2], b[..., :2])
    hull = np.maximum(np.float32(1e-6), span[..., 0] * span[..., 1])
    overlap = np.divide(meet, union, out=np.zeros_like(meet), where=union > 0)
    return ((1 - (overlap - (hull - union) / hull)) / 2).astype(np.float32)


@dataclass(frozen=True)
class TrackerSettings:
    """legacy_lost: a lost track's count of lost frames stands still, so it never ends; False counts on."""

    high: float = 0.40
    low: float = 0.15
    cost_high: float = 0.60
    cost_low: float = 0.50
    min_hits: int = 3
    max_lost: int = 30
    still_px: float = 20.0
    legacy_lost: bool = True


@dataclass
class Track:
    track_id: int
    detection: dict
    settings: TrackerSettings
    hits: int = 1
    age: int = 1
    lost_frames: int = 0
    still_frames: int = 1
    status: str = "TENTATIVE"
    confirmed: bool = False
    centres: list[tuple[float, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.box = tuple(self.detection[k] for k in ("x1", "y1", "x2", "y2"))
        self.filter = MotionFilter(self.box)
        self.confidence, self.class_name = self.detection["confidence"], self.detection["class_name"]
        self.thermal = self.detection["thermal_delta"]
        self.centres.append(((self.box[0] + self.box[2]) / 2, (self.box[1] + self.box[3]) / 2))

    def advance(self) -> None:
        self.filter.advance()
        self.box = self.filter.box()
        self.age += 1
        if self.status != "LOST" or not self.settings.legacy_lost:
            self.lost_frames += 1

    def match(self, detection: dict) -> None:
        self.filter.correct(tuple(detection[k] for k in ("x1", "y1", "x2", "y2")))
        self.box = self.filter.box()
        self.confidence, self.class_name = detection["confidence"], detection["class_name"]
        if detection["thermal_delta"] is not None:
            self.thermal = detection["thermal_delta"]
        cx, cy = (self.box[0] + self.box[2]) / 2, (self.box[1] + self.box[3]) / 2
        moved = math.hypot(cx - self.centres[-1][0], cy - self.centres[-1][1])
        self.still_frames = self.still_frames + 1 if moved < self.settings.still_px else max(0, self.still_frames - 1)
        self.centres = [*self.centres, (round(cx, 1), round(cy, 1))][-HISTORY:]
        self.hits, self.lost_frames = self.hits + 1, 0
        if self.hits >= self.settings.min_hits:
            self.status, self.confirmed = "CONFIRMED", True

    @property
    def stationary(self) -> bool:
        return self.still_frames >= 2 or len(self.centres) <= 2


class Tracker:
    """The tracks of one run; update() takes the detections of its next frame."""

    def __init__(self, settings: TrackerSettings = TrackerSettings()) -> None:
        self.settings, self.tracks, self.made = settings, [], 0

    def _match(self, tracks: list[Track], detections: list[dict], most: float) -> tuple[list[Track], list[dict]]:
        """Matches in place; returns what is left of both."""
        if not tracks or not detections:
            return tracks, detections
        costs = giou_costs(
            np.array([t.box for t in tracks]), np.array([[d[k] for k in ("x1", "y1", "x2", "y2")] for d in detections])
        )
        pairs = [(r, c) for r, c in assign(costs) if costs[r, c] <= most]
        for r, c in pairs:
            tracks[r].match(detections[c])
        rows, columns = {r for r, _ in pairs}, {c for _, c in pairs}
        return [t for k, t in enumerate(tracks) if k not in rows], [d for k, d in enumerate(detections) if k not in columns]

    def update(self, detections: list[dict]) -> list[Track]:
        own = self.settings
        for track in self.tracks:
            track.advance()
        high = [d for d in detections if d["confidence"] >= own.high]
        low = [d for d in detections if own.low <= d["confidence"] < own.high]
        left, fresh = self._match(self.tracks, high, own.cost_high)
        left, _ = self._match(left, low, own.cost_low)
        for track in left:
            track.status = "LOST"
        for detection in fresh:
            self.made += 1
            self.tracks.append(Track(self.made, detection, own))
        self.tracks = [t for t in self.tracks if t.lost_frames <= own.max_lost]
        return self.tracks


OUTPUT = (
    "run_id bigint, frame_id bigint, timestamp_ms double, track_id int, class_name string, x1 double, y1 double, "
    "x2 double, y2 double, confidence double, is_confirmed boolean, is_stationary boolean, thermal_delta double, "
    "status string, stationary_frames int, hits int, lost_frames int, age int, "
    "history array<struct<cx:double,cy:double>>"
)
INPUT = (
    "run_id", "frame_id", "timestamp_ms", "det_no", "x1", "y1", "x2", "y2", "confidence", "class_name", "thermal_delta",
)


def rows_of(tracks: list[Track], run_id: int, frame_id: int, timestamp_ms: float, history: bool = True) -> Iterator[tuple]:
    for t in tracks:
        yield (
            run_id, frame_id, timestamp_ms, t.track_id, t.class_name, *t.box, round(t.confidence, 3), t.confirmed,
            t.stationary, t.thermal, t.status, t.still_frames, t.hits, t.lost_frames, t.age,
            centres_of(t) if history else None,
        )


def centres_of(track: Track) -> list[dict]:
    return [{"cx": x, "cy": y} for x, y in track.centres]


def track(detections: DataFrame, settings: TrackerSettings = TrackerSettings(), final_only: bool = False) -> DataFrame:
    """All live tracks after each frame. detections: INPUT's columns; det_no null for a frame without any.

    final_only: each track once, as it was in its last frame, given out when it or its run has ended.
    """

    def flush(state: dict) -> Iterator[tuple]:
        if state["frame"] is None:
            return
        tracker, last = state["tracker"], state["last"]
        if not final_only:
            yield from rows_of(tracker.update(state["waiting"]), *state["frame"])
            return
        before = list(tracker.tracks)
        live = tracker.update(state["waiting"])
        rows = {row[3]: row for row in rows_of(live, *state["frame"], history=False)}
        for ended in before:
            if ended.track_id not in rows:  # its centres are those of its last frame
                yield *last[ended.track_id][:-1], centres_of(ended)
        state["last"] = rows

    def finish(state: dict) -> Iterator[tuple]:
        yield from flush(state)
        if final_only:
            yield from ((*state["last"][t.track_id][:-1], centres_of(t)) for t in state["tracker"].tracks)

    def step(state: dict, row: dict) -> Iterator[tuple]:
        frame = (row["run_id"], row["frame_id"], row["timestamp_ms"])
        if state["frame"] is None or state["frame"][1] != frame[1]:
            yield from flush(state)
            state["frame"], state["waiting"] = frame, []
        if row["det_no"] is not None:
            state["waiting"].append(row)

    def start(row: dict) -> dict:
        return {"tracker": Tracker(settings), "frame": None, "waiting": [], "last": {}}

    return fold_sorted(
        detections.select(*INPUT), ["run_id"], ["timestamp_ms", "frame_id", "det_no"], start, step, OUTPUT, finish
    )


def with_empty_frames(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Every frame (run_id, frame_id, timestamp_ms) with its detections, or one row with nulls."""
    return frames.select("run_id", "frame_id", "timestamp_ms").join(detections.drop("timestamp_ms"), ["run_id", "frame_id"], "left")


def latest(tracks: DataFrame) -> DataFrame:
    """Each track's row in its last frame."""
    best = tracks.groupBy("run_id", "track_id").agg(F.max_by(F.struct("*"), F.struct("timestamp_ms", "frame_id")).alias("t"))
    return best.select("t.*")
