"""Detections: merging of tiles, non-maximum suppression, pools, class mapping and the detector plug point."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewatch.functions.boxes import Box, clip, mapped_class, shifted, tile_starts
from ridgewatch.functions.exact import exact_round
from ridgewatch.operators.fold import fold_sorted

#: A detector is a function from frames to raw detections; batched inference lives in it.
Detector = Callable[[DataFrame], DataFrame]


def tile_table(frames: DataFrame, width: int, height: int, tile_w: int = 1280, tile_h: int = 960, overlap: float = 0.12) -> DataFrame:
    """Each frame with each of its tiles: tile_no, tile_x, tile_y."""
    cells = [
        F.struct(F.lit(x).alias("tile_x"), F.lit(y).alias("tile_y"))
        for y in tile_starts(height, tile_h, overlap) for x in tile_starts(width, tile_w, overlap)
    ]
    return frames.select("*", F.posexplode(F.array(*cells)).alias("tile_no", "tile")).select("*", "tile.*").drop("tile")


def to_frame(detections: DataFrame, width: int, height: int) -> DataFrame:
    """Tile detections (x1.., tile_x, tile_y, confidence) in frame coordinates, clipped, confidence rounded."""
    box = clip(shifted(Box.of(), F.col("tile_x"), F.col("tile_y")), width, height)
    named = {"x1": box.x1, "y1": box.y1, "x2": box.x2, "y2": box.y2}
    return detections.withColumns(named).withColumn("confidence", exact_round(F.col("confidence"), 3))


def pool(confidence: Column, high: float = 0.40, low: float = 0.15) -> Column:
    """high, low, or null for what neither stage of tracking uses."""
    return F.when(confidence >= high, "high").when(confidence >= low, "low")


def non_maximum_suppression(detections: DataFrame, threshold: float = 0.45, keys: tuple[str, ...] = ("run_id", "frame_id", "class_name")) -> DataFrame:
    """det_no of what stays in each run's frame and class: by falling confidence, unless it overlaps a kept one by more."""
    types = {f.name: f.dataType.simpleString() for f in detections.schema}

    def step(kept: list, row: dict) -> Iterator[tuple]:
        area = max(0.0, row["x2"] - row["x1"]) * max(0.0, row["y2"] - row["y1"])
        for x1, y1, x2, y2, other in kept:
            w, h = min(x2, row["x2"]) - max(x1, row["x1"]), min(y2, row["y2"]) - max(y1, row["y1"])
            if w > 0 and h > 0 and w * h > threshold * (area + other - w * h):
                return
        kept.append((row["x1"], row["y1"], row["x2"], row["y2"], area))
        yield (*(row[k] for k in keys), row["det_no"], row["confidence"])

    schema = ", ".join(f"{k} {types[k]}" for k in (*keys, "det_no", "confidence"))
    columns = [*keys, "det_no", "x1", "y1", "x2", "y2", "confidence"]
    order = [F.desc("confidence"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("det_no")]
    return fold_sorted(detections.select(*columns), list(keys), order, lambda row: [], step, schema)


def detect(frames: DataFrame, detector: Detector, width: int, height: int, confidence: float = 0.25, overlap_iou: float = 0.45) -> DataFrame:
    """A whole detector call: tiles, the detector on each, threshold, merging, classes; human and animal only.

    frames: run_id, frame_id and what the detector needs; det_no must tell a frame's raw detections apart.
    """
    raw = detector(tile_table(frames, width, height)).where(F.col("confidence") >= confidence)
    placed = to_frame(raw, width, height)
    kept = non_maximum_suppression(placed.withColumn("class_key", F.col("class_id")), overlap_iou, ("run_id", "frame_id", "class_key"))
    own = ["run_id", "frame_id", "det_no"]
    merged = placed.join(kept.select(*own), own, "left_semi")
    named = merged.withColumn("mapped", mapped_class(F.col("class_id"), F.col("class_name")))
    named = named.withColumns({"class_name": F.col("mapped.class_name"), "class_id": F.col("mapped.class_id")})
    return named.where(F.col("class_name").isin("human", "animal")).drop("mapped")


def unpacked(tuples: DataFrame) -> DataFrame:
    """Detections given as x1 to y2 with optional conf and cls: confidence 0.5 and human where they're absent."""
    name = F.coalesce("cls", F.lit("human"))
    return tuples.withColumns(
        {
            "confidence": F.coalesce("conf", F.lit(0.5)),
            "class_name": F.when(name.isin("0", "person", "human"), "human").otherwise("animal"),
        }
    ).drop("conf", "cls")


def with_metadata(frames: DataFrame, given: dict[str, object], absent: dict[str, object]) -> DataFrame:
    """Frames with their metadata by precedence: the given argument, else the frame's own column, else the default."""
    own = lambda name: [F.col(name)] if name in frames.columns else []
    value = lambda name: F.coalesce(F.lit(given.get(name)), *own(name), F.lit(absent[name]))
    return frames.withColumns({name: value(name) for name in absent})


def thermal_valid(present: Column, nonzero: Column) -> Column:
    """Whether a frame's thermal image counts: it is there and some pixel isn't zero. Otherwise the sensor dropped out."""
    return F.coalesce(present & (nonzero > 0), F.lit(False))
