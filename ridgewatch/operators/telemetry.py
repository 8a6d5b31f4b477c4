"""Telemetry: as-of interpolation, message fusion and clock checks.

The as-of join is a union of frames and samples with two windows, cut into slices of time: a slice's rows see the last
sample of the slices before and the first of those after it, which are carried over from one row for each slice. So
a run with a third of all rows is many tasks, and nothing is compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgewatch.functions.exact import exact_round
from ridgewatch.functions.geo import blend_angle

POSE = ("lat", "lon", "altitude_agl", "pitch", "roll", "yaw")
_DIGITS = {"lat": 7, "lon": 7}
SLICE_MS = 6 * 3_600_000.0


def neighbours(frames: DataFrame, samples: DataFrame, slice_ms: float = SLICE_MS) -> DataFrame:
    """frames (run_id, frame_id, q_ms) with prev and next, the samples strictly before and at or after q_ms.

    Samples of equal time keep the order of seq if there is such a column. A run without samples gets nulls.
    """
    seq = F.col("seq") if "seq" in samples.columns else F.lit(0)
    sample = F.struct(F.col("t_ms"), *POSE)
    left = frames.select("run_id", F.col("q_ms").alias("at"), F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("seq"), "frame_id")
    right = samples.select(
        "run_id", F.col("t_ms").alias("at"), F.lit(1).alias("side"), seq.cast("bigint").alias("seq"), sample.alias("sample")
    )
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("slice", F.floor(F.col("at") / slice_ms))
    rank = F.when(F.col("side") == 1, F.struct("at", "seq"))  # frames have no rank and are passed over
    slices = rows.groupBy("run_id", "slice").agg(
        F.min_by("sample", rank).alias("first"), F.max_by("sample", rank).alias("last")
    )
    run = Window.partitionBy("run_id").orderBy("slice")
    carried = slices.select(
        "run_id", "slice",
        F.last("last", True).over(run.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", True).over(run.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    # A frame sorts before samples of its own time: what precedes it is strictly earlier.
    own = Window.partitionBy("run_id", "slice").orderBy("at", "side", "seq")
    near = rows.withColumns(
        {
            "prev": F.last("sample", True).over(own.rowsBetween(Window.unboundedPreceding, -1)),
            "next": F.first("sample", True).over(own.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).where("side = 0")
    return near.join(carried, ["run_id", "slice"], "left").select(
        "run_id", "frame_id", F.col("at").alias("q_ms"),
        F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"),
    )


def interpolated(near: DataFrame, tolerance_ms: float = 100.0) -> DataFrame:
    """The pose of each frame of neighbours(), delta_ms to the nearest sample and is_synced.

    Before the first and after the last sample the end sample holds, as it is. Across gaps of more than five
    tolerances the nearer one holds. Else positions are linear and yaw takes the shorter arc, rounded.
    """
    q, prev, after = F.col("q_ms"), F.col("prev"), F.col("next")
    gap = after["t_ms"] - prev["t_ms"]
    to_prev, to_next = F.abs(q - prev["t_ms"]), F.abs(q - after["t_ms"])
    delta = F.when(prev.isNull() & after.isNull(), float("inf")).when(prev.isNull(), to_next)
    delta = delta.when(after.isNull(), to_prev).otherwise(F.least(to_prev, to_next))
    blends = prev.isNotNull() & after.isNotNull() & (gap <= 5 * tolerance_ms)
    alpha = F.when(gap > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (q - prev["t_ms"]) / gap))).otherwise(0.0)
    held = F.when(prev.isNull(), after).when(after.isNull(), prev).when(to_prev <= to_next, prev).otherwise(after)

    def value(name: str) -> Column:
        a, b = prev[name], after[name]
        mixed = blend_angle(a, b, alpha) if name == "yaw" else a + alpha * (b - a)
        return F.when(blends, exact_round(mixed, _DIGITS.get(name, 2))).otherwise(F.coalesce(held[name], F.lit(0.0)))

    return near.select(
        "run_id", "frame_id", "q_ms", *[value(name).alias(name) for name in POSE],
        F.when(blends, exact_round(delta, 2)).otherwise(delta).alias("delta_ms"),
        (delta <= tolerance_ms).alias("is_synced"),
    )


def synchronise(
    frames: DataFrame, samples: DataFrame, tolerance_ms: float = 100.0, offset_ms: float = 0.0,
    drop_unsynced: bool = False, slice_ms: float = SLICE_MS,
) -> DataFrame:
    """Frames (run_id, frame_id, pts_ms) with their pose; they are looked up offset_ms later and keep their own time."""
    asked = frames.withColumn("q_ms", F.col("pts_ms") + offset_ms)
    out = interpolated(neighbours(asked, samples, slice_ms), tolerance_ms)
    out = out.withColumn("timestamp_ms", exact_round(F.col("q_ms") - offset_ms, 2)).drop("q_ms")
    return out.where("is_synced") if drop_unsynced else out


def keep_latest(samples: DataFrame, most: int = 100_000) -> DataFrame:
    """The latest samples of each run: what a live buffer of that size holds."""
    own = Window.partitionBy("run_id").orderBy(F.desc("t_ms"))
    return samples.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= most).drop("_n")


def fuse_messages(messages: DataFrame, gap_ms: float = 100.0, every_message: bool = False) -> DataFrame:
    """Samples from position and attitude messages (run_id, msg_id, t_ms, msg_type and their raw fields).

    At each position or attitude message whose latest counterpart is at most gap_ms away: their fields, scaled, at
    their mean time. every_message emits at messages of other types too.
    """
    is_position, is_attitude = (F.col("msg_type") == k for k in ("GLOBAL_POSITION_INT", "ATTITUDE"))
    own = Window.partitionBy("run_id").orderBy("t_ms", "msg_id").rowsBetween(Window.unboundedPreceding, 0)
    position = F.struct("t_ms", "lat_e7", "lon_e7", "alt_mm")
    attitude = F.struct("t_ms", "roll_rad", "pitch_rad", "yaw_rad")
    latest = messages.select(
        "run_id", "msg_id", "msg_type",
        F.last(F.when(is_position, position), True).over(own).alias("p"),
        F.last(F.when(is_attitude, attitude), True).over(own).alias("a"),
    )
    met = latest.where(F.abs(F.col("p.t_ms") - F.col("a.t_ms")) <= gap_ms)
    met = met if every_message else met.where(is_position | is_attitude)
    zero = F.lit(0.0)
    return met.select(
        "run_id", "msg_id", ((F.col("p.t_ms") + F.col("a.t_ms")) / 2).alias("t_ms"),
        F.coalesce(F.col("p.lat_e7") / 1e7, zero).alias("lat"), F.coalesce(F.col("p.lon_e7") / 1e7, zero).alias("lon"),
        F.coalesce(F.col("p.alt_mm") / 1000.0, zero).alias("altitude_agl"),
        F.degrees(F.coalesce("a.pitch_rad", zero)).alias("pitch"), F.degrees(F.coalesce("a.roll_rad", zero)).alias("roll"),
        F.pmod(F.degrees(F.coalesce("a.yaw_rad", zero)), F.lit(360.0)).alias("yaw"),
    )


def interval_statistics(frames: DataFrame) -> DataFrame:
    """Per run: mean and population deviation of the intervals between frames, and whether time always advances."""
    own = Window.partitionBy("run_id").orderBy("frame_id")
    steps = frames.withColumn("step", F.col("pts_ms") - F.lag("pts_ms").over(own))
    return steps.groupBy("run_id").agg(
        F.avg("step").alias("mean_ms"), F.stddev_pop("step").alias("std_ms"),
        F.bool_and(F.coalesce(F.col("step") > 0, F.lit(True))).alias("monotonic"), F.count("*").alias("frames"),
    )
