"""The query catalogue: every domain query over the views, and its SQL twin where SQL can express it.

Twins are written for DuckDB over the same view text. Where a rule rounds, both sides round the exact binary value
through decimal text; other floating results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgewatch.functions import boxes, geo, scoring
from ridgewatch.functions.boxes import Box
from ridgewatch.functions.exact import exact_round
from ridgewatch.operators import detections, entities, evaluation, selection, telemetry, tracking, triage
from ridgewatch.plans import mission
from ridgewatch.plans.views import duck_cte, view
from ridgewatch.session import table
from ridgewatch.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Hours lie between a run's events here, so tolerances are minutes and selection gaps hours.
TOLERANCE_MS = 1_800_000.0
#: These flights' boxes jump about, so tracks must end.
FLIGHT_TRACKER = tracking.TrackerSettings(high=0.35, legacy_lost=False, max_lost=5)
RULES = selection.SelectionRules(min_gap=3600.0, max_gap=86400.0, blur=100.0)


def query(oracle: str | None = None, *views: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = (f"with {duck_cte(*views)} " if views else "") + oracle
        return fn

    return register


def r6(x: Column) -> Column:
    return F.round(x, 6)


def _ex(sql: str, digits: int) -> str:
    """SQL that rounds as exact_round does."""
    return f"cast(format('{{:.{digits}f}}', {sql}) as double)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "frames_v").select("run_id", "frame_id", (F.col("t_us") / 1000.0).alias("pts_ms"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "telemetry_v").select("run_id", (F.col("t_us") / 1000.0).alias("t_ms"), *telemetry.POSE)


def _synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.synchronise(_frames(spark, sf_dir), _samples(spark, sf_dir), TOLERANCE_MS)


# Telemetry -----------------------------------------------------------------------------------------------------------

_PREV = """select f.run_id, f.frame_id, s.t_us / 1000.0 as prev_ms, s.lat as prev_lat, s.lon as prev_lon,
    s.altitude_agl as prev_altitude_agl, s.pitch as prev_pitch, s.roll as prev_roll, s.yaw as prev_yaw
  from frames_v f asof left join telemetry_v s on f.run_id = s.run_id and f.t_us > s.t_us"""


@query(_PREV, "frames_v", "telemetry_v")
def telemetry_asof_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = telemetry.neighbours(_frames(spark, sf_dir).withColumnRenamed("pts_ms", "q_ms"), _samples(spark, sf_dir))
    return near.select("run_id", "frame_id", F.col("prev.t_ms").alias("prev_ms"), *[F.col(f"prev.{c}").alias(f"prev_{c}") for c in telemetry.POSE])


_NEAR = """prev as (select f.run_id, f.frame_id, f.t_us / 1000.0 as q, s.t_us / 1000.0 as pt, s.lat as plat, s.lon as plon,
    s.altitude_agl as palt, s.pitch as ppit, s.roll as prol, s.yaw as pyaw
  from frames_v f asof left join telemetry_v s on f.run_id = s.run_id and f.t_us > s.t_us),
near as (select p.*, s.t_us / 1000.0 as nt, s.lat as nlat, s.lon as nlon, s.altitude_agl as nalt, s.pitch as npit,
    s.roll as nrol, s.yaw as nyaw
  from (select p.*, f.t_us from prev p join frames_v f using (run_id, frame_id)) p
  asof left join telemetry_v s on p.run_id = s.run_id and p.t_us <= s.t_us),
calc as (select *, nt - pt as gap, abs(q - pt) as dp, abs(q - nt) as dn,
    pt is not null and nt is not null and nt - pt <= 5 * {tol} as mixes,
    case when nt - pt > 0 then greatest(0.0, least(1.0, (q - pt) / (nt - pt))) else 0.0 end as al,
    case when pt is null then true when nt is null then false when abs(q - pt) <= abs(q - nt) then false else true end as usen,
    case when pt is null and nt is null then 'infinity'::double when pt is null then abs(q - nt)
      when nt is null then abs(q - pt) else least(abs(q - pt), abs(q - nt)) end as delta
  from near)""".replace("{tol}", f"{TOLERANCE_MS:.1f}")


def _pose_sql(short: str, digits: int) -> str:
    mixed = f"p{short} + al * (n{short} - p{short})"
    if short == "yaw":
        turn = "(((((nyaw - pyaw + 180.0) % 360.0) + 360.0) % 360.0) - 180.0)"
        mixed = f"(((pyaw + al * {turn}) % 360.0) + 360.0) % 360.0"
    return f"case when mixes then {_ex(mixed, digits)} else coalesce(case when usen then n{short} else p{short} end, 0.0) end"


_POSES = (("lat", "lat", 7), ("lon", "lon", 7), ("altitude_agl", "alt", 2), ("pitch", "pit", 2), ("roll", "rol", 2), ("yaw", "yaw", 2))
_POSE_LIST = ", ".join(f"{_pose_sql(short, digits)} as {name}" for name, short, digits in _POSES)
_DELTA = f"case when mixes then {_ex('delta', 2)} else delta end"


@query(f", {_NEAR} select run_id, frame_id, {_POSE_LIST} from calc", "frames_v", "telemetry_v")
def telemetry_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir).select("run_id", "frame_id", *telemetry.POSE)


@query(
    f", {_NEAR} select run_id, frame_id, {_DELTA} as delta_ms, delta <= {TOLERANCE_MS:.1f} as is_synced from calc",
    "frames_v", "telemetry_v",
)
def telemetry_sync_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir).select("run_id", "frame_id", "delta_ms", "is_synced")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "mavlink_v").withColumn("t_ms", F.col("t_us") / 1000.0)


@query(
    f""", m as (select *, t_us / 1000.0 as t_ms from mavlink_v),
    l as (select run_id, msg_id,
        last_value(case when msg_type = 'GLOBAL_POSITION_INT' then t_ms end ignore nulls) over w as pt,
        last_value(case when msg_type = 'ATTITUDE' then t_ms end ignore nulls) over w as at_,
        last_value(lat_e7 ignore nulls) over w as la, last_value(lon_e7 ignore nulls) over w as lo,
        last_value(alt_mm ignore nulls) over w as al, last_value(pitch_rad ignore nulls) over w as pi_,
        last_value(roll_rad ignore nulls) over w as ro, last_value(yaw_rad ignore nulls) over w as ya
      from m window w as (partition by run_id order by t_ms, msg_id rows between unbounded preceding and current row))
    select run_id, msg_id, (pt + at_) / 2 as t_ms, la / 1e7 as lat, lo / 1e7 as lon, al / 1000.0 as altitude_agl,
      round(degrees(pi_), 6) as pitch, round(degrees(ro), 6) as roll, round(((degrees(ya) % 360.0) + 360.0) % 360.0, 6) as yaw
    from l where abs(pt - at_) <= {TOLERANCE_MS:.1f}""",
    "mavlink_v",
)
def mavlink_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = telemetry.fuse_messages(_messages(spark, sf_dir), TOLERANCE_MS)
    return fused.select("run_id", "msg_id", "t_ms", "lat", "lon", "altitude_agl", *[r6(F.col(c)).alias(c) for c in ("pitch", "roll", "yaw")])


@query(
    """, s as (select run_id, frame_id, t_us / 1000.0 - lag(t_us / 1000.0) over (partition by run_id order by frame_id) as step
      from frames_v)
    select run_id, round(avg(step), 3) as mean_ms, round(stddev_pop(step), 3) as std_ms,
      bool_and(coalesce(step > 0, true)) as monotonic, count(*) as frames from s group by run_id""",
    "frames_v",
)
def pts_interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = telemetry.interval_statistics(_frames(spark, sf_dir))
    return stats.withColumns({c: F.round(c, 3) for c in ("mean_ms", "std_ms")})


@query(
    """select run_id, frame_id, t_us from (select *, row_number() over (partition by run_id order by t_us desc) as n
    from frames_v) where n <= 10""", "frames_v",
)
def telemetry_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a live buffer of ten samples holds."""
    rows = view(spark, sf_dir, "frames_v").withColumn("t_ms", F.col("t_us") / 1000.0)
    return telemetry.keep_latest(rows, 10).select("run_id", "frame_id", "t_us")


# Frames --------------------------------------------------------------------------------------------------------------


@query("select run_id, frame_id from frame_metrics_v where frame_id % 2 = 0", "frame_metrics_v")
def frame_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "frame_metrics_v").withColumn("frame_idx", F.col("frame_id"))
    return selection.stride(frames, 2).select("run_id", "frame_id")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "frame_metrics_v").withColumn("t_s", F.col("t_us") / 1e6)


_SELECT = """, o as (select run_id, frame_id, t_us / 1e6 as t_s, sharpness, motion_score as mo, similarity_score as si,
    row_number() over (partition by run_id order by t_us, frame_id) as n from frame_metrics_v),
  walk as (select run_id, frame_id, n, t_s, t_s as last_s, 'initial_video_anchor' as reason from o where n = 1
    union all
    select run_id, frame_id, n, t_s, case when reason is not null then t_s else last_s end, reason from (
      select o.run_id, o.frame_id, o.n, o.t_s, w.last_s,
        case when o.t_s - w.last_s < {min_gap} or o.sharpness < {blur} then null
          when o.mo >= {motion} and o.si < {similarity} then 'significant_motion_and_scene_change'
          when o.si < {similarity} then 'novel_scene_content'
          when o.t_s - w.last_s >= {max_gap} then 'periodic_coverage_keepalive' end as reason
      from walk w join o on o.run_id = w.run_id and o.n = w.n + 1))
  """
for _name in ("min_gap", "max_gap", "blur", "similarity", "motion"):
    _SELECT = _SELECT.replace(f"{{{_name}}}", repr(getattr(RULES, _name)))


def _recursive(sql: str) -> str:
    return f"with recursive {duck_cte('frame_metrics_v')} {_SELECT} {sql}"


@query()
def frame_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_frames(_candidates(spark, sf_dir), RULES).select("run_id", "frame_id", "reason")


@query()
def frame_selection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_selection(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("frames"))


@query()
def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    out = selection.selection_summary(rows, selection.select_frames(rows, RULES))
    return out.select("run_id", "candidates", "selected", F.round("reduction_pct", 4).alias("reduction_pct"))


ORACLES["frame_selection"] = _recursive("select run_id, frame_id, reason from walk where reason is not null")
ORACLES["frame_selection_reasons"] = _recursive("select reason, count(*) as frames from walk where reason is not null group by reason")
ORACLES["selection_summary"] = _recursive(
    "select run_id, count(*) as candidates, count(reason) as selected, round(100.0 * (count(*) - count(reason)) / count(*), 4) as reduction_pct from walk group by run_id"
)

_BRIGHT, _CONTRAST = _ex("greatest(0.0, 1 - abs(brightness - 128.0) / 128.0)", 4), _ex("least(1.0, contrast / 64.0)", 4)


@query(
    f""", q as (select run_id, frame_id, motion_score as mo, similarity_score as si,
      0.5 * least(1.0, sharpness / 300.0) + 0.25 * {_BRIGHT} + 0.25 * {_CONTRAST} as quality from frame_metrics_v)
    select run_id, frame_id, round(quality, 6) as quality_score,
      round(0.4 * quality + 0.35 * (1 - si) + 0.25 * mo, 6) as selection_score from q""",
    "frame_metrics_v",
)
def frame_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "frame_metrics_v")
    quality = scoring.quality_score(
        F.col("sharpness"), scoring.brightness_score(F.col("brightness")), scoring.contrast_score(F.col("contrast"))
    )
    total = scoring.selection_score(quality, F.col("similarity_score"), F.col("motion_score"))
    return rows.select("run_id", "frame_id", r6(quality).alias("quality_score"), r6(total).alias("selection_score"))


# Geodesy -------------------------------------------------------------------------------------------------------------

_HAV = """2 * 6371000.0 * atan2(sqrt(h), sqrt(greatest(0.0, 1 - h)))"""
_H = """pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "sightings_v")
    own = F.col("run_id"), F.col("t_us"), F.col("track_id")
    from pyspark.sql import Window

    before = Window.partitionBy("run_id").orderBy(*own[1:])
    return rows.withColumns({"lat0": F.lag("lat").over(before), "lon0": F.lag("lon").over(before)}).where("lat0 is not null")


_PAIRS = """, p as (select *, lag(lat) over w as lat0, lag(lon) over w as lon0 from sightings_v
  window w as (partition by run_id order by t_us, track_id)), q as (select * from p where lat0 is not null)"""


@query(
    f"{_PAIRS}, k as (select *, {_H.format(a='lat0', b='lat', c='lon0', d='lon')} as h from q) "
    f"select run_id, track_id, round({_HAV}, 4) as distance_m from k",
    "sightings_v",
)
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return _pairs(spark, sf_dir).select("run_id", "track_id", F.round(d, 4).alias("distance_m"))


_A, _E2 = repr(geo.WGS84_A), repr(geo.WGS84_E2)


def _radii_sql(phi: str) -> tuple[str, str]:
    w2 = f"(1 - {_E2} * pow(sin({phi}), 2))"
    return f"({_A} * (1 - {_E2}) / pow({w2}, 1.5))", f"({_A} / sqrt({w2}))"


_M, _N = _radii_sql("mid")


@query(
    f"{_PAIRS}, k as (select *, (radians(lat0) + radians(lat)) / 2 as mid from q) select run_id, track_id, "
    f"round(sqrt(pow({_M} * (radians(lat) - radians(lat0)), 2) + pow({_N} * cos(mid) * (radians(lon) - radians(lon0)), 2)), 4) as distance_m from k",
    "sightings_v",
)
def wgs84_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.local_distance_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return _pairs(spark, sf_dir).select("run_id", "track_id", F.round(d, 4).alias("distance_m"))


_MP, _NP = _radii_sql("radians(lat)")


@query(
    f"select run_id, track_id, {_ex(f'lat + degrees((track_id % 200 - 100.0) / {_MP})', 7)} as lat_out, "
    f"{_ex(f'lon + degrees((track_id % 300 - 150.0) / ({_NP} * cos(radians(lat))))', 7)} as lon_out from sightings_v",
    "sightings_v",
)
def ned_to_wgs84(spark: SparkSession, sf_dir: str) -> DataFrame:
    north, east = F.col("track_id") % 200 - 100.0, F.col("track_id") % 300 - 150.0
    lat, lon = geo.offset_to_wgs84(F.col("lat"), F.col("lon"), north, east)
    return view(spark, sf_dir, "sightings_v").select("run_id", "track_id", lat.alias("lat_out"), lon.alias("lon_out"))


_TRIG = """, a as (select *, sin(radians(yaw)) sy, cos(radians(yaw)) cy, sin(radians(pitch)) sp, cos(radians(pitch)) cp,
  sin(radians(roll)) sr, cos(radians(roll)) cr from telemetry_v),
  m as (select *, cy * sp * sr - sy * cr r00, cy * sp * cr + sy * sr r01, cy * cp r02,
    sy * sp * sr + cy * cr r10, sy * sp * cr - cy * sr r11, sy * cp r12, cp * sr r20, cp * cr r21, -sp r22 from a)"""


@query(
    f"{_TRIG} select run_id, t_us, " + ", ".join(f"round(r{i}{j}, 6) + 0.0 as r{i}{j}" for i in range(3) for j in range(3)) + " from m",
    "telemetry_v",
)
def rotation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geo.camera_to_ned(F.col("yaw"), F.col("pitch"), F.col("roll"))
    cells = [(r6(c) + 0.0).alias(f"r{i}{j}") for i, row in enumerate(rows) for j, c in enumerate(row)]
    return view(spark, sf_dir, "telemetry_v").select("run_id", "t_us", *cells)


_FOCAL = repr(geo.Camera().focal)


@query(
    f"""{_TRIG}, ray as (select *, ((t_us // 1000 % 3840) - 1920.0) / {_FOCAL} x, ((t_us // 3000 % 2160) - 1080.0) / {_FOCAL} y from m),
    v as (select *, r00 * x + r01 * y + r02 vn, r10 * x + r11 * y + r12 ve, r20 * x + r21 * y + r22 vd, greatest(1.0, altitude_agl) ht from ray),
    d as (select *, ht / greatest(vd, 1e-6) sc from v),
    g as (select *, sqrt(pow(sc * vn, 2) + pow(sc * ve, 2)) dist from d)
    select run_id, t_us, {_ex(f'lat + degrees(sc * vn / {_MP})', 7)} as latitude,
      {_ex(f'lon + degrees(sc * ve / ({_NP} * cos(radians(lat))))', 7)} as longitude,
      {_ex('altitude_agl * tan(radians(1.0)) + 1.5 + 0.5 * tan(radians(degrees(atan2(dist, ht))))', 2)} as error_radius_m,
      {_ex('dist', 2)} as ground_distance_m, vd > 1e-6 as below_horizon from g""",
    "telemetry_v",
)
def raycast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels cast to the ground, all rows."""
    rows = view(spark, sf_dir, "telemetry_v")
    us = F.col("t_us")
    u, v = F.expr("t_us div 1000 % 3840") * 1.0, F.expr("t_us div 3000 % 2160") * 1.0
    pose = [F.col(c) for c in ("lat", "lon", "altitude_agl", "pitch", "roll", "yaw")]
    spot = geo.cast_pixel(u, v, *pose)
    return rows.select("run_id", us, spot.alias("s")).select("run_id", "t_us", "s.*")


@query(
    "select run_id, t_us, " + _ex("altitude_agl * tan(radians(1.0)) + 1.5 + 0.5 * tan(radians(abs(roll)))", 2) + " as error_radius_m from telemetry_v",
    "telemetry_v",
)
def error_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "telemetry_v")
    return rows.select("run_id", "t_us", geo.ErrorModel().radius(F.col("altitude_agl"), F.col("roll")).alias("error_radius_m"))


@query(
    """select run_id, t_us, round((((yaw + 0.3 * (((((pitch * 7 - yaw + 180.0) % 360.0) + 360.0) % 360.0) - 180.0)) % 360.0) + 360.0) % 360.0, 6) as angle
    from telemetry_v""", "telemetry_v",
)
def angle_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = geo.blend_angle(F.col("yaw"), F.col("pitch") * 7, F.lit(0.3))
    return view(spark, sf_dir, "telemetry_v").select("run_id", "t_us", r6(angle).alias("angle"))


# Boxes and detections ------------------------------------------------------------------------------------------------


@query(
    """select x as x1, y as y1, least(x + 1280, 3840) as x2, least(y + 960, 2160) as y2
    from (select unnest([0, 1126, 2252, 2560]) as x), (select unnest([0, 844, 1200]) as y)"""
)
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = boxes.tiles(3840, 2160, 1280, 960, 0.12)
    return spark.range(1).select(F.explode(grid).alias("t")).select("t.*")


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "detections_v")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections numbered within their frame by every column that tells them apart."""
    from pyspark.sql import Window

    own = Window.partitionBy("run_id", "frame_id").orderBy("det_no", "part_no", "supp_no", "x1", "y1", "x2", "y2")
    return _detections(spark, sf_dir).withColumn("pred_no", F.row_number().over(own))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("run_id", "frame_id").orderBy("gt_no", "gt_part", "gt_supp", "gx1", "gy1", "gx2", "gy2")
    return view(spark, sf_dir, "ground_truth_v").withColumn("gt_no", F.row_number().over(own))


_NUMBERED = """, p as (select *, row_number() over (partition by run_id, frame_id order by det_no, part_no, supp_no, x1, y1, x2, y2) as pred_no from detections_v),
  g as (select * exclude (gt_no), row_number() over (partition by run_id, frame_id order by gt_no, gt_part, gt_supp, gx1, gy1, gx2, gy2) as gt_no from ground_truth_v),
  o as (select run_id, frame_id, pred_no, gt_no, x1, y1, x2, y2, gx1, gy1, gx2, gy2,
    greatest(0.0, least(x2, gx2) - greatest(x1, gx1)) * greatest(0.0, least(y2, gy2) - greatest(y1, gy1)) as meet,
    (x2 - x1) * (y2 - y1) + (gx2 - gx1) * (gy2 - gy1) as areas,
    (greatest(x2, gx2) - least(x1, gx1)) * (greatest(y2, gy2) - least(y1, gy1)) as hull from p join g using (run_id, frame_id))"""
_BOTH = ("detections_v", "ground_truth_v")


@query(f"{_NUMBERED} select run_id, frame_id, pred_no, gt_no, round(meet / (areas - meet), 6) as iou from o where meet > 0", *_BOTH)
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.overlaps(_predictions(spark, sf_dir), _truth(spark, sf_dir)).withColumn("iou", r6(F.col("iou")))


_COST = "(1 - (meet / (areas - meet) - (hull - (areas - meet)) / hull)) / 2"


@query(f"{_NUMBERED} select run_id, frame_id, pred_no, gt_no, round({_COST}, 6) as cost from o", *_BOTH)
def giou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = _predictions(spark, sf_dir).join(_truth(spark, sf_dir), ["run_id", "frame_id"])
    other = Box(*(F.col(f"g{c}") for c in ("x1", "y1", "x2", "y2")))
    return met.select("run_id", "frame_id", "pred_no", "gt_no", r6(boxes.giou_cost(Box.of(), other)).alias("cost"))


@query(f"{_NUMBERED} select run_id, frame_id, pred_no, round(min({_COST}), 6) as best_cost, count_if({_COST} <= 0.6) as within from o group by all", *_BOTH)
def assignment_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = _predictions(spark, sf_dir).join(_truth(spark, sf_dir), ["run_id", "frame_id"])
    other = Box(*(F.col(f"g{c}") for c in ("x1", "y1", "x2", "y2")))
    cost = met.select("run_id", "frame_id", "pred_no", boxes.giou_cost(Box.of(), other).alias("cost"))
    return cost.groupBy("run_id", "frame_id", "pred_no").agg(r6(F.min("cost")).alias("best_cost"), F.count_if(F.col("cost") <= 0.6).alias("within"))


@query(
    """select run_id, frame_id, det_no, part_no, least(greatest(x1 - 100.0, 0.0), 3000.0) as x1, least(greatest(y1 - 100.0, 0.0), 1800.0) as y1,
    least(greatest(x2, 0.0), 3000.0) as x2, least(greatest(y2, 0.0), 1800.0) as y2 from detections_v""", "detections_v",
)
def clip_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = Box(F.col("x1") - 100.0, F.col("y1") - 100.0, F.col("x2"), F.col("y2"))
    b = boxes.clip(moved, 3000, 1800)
    return _detections(spark, sf_dir).select("run_id", "frame_id", "det_no", "part_no", b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"))


_CROP = [f"cast(trunc(least(greatest({a} {s} 0.25 * greatest(10.0, {b}), 0.0), {m}.0)) as integer)" for a, s, b, m in (("x1", "-", "x2 - x1", 3840), ("y1", "-", "y2 - y1", 2160), ("x2", "+", "x2 - x1", 3840), ("y2", "+", "y2 - y1", 2160))]


@query(f"select run_id, frame_id, det_no, part_no, {_CROP[0]} as cx1, {_CROP[1]} as cy1, {_CROP[2]} as cx2, {_CROP[3]} as cy2 from detections_v", "detections_v")
def crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = boxes.crop_window(Box.of(), 3840, 2160)
    return _detections(spark, sf_dir).select("run_id", "frame_id", "det_no", "part_no", w.x1.alias("cx1"), w.y1.alias("cy1"), w.x2.alias("cx2"), w.y2.alias("cy2"))


@query(
    """select run_id, frame_id, det_no, part_no, greatest(1.0, x2 - x1) / greatest(1.0, y2 - y1) as aspect, x1 + greatest(1.0, x2 - x1) / 2 as cx,
    y1 + greatest(1.0, y2 - y1) / 2 as cy, greatest(1.0, y2 - y1) as height from detections_v""", "detections_v",
)
def box_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detections(spark, sf_dir).select("run_id", "frame_id", "det_no", "part_no", boxes.to_centre(Box.of()).alias("c")).select("run_id", "frame_id", "det_no", "part_no", "c.*")


_CLASS_INPUT = "(case part_no % 7 when 0 then 'Person' when 1 then 'Sheep dog' when 2 then 'boat' when 3 then 'CATTLE' when 4 then 'survivor' when 5 then 'truck' else 'bird' end)"


@query(
    f""", n as (select run_id, frame_id, det_no, part_no, cast(part_no % 30 as integer) as cid, lower{_CLASS_INPUT} as nm from detections_v)
    select run_id, frame_id, det_no, part_no,
      case when cid = 0 or nm in ('person', 'human', 'survivor') then 'human'
        when cid = 1 or cid between 14 and 23 or regexp_matches(nm, 'animal|dog|cat|horse|cow|sheep|bird') then 'animal' else nm end as class_name,
      case when cid = 0 or nm in ('person', 'human', 'survivor') then 0
        when cid = 1 or cid between 14 and 23 or regexp_matches(nm, 'animal|dog|cat|horse|cow|sheep|bird') then 1 else cid end as class_id
    from n""",
    "detections_v",
)
def class_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = boxes.mapped_class((F.col("part_no") % 30).cast("int"), F.expr(_CLASS_INPUT))
    return _detections(spark, sf_dir).select("run_id", "frame_id", "det_no", "part_no", mapped.alias("m")).select("run_id", "frame_id", "det_no", "part_no", "m.*")


@query(
    """select case when confidence >= 0.4 then 'high' when confidence >= 0.15 then 'low' end as pool, class_name, count(*) as n,
    round(avg(thermal_delta), 6) as mean_thermal from detections_v where class_name in ('human', 'animal') group by all""", "detections_v",
)
def confidence_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _detections(spark, sf_dir).where(F.col("class_name").isin("human", "animal"))
    return rows.groupBy(detections.pool(F.col("confidence")).alias("pool"), "class_name").agg(F.count("*").alias("n"), r6(F.avg("thermal_delta")).alias("mean_thermal"))


#: Kept boxes are carried along a frame's rows in their order.
_NMS = """, ns as (select *, row_number() over (partition by run_id, frame_id, class_name order by confidence desc, x1, y1, x2, y2, pred_no) as n from p),
  walk as (select run_id, frame_id, class_name, n, pred_no, confidence, true as keep, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] as boxes from ns where n = 1
    union all
    select run_id, frame_id, class_name, n, pred_no, confidence, keep, case when keep then list_append(boxes, box) else boxes end from (
      select o.run_id, o.frame_id, o.class_name, o.n, o.pred_no, o.confidence, w.boxes, {'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2} as box,
        not list_bool_or(list_transform(w.boxes, lambda b:
          least(b.x2, o.x2) > greatest(b.x1, o.x1) and least(b.y2, o.y2) > greatest(b.y1, o.y1) and
          (least(b.x2, o.x2) - greatest(b.x1, o.x1)) * (least(b.y2, o.y2) - greatest(b.y1, o.y1)) > 0.45 * (
            (o.x2 - o.x1) * (o.y2 - o.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
            - (least(b.x2, o.x2) - greatest(b.x1, o.x1)) * (least(b.y2, o.y2) - greatest(b.y1, o.y1))))) as keep
      from walk w join ns as o on o.run_id = w.run_id and o.frame_id = w.frame_id and o.class_name = w.class_name and o.n = w.n + 1))
  select run_id, frame_id, class_name, pred_no as det_no, confidence from walk where keep"""


@query()
def nms_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir).withColumn("det_no", F.col("pred_no"))
    return detections.non_maximum_suppression(rows)


ORACLES["nms_keep"] = f"with recursive {duck_cte(*_BOTH)} {_NUMBERED} {_NMS}"


# Tracking, entities, evaluation --------------------------------------------------------------------------------------


def _flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as flights."""
    rows = _predictions(spark, sf_dir).where(F.col("class_name").isin("human", "animal"))
    return rows.select(
        "run_id", "frame_id", (F.col("frame_id") * 40.0).alias("timestamp_ms"),
        F.col("pred_no").alias("det_no"), "x1", "y1", "x2", "y2", "confidence", "class_name", "thermal_delta",
    )


@query()
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = tracking.track(_flights(spark, sf_dir), FLIGHT_TRACKER, final_only=True)
    return last.select("run_id", "track_id", "class_name", "hits", "age", "status", "is_confirmed", "is_stationary", F.round("x1", 1).alias("x1"))


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sightings_v").withColumns(
        {"timestamp_ms": F.col("t_us") / 1000.0, "error_radius_m": F.lit(2.0), "hits": F.col("hits").cast("bigint")}
    )


_CELL = "8e0 / 110000e0"


@query(
    f""", s as (select *, floor(lat / ({_CELL})) as r, floor(lon / ({_CELL} / cos(radians(28e0)))) as c from sightings_v),
    j as (select s.run_id as left_run, s.track_id as left_id, b.run_id as right_run, b.track_id as right_id, {_H.format(a='s.lat', b='b.lat', c='s.lon', d='b.lon')} as h
      from s join (select *, r + i as near_r, c + k as near_c from s, (select unnest([-1, 0, 1]) as i), (select unnest([-1, 0, 1]) as k)) b
      on s.class_name = b.class_name and s.r = b.near_r and s.c = b.near_c where s.run_id < b.run_id or (s.run_id = b.run_id and s.track_id < b.track_id))
    select left_run, left_id, right_run, right_id, round({_HAV}, 4) as distance_m from j where {_HAV} <= 8.0""",
    "sightings_v",
)
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sightings within the radius, of all runs, each pair once."""
    rows = view(spark, sf_dir, "sightings_v")
    found = entities.radius_pairs(rows, rows, 8.0, 28.0)
    own = lambda side: F.struct(f"{side}.run_id", f"{side}.track_id")
    return found.where(own("l") < own("g")).select(
        F.col("l.run_id").alias("left_run"), F.col("l.track_id").alias("left_id"), F.col("g.run_id").alias("right_run"),
        F.col("g.track_id").alias("right_id"), F.round("distance_m", 4).alias("distance_m"),
    )


@query()
def entity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities.ranked_entities(entities.cluster(_sightings(spark, sf_dir)))
    return found.select("run_id", "entity_id", "class_name", r6(F.col("latitude")).alias("latitude"), r6(F.col("longitude")).alias("longitude"), "best_confidence", "total_hits", "observation_count", "rank")


@query()
def entity_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities.cluster(_sightings(spark, sf_dir))
    return found.groupBy("run_id", "class_name").agg(
        F.count("*").alias("entities"), F.sum("observation_count").alias("sightings"), F.max("best_confidence").alias("best_confidence"),
        F.sum("total_hits").alias("hits"), F.max(F.array_size("track_ids")).alias("most_tracks"),
    )


@query(
    """select run_id, class_name, count(*) as sightings, sum(hits)::bigint as hits, max(confidence) as best_confidence, count(distinct track_id) as tracks,
    arg_max(track_id, (confidence, -track_id)) as best_track from sightings_v group by all""", "sightings_v",
)
def sighting_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sightings_v").groupBy("run_id", "class_name").agg(
        F.count("*").alias("sightings"), F.sum("hits").alias("hits"), F.max("confidence").alias("best_confidence"),
        F.count_distinct("track_id").alias("tracks"), F.max_by("track_id", F.struct("confidence", -F.col("track_id"))).alias("best_track"),
    )


@query()
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.clustering_statistics(entities.cluster(_sightings(spark, sf_dir)))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sightings(spark, sf_dir).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    return triage.records(rows).withColumns({"place": F.col("track_id"), "last_detected_ms": F.col("timestamp_ms")})


@query()
def record_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.merge_records(_records(spark, sf_dir)).select("run_id", "class_name", "track_id", "confidence", "triage_score", "hits", "merged")


_SCORE = _ex(
    "least(1.0, greatest(0.0, 0.3 * confidence + 0.35 * (case when is_stationary then 1.0 else 0.0 end) + 0.2 * (case when thermal_delta > 0 then least(1.0, thermal_delta / 10.0) else 0.0 end) + 0.15 * least(1.0, greatest(0.1, hits / 10.0))))",
    3,
).replace("0.3 *", "0.3::double *").replace("0.35 *", "0.35::double *").replace("0.2 *", "0.2::double *").replace("0.15 *", "0.15::double *")
_LEVEL = "case when triage_score >= 0.75 then 'CRITICAL_RESCUE' when triage_score >= 0.5 then 'MODERATE_SEARCH' else 'LOW_PRIORITY' end"
_COLOR = "case when triage_score >= 0.75 then '#e63946' when triage_score >= 0.5 then '#f4a261' else '#e9c46a' end"
_SCORED = f", sc as (select *, {_SCORE} as triage_score from sightings_v), rec as (select *, {_LEVEL} as urgency_level, {_COLOR} as urgency_color, case when is_stationary then 'STATIONARY' else 'MOBILE' end as status from sc)"


@query(f"{_SCORED} select run_id, track_id, triage_score, urgency_level, urgency_color, status from rec", "sightings_v")
def triage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("run_id", "track_id", "triage_score", "urgency_level", "urgency_color", "status")


@query(f"{_SCORED} select run_id, track_id, row_number() over (partition by run_id order by triage_score desc, track_id) as rank from rec", "sightings_v")
def triage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.rank(_records(spark, sf_dir), "track_id").select("run_id", "track_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    f"""{_SCORED} select run_id, count(*) as records, count_if(urgency_level = 'CRITICAL_RESCUE') as critical, count_if(urgency_level = 'MODERATE_SEARCH') as moderate,
    count_if(urgency_level = 'LOW_PRIORITY') as low, count_if(is_stationary) as stationary, count_if(not is_stationary) as mobile,
    count_if(class_name = 'human') as humans, count_if(class_name = 'animal') as animals from rec group by run_id""", "sightings_v",
)
def triage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.counts(_records(spark, sf_dir))


@query("select round(avg(lat), 6) as center_lat, round(avg(lon), 6) as center_lon from sightings_v", "sightings_v")
def map_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.map_centre(_records(spark, sf_dir)).select(r6(F.col("center_lat")).alias("center_lat"), r6(F.col("center_lon")).alias("center_lon"))


@query("select track_id from sightings_v order by sqrt(pow(lat - 27.7181, 2) + pow(lon - 85.3251, 2)), track_id limit 1", "sightings_v")
def nearest_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.nearest(_records(spark, sf_dir), 27.7181, 85.3251).select("track_id")


def _matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    made, truth = _predictions(spark, sf_dir), _truth(spark, sf_dir)
    return made, truth, evaluation.greedy_matches(evaluation.overlaps(made, truth))


_GREEDY = """, q as (select run_id, frame_id, pred_no, gt_no, meet / (areas - meet) as iou,
    row_number() over (partition by run_id, frame_id order by pred_no, meet / (areas - meet) desc, gt_no) as n from o where meet > 0),
  walk as (select run_id, frame_id, pred_no, gt_no, iou, n, pred_no as done, iou >= 0.5 as hit, case when iou >= 0.5 then [gt_no] else [] end as taken from q where n = 1
    union all
    select run_id, frame_id, pred_no, gt_no, iou, n, case when passed then done else pred_no end, not passed and iou >= 0.5,
      case when not passed and iou >= 0.5 then list_append(taken, gt_no) else taken end from (
        select q.*, w.done, w.taken, q.pred_no = w.done or list_contains(w.taken, q.gt_no) as passed
        from walk w join q on q.run_id = w.run_id and q.frame_id = w.frame_id and q.n = w.n + 1))"""


@query()
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)[2].withColumn("iou", r6(F.col("iou")))


_WALKED = f"with recursive {duck_cte(*_BOTH)} {_NUMBERED} {_GREEDY}"
ORACLES["greedy_match"] = f"{_WALKED} select run_id, frame_id, pred_no, gt_no, round(iou, 6) as iou from walk where hit"


@query(f"{_NUMBERED} select run_id, frame_id, gt_no from g anti join (select run_id, frame_id, gt_no from o where meet >= 0.5 * (areas - meet)) using (run_id, frame_id, gt_no)", *_BOTH)
def unmatched_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth that no prediction overlaps enough."""
    truth = _truth(spark, sf_dir)
    enough = evaluation.overlaps(_predictions(spark, sf_dir), truth).where(F.col("iou") >= 0.5)
    return evaluation.false_negatives(truth, enough).select("run_id", "frame_id", "gt_no")


@query(f"{_NUMBERED} select run_id, frame_id, gt_no from g semi join (select run_id, frame_id, gt_no from o where meet >= 0.5 * (areas - meet)) using (run_id, frame_id, gt_no)", *_BOTH)
def matched_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth that some prediction overlaps enough."""
    truth = _truth(spark, sf_dir)
    enough = evaluation.overlaps(_predictions(spark, sf_dir), truth).where(F.col("iou") >= 0.5)
    return truth.join(enough, ["run_id", "frame_id", "gt_no"], "left_semi").select("run_id", "frame_id", "gt_no")


@query()
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, truth, matches = _matches(spark, sf_dir)
    frames = made.groupBy("run_id", "frame_id").agg((F.first("frame_id") * 40.0).alias("timestamp_ms"), (F.max("part_no") % 15 * 20.0).alias("latency_ms"))
    return evaluation.metrics(made, truth.withColumn("entity_id", F.col("gt_part")), matches, frames)


ORACLES["eval_metrics"] = f"""{_WALKED},
  fr as (select run_id, frame_id, frame_id * 40e0 as ts, max(part_no) % 15 * 20e0 as lat from p group by run_id, frame_id),
  cl as (select run_id, count(*) as frames, min(ts) as b, max(ts) as e, avg(lat) as ml, quantile_cont(lat, 0.95) as pl, max(lat) as xl from fr group by run_id),
  tp as (select run_id, count(*) as tp from walk where hit group by run_id), np as (select run_id, count(*) as np from p group by run_id),
  ng as (select run_id, count(*) as ng, count(distinct gt_part) as en from g group by run_id),
  a as (select run_id, coalesce(tp, 0) as tp, coalesce(np, 0) - coalesce(tp, 0) as fp, coalesce(ng, 0) - coalesce(tp, 0) as fn, coalesce(ng, 0) as ng,
    greatest(1, coalesce(en, 0)) as en, coalesce(frames, 0) as frames, ml, pl, xl, greatest(1e0, case when e > b then (e - b) / 1000e0 else frames / 30e0 end) as sec
    from cl full join np using (run_id) full join ng using (run_id) full join tp using (run_id)),
  m as (select *, tp / greatest(1, tp + fn)::double as rc, tp / greatest(1, tp + fp)::double as pr from a)
  select run_id, ng as total_gt_instances, tp as true_positives, fp as false_positives, fn as false_negatives, {_ex('rc', 4)} as recall_at_50,
    {_ex('pr', 4)} as precision_at_50, {_ex('2 * pr * rc / greatest(1e-6, pr + rc)', 4)} as f1_score, {_ex('fp / (sec / 60e0)', 2)} as fp_per_minute,
    en as gt_unique_entities, 0 as predicted_unique_tracks, 0e0 as deduplication_accuracy, {_ex('ml', 2)} as mean_latency_ms, {_ex('pl', 2)} as p95_latency_ms,
    {_ex('xl', 2)} as max_latency_ms, frames as total_frames_evaluated, {_ex('sec', 2)} as video_duration_seconds, {"'" + scoring.GUARDRAIL.replace("'", "''") + "'"} as recommender_guardrail_status,
    case when rc >= 0.9 and ml <= 300 then 'PASSED' else 'FAILED' end as acceptance_verdict from m"""


@query(
    """select event_type, round(avg(value), 6) as mean_latency, round(quantile_cont(value, 0.95), 6) as p95_latency, min(value) as min_latency, max(value) as max_latency
    from events group by event_type"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "events").groupBy("event_type").agg(*evaluation.latency_aggregates("value"))
    return stats.withColumns({c: r6(F.col(c)) for c in ("mean_latency", "p95_latency")})


# Exports -------------------------------------------------------------------------------------------------------------


def _export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).withColumns(
        {
            "first_detected_ts": F.col("timestamp_ms"), "last_detected_ts": F.col("timestamp_ms"), "crop_bbox": F.array(F.lit(0.0)),
            "full_frame_path": F.lit("frames\\a.jpg"), "raw_crop_path": F.lit("crops\\a.jpg"), "annotated_crop_path": F.lit("crops\\b.jpg"),
        }
    )


@query(
    f"""{_SCORED} select track_id, triage_score, '#' || track_id as queue_name, replace('frames\\a.jpg', '\\', '/') as path,
      {_ex('lon', 6)} as first_coordinate, {_ex('lat', 6)} as second_coordinate, class_name, urgency_level, urgency_color, confidence, status,
      is_stationary, thermal_delta as thermal_delta_c, 2e0 as error_radius_m, t_us / 1000e0 as first_detected_ms, t_us / 1000e0 as last_detected_ms, hits::bigint as hits_count,
      'crops/a.jpg' as raw_crop_path, 'crops/b.jpg' as annotated_crop_path from rec""", "sightings_v",
)
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the JSON of each feature."""
    rows = sinks.geojson_features(_export_records(spark, sf_dir))
    of = lambda path: F.get_json_object("feature", path)
    return rows.select(
        of("$.properties.track_id").cast("bigint").alias("track_id"), of("$.properties.triage_score").cast("double").alias("triage_score"),
        F.concat(F.lit("#"), of("$.properties.track_id")).alias("queue_name"), of("$.properties.full_frame_path").alias("path"),
        exact_round(of("$.geometry.coordinates[0]").cast("double"), 6).alias("first_coordinate"),
        exact_round(of("$.geometry.coordinates[1]").cast("double"), 6).alias("second_coordinate"),
        *[of(f"$.properties.{c}").alias(c) for c in ("class_name", "urgency_level", "urgency_color", "status", "raw_crop_path", "annotated_crop_path")],
        *[of(f"$.properties.{c}").cast("double").alias(c) for c in ("confidence", "thermal_delta_c", "error_radius_m", "first_detected_ms", "last_detected_ms")],
        of("$.properties.is_stationary").cast("boolean").alias("is_stationary"), of("$.properties.hits_count").cast("bigint").alias("hits_count"),
    )


@query(
    f"""{_SCORED} select track_id, 'Survivor #' || track_id || ' [' || urgency_level || ']' as name,
      '#' || case urgency_level when 'CRITICAL_RESCUE' then 'criticalStyle' when 'MODERATE_SEARCH' then 'moderateStyle' else 'lowStyle' end as style,
      cast(trunc(confidence * 100) as integer) || '%' as confidence, format('{{:.6f}}, {{:.6f}}', lat, lon) as coordinates from rec""", "sightings_v",
)
def kml_placemarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the KML of each record."""
    rows = sinks.kml_placemarks(_export_records(spark, sf_dir))
    cut = lambda pattern: F.regexp_extract("placemark", pattern, 1)
    return rows.select(
        F.col("place").alias("track_id"), cut("<name>(.*?)</name>").alias("name"), cut("<styleUrl>(.*?)</styleUrl>").alias("style"),
        cut("<b>Confidence:</b> (.*?)<br/>").alias("confidence"), cut("<b>Coordinates:</b> (.*?)</p>").alias("coordinates"),
    )


@query(
    f"""{_SCORED} select '#' || track_id as track, upper(class_name) as "class", triage_score, urgency_level, status as movement_status,
      format('{{:.6f}}, {{:.6f}}', lat, lon) as gps_coordinates, cast(trunc(confidence * 100) as integer) || '%' as detection_confidence, '±2.0m' as estimated_error,
      case when coalesce(thermal_delta, 0) <> 0 then '+' || thermal_delta || '°C' else 'N/A (Optical)' end as thermal, hits::bigint as observation_frames, lat as latitude, lon as longitude from rec""", "sightings_v",
)
def queue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.queue_table(_export_records(spark, sf_dir))
    return rows.select("track", "class", "triage_score", "urgency_level", "movement_status", "gps_coordinates", "detection_confidence", "estimated_error", "thermal", "observation_frames", "latitude", "longitude")


@query(
    f"""{_SCORED} select track_id, format('https://www.google.com/maps/dir/?api=1&destination={{:.6f}},{{:.6f}}', lat, lon) as navigate_url,
    format('https://www.google.com/maps?q={{:.6f}},{{:.6f}}', lat, lon) as pin_url,
    format('https://www.openstreetmap.org/?mlat={{:.6f}}&mlon={{:.6f}}#map=19/{{:.6f}}/{{:.6f}}', lat, lon, lat, lon) as osm_url,
    'https://api.whatsapp.com/send?text=' || replace('URGENT RESCUE DISPATCH: Survivor #' || track_id || ' [' || urgency_level || '] at GPS Coordinates: ' ||
      format('{{:.6f}}, {{:.6f}}', lat, lon) || ' (Error: ±2.0m). Direct Navigation: ' ||
      format('https://www.google.com/maps/dir/?api=1&destination={{:.6f}},{{:.6f}}', lat, lon), ' ', '+') as share_url from rec""", "sightings_v",
)
def dispatch_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.dispatch_links(_export_records(spark, sf_dir)).select("track_id", "navigate_url", "pin_url", "osm_url", "share_url")


@query(
    """select p_partkey % 7 as class_id, count(*) as boxes from part
    where p_name in (select distinct p_name from part order by p_name limit 1000) group by all"""
)
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label scan's report over parts as label files: boxes by class in the first thousand by name."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("file"), (F.col("p_partkey") % 7).alias("class_id"))
    return readers.label_histogram(rows)


@query(
    f"""select range as k, {_ex('27.7172e0 + 8e0 * cos(radians(90e0)) * (range * 100e0 / 1000e0) / 111139e0', 7)} as lat,
      {_ex('85.324e0 + 8e0 * sin(radians(90e0)) * (range * 100e0 / 1000e0) / (111139e0 * cos(radians(27.7172e0)))', 7)} as lon,
      {_ex('50e0 + 1.2e0 * sin(0.4e0 * (range * 100e0 / 1000e0)) + 0.3e0 * cos(1.1e0 * (range * 100e0 / 1000e0))', 2)} as altitude_agl,
      {_ex('90e0 + sin(0.2e0 * (range * 100e0 / 1000e0))', 2)} as yaw from range(0, 100)"""
)
def synthetic_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.synthetic_telemetry(spark, duration_s=8.9)
    return rows.select((F.round(F.col("timestamp_ms") / 100)).cast("bigint").alias("k"), "lat", "lon", "altitude_agl", "yaw")


@query()
def mission_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mission over the flights: tracking, geolocation, clustering, triage and merging."""
    done = mission.run_mission(*_mission_inputs(spark, sf_dir), tracker=FLIGHT_TRACKER)
    return done.records.select("run_id", "track_id", "class_name", "triage_score", "urgency_level", "hits", "rank")


@query()
def mission_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mission.run_mission(*_mission_inputs(spark, sf_dir), tracker=FLIGHT_TRACKER).summary


def _mission_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    flights = _flights(spark, sf_dir)
    frames = flights.select("run_id", "frame_id", "timestamp_ms").distinct()
    pose = {"lat": 27.7172, "lon": 85.324, "altitude_agl": 50.0, "pitch": -75.0, "roll": 0.0, "yaw": 45.0}
    samples = frames.where("frame_id % 3 = 0").select(
        "run_id", F.col("timestamp_ms").alias("t_ms"), *[(F.lit(v) + F.col("frame_id") % 90 * 1e-6).alias(c) for c, v in pose.items()]
    )
    return frames, samples, flights


_CENTRE = f"""pose as (select run_id, frame_id, {_POSE_LIST}, delta <= {TOLERANCE_MS:.1f} as is_synced from calc),
  ray as (select *, cos(radians(yaw)) * cos(radians(pitch)) as vn, sin(radians(yaw)) * cos(radians(pitch)) as ve, -sin(radians(pitch)) as vd, greatest(1.0, altitude_agl) as ht from pose),
  sc0 as (select *, ht / greatest(vd, 1e-6) as sc from ray), gr as (select *, sqrt(pow(sc * vn, 2) + pow(sc * ve, 2)) as dist from sc0),
  hit as (select run_id, frame_id as track_id, (frame_id * 13 % 1000) / 1000e0 as confidence, frame_id % 3 = 0 as is_stationary,
    case when is_synced then frame_id % 12 * 1e0 end as thermal_delta, 1 + frame_id % 12 as hits,
    {_ex(f'lat + degrees(sc * vn / {_MP})', 7)} as latitude, {_ex(f'lon + degrees(sc * ve / ({_NP} * cos(radians(lat))))', 7)} as longitude,
    {_ex('altitude_agl * tan(radians(1.0)) + 1.5 + 0.5 * tan(radians(degrees(atan2(dist, ht))))', 2)} as error_radius_m, {_ex('dist', 2)} as ground_distance_m from gr),
  sc as (select *, {_SCORE} as triage_score from hit)
  select run_id, row_number() over (partition by run_id order by triage_score desc, track_id) as rank, track_id, triage_score, {_LEVEL} as urgency_level,
    latitude, longitude, error_radius_m, ground_distance_m from sc"""


@query(f", {_NEAR}, {_CENTRE}", "frames_v", "telemetry_v")
def flagship_mission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of telemetry for each frame, its centre pixel cast to the ground, scored and ranked."""
    synced = _synced(spark, sf_dir)
    spot = geo.cast_pixel(F.lit(1920.0), F.lit(1080.0), *[F.col(c) for c in telemetry.POSE])
    rows = synced.withColumn("s", spot).select("run_id", F.col("frame_id").alias("track_id"), "is_synced", "s.*")
    rows = rows.withColumns(
        {
            "confidence": (F.col("track_id") * 13 % 1000) / 1000.0, "is_stationary": F.col("track_id") % 3 == 0,
            "thermal_delta": F.when(F.col("is_synced"), F.col("track_id") % 12 * 1.0), "hits": 1 + F.col("track_id") % 12,
        }
    )
    ranked = triage.rank(triage.records(rows), "track_id")
    return ranked.select("run_id", "rank", "track_id", "triage_score", "urgency_level", "latitude", "longitude", "error_radius_m", "ground_distance_m")
