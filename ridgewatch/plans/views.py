"""Domain views over the star-schema tables: the inputs of the domain queries, as SQL that Spark and DuckDB share.

Only the epoch function differs between the two engines; everything else is the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgewatch.session import table

#: View -> (source tables, SQL with {us} for the epoch microseconds of a timestamp).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "telemetry_v": (
        ("events",),
        """select user_id as run_id, {us:ts} as t_us,
             27.7172e0 + (event_id % 1000) * 0.00001e0 as lat, 85.3240e0 + (event_id % 777) * 0.00001e0 as lon,
             30.0e0 + cast(value as double) % 70e0 as altitude_agl, -90.0e0 + (event_id % 60) as pitch,
             0.0e0 + (event_id % 7) - 3e0 as roll, 0.0e0 + (event_id * 37) % 360 as yaw
           from events where event_type in ('view', 'purchase')""",
    ),
    "frames_v": (
        ("events",),
        "select user_id as run_id, event_id as frame_id, {us:ts} as t_us from events where event_type = 'click'",
    ),
    "frame_metrics_v": (
        ("events",),
        """select user_id as run_id, event_id as frame_id, {us:ts} as t_us, value * 4e0 as sharpness,
             (event_id % 100) / 100.0e0 as motion_score, (event_id * 7 % 100) / 100.0e0 as similarity_score,
             cast(value as double) % 256e0 as brightness, (event_id % 64) * 1e0 as contrast
           from events""",
    ),
    "detections_v": (
        ("lineitem",),
        """select l_orderkey % 64 as run_id, cast(floor(l_orderkey / 64e0) as bigint) as frame_id, l_linenumber as det_no, l_partkey as part_no, l_suppkey as supp_no,
             1e0 * ((l_partkey * 37) % 3700) as x1, 1e0 * ((l_suppkey * 53) % 2040) as y1,
             1e0 * ((l_partkey * 37) % 3700) + 20e0 + l_quantity as x2,
             1e0 * ((l_suppkey * 53) % 2040) + 40e0 + l_quantity as y2,
             (l_partkey * 13 % 1000) / 1000.0e0 as confidence,
             case l_returnflag when 'N' then 'human' when 'R' then 'animal' else 'other' end as class_name,
             case when l_linestatus = 'O' then l_discount * 100e0 end as thermal_delta
           from lineitem""",
    ),
    "ground_truth_v": (
        ("lineitem",),
        """select l_orderkey % 64 as run_id, cast(floor(l_orderkey / 64e0) as bigint) as frame_id, l_linenumber as gt_no, l_partkey as gt_part, l_suppkey as gt_supp,
             1e0 * ((l_partkey * 37) % 3700 + l_linenumber % 5) as gx1,
             1e0 * ((l_suppkey * 53) % 2040 + l_linenumber % 5) as gy1,
             1e0 * ((l_partkey * 37) % 3700 + l_linenumber % 5) + 20e0 + l_quantity as gx2,
             1e0 * ((l_suppkey * 53) % 2040 + l_linenumber % 5) + 40e0 + l_quantity as gy2
           from lineitem where l_partkey % 10 <> 0""",
    ),
    "sightings_v": (
        ("orders",),
        """select o_custkey % 10 as run_id, o_orderkey as track_id, {us:o_orderdate} as t_us,
             27.7172e0 + (o_custkey % 50) * 0.0001e0 + (o_orderkey % 7) * 0.00001e0 as lat,
             85.324e0 + (o_custkey % 40) * 0.0001e0 + (o_orderkey % 5) * 0.00001e0 as lon,
             (o_orderkey * 13 % 1000) / 1000.0e0 as confidence,
             case when o_custkey % 3 = 0 then 'animal' else 'human' end as class_name,
             case when o_orderkey % 4 = 0 then (o_orderkey % 120) / 10.0e0 end as thermal_delta,
             o_orderkey % 3 = 0 as is_stationary, 1 + o_orderkey % 12 as hits
           from orders""",
    ),
    "mavlink_v": (
        ("events",),
        """select user_id as run_id, event_id as msg_id, {us:ts} as t_us,
             case event_type when 'view' then 'GLOBAL_POSITION_INT' else 'ATTITUDE' end as msg_type,
             case event_type when 'view' then 277172000 + event_id % 1000 end as lat_e7,
             case event_type when 'view' then 853240000 + event_id % 777 end as lon_e7,
             case event_type when 'view' then 30000 + event_id % 70000 end as alt_mm,
             case event_type when 'purchase' then (event_id % 628) / 100.0e0 end as yaw_rad,
             case event_type when 'purchase' then (event_id % 314) / 100.0e0 - 1.57e0 end as pitch_rad,
             case event_type when 'purchase' then (event_id % 100) / 100.0e0 end as roll_rad
           from events where event_type in ('view', 'purchase')""",
    ),
}

#: The two engines' epoch microseconds.
_SPARK_US, _DUCK_US = "unix_micros(cast({0} as timestamp))", "epoch_us({0})"


def _sql(text: str, epoch: str) -> str:
    head, *rest = text.split("{us:")
    return head + "".join(epoch.format(column) + after for column, _, after in (r.partition("}") for r in rest))


def duck_cte(*names: str) -> str:
    """A WITH list of views for a DuckDB query."""
    return ", ".join(f"{name} as ({_sql(VIEWS[name][1], _DUCK_US)})" for name in names)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; only the columns used later are read."""
    sources, text = VIEWS[name]
    frames = {source: table(spark, sf_dir, source) for source in sources}
    return spark.sql(_sql(text, _SPARK_US).replace(f"from {sources[0]}", f"from {{{sources[0]}}}"), **frames)
