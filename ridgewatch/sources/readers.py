"""Readers: telemetry, frame metadata, labels, GeoJSON and metrics, and generated telemetry."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgewatch.functions.exact import exact_round
from ridgewatch.functions.geo import METRES_PER_DEGREE

TELEMETRY = ("timestamp_ms", "lat", "lon", "altitude_agl", "pitch", "roll", "yaw")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """A telemetry CSV: header names trimmed and in lower case, rows with a value that isn't a number are left out.

    Extra columns are ignored; a missing one is an error. seq keeps the order of equal timestamps within a file.
    """
    raw = spark.read.csv(path, header=True)
    names = {c.strip().lower(): c for c in raw.columns}
    if absent := [c for c in TELEMETRY if c not in names]:
        raise ValueError(f"telemetry lacks {', '.join(absent)}")
    numbers = raw.select(
        *[F.trim(F.col(f"`{names[c]}`")).try_cast("double").alias(c) for c in TELEMETRY],
        F.monotonically_increasing_id().alias("seq"),
    )
    return numbers.na.drop(subset=list(TELEMETRY))


def frame_table(spark: SparkSession, frames: int, fps: float | None, run_id: int = 0) -> DataFrame:
    """Frame metadata of a stream: frame_idx and pts_ms from the frame rate, 30 where that isn't a positive number."""
    rate = fps if fps and fps > 0 and not math.isnan(fps) else 30.0
    return spark.range(frames).select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.col("id").alias("frame_idx"), (F.col("id") / rate * 1000).alias("pts_ms")
    )


def with_container_time(frames: DataFrame, fps: float) -> DataFrame:
    """pts_ms from the container where it is positive, else from the frame rate."""
    return frames.withColumn("pts_ms", F.when(F.col("container_ms") > 0, F.col("container_ms")).otherwise(F.col("frame_idx") / fps * 1000))


def paired_streams(rgb: DataFrame, thermal: DataFrame, every: int = 1, stop_with_thermal: bool = True) -> DataFrame:
    """Frames of both streams by index; a thermal stream that ends early ends the pairs, or leaves nulls."""
    own = rgb.where(F.col("frame_idx") % every == 0)
    return own.join(thermal.withColumnsRenamed({c: f"thermal_{c}" for c in thermal.columns if c not in ("run_id", "frame_idx")}), ["run_id", "frame_idx"], "inner" if stop_with_thermal else "left")


def _with_sway(t: Column, mean: float, *waves: tuple[Callable[[Column], Column], float, float]) -> Column:
    """mean plus waves, each a function, an amplitude and a frequency in radians a second."""
    out = F.lit(mean)
    for wave, size, rate in waves:
        out = out + size * wave(rate * t)
    return out


def synthetic_telemetry(
    spark: SparkSession, duration_s: float, rate_hz: float = 10.0, lat: float = 27.7172, lon: float = 85.3240,
    altitude: float = 50.0, speed: float = 8.0, heading: float = 90.0, gimbal_pitch: float = -75.0,
    jitter: DataFrame | None = None,
) -> DataFrame:
    """A straight flight with swaying altitude and attitude, one second longer than asked.

    jitter: k and jitter_ms, added to the time of sample k (never to sample 0).
    """
    count = math.ceil((duration_s + 1) * rate_hz) + 1
    base = spark.range(count).withColumnRenamed("id", "k")
    base = base.join(jitter, "k", "left") if jitter is not None else base.withColumn("jitter_ms", F.lit(0.0))
    shift = F.when(F.col("k") == 0, 0.0).otherwise(F.coalesce("jitter_ms", F.lit(0.0)))
    at = F.greatest(F.lit(0.0), F.col("k") * (1000.0 / rate_hz) + shift)
    t = F.col("at") / 1000.0
    north, east = speed * math.cos(math.radians(heading)), speed * math.sin(math.radians(heading))
    per_lon = METRES_PER_DEGREE * math.cos(math.radians(lat))
    # Amplitudes and frequencies of the sway.
    poses = {
        "lat": (lat + north * t / METRES_PER_DEGREE, 7),
        "lon": (lon + east * t / per_lon, 7),
        "altitude_agl": (_with_sway(t, altitude, (F.sin, 1.2, 0.4), (F.cos, 0.3, 1.1)), 2),
        "pitch": (_with_sway(t, gimbal_pitch, (F.sin, 0.6, 0.8)), 2),
        "roll": (_with_sway(t, 0.0, (F.cos, 0.4, 0.9)), 2),
        "yaw": (F.pmod(_with_sway(t, heading, (F.sin, 1.0, 0.2)), F.lit(360.0)), 2),
    }
    return base.select(at.alias("at")).select(
        exact_round(F.col("at"), 2).alias("timestamp_ms"), *[exact_round(c, k).alias(n) for n, (c, k) in poses.items()]
    )


def fallback_telemetry(spark: SparkSession, frames: int, fps: float, lat: float = 27.717245, lon: float = 85.324012) -> DataFrame:
    """One sample for each frame of a flight without a log, in closed form."""
    k = F.col("id")
    # Drift per frame, and amplitude and period of the sway.
    return spark.range(frames).select(
        (k / fps * 1000.0).alias("timestamp_ms"), (lat + k * 0.000003).alias("lat"), (lon + k * 0.000002).alias("lon"),
        (45.0 + F.sin(k / 30.0) * 2.0).alias("altitude_agl"), (-75.0 + F.cos(k / 25.0) * 3.0).alias("pitch"),
        F.lit(0.0).alias("roll"), (45.0 + k * 0.05).alias("yaw"),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label text files: split (from the folder; valid is val), file and class_id of each line with an integer first."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    rows = lines.select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s+")[0].try_cast("int").alias("class_id"))
    folder = F.regexp_extract("file", r"/(train|val|valid|test)/", 1)
    split = F.when(folder == "valid", "val").when(folder == "", None).otherwise(folder)
    return rows.where("class_id is not null").withColumn("split", split)


def label_splits(spark: SparkSession, path: str, images: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp")) -> DataFrame:
    """Per split (valid is val): how many images and label files lie below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # no content is read
    folder = F.regexp_extract("path", r"/(train|val|valid|test)/", 1)
    split = F.when(folder == "valid", "val").when(folder == "", None).otherwise(folder)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return files.select(split.alias("split"), ending.alias("ending")).where("split is not null").groupBy("split").agg(
        F.count_if(F.col("ending").isin(*images)).alias("images"), F.count_if(F.col("ending") == "txt").alias("labels")
    )


def label_histogram(labels: DataFrame, files: int = 1000) -> DataFrame:
    """Boxes by class over the first files by name (a report's limit)."""
    first = labels.select("file").distinct().orderBy("file").limit(files)
    return labels.join(first, "file", "left_semi").groupBy("class_id").agg(F.count("*").alias("boxes"))


_FEATURES = (
    "features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<track_id:bigint,"
    "class_name:string,triage_score:double,urgency_level:string,urgency_color:string,confidence:double,status:string,"
    "is_stationary:boolean,thermal_delta_c:double,error_radius_m:double,first_detected_ms:double,"
    "last_detected_ms:double,hits_count:bigint,crop_bbox:array<double>,full_frame_path:string,raw_crop_path:string,"
    "annotated_crop_path:string>>>"
)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """The features of a GeoJSON file; none if it is absent or broken."""
    try:
        documents = spark.read.schema(_FEATURES).option("mode", "DROPMALFORMED").json(path, multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        documents = spark.createDataFrame([], _FEATURES)
    return documents.select(F.explode("features").alias("f")).select(
        "f.properties.*", F.col("f.geometry.coordinates")[1].alias("latitude"), F.col("f.geometry.coordinates")[0].alias("longitude")
    )


#: What a dashboard shows before the first mission.
METRIC_DEFAULTS = {"mean_latency_ms": 0.0, "throughput_fps": 0.0, "total_frames_evaluated": 0.0}


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row of metrics, with defaults for what is absent."""
    schema = ", ".join(f"{name} double" for name in METRIC_DEFAULTS)
    try:
        rows = spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([tuple(METRIC_DEFAULTS.values())], schema)
    return rows.select(*[F.coalesce(name, F.lit(value)).alias(name) for name, value in METRIC_DEFAULTS.items()])
