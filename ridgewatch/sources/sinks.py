"""Sinks: GeoJSON, KML, map page, logs, queue and reports.

Rows become text in column expressions; only the ranked records of a mission, which are few by nature, come to the
driver, one row at a time, to be written between a document's head and foot.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewatch.functions.exact import fixed


def ranked(records: DataFrame) -> DataFrame:
    """Records by falling score; equal scores keep their place."""
    return records.orderBy(F.desc("triage_score"), "place")


def slashed(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def geojson_features(records: DataFrame) -> DataFrame:
    """place, triage_score and feature, the JSON of each record."""
    properties = F.struct(
        "track_id", "class_name", "triage_score", "urgency_level", "urgency_color", "confidence", "status",
        "is_stationary", F.col("thermal_delta").alias("thermal_delta_c"), "error_radius_m",
        F.col("first_detected_ts").alias("first_detected_ms"), F.col("last_detected_ts").alias("last_detected_ms"),
        F.col("hits").alias("hits_count"), "crop_bbox", slashed(F.col("full_frame_path")).alias("full_frame_path"),
        slashed(F.col("raw_crop_path")).alias("raw_crop_path"), slashed(F.col("annotated_crop_path")).alias("annotated_crop_path"),
    )
    geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    return records.select("place", "triage_score", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def _stream(path: str, head: str, lines, between: str, foot: str) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(head)
        for number, line in enumerate(lines):
            out.write((between if number else "") + line)
        out.write(foot)
    return path


def write_geojson(records: DataFrame, path: str) -> str:
    """An RFC 7946 feature collection, by falling score."""
    # The collection's name and reference system.
    head = {"type": "FeatureCollection", "name": "SAR_Triage_Survivors", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}}
    rows = ranked(geojson_features(records)).select("feature").toLocalIterator()
    return _stream(path, json.dumps(head)[:-1] + ', "features": [\n', (r["feature"] for r in rows), ",\n", "\n]}\n")


#: Urgency, style id, colour (aabbggrr) and scale of each map symbol.
STYLES = (
    ("CRITICAL_RESCUE", "criticalStyle", "ff4639e6", "1.3"),
    ("MODERATE_SEARCH", "moderateStyle", "ff61a2f4", "1.1"),
    ("LOW_PRIORITY", "lowStyle", "ff6ac4e9", "0.9"),
)


def percent(share: Column) -> Column:
    return F.concat((share * 100).cast("int").cast("string"), F.lit("%"))


def thermal_text(delta: Column, absent: str) -> Column:
    """A delta with sign and unit; null and 0 count as absent."""
    return F.when(delta.isNotNull() & (delta != 0), F.concat(F.lit("+"), delta.cast("string"), F.lit("°C"))).otherwise(absent)


def kml_placemarks(records: DataFrame) -> DataFrame:
    """place, triage_score and placemark, the KML of each record."""
    style = F.when(F.col("urgency_level") == STYLES[0][0], STYLES[0][1]).when(F.col("urgency_level") == STYLES[1][0], STYLES[1][1])
    facts = [
        ("Class", F.col("class_name")), ("Triage Score", F.col("triage_score").cast("string")), ("Confidence", percent(F.col("confidence"))),
        ("Movement Status", F.col("status")), ("Thermal Delta", thermal_text(F.col("thermal_delta"), "N/A")),
        ("GPS Uncertainty", F.concat(F.lit("±"), F.col("error_radius_m").cast("string"), F.lit("m"))),
        ("Coordinates", F.concat_ws(", ", fixed(F.col("latitude"), 6), fixed(F.col("longitude"), 6))),
    ]
    listed = F.concat_ws("<br/>", *[F.concat(F.lit(f"<b>{name}:</b> "), value) for name, value in facts])
    track, level = F.col("track_id").cast("string"), F.col("urgency_level")
    mark = F.concat(
        F.lit("<Placemark><name>Survivor #"), track, F.lit(" ["), level, F.lit("]</name><description><![CDATA[<h3>Track #"),
        track, F.lit(" - "), level, F.lit("</h3><p>"), listed, F.lit("</p>]]></description><styleUrl>#"),
        style.otherwise(STYLES[2][1]), F.lit("</styleUrl><Point><coordinates>"), F.col("longitude").cast("string"), F.lit(","),
        F.col("latitude").cast("string"), F.lit(",0</coordinates></Point></Placemark>"),
    )
    return records.select("place", "triage_score", mark.alias("placemark"))


def write_kml(records: DataFrame, path: str) -> str:
    styles = "".join(
        f'<Style id="{name}"><IconStyle><color>{color}</color><scale>{scale}</scale></IconStyle></Style>\n'
        for _, name, color, scale in STYLES
    )
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>\n{styles}'
    rows = ranked(kml_placemarks(records)).select("placemark").toLocalIterator()
    return _stream(path, head, (r["placemark"] for r in rows), "\n", "\n</Document></kml>\n")


def map_centre(records: DataFrame, lat: float = 27.7172, lon: float = 85.3240) -> DataFrame:
    """The mean position, or a default without records."""
    return records.agg(
        F.coalesce(F.avg("latitude"), F.lit(lat)).alias("center_lat"), F.coalesce(F.avg("longitude"), F.lit(lon)).alias("center_lon")
    )


def write_map(records: DataFrame, path: str) -> str:
    """A map page of its own: markers as JSON, drawn on a plain canvas without any service."""
    centre = map_centre(records).first()
    rows = ranked(geojson_features(records)).select("feature").toLocalIterator()
    head = (
        "<!doctype html><meta charset=utf-8><title>Survivors</title><canvas id=m width=900 height=700></canvas><script>\n"
        f"const centre=[{centre['center_lon']},{centre['center_lat']}],marks=[\n"
    )
    foot = (
        "];\nconst g=document.getElementById('m').getContext('2d'),s=2e5;for(const f of marks){const[x,y]=f.geometry.coordinates,"
        "p=f.properties;g.fillStyle=p.urgency_color;g.beginPath();g.arc(450+(x-centre[0])*s,350-(y-centre[1])*s,6,0,7);g.fill();}\n</script>\n"
    )
    return _stream(path, head, (r["feature"] for r in rows), ",\n", foot)


def selection_log(selected: DataFrame) -> DataFrame:
    """The rows of the selected-frame log, formatted as text."""
    number = lambda c, k: fixed(F.col(c), k).alias(c)
    return selected.select(
        F.format_string("frame_%06d", F.col("number")).alias("frame_id"), F.col("frame_id").alias("original_frame_number"),
        number("timestamp_seconds", 3), number("fps", 2), number("sharpness_score", 2),
        *[number(c, 4) for c in ("brightness_score", "contrast_score", "motion_score", "similarity_score", "selection_score")],
        F.col("reason").alias("reason_for_selection"),
    )


def write_selection_log(selected: DataFrame, path: str) -> None:
    selection_log(selected).write.mode("overwrite").csv(path, header=True)


def queue_table(records: DataFrame) -> DataFrame:
    """The priority queue as shown: twelve columns of text and numbers, ranked."""
    lat, lon = fixed(F.col("latitude"), 6), fixed(F.col("longitude"), 6)
    return records.select(
        F.concat(F.lit("#"), F.col("track_id").cast("string")).alias("track"), F.upper("class_name").alias("class"),
        "triage_score", "urgency_level", F.col("status").alias("movement_status"), "latitude", "longitude",
        F.concat_ws(", ", lat, lon).alias("gps_coordinates"),
        F.concat(F.lit("±"), F.col("error_radius_m").cast("string"), F.lit("m")).alias("estimated_error"),
        thermal_text(F.col("thermal_delta"), "N/A (Optical)").alias("thermal"),
        percent(F.col("confidence")).alias("detection_confidence"), F.col("hits").alias("observation_frames"), "place",
    )


def write_queue(records: DataFrame, path: str) -> str:
    """The queue as a workbook where openpyxl is installed, else as CSV."""
    rows = ranked(queue_table(records)).drop("place").toPandas()
    try:
        import openpyxl  # noqa: F401
    except ModuleNotFoundError:
        path = path.removesuffix(".xlsx") + ("" if path.endswith(".csv") else ".csv")
        rows.to_csv(path, index=False)
        return path
    rows.to_excel(path, index=False, sheet_name="Survivor_Priority_Queue")
    return path


def dispatch_links(records: DataFrame) -> DataFrame:
    """Per record: links to navigate to and pin the position, and the text to share."""
    lat, lon = fixed(F.col("latitude"), 6), fixed(F.col("longitude"), 6)
    go = F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), lat, F.lit(","), lon)
    text = F.concat(
        F.lit("URGENT RESCUE DISPATCH: Survivor #"), F.col("track_id").cast("string"), F.lit(" ["), F.col("urgency_level"),
        F.lit("] at GPS Coordinates: "), lat, F.lit(", "), lon, F.lit(" (Error: ±"), F.col("error_radius_m").cast("string"),
        F.lit("m). Direct Navigation: "), go,
    )
    return records.select(
        "track_id", go.alias("navigate_url"), F.concat(F.lit("https://www.google.com/maps?q="), lat, F.lit(","), lon).alias("pin_url"),
        F.concat(F.lit("https://www.openstreetmap.org/?mlat="), lat, F.lit("&mlon="), lon, F.lit("#map=19/"), lat, F.lit("/"), lon).alias("osm_url"),
        F.concat(F.lit("https://api.whatsapp.com/send?text="), F.replace(text, F.lit(" "), F.lit("+"))).alias("share_url"),
    )


def utc_text(epoch_s: Column) -> Column:
    """Seconds since the epoch as text in UTC, whatever the session's time zone."""
    moment = F.to_utc_timestamp(F.timestamp_seconds(epoch_s), F.current_timezone())
    return F.concat(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def data_url(data: Column, kind: str = "image/png") -> Column:
    """Bytes as a data URL in base64, for pages; null without bytes."""
    return F.when(F.length(data) > 0, F.concat(F.lit(f"data:{kind};base64,"), F.base64(data)))


def write_images(images: DataFrame, folder: str, name: str, data: str) -> None:
    """One row an image below folder/name, as Parquet: any store, whole files only. base64(data) gives text for pages."""
    images.select("run_id", "track_id", data).write.mode("overwrite").parquet(f"{folder}/{name}")


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """One row as JSON and as a report with a verdict computed from it."""
    row = metrics.first().asDict()
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "evaluation.json").write_text(json.dumps(row, indent=2), encoding="utf-8")
    lines = [f"| {name} | {value} |" for name, value in row.items()]
    Path(folder, "evaluation.md").write_text("\n".join(["# Evaluation", "", "| metric | value |", "| - | - |", *lines, ""]), encoding="utf-8")


def reset_outputs(folder: str) -> None:
    """Empties a mission's outputs: an empty collection, an empty KML and no evidence files."""
    where = Path(folder)
    for path in [*where.glob("evidence/*"), *where.glob("diagnostics/*")]:
        path.unlink()
    _stream(str(where / "survivors.geojson"), '{"type": "FeatureCollection", "features": [', [], "", "]}\n")
    _stream(str(where / "survivors.kml"), '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>', [], "", "</Document></kml>\n")
