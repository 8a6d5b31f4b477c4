"""Ground entities: clustering of sightings by distance, record deduplication, and their aggregates.

Clustering depends on the order of sightings, for a merge moves the entity that later ones are compared with. Classes
and runs don't interact, so they are the unit of parallelism. Within one, a grid of cells as wide as the radius finds
the entities nearby; a sighting looks at a few cells, not at all entities.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgewatch.functions.exact import exact_round
from ridgewatch.functions.geo import EARTH_RADIUS_M
from ridgewatch.operators.fold import fold_sorted


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """The haversine distance of functions.geo, for one pair."""
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


class Grid:
    """Points by cell; near() gives all whose distance may be within the radius."""

    def __init__(self, radius_m: float) -> None:
        self.cell = max(radius_m, 1e-3) / 110_000.0
        self.members: dict[tuple[int, int], set[int]] = defaultdict(set)
        self.at: dict[int, tuple[int, int]] = {}

    def _cell(self, lat: float, lon: float) -> tuple[int, int]:
        return math.floor(lat / self.cell), math.floor(lon / self.cell)

    def put(self, number: int, lat: float, lon: float) -> None:
        new = self._cell(lat, lon)
        if (old := self.at.get(number)) != new:
            if old is not None:
                self.members[old].discard(number)
            self.members[new].add(number)
            self.at[number] = new

    def near(self, lat: float, lon: float) -> list[int]:
        row, column = self._cell(lat, lon)
        shrink = math.cos(math.radians(min(89.9, abs(lat) + 2 * self.cell)))
        reach = math.ceil(1 / max(shrink, 1e-3)) + 1
        if reach > len(self.at):  # near a pole a cell's width shrinks: look at all
            return sorted(self.at)
        cells = ((r, c) for r in range(row - 1, row + 2) for c in range(column - reach, column + reach + 1))
        return sorted(n for cell in cells for n in self.members.get(cell, ()))


ENTITY = (
    "run_id bigint, class_name string, local_id int, latitude double, longitude double, best_confidence double, "
    "is_stationary boolean, status string, thermal_delta double, error_radius_m double, first_detected_ms double, "
    "last_detected_ms double, total_hits bigint, observation_count int, track_ids array<bigint>, best_sighting bigint, "
    "first_sighting bigint, trajectory array<struct<lat:double,lon:double>>"
)
SIGHTING = (
    "run_id", "class_name", "track_id", "lat", "lon", "confidence", "is_stationary", "thermal_delta", "error_radius_m",
    "timestamp_ms", "hits",
)


class Clustering:
    """The entities of one run and class; see() takes its next sighting."""

    def __init__(self, radius_m: float, still_m: float) -> None:
        self.radius_m, self.still_m = radius_m, still_m
        self.entities: list[dict] = []
        self.grid = Grid(radius_m)

    def see(self, row: dict) -> None:
        found = [(metres(row["lat"], row["lon"], e["lat"], e["lon"]), n) for n in self.grid.near(row["lat"], row["lon"]) for e in (self.entities[n],)]
        _, number = min(((d, n) for d, n in found if d <= self.radius_m), default=(None, None))
        if number is None:
            number = len(self.entities)
            new = {k: row[k] for k in SIGHTING}
            new |= {"first": row["timestamp_ms"], "last": row["timestamp_ms"], "count": 1, "tracks": {row["track_id"]: None}}
            new |= {"path": [(row["lat"], row["lon"])], "best": row["track_id"], "opened_by": row["track_id"]}
            self.entities.append(new)
        else:
            self._merge(self.entities[number], row)
        self.grid.put(number, self.entities[number]["lat"], self.entities[number]["lon"])

    def _merge(self, e: dict, row: dict) -> None:
        e["count"] += 1
        e["hits"] += row["hits"]
        e["last"] = max(e["last"], row["timestamp_ms"])
        e["tracks"][row["track_id"]] = None
        e["path"].append((row["lat"], row["lon"]))
        total = e["confidence"] + row["confidence"]
        old = e["confidence"] / total if total else 0.5
        new = row["confidence"] / total if total else 0.5
        e["lat"], e["lon"] = old * e["lat"] + new * row["lat"], old * e["lon"] + new * row["lon"]
        if row["confidence"] > e["confidence"]:
            e["confidence"], e["best"] = row["confidence"], row["track_id"]
        if row["thermal_delta"] is not None and (e["thermal_delta"] is None or row["thermal_delta"] > e["thermal_delta"]):
            e["thermal_delta"] = row["thermal_delta"]
        e["is_stationary"] = metres(*e["path"][0], *e["path"][-1]) < self.still_m

    def rows(self) -> Iterator[tuple]:
        for number, e in enumerate(self.entities):
            yield (
                e["run_id"], e["class_name"], number, e["lat"], e["lon"], e["confidence"], e["is_stationary"],
                "STATIONARY" if e["is_stationary"] else "MOBILE", e["thermal_delta"], e["error_radius_m"], e["first"],
                e["last"], e["hits"], e["count"], list(e["tracks"]), e["best"], e["opened_by"],
                [{"lat": a, "lon": b} for a, b in e["path"]],
            )


def cluster(sightings: DataFrame, radius_m: float = 8.0, still_m: float = 3.0) -> DataFrame:
    """Entities of sightings in order of time, then track; entity_id counts a run's entities by their first sighting."""

    def step(state: Clustering, row: dict) -> tuple:
        state.see(row)
        return ()

    found = fold_sorted(
        sightings.select(*SIGHTING), ["run_id", "class_name"], ["timestamp_ms", "track_id"],
        lambda row: Clustering(radius_m, still_m), step, ENTITY, lambda state: state.rows(),
    )
    by_first = Window.partitionBy("run_id").orderBy("first_detected_ms", "first_sighting", "class_name", "local_id")
    return found.withColumn("entity_id", F.row_number().over(by_first))


def confirmed(entities: DataFrame, min_hits: int = 3) -> DataFrame:
    """Entities with enough hits; all of a run where none has."""
    enough = F.col("total_hits") >= min_hits
    any_enough = F.max(enough).over(Window.partitionBy("run_id"))
    return entities.withColumn("_any", any_enough).where(enough | ~F.col("_any")).drop("_any")


def ranked_entities(entities: DataFrame) -> DataFrame:
    """rank by hits, then confidence, falling; ties by entity_id."""
    order = Window.partitionBy("run_id").orderBy(F.desc("total_hits"), F.desc("best_confidence"), "entity_id")
    return entities.withColumn("rank", F.row_number().over(order))


def clustering_statistics(entities: DataFrame, min_hits: int = 3) -> DataFrame:
    """Per run: sightings, suppressed ones and their share, entities and confirmed ones."""
    seen, made = F.sum("observation_count"), F.count("*")
    return entities.groupBy("run_id").agg(
        seen.alias("total_raw_sightings"), (seen - made).alias("total_duplicate_suppressions"),
        exact_round((seen - made) / seen * 100.0, 2).alias("deduplication_ratio_pct"), made.alias("total_ground_entities"),
        F.count_if(F.col("total_hits") >= min_hits).alias("confirmed_unique_survivors"),
    )


def merge_records(records: DataFrame, radius_m: float = 8.0) -> DataFrame:
    """Records in list order (place): each joins the first of its class within the radius, or is kept with its columns.

    A kept record adds up hits, takes the latest time (last_detected_ms), and of a more confident record its confidence,
    its evidence (best_record) and the higher score; merged counts its records. Its position, and so the grid, stays.
    """
    names = [*records.columns, "best_record", "merged"]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema]

    def start(row: dict) -> dict:
        return {"grid": Grid(radius_m), "kept": []}

    def step(state: dict, row: dict) -> tuple:
        kept = state["kept"]
        for n in state["grid"].near(row["latitude"], row["longitude"]):
            e = kept[n]
            if metres(row["latitude"], row["longitude"], e["latitude"], e["longitude"]) <= radius_m:
                e["hits"] += row["hits"]
                e["last_detected_ms"] = max(e["last_detected_ms"], row["last_detected_ms"])
                e["merged"] += 1
                if row["confidence"] > e["confidence"]:
                    e["confidence"], e["best_record"] = row["confidence"], row["track_id"]
                    e["triage_score"] = max(e["triage_score"], row["triage_score"])
                return ()
        state["grid"].put(len(kept), row["latitude"], row["longitude"])
        kept.append(row | {"best_record": row["track_id"], "merged": 1})
        return ()

    def finish(state: dict) -> Iterator[tuple]:
        for e in state["kept"]:
            yield tuple(e[n] for n in names)

    schema = ", ".join([*kinds, "best_record bigint", "merged int"])
    return fold_sorted(records, ["run_id", "class_name"], ["place"], start, step, schema, finish)


def radius_pairs(left: DataFrame, right: DataFrame, radius_m: float, max_lat: float) -> DataFrame:
    """Pairs of a class within the radius, by an equi-join on grid cells (right side in its cell and its neighbours).

    left and right: class_name, lat, lon and their own further columns; max_lat: the highest latitude in the data.
    """
    from ridgewatch.functions.geo import haversine_m

    lat_cell = radius_m / 110_000.0
    lon_cell = lat_cell / max(1e-6, math.cos(math.radians(min(89.9, max_lat))))
    cell = lambda c, size: F.floor(F.col(c) / size)
    own = left.select(F.struct("*").alias("l"), "class_name", cell("lat", lat_cell).alias("r"), cell("lon", lon_cell).alias("c"))
    around = right.select(
        F.struct("*").alias("g"), "class_name", cell("lat", lat_cell).alias("r0"), cell("lon", lon_cell).alias("c0")
    )
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = around.select("g", "class_name", F.inline(shifts), "r0", "c0").select(
        "g", "class_name", (F.col("r0") + F.col("i")).alias("r"), (F.col("c0") + F.col("j")).alias("c")
    )
    distance = haversine_m(F.col("l.lat"), F.col("l.lon"), F.col("g.lat"), F.col("g.lon"))
    return own.join(spread, ["class_name", "r", "c"]).withColumn("distance_m", distance).where(
        F.col("distance_m") <= radius_m
    ).select("l", "g", "distance_m")
