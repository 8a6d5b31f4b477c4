"""Geodesy and camera geometry as column expressions: everything stays inside code generation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgewatch.functions.exact import exact_round

# The mean Earth radius of the haversine, and WGS84's semi-major axis and squared eccentricity.
EARTH_RADIUS_M = 6_371_000.0
WGS84_A = 6_378_137.0
WGS84_E2 = 0.00669437999014
METRES_PER_DEGREE = 111_139.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_lat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2.0)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def radii(lat_rad: Column) -> tuple[Column, Column]:
    """Meridian and prime-vertical radii of curvature at a latitude in radians."""
    w2 = 1 - WGS84_E2 * F.pow(F.sin(lat_rad), 2.0)
    return WGS84_A * (1 - WGS84_E2) / F.pow(w2, 1.5), WGS84_A / F.sqrt(w2)


def offset_to_wgs84(lat: Column, lon: Column, north_m: Column, east_m: Column) -> tuple[Column, Column]:
    """The position north_m and east_m away from a position, in degrees with 7 decimals."""
    phi = F.radians(lat)
    meridian, prime = radii(phi)
    d_lon = F.when(F.cos(phi) == 0, 0.0).otherwise(east_m / (prime * F.cos(phi)))
    return exact_round(lat + F.degrees(north_m / meridian), 7), exact_round(lon + F.degrees(d_lon), 7)


def local_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the ellipsoid's tangent at the mean latitude."""
    mean = (F.radians(lat1) + F.radians(lat2)) / 2
    meridian, prime = radii(mean)
    return F.hypot(
        meridian * (F.radians(lat2) - F.radians(lat1)), prime * F.cos(mean) * (F.radians(lon2) - F.radians(lon1))
    )


def blend_angle(start: Column, end: Column, alpha: Column) -> Column:
    """The angle a share alpha along the shorter arc from start to end, in [0, 360)."""
    turn = F.pmod(end - start + 180.0, F.lit(360.0)) - 180.0
    return F.pmod(start + alpha * turn, F.lit(360.0))


@dataclass(frozen=True)
class Camera:
    """A pinhole camera with square pixels and a centred axis."""

    width: int = 3840
    height: int = 2160
    fov_deg: float = 84.0

    @property
    def focal(self) -> float:
        return self.width / 2 / math.tan(math.radians(self.fov_deg) / 2)

    def ray(self, u: Column, v: Column) -> tuple[Column, Column]:
        """Right and down components of the ray through a pixel, forward being 1."""
        return (u - self.width / 2) / self.focal, (v - self.height / 2) / self.focal

    def unit_ray(self, u: Column, v: Column) -> Column:
        """The ray through a pixel with length 1."""
        right, down = self.ray(u, v)
        size = F.sqrt(right * right + down * down + 1)
        return F.struct((right / size).alias("x"), (down / size).alias("y"), (1 / size).alias("z"))


def camera_to_ned(yaw: Column, pitch: Column, roll: Column) -> list[list[Column]]:
    """Rows north, east, down by columns right, down, forward of the camera; degrees."""
    sy, cy, sp, cp, sr, cr = (f(F.radians(a)) for a in (yaw, pitch, roll) for f in (F.sin, F.cos))
    right = [cy * sp * sr - sy * cr, sy * sp * sr + cy * cr, cp * sr]
    down = [cy * sp * cr + sy * sr, sy * sp * cr - cy * sr, cp * cr]
    forward = [cy * cp, sy * cp, -sp]
    return [list(row) for row in zip(right, down, forward)]


@dataclass(frozen=True)
class ErrorModel:
    """Uncertainty of the gimbal (degrees), the position fix and the altitude (metres)."""

    gimbal_deg: float = 1.0
    position_m: float = 1.5
    altitude_m: float = 0.5

    def radius(self, altitude: Column, look_deg: Column) -> Column:
        drift = altitude * math.tan(math.radians(self.gimbal_deg))
        return exact_round(drift + self.position_m + self.altitude_m * F.tan(F.radians(F.abs(look_deg))), 2)


def cast_pixel(
    u: Column, v: Column, lat: Column, lon: Column, altitude: Column, pitch: Column, roll: Column, yaw: Column,
    camera: Camera = Camera(), errors: ErrorModel = ErrorModel(), ground_m: float = 0.0,
) -> Column:
    """Where the ray through a pixel meets flat ground: latitude, longitude, error_radius_m, ground_distance_m.

    A ray at or above the horizon is held just below it (a far point), and below_horizon says so.
    """
    right, down = camera.ray(u, v)
    north, east, fall = (row[0] * right + row[1] * down + row[2] for row in camera_to_ned(yaw, pitch, roll))
    height = F.greatest(F.lit(1.0), altitude - ground_m)
    reach = height / F.greatest(fall, F.lit(1e-6))
    phi = F.radians(lat)
    meridian, prime = radii(phi)
    parallel = F.when(F.cos(phi) == 0, 1.0).otherwise(prime * F.cos(phi))
    distance = F.hypot(reach * north, reach * east)
    look = F.degrees(F.atan2(distance, height))
    return F.struct(
        exact_round(lat + F.degrees(reach * north / meridian), 7).alias("latitude"),
        exact_round(lon + F.degrees(reach * east / parallel), 7).alias("longitude"),
        errors.radius(altitude, look).alias("error_radius_m"),
        exact_round(distance, 2).alias("ground_distance_m"),
        (fall > 1e-6).alias("below_horizon"),
    )
