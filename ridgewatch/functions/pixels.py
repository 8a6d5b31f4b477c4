"""Statistics of small image arrays in NumPy, as Arrow-batched functions: the default behind the pixel plug points.

An image column is binary, row by row, one byte a pixel (grey) or three (blue, green, red), with its width beside it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STATISTICS = T.StructType(
    [*(T.StructField(c, T.DoubleType()) for c in ("sharpness", "brightness", "contrast")), T.StructField("nonzero", T.LongType())]
)
_DIFFERENCE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("changed_share", "mean_difference")])


def grey(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, width).astype(np.float64)


def laplacian_variance(image: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian; the border mirrors the row or column next to it."""
    wide = np.pad(image, 1, mode="reflect") if min(image.shape) > 1 else np.pad(image, 1, mode="edge")
    around = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:]
    return float((around - 4 * image).var())


def colour(data: bytes, width: int) -> np.ndarray:
    """Blue, green and red of each pixel."""
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, width, 3)


def to_grey(image: np.ndarray) -> np.ndarray:
    """Luma with the usual weights, in whole steps."""
    return np.rint(image @ np.array([0.114, 0.587, 0.299])).astype(np.float64)


def area_resize(image: np.ndarray, width: int = 640) -> np.ndarray:
    """Shrinks to a width by averaging the pixels under each new one; the height keeps the proportion."""
    old_height, old_width = image.shape[:2]
    if old_width <= width:
        return image.astype(np.float64)
    height = max(1, round(old_height * width / old_width))

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.linspace(0, old, new + 1)
        low, high = np.maximum(edges[:-1, None], np.arange(old)), np.minimum(edges[1:, None], np.arange(1, old + 1))
        return np.maximum(0, high - low) / (old / new)

    rows, columns = weights(old_height, height), weights(old_width, width)
    return np.einsum("ij,jk...,lk->il...", rows, image.astype(np.float64), columns)


def hue_saturation_histogram(image: np.ndarray, hues: int = 30, saturations: int = 32) -> np.ndarray:
    """Counts of pixels by hue and saturation."""
    rgb = image[..., ::-1].astype(np.float64) / 255
    top, low = rgb.max(axis=-1), rgb.min(axis=-1)
    span = np.where(top > low, top - low, 1)
    r, g, b = (rgb[..., k] for k in range(3))
    sector = np.where(top == r, (g - b) / span % 6, np.where(top == g, (b - r) / span + 2, (r - g) / span + 4))
    hue = np.where(top > low, sector / 6, 0)
    saturation = np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0)
    cells = np.minimum((hue * hues).astype(int), hues - 1) * saturations
    return np.bincount((cells + np.minimum((saturation * saturations).astype(int), saturations - 1)).ravel(), minlength=hues * saturations)


def likeness(image: np.ndarray, reference: np.ndarray | None) -> tuple[float | None, float | None]:
    """Histogram correlation and mean difference of all three colours to a reference of equal size; nothing without one."""
    if reference is None or image.shape != reference.shape:
        return None, None
    a, b = (hue_saturation_histogram(x).astype(np.float64) for x in (image, reference))
    a, b = a - a.mean(), b - b.mean()
    norm = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return (float((a * b).sum()) / norm if norm else 1.0), float(np.abs(image.astype(np.float64) - reference).mean())


def change(image: np.ndarray, before: np.ndarray | None) -> tuple[float | None, float | None]:
    """The share of grey pixels that differ by more than 25 and the mean difference to the frame before."""
    if before is None or image.shape != before.shape:
        return None, None
    difference = np.abs(to_grey(image) - to_grey(before))
    return float((difference > 25).mean()), float(difference.mean())


def png(image: np.ndarray) -> bytes:
    """A blue-green-red image as PNG."""
    height, width = image.shape[:2]
    lines = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(image[..., ::-1].astype(np.uint8)))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def crop_square(image: np.ndarray, window: tuple[int, int, int, int], size: int = 256, frame: bool = False) -> np.ndarray:
    """A window of an image as a square, by nearest pixels; with a frame drawn if asked; grey without pixels."""
    x1, y1, x2, y2 = window
    part = image[max(0, y1) : y2, max(0, x1) : x2]
    if not part.size:
        return np.full((size, size, 3), 40, np.uint8)
    rows, columns = (np.minimum(np.arange(size) * n // size, n - 1) for n in part.shape[:2])
    out = part[rows][:, columns].copy()
    if frame:
        for edge in (np.s_[:3], np.s_[-3:], np.s_[:, :3], np.s_[:, -3:]):
            out[edge] = (70, 57, 230)
    return out


@F.pandas_udf(
    T.StructType([T.StructField("raw_crop", T.BinaryType()), T.StructField("annotated_crop", T.BinaryType())])
)
def evidence_crops(
    data: pd.Series, width: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series
) -> pd.DataFrame:
    """Two PNG squares of a window of each colour image: as it is, and framed. A null image gives placeholders."""
    rows = []
    for raw, columns, *window in zip(data, width, x1, y1, x2, y2):
        image = colour(raw, int(columns)) if raw and not pd.isna(columns) else np.zeros((0, 0, 3), np.uint8)
        rows.append(tuple(png(crop_square(image, tuple(map(int, window)), frame=f)) for f in (False, True)))
    return pd.DataFrame(rows, columns=["raw_crop", "annotated_crop"])


def thermal_delta(image: np.ndarray, box: tuple[float, float, float, float]) -> float | None:
    """Mean inside a box less the mean of the padded region around it, which includes it."""
    height, width = image.shape
    x1, y1, x2, y2 = (round(v) for v in box)
    x1, y1, x2, y2 = max(0, x1), max(0, y1), min(width, x2), min(height, y2)
    if x2 <= x1 or y2 <= y1:
        return None
    px, py = max(10, (x2 - x1) // 2), max(10, (y2 - y1) // 2)
    region = image[max(0, y1 - py) : min(height, y2 + py), max(0, x1 - px) : min(width, x2 + px)]
    return round(float(image[y1:y2, x1:x2].mean() - region.mean()), 2)


@F.pandas_udf(_STATISTICS)
def image_statistics(data: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Sharpness, mean, population deviation and the number of pixels that aren't zero of grey images."""
    rows = []
    for raw, columns in zip(data, width):
        if not raw or pd.isna(columns):
            rows.append((None, None, None, 0))
            continue
        image = grey(raw, int(columns))
        rows.append((laplacian_variance(image), image.mean(), image.std(), int((image > 0).sum())))
    return pd.DataFrame(rows, columns=["sharpness", "brightness", "contrast", "nonzero"])


@F.pandas_udf(_DIFFERENCE)
def image_difference(data: pd.Series, before: pd.Series) -> pd.DataFrame:
    """The share of pixels that differ by more than 25 and the mean difference of two grey images of equal size."""
    rows = []
    for a, b in zip(data, before):
        if not a or not b or len(a) != len(b):
            rows.append((None, None))
            continue
        difference = np.abs(np.frombuffer(a, np.uint8).astype(np.int16) - np.frombuffer(b, np.uint8).astype(np.int16))
        rows.append((float((difference > 25).mean()), float(difference.mean())))
    return pd.DataFrame(rows, columns=["changed_share", "mean_difference"])


@F.pandas_udf(T.DoubleType())
def thermal_deltas(data: pd.Series, width: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if not raw or not any(raw) else thermal_delta(grey(raw, int(w)), box)
            for raw, w, *box in zip(data, width, x1, y1, x2, y2)
        ],
        dtype="float64",
    )
