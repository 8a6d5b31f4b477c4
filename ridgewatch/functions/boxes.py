"""Boxes in pixels (x1, y1, x2, y2) as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgewatch.functions.exact import exact_round


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @property
    def area(self) -> Column:
        return (self.x2 - self.x1) * (self.y2 - self.y1)

    @property
    def clamped_area(self) -> Column:
        return F.greatest(F.lit(0.0), self.x2 - self.x1) * F.greatest(F.lit(0.0), self.y2 - self.y1)

    def meet(self, other: Box) -> Column:
        """The area of the intersection."""
        return Box(
            F.greatest(self.x1, other.x1), F.greatest(self.y1, other.y1),
            F.least(self.x2, other.x2), F.least(self.y2, other.y2),
        ).clamped_area

    def hull(self, other: Box) -> Column:
        """The area of the smallest box around both."""
        return Box(
            F.least(self.x1, other.x1), F.least(self.y1, other.y1),
            F.greatest(self.x2, other.x2), F.greatest(self.y2, other.y2),
        ).area


def iou(a: Box, b: Box) -> Column:
    union = a.clamped_area + b.clamped_area - a.meet(b)
    return F.when(union <= 0, 0.0).otherwise(a.meet(b) / union)


def giou_cost(a: Box, b: Box) -> Column:
    """(1 - GIoU) / 2: 0 for equal boxes, towards 1 for boxes far apart."""
    meet = a.meet(b)
    union = a.area + b.area - meet
    overlap = F.when(union > 0, meet / union).otherwise(0.0)
    hull = F.greatest(F.lit(1e-6), a.hull(b))
    return (1 - (overlap - (hull - union) / hull)) / 2


def clip(box: Box, width: int, height: int) -> Box:
    inside = lambda c, most: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(most)))
    return Box(inside(box.x1, width), inside(box.y1, height), inside(box.x2, width), inside(box.y2, height))


def shifted(box: Box, x: Column, y: Column) -> Box:
    """A tile's box in the coordinates of its frame."""
    return Box(box.x1 + x, box.y1 + y, box.x2 + x, box.y2 + y)


def tile_starts(size: int, tile: int, overlap: float) -> list[int]:
    """Where tiles begin along a side; the last one ends at the side's end."""
    if tile >= size:
        return [0]
    step = max(1, int(tile * (1 - overlap)))
    starts = list(range(0, size - tile + 1, step))
    return starts if starts[-1] + tile >= size else [*starts, size - tile]


def tiles(width: int, height: int, tile_w: int, tile_h: int, overlap: float) -> Column:
    """The tile grid as an array of boxes, row by row."""
    xs, ys = tile_starts(width, tile_w, overlap), tile_starts(height, tile_h, overlap)
    return F.array(
        *[
            F.struct(
                F.lit(x).alias("x1"), F.lit(y).alias("y1"),
                F.lit(min(x + tile_w, width)).alias("x2"), F.lit(min(y + tile_h, height)).alias("y2"),
            )
            for y in ys for x in xs
        ]
    )


def crop_window(box: Box, width: int, height: int, share: float | None = 0.25, pixels: int = 60) -> Box:
    """A box padded by a share of its sides (at least 10 pixels long), or by pixels if share is None; whole pixels."""
    if share is None:
        pad_x = pad_y = F.lit(float(pixels))
    else:
        pad_x = share * F.greatest(F.lit(10.0), box.x2 - box.x1)
        pad_y = share * F.greatest(F.lit(10.0), box.y2 - box.y1)
    padded = clip(Box(box.x1 - pad_x, box.y1 - pad_y, box.x2 + pad_x, box.y2 + pad_y), width, height)
    return Box(*(c.cast("int") for c in (padded.x1, padded.y1, padded.x2, padded.y2)))


def to_centre(box: Box) -> Column:
    """Centre, aspect and height, with sides of at least 1."""
    w, h = F.greatest(F.lit(1.0), box.x2 - box.x1), F.greatest(F.lit(1.0), box.y2 - box.y1)
    return F.struct(
        (box.x1 + w / 2).alias("cx"), (box.y1 + h / 2).alias("cy"), (w / h).alias("aspect"), h.alias("height")
    )


def from_centre(c: Column) -> Box:
    w, h = c["aspect"] * c["height"], c["height"]
    x1, y1 = c["cx"] - w / 2, c["cy"] - h / 2
    return Box(*(exact_round(v, 2) for v in (x1, y1, x1 + w, y1 + h)))


# Names and ids that stand for the two classes.
HUMAN_NAMES = ("person", "human", "survivor")
ANIMAL_WORDS = ("animal", "dog", "cat", "horse", "cow", "sheep", "bird")
ANIMAL_IDS = (1, *range(14, 24))


def mapped_class(class_id: Column, name: Column) -> Column:
    """class_name and class_id after mapping onto human and animal; others keep their name in lower case."""
    low = F.lower(name)
    human = (class_id == 0) | low.isin(*HUMAN_NAMES)
    animal = class_id.isin(*ANIMAL_IDS) | low.rlike("|".join(ANIMAL_WORDS))
    return F.struct(
        F.when(human, "human").when(animal, "animal").otherwise(low).alias("class_name"),
        F.when(human, 0).when(animal, 1).otherwise(class_id).alias("class_id"),
    )
