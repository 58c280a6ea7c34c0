"""Box geometry as column expressions (PRJ-01..04, 14, 16, 19): everything stays in code generation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


@dataclass(frozen=True)
class Box:
    """Four corner columns."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return F.greatest(self.width, F.lit(0.0)) * F.greatest(self.height, F.lit(0.0))


def box(prefix: str = "", suffix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{c}{suffix}") for c in CORNERS])


def from_center(cx: Column, cy: Column, w: Column, h: Column, width: Column | float = 1.0, height: Column | float = 1.0) -> Box:
    """Corners of a centre-and-size box; with an image size, pixels of a normalised one."""
    return Box((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def to_center(b: Box, width: Column | float = 1.0, height: Column | float = 1.0) -> tuple[Column, Column, Column, Column]:
    return (b.x1 + b.x2) / 2 / width, (b.y1 + b.y2) / 2 / height, b.width / width, b.height / height


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box, eps: float = 1e-9) -> Column:
    """Intersection over union; the union is at least ``eps``."""
    inter = intersection(a, b)
    return inter / F.greatest(a.area + b.area - inter, F.lit(eps))


def edge_distance(b: Box, width: Column, height: Column) -> Column:
    """Distance to the nearest image edge as a share of the longer side, at least 0."""
    return F.greatest(F.least(b.x1, b.y1, width - b.x2, height - b.y2) / F.greatest(width, height), F.lit(0.0))


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Starts of tiles along a side: steps of tile - overlap, the last tile flush with the end; one tile if the side is short."""
    last = length - tile
    steps = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(tile - overlap))
    return F.when(last <= 0, F.array(F.lit(0).cast("int"))).otherwise(F.array_union(steps, F.array(last))).cast("array<int>")


def pair_similarity(zdx: Column, zdy: Column, zarea: Column, zshape: Column, sim: Column) -> Column:
    """Heuristic link score of two views of an object from its z-scored displacement, area and shape and its class similarity."""
    cost = 0.5 * (zdx * zdx + zdy * zdy) + 0.12 * zarea * zarea + 0.08 * zshape * zshape + 0.10 * (1 - sim)
    return F.exp(-F.least(cost, F.lit(40.0)))
