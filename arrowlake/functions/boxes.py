"""Box arithmetic on corner columns x1, y1, x2, y2. Boxes of a side are named by a prefix (``a.`` or ``b.``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ["x1", "y1", "x2", "y2"]


def corners(side: str = "") -> list[Column]:
    return [F.col(f"{side}{c}") for c in CORNERS]


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x1": x, "y1": y, "x2": x + w, "y2": y + h}


def from_cxcywh(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def to_xywh(side: str = "") -> dict[str, Column]:
    x1, y1, x2, y2 = corners(side)
    return {"x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1}


def to_cxcywh(side: str = "") -> dict[str, Column]:
    x1, y1, x2, y2 = corners(side)
    return {"cx": (x1 + x2) / 2, "cy": (y1 + y2) / 2, "w": x2 - x1, "h": y2 - y1}


def expanded(by: float, side: str = "") -> dict[str, Column]:
    x1, y1, x2, y2 = corners(side)
    return {"x1": x1 - by, "y1": y1 - by, "x2": x2 + by, "y2": y2 + by}


def scaled(sx: Column, sy: Column, side: str = "") -> dict[str, Column]:
    x1, y1, x2, y2 = corners(side)
    return {"x1": x1 * sx, "y1": y1 * sy, "x2": x2 * sx, "y2": y2 * sy}


def shrunk(ratio: float, side: str = "") -> dict[str, Column]:
    """The box about the same centre with ``ratio`` of the area."""
    x1, y1, x2, y2 = corners(side)
    keep = (1 - ratio**0.5) / 2
    return {"x1": x1 + (x2 - x1) * keep, "y1": y1 + (y2 - y1) * keep, "x2": x2 - (x2 - x1) * keep, "y2": y2 - (y2 - y1) * keep}


def area(side: str = "") -> Column:
    x1, y1, x2, y2 = corners(side)
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def intersection(a: str = "a.", b: str = "b.") -> Column:
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = corners(a), corners(b)
    w, h = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlap(kind: str, a: str = "a.", b: str = "b.") -> Column:
    """iou; ioa (over b's area) or ioa_first (over a's); iom (over the smaller); giou. 0 where disjoint or degenerate, but for giou."""
    inter, one, two = intersection(a, b), area(a), area(b)
    union = one + two - inter
    if kind == "giou":
        (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = corners(a), corners(b)
        hull = (F.greatest(ax2, bx2) - F.least(ax1, bx1)) * (F.greatest(ay2, by2) - F.least(ay1, by1))
        return F.coalesce(F.try_divide(inter, union), F.lit(0.0)) - F.coalesce(F.try_divide(hull - union, hull), F.lit(0.0))
    below = {"iou": union, "ioa": two, "ioa_first": one, "iom": F.least(one, two)}[kind]
    return F.when(inter > 0, F.coalesce(F.try_divide(inter, below), F.lit(0.0))).otherwise(0.0)


def contains(outer: str, x: Column, y: Column) -> Column:
    x1, y1, x2, y2 = corners(outer)
    return x.between(x1, x2) & y.between(y1, y2)


def distance_to(side: str, x: Column, y: Column) -> Column:
    """Distance of a point to a box; 0 inside."""
    x1, y1, x2, y2 = corners(side)
    dx, dy = F.greatest(x1 - x, x - x2, F.lit(0.0)), F.greatest(y1 - y, y - y2, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)
