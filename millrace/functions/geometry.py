"""Boxes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_xywh(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """(x1, y1, x2, y2) within [0, 1], four decimals; null for a box without area."""
    clip = lambda v, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size))
    x1, y1, x2, y2 = clip(x, width), clip(y, height), clip(x + w, width), clip(y + h, height)
    box = F.array(*[F.bround(v, 4) for v in (x1, y1, x2, y2)])
    return F.when((w > 0) & (h > 0) & (width > 0) & (height > 0) & (x2 > x1) & (y2 > y1), box)


def holds_relation(relation: Column, subject: Column, target: Column, margin: float = 0.02) -> Column:
    """Whether the subject's box centre lies to the claimed side of the target's, by more than ``margin``."""
    cs, co = (subject[0] + subject[2]) / 2, (target[0] + target[2]) / 2
    return F.when(relation == "left_of", cs + margin < co).when(relation == "right_of", cs > co + margin).otherwise(False)


def box_area(w: Column, h: Column) -> Column:
    return F.coalesce(F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)), F.lit(0.0))
