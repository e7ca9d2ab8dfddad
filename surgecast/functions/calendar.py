"""Calendar features of a timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend"]


def calendar_features(ts: str) -> list[Column]:
    """Hour and weekday on the unit circle (Monday is 0), and the weekend flag."""
    hour = (F.hour(ts) + F.minute(ts) / 60.0) * (2 * math.pi / 24.0)
    weekday = F.weekday(ts)
    angle = weekday * (2 * math.pi / 7.0)
    return [
        F.sin(hour).alias("hour_sin"),
        F.cos(hour).alias("hour_cos"),
        F.sin(angle).alias("dow_sin"),
        F.cos(angle).alias("dow_cos"),
        F.when(weekday >= 5, 1).otherwise(0).alias("is_weekend"),
    ]
