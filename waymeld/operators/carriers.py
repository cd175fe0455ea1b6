"""Coverage along carrier lines: pieces of one straight line, whatever its bearing, counted once.

A piece is named by the line that carries it, as a bearing in steps of 1e-5 rad (reverse travel
has the same one) and a distance from the origin in steps of 1 m, both in the Mercator plane.
Its ends become places along that line, so that overlap is an interval union.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import MERCATOR_M, mercator_x, mercator_y
from .intervals import interval_union

# Steps of a bearing in a radian, and limits of latitude (degrees), length and gap (metres).
BEARINGS = 100_000
FAR_LAT, LEAST_M, GAP_M = 85.0, 0.01, 0.5


def _nearest(value: Column) -> Column:
    return F.floor(value + 0.5)


def _real(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != math.inf)


def on_carriers(segments: DataFrame, a: tuple[str, str] = ("ax", "ay"), b: tuple[str, str] = ("bx", "by")) -> DataFrame:
    """Add bearing, offset and [lo_mm, hi_mm] along the carrier to segments given by lng, lat ends.

    Rows with a null or non-finite coordinate, beyond 85 degrees, or under a centimetre have no carrier and go.
    """
    whole = _real(F.col(a[0]))
    for c in (a[1], *b):
        whole = whole & _real(F.col(c))
    plane = (segments.where(whole & (F.abs(a[1]) <= FAR_LAT) & (F.abs(b[1]) <= FAR_LAT))
             .withColumns({"_ax": mercator_x(a[0]), "_ay": mercator_y(a[1]), "_bx": mercator_x(b[0]), "_by": mercator_y(b[1])})
             .where(F.hypot(F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")) >= LEAST_M))
    turn = F.atan2(F.col("_by") - F.col("_ay"), F.col("_bx") - F.col("_ax"))
    aimed = plane.withColumn("bearing", _nearest(F.pmod(turn, F.lit(math.pi)) * BEARINGS)).withColumns(
        {"_ux": F.cos(F.col("bearing") / BEARINGS), "_uy": F.sin(F.col("bearing") / BEARINGS)})
    along = lambda x, y: _nearest((F.col(x) * F.col("_ux") + F.col(y) * F.col("_uy")) * 1000)
    return aimed.select(*segments.columns, "bearing", _nearest(F.col("_ay") * F.col("_ux") - F.col("_ax") * F.col("_uy")).alias("offset"),
                        F.least(along("_ax", "_ay"), along("_bx", "_by")).alias("lo_mm"), F.greatest(along("_ax", "_ay"), along("_bx", "_by")).alias("hi_mm"))


def collinear_coverage(segments: DataFrame, keys: list[str] | None = None, **ends) -> DataFrame:
    """Disjoint pieces of each carrier (and key) with their ground length: keys, bearing, offset, lo_mm, hi_mm, length_m.

    Repeats, reverse travel, splits and gaps of up to half a metre are merged. The plane stretches by the
    latitude, so a piece counts by the scale at its middle, whichever segment came first. Null keys go.
    """
    line = [*(keys or []), "bearing", "offset"]
    pieces = interval_union(on_carriers(segments, **ends), line, "lo_mm", "hi_mm", eps=GAP_M * 1000, width=float(1 << 22))
    theta, middle = F.col("bearing") / BEARINGS, (F.col("lo_mm") + F.col("hi_mm")) / 2000
    north = middle * F.sin(theta) + F.col("offset") * F.cos(theta)
    return pieces.withColumn("length_m", (F.col("hi_mm") - F.col("lo_mm")) / 1000 / F.cosh(north / MERCATOR_M))
