"""Map geometry: Web Mercator viewports and levels of detail."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import RESOLUTION_MARGIN


def viewport_bbox(lon: float, lat: float, zoom: float, width: int, height: int) -> tuple[float, float, float, float]:
    """Corners (lon, lat, lon, lat) of a screen of ``width`` by ``height`` pixels centred on a place."""
    step = math.tau / (512 * 2**zoom)  # radians of a pixel on the projected globe
    north = math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
    south, top = (math.degrees(2 * math.atan(math.exp(north + side * step * height / 2)) - math.pi / 2) for side in (-1, 1))
    aside = math.degrees(step * width / 2)
    return lon - aside, south, lon + aside, top


def screen_boxes(screens: DataFrame) -> DataFrame:
    """``screens`` (``lon, lat, zoom, width, height``) with the corners ``x0, y0, x1, y1`` of each, and ``degrees_a_pixel``."""
    pixel = F.lit(360.0) / (F.lit(512.0) * F.pow(F.lit(2.0), F.col("zoom")))
    aside = F.col("width") / 2 * pixel
    north = F.ln(F.tan(F.radians(F.col("lat")) / 2 + math.pi / 4))
    edge = lambda side: F.degrees(F.atan(F.exp(north + side * F.radians(F.col("height") / 2 * pixel))) * 2 - math.pi / 2)
    return screens.select("*", (F.col("lon") - aside).alias("x0"), edge(-1).alias("y0"), (F.col("lon") + aside).alias("x1"), edge(1).alias("y1"), pixel.alias("degrees_a_pixel"))


def degrees_per_pixel(zoom: float) -> float:
    return 360 / (512 * 2**zoom)


def level_resolution(level: int) -> float:
    """Resolution of a level in a regular pyramid."""
    return 360 / (1024 * 2**level) * 0.9999954


def select_level(resolutions: Sequence[float], target: float) -> int:
    """The last of the leading levels that are at least as coarse as the target; 0 if the first isn't."""
    level = 0
    for i, r in enumerate(resolutions):
        if r < target:
            break
        level = i
    return level


def resolve_level(resolutions: Sequence[float], degrees_a_pixel: float, offset: int = 0) -> int:
    """Level for a screen: a margin on the target, the user's offset, and the pyramid's ends."""
    return max(0, min(len(resolutions) - 1, select_level(resolutions, degrees_a_pixel * RESOLUTION_MARGIN) + offset))


def levels_for(targets: DataFrame, levels: DataFrame) -> DataFrame:
    """``select_level`` for many targets (``target``) over a table ``level, resolution``: one aggregate over the few levels."""
    steps = F.sort_array(F.collect_list(F.struct("level", "resolution")))
    lv = F.broadcast(levels.agg(steps.alias("steps")))  # one row, one entry for each level
    ahead = F.filter("steps", lambda s: s["resolution"] < F.col("target"))
    first = F.array_min(F.transform(ahead, lambda s: s["level"]))
    last = F.array_max(F.transform("steps", lambda s: s["level"]))
    return targets.join(lv).select("target", F.greatest(F.coalesce(first - 1, last), F.lit(0)).alias("level"))


def intersects(bbox: str, q: tuple[float, float, float, float]) -> Column:
    """Rectangles that touch or overlap. Plain comparisons on nested fields, so the scan prunes by them."""
    return (F.col(f"{bbox}.xmax") >= q[0]) & (F.col(f"{bbox}.xmin") <= q[2]) & (F.col(f"{bbox}.ymax") >= q[1]) & (F.col(f"{bbox}.ymin") <= q[3])


def point_inside(lon: Column, lat: Column, q: tuple[float, float, float, float]) -> Column:
    return lon.between(q[0], q[2]) & lat.between(q[1], q[3])


def point_wkb(lon: float, lat: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, lon, lat)


def point_of(geometry: Column) -> Column:
    """``struct<lon, lat>`` of a little-endian WKB point, by built-in functions: the bytes as hex, reversed to a long."""
    h = F.hex(geometry)

    def number(start: int) -> Column:
        part = F.substring(h, start, 16)
        bits = [F.substring(part, 15 - 2 * i, 2) for i in range(8)]
        high = F.conv(F.concat(*bits[:4]), 16, 10).cast("long")
        low = F.conv(F.concat(*bits[4:]), 16, 10).cast("long")
        sign = F.when(high >= 2**31, -1.0).otherwise(1.0)
        exponent = F.shiftright(high, 20).bitwiseAND(2047)
        mantissa = high.bitwiseAND(2**20 - 1) * F.lit(2**32).cast("long") + low
        normal = (1 + mantissa / float(2**52)) * F.pow(F.lit(2.0), exponent - 1023)
        return sign * F.when(exponent == 0, mantissa / float(2**52) * 2.0**-1022).otherwise(normal)

    return F.when(geometry.isNotNull(), F.struct(number(11).alias("lon"), number(27).alias("lat")))


def screen_radius(radius: Column, zoom: float) -> Column:
    """Radius on screen: 0.533, 1 and 1.667 times at zooms 10, 14 and 18, linear between, constant beyond."""
    stops = ((10, 0.533), (14, 1.0), (18, 1.667))
    z = min(max(zoom, stops[0][0]), stops[-1][0])
    factor = next(b + (z - a) / (c - a) * (d - b) for (a, b), (c, d) in zip(stops, stops[1:], strict=False) if z <= c)
    return radius * factor
