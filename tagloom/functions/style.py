"""Styles: radius, opacity, and colours mixed in OKLab."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CHOICES, NEUTRAL, OPACITY_BASE, OPACITY_MIN, OPACITY_RAISED, PALETTE, RADIUS_BASE, RADIUS_MAX, RADIUS_MIN, UNEVALUATED

# The published OKLab matrices.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.291485548))
TO_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))


def linear(c: float) -> float:
    """One sRGB channel, 0 to 1, as light."""
    return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4


def oklab(colour: str) -> tuple[float, ...]:
    rgb = [linear(int(colour[i : i + 2], 16) / 255) for i in (1, 3, 5)]
    lms = [sum(m * x for m, x in zip(row, rgb, strict=True)) ** (1 / 3) for row in TO_LMS]
    return tuple(sum(m * x for m, x in zip(row, lms, strict=True)) for row in TO_LAB)


def let(values: list[Column], body) -> Column:
    """``body`` of the values, each of which is computed once however often it is used."""
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.element_at(F.transform(F.array(bound), lambda s: body([s[f"v{i}"] for i in range(len(values))])), 1)


def product(matrix, vector: list[Column]) -> list[Column]:
    return [sum((F.lit(m) * c for m, c in zip(row[1:], vector[1:], strict=True)), F.lit(row[0]) * vector[0]) for row in matrix]


def hex_of(lab: list[Column]) -> Column:
    """``#rrggbb`` of an OKLab colour, channels clamped and rounded half up."""

    def digits(c: Column) -> Column:
        c = F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
        return F.lpad(F.lower(F.hex(F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5))), 2, "0")

    cubes = lambda v: [F.pow(x, F.lit(3.0)) for x in product(FROM_LAB, v)]
    return let(lab, lambda v: let(cubes(v), lambda q: let(product(TO_RGB, q), lambda c: F.concat(F.lit("#"), *map(digits, c)))))


def mix_colour(shares: list[Column]) -> Column:
    """The palette mixed by ``shares``; shares that are null or not positive don't count, and with none left it is unevaluated."""
    columns = list(zip(*map(oklab, PALETTE), strict=True))
    weights = [F.when(s > 0, s).otherwise(0.0) for s in shares]

    def mixed(w: list[Column]) -> Column:
        total = sum(w[1:], w[0])
        return F.when(total > 0, hex_of([x / total for x in product(columns, w)])).otherwise(UNEVALUATED)

    return let(weights, mixed)


def radius_for(score: Column) -> Column:
    high = RADIUS_BASE + (score - NEUTRAL) / NEUTRAL * (RADIUS_MAX - RADIUS_BASE)
    low = RADIUS_MIN + score / NEUTRAL * (RADIUS_BASE - RADIUS_MIN)
    return F.when(score.isNull(), RADIUS_BASE).when(score >= NEUTRAL, high).otherwise(low)


def opacity_for(score: Column) -> Column:
    low = OPACITY_MIN + score / NEUTRAL * (OPACITY_BASE - OPACITY_MIN)
    return F.when(score.isNull(), OPACITY_BASE).when(score >= NEUTRAL, OPACITY_RAISED).otherwise(low)


def top_choice(choice: Column) -> Column:
    """``struct<name, percent>`` of the first largest share."""
    best = F.array_max(choice)
    name = F.element_at(F.array(*map(F.lit, CHOICES)), F.array_position(choice, best).cast("int"))
    return F.when(best.isNotNull(), F.struct(name.alias("name"), F.floor(best * 100 + 0.5).cast("int").alias("percent")))


def three_way(score: Column) -> Column:
    """1 above 2.1, -1 below 1.9, else 0."""
    return F.when(score > 2.1, 1).when(score < 1.9, -1).otherwise(0)
