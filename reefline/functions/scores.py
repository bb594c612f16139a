"""Bands, labels and probabilities computed from numbers already in the row.

The limits and weights of these rules are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.8, F.lit("high"))
        .when(confidence >= 0.5, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def clarity_label(clarity: Column) -> Column:
    """Only a missing value is 'Not analysed'; 0.0 is a measurement."""
    return (
        F.when(clarity > 0.8, F.lit("Excellent"))
        .when(clarity > 0.6, F.lit("Good"))
        .when(clarity > 0.4, F.lit("Fair"))
        .when(clarity.isNotNull(), F.lit("Poor"))
        .otherwise(F.lit("Not analysed"))
    )


def light_label(light: Column) -> Column:
    return (
        F.when(light > 0.7, F.lit("Bright"))
        .when(light > 0.4, F.lit("Moderate"))
        .when(light.isNotNull(), F.lit("Low light conditions"))
        .otherwise(F.lit("Not analysed"))
    )


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole rounded, 0 when the whole is 0."""
    return F.bround(
        F.coalesce(F.try_divide(part * F.lit(100.0), whole.cast("double")), F.lit(0.0)), digits
    )


def percent_text(share: Column) -> Column:
    """0.873 as '87.3%'."""
    return F.format_string("%.1f%%", share * 100.0)


def expected_surface_height(depth_m: Column) -> Column:
    """Where the water surface shows in the frame, as a share of its height from the top."""
    return (
        F.when(F.coalesce(depth_m, F.lit(0.0)) <= 0, F.lit(0.2))
        .when(depth_m < 2, F.lit(0.15))
        .when(depth_m < 5, F.lit(0.10))
        .when(depth_m < 10, F.lit(0.05))
        .otherwise(F.lit(0.02))
    )


def surface_probability(
    ymin: Column, frame_height: Column, depth_m: Column, blue_variance: Column, texture: Column
) -> Column:
    """Chance that a box shows the water surface: position, expected height, colour, texture."""
    top = ymin.cast("int") / frame_height
    near = F.greatest(
        F.lit(0.0), F.lit(1.0) - F.abs(top - expected_surface_height(depth_m)) * F.lit(5.0)
    )
    return (
        (F.lit(1.0) - top) * F.lit(0.30)
        + near * F.lit(0.25)
        + blue_variance * F.lit(0.25)
        + texture * F.lit(0.20)
    )


def crop_box(
    xmin: Column,
    ymin: Column,
    xmax: Column,
    ymax: Column,
    width: Column,
    height: Column,
    share: float | None = None,
    pixels: int | None = None,
) -> dict[str, Column]:
    """Box grown by a share of its size or by pixels, clamped to the frame."""
    x1, y1, x2, y2 = (c.cast("int") for c in (xmin, ymin, xmax, ymax))
    if share is not None:
        pad_x = ((x2 - x1) * F.lit(float(share))).cast("int")
        pad_y = ((y2 - y1) * F.lit(float(share))).cast("int")
    else:
        pad_x = pad_y = F.lit(int(pixels or 0))
    return {
        "crop_x1": F.greatest(F.lit(0), x1 - pad_x),
        "crop_y1": F.greatest(F.lit(0), y1 - pad_y),
        "crop_x2": F.least(width.cast("int"), x2 + pad_x),
        "crop_y2": F.least(height.cast("int"), y2 + pad_y),
    }


def sample_times(
    start_ms: Column, end_ms: Column, most: int = 20, every_ms: int = 200
) -> Column:
    """Evenly spaced times from start to end, at least three.

    A track shorter than 100 ms counts as two seconds when choosing how many.
    """
    length = end_ms - start_ms
    counted = F.when(length < 100, F.lit(2000).cast("bigint")).otherwise(length)
    n = F.greatest(
        F.lit(3).cast("bigint"),
        F.least(F.lit(most).cast("bigint"), F.call_function("div", counted, F.lit(every_ms).cast("bigint"))),
    )
    step = length.cast("double") / (n - 1)
    times = F.transform(
        F.sequence(F.lit(0).cast("bigint"), n - 1),
        lambda i: F.when(i == n - 1, end_ms).otherwise(
            (start_ms.cast("double") + i.cast("double") * step).cast("bigint")
        ),
    )
    return times
