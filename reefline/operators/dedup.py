"""Duplicate boxes of a video: exact by image hash and box, near by box alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.operators.ranking import top_rows

BOX = ("xmin", "ymin", "xmax", "ymax")


def whole_box() -> list[Column]:
    return [F.col(c).cast("int") for c in BOX]


def detection_hash(image_bits: Column) -> Column:
    """MD5 of the image's difference bits and the whole-number box."""
    box = F.concat_ws("_", *[c.cast("string") for c in whole_box()])
    return F.md5(F.concat_ws("_", image_bits, box))


def first_of_duplicates(
    detections: DataFrame, image_bits: Column, order: Sequence[Column], video: str = "video_path"
) -> DataFrame:
    """Keep the first detection of each (video, image bits, whole-number box)."""
    return top_rows(
        detections.withColumn("detection_hash", detection_hash(image_bits)),
        [video, "detection_hash"],
        order,
    )


def near_duplicates(
    detections: DataFrame, order: str, tolerance: int = 2, video: str = "video_path"
) -> DataFrame:
    """Distinct boxes per video, with ``duplicate`` = an earlier box is within the tolerance.

    ``order`` is a column that orders the detections of a video. Boxes are whole
    numbers and reduced to distinct ones first. In buckets of width
    8 * tolerance a box reaches at most two buckets per side, one for most, and a
    bucket holds a fixed number of distinct boxes, so no bucket can grow with the
    data. A row names its bucket by one hash; equal hashes are only candidates.
    """
    width = max(8 * tolerance, 1)
    boxes = detections.groupBy(
        video, *[c.alias(n) for c, n in zip(whole_box(), BOX, strict=True)]
    ).agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("detections"))
    earlier = boxes.select(
        video,
        F.xxhash64(*[F.floor(F.col(c) / width) for c in BOX]).alias("bucket"),
        *[F.col(c).alias(f"e_{c}") for c in BOX],
        F.col("first_seen").alias("e_seen"),
    )
    reached = [
        F.array_distinct(F.array(F.floor((F.col(c) - tolerance) / width), F.floor((F.col(c) + tolerance) / width)))
        for c in BOX
    ]
    reach = boxes.select(video, *BOX, "first_seen")
    for c, near in zip(BOX, reached, strict=True):
        reach = reach.withColumn(f"b_{c}", F.explode(near))
    reach = reach.select(video, *BOX, "first_seen", F.xxhash64(*[F.col(f"b_{c}") for c in BOX]).alias("bucket"))
    near = F.col("e_seen") < F.col("first_seen")
    for c in BOX:
        near = near & (F.abs(F.col(c) - F.col(f"e_{c}")) <= tolerance)
    hits = (
        reach.join(earlier, [video, "bucket"])
        .filter(near)
        .select(video, *BOX)
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    return (
        boxes.join(hits, [video, *BOX], "left")
        .withColumn("duplicate", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )
