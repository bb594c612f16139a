"""From tracker boxes to detections, overview and best detection per track."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.operators import tracks as t
from reefline.operators.inventory import new_videos
from reefline.schemas import DETECTIONS
from reefline.sources.tables import append_table


@dataclass(frozen=True)
class DetectionRun:
    detections: DataFrame
    overview: DataFrame
    best: DataFrame


def detection_run(
    boxes: DataFrame,
    input_root: str,
    fps: float,
    threshold: float = 0.25,
    folder_depth: int = 0,
    periods: DataFrame | None = None,
    first_id: int = 0,
) -> DetectionRun:
    """Shape, filter and number the boxes of many videos at once.

    ``periods`` keeps only frames of the stable period of each video. ``first_id``
    continues the numbering of an earlier run.
    """
    shaped = t.confident(t.shape_detections(boxes, input_root, folder_depth), threshold)
    if periods is not None:
        shaped = t.inside_stable_period(shaped, periods)
    survivors = t.surviving_tracks(shaped, fps)
    numbered = t.global_track_ids(shaped, survivors).withColumn(
        "track_id", F.col("track_id") + first_id
    )
    folders = sorted(c for c in numbered.columns if c.startswith("folder"))
    detections = numbered.select(*[f.name for f in DETECTIONS.fields], *folders)
    videos = boxes.select(t.strip_prefix(F.col("video_path"), input_root).alias("video_path")).distinct()
    return DetectionRun(
        detections, t.overview(survivors, videos), t.best_detections(detections)
    )


def continue_run(
    boxes: DataFrame, done: DataFrame, input_root: str, fps: float, **options
) -> DetectionRun:
    """Process only videos that ``done``, the overview of earlier runs, does not list."""
    path = t.strip_prefix(F.col("video_path"), input_root)
    waiting = new_videos(boxes.select(path.alias("video_path")).distinct(), done)
    fresh = (
        boxes.withColumn("_key", path)
        .join(waiting.withColumnRenamed("video_path", "_key"), "_key", "left_semi")
        .drop("_key")
    )
    found = t.run_totals(done).first()["tracks_found"]
    return detection_run(fresh, input_root, fps, first_id=int(found), **options)


def save_run(run: DetectionRun, folder: str, fmt: str = "parquet") -> None:
    append_table(run.detections, f"{folder}/output", fmt)
    append_table(run.overview, f"{folder}/overview", fmt)
