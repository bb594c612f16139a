"""MaxN report, suggestion update, combined metadata, training set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.functions.clock import clock_to_seconds
from reefline.functions.paths import station_folder, thumbnail_name
from reefline.operators import history as h
from reefline.operators import maxn as m
from reefline.operators import suggest, training
from reefline.operators.inventory import METADATA_EXTENSIONS, map_collections, video_inventory
from reefline.operators.metadata import combine_metadata
from reefline.operators.tracks import best_detections
from reefline.schemas import TRACK_KEY
from reefline.session import reliable_checkpoint
from reefline.sources import tables


def maxn_report(
    detections: DataFrame,
    labels: DataFrame,
    chapters: bool = False,
    on: Sequence[str] = ("track_id",),
) -> tuple[DataFrame, DataFrame]:
    """MaxN of reviewed detections, in report order, and the share of usable labels.

    ``labels`` come from :func:`reefline.sources.tables.read_label_names`; a name
    that does not parse, or a track with two names, stops the report.
    """
    if "problem" in labels.columns:
        bad = labels.filter(F.col("problem").isNotNull()).limit(1).collect()
        if bad:
            raise ValueError(f"unusable label file: {bad[0]['name']} ({bad[0]['problem']})")
    cleaned = m.apply_human_labels(detections, labels, on)
    table = m.maxn_by_chapter(cleaned) if chapters else m.maxn_by_video(cleaned)
    return m.maxn_ordered(table), m.label_confidence(labels)


def suggestion_update(
    validation: DataFrame, history: DataFrame, window_seconds: float = 120.0
) -> dict[str, DataFrame]:
    """Predictions, the new history, its accuracy, its confusions and the species suggested.

    ``validation`` is a cleaned validation table with time_seconds. It is written
    once to the shared folder, because the plans read it several times.
    """
    table = reliable_checkpoint(suggest.with_time_ms(validation))
    predicted = reliable_checkpoint(suggest.predictions(table, int(window_seconds * 1000)))
    resolved = h.update_history(history, predicted, table)
    return {
        "predictions": predicted,
        "history": resolved.drop("in_validation", "outcome_now"),
        "accuracy": h.accuracy(resolved),
        "confusion": h.confusion(resolved),
        "distribution": suggest.suggestion_distribution(predicted),
    }


def save_suggestions(update: dict[str, DataFrame], folder: str, version: str) -> None:
    """JSON rows of each run in its own folder: predictions and history keyed by
    ``collection|station|video|track``, the accuracy summary and the confusions."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in TRACK_KEY]).alias("key")
    for name in ("predictions", "history"):
        tables.write_table(update[name].select(key, "*"), f"{folder}/{version}/{name}", "json")
    for name in ("accuracy", "confusion"):
        tables.write_table(update[name], f"{folder}/{version}/{name}", "json")


ACCURACY = "total_suggestions_made bigint, correct bigint, incorrect bigint, pending bigint, accuracy_percent double"
CONFUSION = "suggested_species string, actual string, n bigint"


def read_saved(spark: SparkSession, folder: str, version: str) -> tuple[DataFrame, DataFrame]:
    """The accuracy summary and the confusions of a saved run."""
    kept = f"{folder}/{version}"
    return spark.read.schema(ACCURACY).json(f"{kept}/accuracy"), spark.read.schema(CONFUSION).json(f"{kept}/confusion")


def thumbnail_table(all_tracks: DataFrame, base_dirs: dict[str, str]) -> DataFrame:
    """Best detection of each track with its thumbnail name, seconds and video path."""
    best = best_detections(all_tracks, TRACK_KEY)
    return map_collections(best, base_dirs).select(
        thumbnail_name(F.col("bruv_station"), F.col("video_id"), F.col("track_id")).alias("thumbnail"),
        *TRACK_KEY,
        "frame",
        "time",
        clock_to_seconds(F.col("time")).alias("time_seconds"),
        F.when(
            F.col("base_dir") != "orphaned",
            F.concat_ws(
                "/",
                "base_dir",
                station_folder(F.col("bruv_station")),
                F.concat(F.col("video_id"), F.lit(".MP4")),
            ),
        )
        .otherwise(F.lit(""))
        .alias("video_path"),
        "confidence",
        "xmin",
        "ymin",
        "xmax",
        "ymax",
    )


def combined_metadata(
    spark: SparkSession,
    video_folder: str,
    user_file: str | None = None,
    camera: DataFrame | None = None,
    maxn: DataFrame | None = None,
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """One metadata row per video file below a folder."""
    videos = video_inventory(
        tables.read_video_files(spark, video_folder), METADATA_EXTENSIONS
    ).select(F.element_at(F.split("video_path", "/"), -1).alias("video_filename"), "video_path")
    user = tables.read_user_metadata(spark, user_file) if user_file else None
    wide = m.maxn_wide(m.maxn_wide_key(maxn), labels) if maxn is not None else None
    return combine_metadata(videos, user, camera, wide)


def training_set(validation: DataFrame, detections: DataFrame, key: Sequence[str]) -> dict[str, DataFrame]:
    """Labels, class index, frame manifest and extraction counts for training a classifier."""
    labels = training.labels_from_validation(validation)
    manifest = training.frame_manifest(training.track_windows(validation, detections, key))
    return {
        "labels": labels,
        "distribution": training.class_distribution(labels),
        "classes": training.class_index(labels),
        "manifest": manifest,
        "statistics": training.extraction_stats(manifest),
    }
