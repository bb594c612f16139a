"""Video lists: which files count, which are new, how much work they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.functions.paths import basename, deployment_id, dirname, natural_number
from reefline.functions.scores import percent

# Video file endings, in lower case.
DETECTOR_EXTENSIONS = [".mp4", ".avi"]
METADATA_EXTENSIONS = [".mp4", ".avi", ".mov", ".mkv"]
SURVEY_EXTENSIONS = [".mp4", ".avi", ".mov", ".mkv", ".m4v"]


def is_video(path: Column, extensions: Sequence[str] = DETECTOR_EXTENSIONS) -> Column:
    """Visible file with one of the endings, in any case."""
    name = F.lower(basename(path))
    fits = F.lit(False)
    for e in extensions:
        fits = fits | name.endswith(e)
    return fits & ~name.startswith(".")


def video_inventory(
    files: DataFrame,
    extensions: Sequence[str] = DETECTOR_EXTENSIONS,
    stereo_prefix: str | None = None,
) -> DataFrame:
    kept = files.filter(is_video(F.col("video_path"), extensions))
    if stereo_prefix is not None:
        kept = kept.filter(basename(F.col("video_path")).startswith(stereo_prefix))
    return kept


def natural_order(videos: DataFrame) -> DataFrame:
    """Folder by folder, by the first number in the name, then by name."""
    name = basename(F.col("video_path"))
    return videos.orderBy(dirname(F.col("video_path")), natural_number(name), name)


def new_videos(videos: DataFrame, processed: DataFrame) -> DataFrame:
    return videos.join(processed.select("video_path"), "video_path", "left_anti")


def done_videos(videos: DataFrame, processed: DataFrame) -> DataFrame:
    return videos.join(processed.select("video_path"), "video_path", "left_semi")


def next_videos(videos: DataFrame, processed: DataFrame, limit: int) -> DataFrame:
    """The next videos to process when ``limit`` counts those already processed."""
    done = processed.select("video_path").distinct().count()
    return natural_order(new_videos(videos, processed)).limit(max(0, limit - done))


def incremental_status(videos: DataFrame, processed: DataFrame) -> DataFrame:
    """Totals of all, processed and new videos, and the tracks found so far."""
    both = videos.select(
        "video_path", F.lit(True).alias("_listed"), F.lit(None).cast("bigint").alias("tracks_found")
    ).unionByName(
        processed.select(
            "video_path",
            F.lit(False).alias("_listed"),
            F.col("tracks_found").cast("bigint").alias("tracks_found"),
        )
    )
    per_video = both.groupBy("video_path").agg(
        F.bool_or("_listed").alias("listed"),
        F.bool_or(~F.col("_listed")).alias("done"),
        F.sum("tracks_found").alias("tracks_found"),
    )
    listed, done = F.col("listed"), F.col("done")
    return per_video.agg(
        F.count_if(listed).alias("total_videos"),
        F.count_if(listed & done).alias("already_processed"),
        F.count_if(listed & ~done).alias("new_videos"),
        F.coalesce(F.sum("tracks_found"), F.lit(0)).alias("tracks_found_so_far"),
        F.coalesce(F.bool_or(done), F.lit(False)).alias("has_existing_results"),
    )


def map_collections(videos: DataFrame, base_dirs: dict[str, str]) -> DataFrame:
    """Base folder of each collection; videos of an unknown one are 'orphaned'."""
    out = F.lit("orphaned")
    for name, folder in base_dirs.items():
        out = F.when(F.col("collection") == name, F.lit(folder)).otherwise(out)
    return videos.withColumn("base_dir", out)


def original_folders(results: DataFrame, files: DataFrame) -> DataFrame:
    """Folder a result's video came from, by file name; the first in path order if several."""
    home = files.groupBy(basename(F.col("video_path")).alias("video_name")).agg(
        F.min(dirname(F.col("video_path"))).alias("folder"),
        F.count(F.lit(1)).alias("candidates"),
    )
    return results.join(home, "video_name", "left").withColumn(
        "folder", F.coalesce("folder", F.lit("orphaned"))
    )


def deployments(videos: DataFrame, marker: str = "BRUV") -> DataFrame:
    """Videos per deployment."""
    return videos.groupBy(deployment_id(F.col("video_path"), marker).alias("deployment_id")).agg(
        F.count(F.lit(1)).alias("videos")
    )


def storage_estimate(videos: DataFrame) -> DataFrame:
    """Space for converted copies, results (5 %), scratch (10 %) and a 20 % margin, in GB."""
    size = F.sum("size") / F.lit(float(1024**3))
    total = size * 1.15
    return videos.agg(
        size.alias("input_size_gb"),
        F.count(F.lit(1)).alias("video_count"),
        (size * 0.05).alias("analysis_size_gb"),
        (size * 0.1).alias("temp_space_gb"),
        total.alias("total_required_gb"),
        (total * 1.2).alias("safety_margin_gb"),
    )


def time_estimate(videos: DataFrame, minutes_each: float = 60.0) -> DataFrame:
    """Hours by stage: 2 min copy, 2 % of the length for detection, 0.5 min metadata."""
    n = F.count(F.lit(1))
    detect = minutes_each * 0.02
    each = 2 + detect + 0.5
    return videos.agg(
        (n * 2 / F.lit(60.0)).alias("reformat_hours"),
        (n * detect / 60).alias("detection_hours"),
        (n * 0.5 / 60).alias("metadata_hours"),
        (n * each / 60).alias("total_hours"),
        F.lit(60 / each).alias("videos_per_hour"),
    )


def task_stats(tasks: DataFrame) -> DataFrame:
    """Total and mean processing time, success rate, tasks by state."""
    spent = F.col("end_time") - F.col("start_time")
    done = F.col("status") == "completed"
    return tasks.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.coalesce(F.sum(F.when(done, spent)), F.lit(0.0)).alias("total_seconds"),
        F.avg(F.when(done, spent)).alias("mean_seconds"),
    ).withColumn("success_percent", percent(F.col("completed"), F.col("total_tasks")))


def progress(tasks: DataFrame, started: float, now: float) -> DataFrame:
    """Percent complete, throughput per hour and hours to go at time ``now``."""
    elapsed = float(now) - float(started)
    counts = task_stats(tasks).select("total_tasks", "completed", "failed", "skipped")
    remaining = F.col("total_tasks") - F.col("completed") - F.col("failed") - F.col("skipped")
    rate = F.try_divide(F.col("completed") * 3600.0, F.lit(elapsed))
    return counts.withColumns(
        {
            "remaining": remaining,
            "completion_percent": F.coalesce(
                F.try_divide(F.col("completed") * 100.0, F.col("total_tasks").cast("double")), F.lit(0.0)
            ),
            "elapsed_hours": F.lit(elapsed / 3600.0),
            "throughput_per_hour": F.coalesce(rate, F.lit(0.0)),
            "hours_to_go": F.try_divide(remaining.cast("double"), rate),
        }
    )
