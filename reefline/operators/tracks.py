"""Tracks: shaping detections, false-positive removal, renumbering, best detections."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefline.functions.paths import basename, strip_prefix, with_folder_columns
from reefline.operators.ranking import bucketed_index, null_safe_join, running_total, top_rows

TRACK = ("video_path", "track_id")
BOX = ("xmin", "ymin", "xmax", "ymax")

# Limits of the false-positive rule.
LEAST_MOTION = 0.08
SURE_CONFIDENCE = 0.7

# Track ids are cut into runs of this many values when they are numbered.
ID_RUN = 65_536

# Tracks of up to this many detections are ranked whole, each by one task.
WHOLE_TRACK = 65_536


def shape_detections(boxes: DataFrame, input_root: str, folder_depth: int = 0) -> DataFrame:
    """Tracker boxes to detection rows: relative path, name, track key, folder columns."""
    full = F.col("video_path")
    shaped = boxes.withColumns(
        {
            "video_name": basename(full),
            "track_metadata": F.concat(full, F.lit("/"), F.col("track_id").cast("string")),
            "video_path": strip_prefix(full, input_root),
        }
    )
    return with_folder_columns(shaped, folder_depth)


def shape_raw_detections(boxes: DataFrame, input_root: str) -> DataFrame:
    """All boxes, tracked or not: a missing track becomes -1."""
    full = F.col("video_path")
    return boxes.withColumns(
        {
            "video_name": basename(full),
            "has_track_id": F.col("track_id").isNotNull(),
            "track_id": F.coalesce(F.col("track_id"), F.lit(-1).cast("bigint")),
            "video_path": strip_prefix(full, input_root),
        }
    )


def confident(detections: DataFrame, threshold: float = 0.25) -> DataFrame:
    return detections.filter(F.col("confidence") >= threshold)


def inside_stable_period(detections: DataFrame, periods: DataFrame) -> DataFrame:
    """Keep frames from start_frame to end_frame of their video, both included."""
    return (
        detections.join(periods.select("video_path", "start_frame", "end_frame"), "video_path")
        .filter(F.col("frame").between(F.col("start_frame"), F.col("end_frame")))
        .drop("start_frame", "end_frame")
    )


def track_stats(detections: DataFrame, key: Sequence[str] = TRACK) -> DataFrame:
    """Per track: rows, best confidence, and movement of the box centre relative to the frame."""
    cx = (F.col("xmin") + F.col("xmax")) / 2
    cy = (F.col("ymin") + F.col("ymax")) / 2
    return detections.groupBy(*key).agg(
        F.count(F.lit(1)).alias("track_life"),
        F.max("confidence").alias("max_conf"),
        ((F.max(cx) - F.min(cx)) / F.max("w")).alias("motion_x"),
        ((F.max(cy) - F.min(cy)) / F.max("h")).alias("motion_y"),
    )


def false_positive(fps: float) -> Column:
    """Short or still, and never confident."""
    short = F.col("track_life") < float(fps)
    still = F.greatest("motion_x", "motion_y") < LEAST_MOTION
    return (short | still) & (F.col("max_conf") < SURE_CONFIDENCE)


def surviving_tracks(
    detections: DataFrame, fps: float, key: Sequence[str] = TRACK
) -> DataFrame:
    """Tracks that pass the false-positive rule, with their statistics."""
    return track_stats(detections, key).filter(~false_positive(fps))


def drop_false_positives(
    detections: DataFrame, fps: float, key: Sequence[str] = TRACK
) -> DataFrame:
    """Detections of surviving tracks.

    The statistics are one row per track, aggregated before the shuffle; the
    detections meet them in a semi join, which Spark broadcasts when the track
    table is small and splits when a track is hot.
    """
    return detections.join(
        surviving_tracks(detections, fps, key).select(*key), list(key), "left_semi"
    )


def renumber_tracks(tracks: DataFrame, video: str = "video_path") -> DataFrame:
    """Number tracks 0..k-1 inside each video by track id. One row per track in and out."""
    return bucketed_index(
        tracks, [video], F.floor(F.col("track_id") / ID_RUN), [F.col("track_id")], "new_track_id"
    )


def track_offsets(tracks: DataFrame, video: str = "video_path") -> DataFrame:
    """Per video: tracks found, and the number of tracks in all earlier videos."""
    counts = tracks.groupBy(video).agg(F.count_distinct("track_id").alias("tracks_found"))
    return running_total(counts, [video], "tracks_found", "first_track_id")


def global_track_ids(detections: DataFrame, tracks: DataFrame) -> DataFrame:
    """Give detections ids that are unique over all videos: video offset + number in the video.

    ``tracks`` lists the surviving tracks; detections of other tracks drop out.
    """
    numbered = renumber_tracks(tracks.select("video_path", "track_id"))
    offsets = track_offsets(tracks).select("video_path", "first_track_id")
    ids = numbered.join(offsets, "video_path").select(
        "video_path",
        "track_id",
        (F.col("first_track_id") + F.col("new_track_id")).alias("new_track_id"),
    )
    return (
        detections.join(ids, ["video_path", "track_id"])
        .drop("track_id")
        .withColumnRenamed("new_track_id", "track_id")
    )


def best_detections(
    detections: DataFrame, key: Sequence[str] = TRACK, ties: Sequence[str] = ("frame",)
) -> DataFrame:
    """The most confident detection of each track; a tie goes to the earliest."""
    return top_rows(detections, list(key), [F.col("confidence").desc(), *[F.col(c) for c in ties]])


def peek_ids(detections: DataFrame) -> DataFrame:
    """An id for each frame that has a box, counted over all videos in path order."""
    frames = detections.select("video_path", "frame").distinct()
    counts = frames.groupBy("video_path").agg(F.count(F.lit(1)).alias("frames"))
    offsets = running_total(counts, ["video_path"], "frames", "first_id").select(
        "video_path", "first_id"
    )
    placed = bucketed_index(
        frames, ["video_path"], F.floor(F.col("frame") / ID_RUN), [F.col("frame")], "pos"
    )
    return placed.join(offsets, "video_path").select(
        "video_path", "frame", (F.col("first_id") + F.col("pos")).alias("peek_id")
    )


def middle_detections(
    detections: DataFrame,
    key: Sequence[str] = TRACK,
    ties: Sequence[str] = BOX,
    frame_run: int = 4096,
    over: Mapping[str, Column] | None = None,
    whole: int = WHOLE_TRACK,
    nulls_last: bool = False,
) -> DataFrame:
    """Detection number n div 2 of each track in frame order, with the track's n and the aggregates ``over`` it.

    A window ranks tracks of up to ``whole`` detections in one shuffle; longer
    ones, which would fill a task, are ranked by counts. The leading hash keeps
    sorts from comparing long paths that start alike. Missing frames and ties
    come first, or last with ``nulls_last``.
    """
    keys, over = list(key), dict(over or {})
    rising = F.asc_nulls_last if nulls_last else F.asc_nulls_first
    hashed = detections.withColumn("_track", F.xxhash64(*keys))
    # at most one row for each ``whole`` detections, so it can be sent to every task
    long = F.broadcast(
        hashed.groupBy("_track").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > whole).select("_track")
    )
    in_order = Window.partitionBy("_track", *keys).orderBy(*[rising(c) for c in ("frame", *ties)])
    track = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    middle = F.call_function("div", F.col("detections"), F.lit(2).cast("bigint"))
    short = (
        hashed.join(long, "_track", "left_anti")
        .withColumns(
            {
                "_pos": F.row_number().over(in_order) - 1,
                "detections": F.count(F.lit(1)).over(track),
                **{name: total.over(track) for name, total in over.items()},
            }
        )
        .filter(F.col("_pos") == middle)
        .drop("_track", "_pos")
    )
    rest = hashed.join(long, "_track", "left_semi").drop("_track")
    return short.unionByName(_middle_by_counts(rest, keys, ties, frame_run, over, rising))


def _middle_by_counts(
    detections: DataFrame,
    keys: list[str],
    ties: Sequence[str],
    frame_run: int,
    over: dict[str, Column],
    rising: Callable[[str], Column],
) -> DataFrame:
    """Middle detections of tracks of any length.

    Boxes are counted per frame and per run of frames: the counts tell the run,
    then the frame that holds the middle, and only that frame's boxes are ranked.
    """
    frames = (
        detections.groupBy(*keys, "frame")
        .agg(F.count(F.lit(1)).alias("_boxes"))
        .withColumn("_run", F.floor(F.col("frame") / frame_run))
    )
    runs = frames.groupBy(*keys, "_run").agg(F.sum("_boxes").alias("_size"))
    totals = detections.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("detections"), *[total.alias(name) for name, total in over.items()]
    )
    before = Window.partitionBy(*keys).orderBy(rising("_run")).rowsBetween(Window.unboundedPreceding, -1)
    target = (
        null_safe_join(
            runs.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))), totals, keys
        )
        .withColumn("_want", F.call_function("div", F.col("detections"), F.lit(2).cast("bigint")))
        .filter(
            (F.col("_want") >= F.col("_start")) & (F.col("_want") < F.col("_start") + F.col("_size"))
        )
        .select(*keys, "_run", "detections", *over, (F.col("_want") - F.col("_start")).alias("_skip"))
    )
    in_run = Window.partitionBy(*keys, "_run").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    chosen = (
        null_safe_join(frames, target, [*keys, "_run"])
        .withColumn("_first", F.coalesce(F.sum("_boxes").over(in_run), F.lit(0)))
        .filter((F.col("_skip") >= F.col("_first")) & (F.col("_skip") < F.col("_first") + F.col("_boxes")))
        .select(*keys, "frame", "detections", *over, (F.col("_skip") - F.col("_first")).alias("_skip"))
    )
    inside = Window.partitionBy(*keys, "frame").orderBy(*[rising(c) for c in ties])
    return (
        null_safe_join(detections, chosen, [*keys, "frame"])
        .withColumn("_pos", F.row_number().over(inside) - 1)
        .filter(F.col("_pos") == F.col("_skip"))
        .drop("_skip", "_pos")
    )


def raw_summary(raw: DataFrame) -> DataFrame:
    return raw.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("has_track_id").alias("tracked"),
        F.count_if(~F.col("has_track_id")).alias("untracked"),
    )


def result_summary(detections: DataFrame) -> DataFrame:
    """Rows, distinct tracks and distinct video names of a result table."""
    return detections.agg(
        F.count(F.lit(1)).alias("total_detections"),
        F.count_distinct("track_id").alias("total_tracks"),
        F.count_distinct("video_name").alias("videos_processed"),
    )


def label_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def overview(detections: DataFrame, videos: DataFrame) -> DataFrame:
    """Tracks found per listed video, 0 where there are none."""
    counts = detections.groupBy("video_path").agg(F.count_distinct("track_id").alias("tracks_found"))
    return videos.select("video_path").join(counts, "video_path", "left").na.fill({"tracks_found": 0})


def run_totals(overview_table: DataFrame) -> DataFrame:
    """Where a stopped run resumes: videos done and tracks found so far."""
    return overview_table.agg(
        F.count_distinct("video_path").alias("videos_processed"),
        F.coalesce(F.sum("tracks_found"), F.lit(0)).alias("tracks_found"),
    )
