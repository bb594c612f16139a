"""Stable camera periods from motion scores of successive samples.

Samples of one video are cut into chunks with a small overlap, so a long video
spreads over many tasks; only runs that touch a chunk edge are joined up again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefline.operators.ranking import bucketed_index, top_rows

CHUNK = 4096


def index_samples(samples: DataFrame, video: str = "video_path", frame_run: int = 65_536) -> DataFrame:
    """Dense zero-based ``sample_idx`` by frame; the first sample of a video has no score."""
    return bucketed_index(
        samples.filter(F.col("motion_score").isNotNull()),
        [video],
        F.floor(F.col("frame") / frame_run),
        [F.col("frame")],
        "sample_idx",
    )


def smoothed(samples: DataFrame, video: str = "video_path", chunk: int = CHUNK) -> DataFrame:
    """Centred moving average of width min(5, n), zero padded and always divided by the width.

    Needs a dense ``sample_idx`` per video.
    """
    i = F.col("sample_idx")
    sizes = samples.groupBy(video).agg(F.count(F.lit(1)).alias("samples"))
    home = F.floor(i / chunk)
    spread = samples.withColumns({"_home": home}).withColumn(
        "_chunk",
        F.explode(F.array_distinct(F.array(F.floor((i - 2) / chunk), home, F.floor((i + 2) / chunk)))),
    )
    w = Window.partitionBy(video, "_chunk").orderBy("sample_idx")

    def near(step: int) -> Column:
        return F.coalesce(F.lag("motion_score", -step).over(w), F.lit(0.0))

    sides = (
        spread.withColumns({f"_n{k}": near(s) for k, s in enumerate((-1, 1, -2, 2))})
        .filter(F.col("_chunk") == F.col("_home"))
        .join(sizes, video)
    )
    width = F.least(F.lit(5).cast("bigint"), F.col("samples"))
    total = F.col("motion_score")
    for k in range(4):
        total = total + F.when(width >= k + 2, F.col(f"_n{k}")).otherwise(F.lit(0.0))
    return sides.select(video, "sample_idx", "samples", (total / width).alias("smoothed"))


def stable_runs(
    smooth: DataFrame, threshold: float = 0.15, video: str = "video_path", chunk: int = CHUNK
) -> DataFrame:
    """Maximal runs of samples below the threshold: first index, last index, length."""
    calm = smooth.filter(F.col("smoothed") < threshold).withColumn(
        "_chunk", F.floor(F.col("sample_idx") / chunk)
    )
    w = Window.partitionBy(video, "_chunk").orderBy("sample_idx")
    pieces = (
        calm.withColumn("_island", F.col("sample_idx") - F.row_number().over(w))
        .groupBy(video, "_chunk", "_island")
        .agg(F.min("sample_idx").alias("first_idx"), F.max("sample_idx").alias("last_idx"))
        .select(video, "first_idx", "last_idx")
    )
    at_edge = (F.col("first_idx") % chunk == 0) | (F.col("last_idx") % chunk == chunk - 1)
    # at most two pieces per chunk reach an edge
    order = Window.partitionBy(video).orderBy("first_idx")
    edges = pieces.filter(at_edge)
    breaks = F.coalesce(F.lag("last_idx").over(order) + 1 != F.col("first_idx"), F.lit(True))
    joined = (
        edges.withColumn("_new", breaks.cast("int"))
        .withColumn("_run", F.sum("_new").over(order))
        .groupBy(video, "_run")
        .agg(F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"))
        .drop("_run")
    )
    return (
        pieces.filter(~at_edge)
        .unionByName(joined)
        .withColumn("length", F.col("last_idx") - F.col("first_idx") + 1)
    )


def stable_periods(
    samples: DataFrame,
    threshold: float = 0.15,
    least_seconds: float = 10.0,
    sample_rate: float = 1.0,
    frame_step: int = 1,
    video: str = "video_path",
    chunk: int = CHUNK,
) -> DataFrame:
    """The longest stable run of each video, the earliest of equals.

    A video without one gets its middle 80 percent and ``fallback`` = true. Score
    number i compares samples i and i+1, so its frame is (i + 1) * ``frame_step``.
    """
    smooth = smoothed(samples, video, chunk)
    runs = stable_runs(smooth, threshold, video, chunk).filter(
        F.col("length") * float(sample_rate) >= float(least_seconds)
    )
    longest = top_rows(runs, [video], [F.col("length").desc(), F.col("first_idx").asc()])
    sizes = samples.groupBy(video).agg(F.count(F.lit(1)).alias("samples"))
    margin = F.floor(F.col("samples") * 0.1)
    last = F.when(margin > 0, F.col("samples") - margin).otherwise(F.col("samples") - 1)
    return (
        sizes.join(longest, video, "left")
        .select(
            video,
            "samples",
            F.coalesce("first_idx", margin).alias("start_idx"),
            F.coalesce("last_idx", last).alias("end_idx"),
            F.col("first_idx").isNull().alias("fallback"),
        )
        .withColumns(
            {
                "start_frame": (F.col("start_idx") + 1) * frame_step,
                "end_frame": (F.col("end_idx") + 1) * frame_step,
            }
        )
    )


def skip_times(periods: DataFrame, fps: float, total_frames: str = "total_frames") -> DataFrame:
    """Seconds to skip at the start and the end of each video."""
    return periods.withColumns(
        {
            "skip_start": F.col("start_frame") / float(fps),
            "skip_end": (F.col(total_frames) - F.col("end_frame")) / float(fps),
        }
    )
