"""Stable camera periods and frames inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.catalogue import inputs
from reefline.catalogue.registry import query
from reefline.operators import stability as st
from reefline.operators import tracks as t

THRESHOLD = 0.55

_SMOOTH = """
WITH n AS (SELECT *, count(*) OVER (PARTITION BY video_no) AS samples FROM stability_samples),
z AS (SELECT video_no, sample_idx, samples,
  (motion_score
   + CASE WHEN samples >= 2 THEN coalesce(lag(motion_score, 1) OVER k, 0) ELSE 0 END
   + CASE WHEN samples >= 3 THEN coalesce(lead(motion_score, 1) OVER k, 0) ELSE 0 END
   + CASE WHEN samples >= 4 THEN coalesce(lag(motion_score, 2) OVER k, 0) ELSE 0 END
   + CASE WHEN samples >= 5 THEN coalesce(lead(motion_score, 2) OVER k, 0) ELSE 0 END) / least(5, samples) AS smoothed
  FROM n WINDOW k AS (PARTITION BY video_no ORDER BY sample_idx)),
c AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY video_no ORDER BY sample_idx) AS island FROM z WHERE smoothed < 0.55e0),
r AS (SELECT video_no, min(sample_idx) AS first_idx, max(sample_idx) AS last_idx, count(*) AS length FROM c GROUP BY video_no, island)
"""


@query("smoothed_motion", _SMOOTH + "SELECT video_no, sample_idx, samples, round(smoothed, 9) AS smoothed FROM z")
def smoothed_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.smoothed(inputs.stability_samples(spark, sf_dir), "video_no").withColumn(
        "smoothed", F.bround("smoothed", 9)
    )


@query("stable_runs", _SMOOTH + "SELECT * FROM r")
def stable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = st.smoothed(inputs.stability_samples(spark, sf_dir), "video_no")
    return st.stable_runs(smooth, THRESHOLD, "video_no")


_PERIODS = (
    _SMOOTH
    + """, b AS (SELECT * FROM r WHERE length >= 8 QUALIFY row_number() OVER (PARTITION BY video_no ORDER BY length DESC, first_idx) = 1),
s AS (SELECT video_no, count(*) AS samples, CAST(floor(count(*) * 0.1e0) AS BIGINT) AS margin FROM stability_samples GROUP BY video_no),
p AS (SELECT video_no, samples, coalesce(first_idx, margin) AS start_idx,
  coalesce(last_idx, CASE WHEN margin > 0 THEN samples - margin ELSE samples - 1 END) AS end_idx, first_idx IS NULL AS fallback
  FROM s LEFT JOIN b USING (video_no))
"""
)


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.stable_periods(
        inputs.stability_samples(spark, sf_dir),
        threshold=THRESHOLD,
        least_seconds=8,
        frame_step=30,
        video="video_no",
    )


@query(
    "stable_periods",
    _PERIODS + "SELECT *, (start_idx + 1) * 30 AS start_frame, (end_idx + 1) * 30 AS end_frame FROM p",
)
def stable_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(spark, sf_dir)


@query(
    "skip_times",
    _PERIODS
    + """SELECT video_no, round((start_idx + 1) * 30 / 25e0, 3) AS skip_start,
  round(((samples + 1) * 30 - (end_idx + 1) * 30) / 25e0, 3) AS skip_end FROM p""",
)
def skip_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _periods(spark, sf_dir).withColumn("total_frames", (F.col("samples") + 1) * 30)
    return st.skip_times(whole, fps=25).select(
        "video_no",
        F.bround("skip_start", 3).alias("skip_start"),
        F.bround("skip_end", 3).alias("skip_end"),
    )


@query(
    "stable_detections",
    _PERIODS
    + """SELECT d.video_path, d.frame, d.track_id, d.xmin, d.ymin, d.xmax, d.ymax, d.confidence FROM detections d JOIN p ON p.video_no = d.video_no
WHERE d.frame BETWEEN p.start_idx AND p.end_idx""",
)
def stable_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inputs.detections(spark, sf_dir).withColumnRenamed("video_path", "path").withColumnRenamed(
        "video_no", "video_path"
    )
    periods = _periods(spark, sf_dir).select(
        F.col("video_no").alias("video_path"),
        F.col("start_idx").alias("start_frame"),
        F.col("end_idx").alias("end_frame"),
    )
    return t.inside_stable_period(found, periods).select(F.col("path").alias("video_path"), "frame", "track_id", "xmin", "ymin", "xmax", "ymax", "confidence")
