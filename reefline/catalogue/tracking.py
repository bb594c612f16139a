"""Track filtering, numbering and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.catalogue import inputs
from reefline.catalogue.registry import query
from reefline.operators import tracks as t
from reefline.operators.maxn import apply_human_labels

_TIES = ("frame", "det_o", "det_l", "det_p", "xmax")
# Short tracks, a few detections each, so that the false-positive rule has work to do.
_SHORT_TRACK = "det_o % 250"

_STATS = f"""
WITH short AS (SELECT * REPLACE ({_SHORT_TRACK} AS track_id) FROM detections),
s AS (SELECT video_path, track_id, count(*) AS track_life, max(confidence) AS max_conf,
  (max((xmin + xmax) / 2) - min((xmin + xmax) / 2)) / max(w) AS motion_x,
  (max((ymin + ymax) / 2) - min((ymin + ymax) / 2)) / max(h) AS motion_y
  FROM short GROUP BY video_path, track_id),
k AS (SELECT * FROM s WHERE NOT ((track_life < 3 OR greatest(motion_x, motion_y) < 0.08e0) AND max_conf < 0.7e0))
"""


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.detections(spark, sf_dir).withColumn("track_id", F.expr(_SHORT_TRACK))


@query(
    "shaped_detections",
    """SELECT video_path, video_name, frame, track_id,
  concat('/surveys/', video_path, '/', CAST(track_id AS STRING)) AS track_metadata, folder1, folder2, det_o, det_l, det_p, xmax
FROM detections""",
)
def shaped_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = (
        inputs.detections(spark, sf_dir)
        .withColumn("video_path", F.concat(F.lit("/surveys/"), F.col("video_path")))
        .drop("video_name", "folder1", "folder2")
    )
    return t.shape_detections(boxes, "/surveys", folder_depth=2).select(
        "video_path", "video_name", "frame", "track_id", "track_metadata", "folder1", "folder2",
        "det_o", "det_l", "det_p", "xmax",
    )


_RAW_TRACK = "CASE WHEN det_p % 4 = 0 THEN NULL ELSE track_id END"


@query(
    "shaped_raw_detections",
    f"""SELECT video_path, video_name, ({_RAW_TRACK}) IS NOT NULL AS has_track_id,
  coalesce({_RAW_TRACK}, -1) AS track_id, frame, time, xmin, ymin, xmax, ymax, w, h, confidence, label FROM detections""",
)
def shaped_raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = (
        inputs.detections(spark, sf_dir)
        .withColumn("track_id", F.expr(_RAW_TRACK))
        .withColumn("video_path", F.concat(F.lit("/surveys/"), F.col("video_path")))
    )
    return t.shape_raw_detections(boxes, "/surveys").select(
        "video_path", "video_name", "has_track_id", "track_id", "frame", "time", "xmin", "ymin", "xmax", "ymax", "w", "h", "confidence", "label"
    )


@query(
    "raw_detection_summary",
    f"""SELECT count(*) AS total, count({_RAW_TRACK}) AS tracked, count(*) - count({_RAW_TRACK}) AS untracked FROM detections""",
)
def raw_detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = inputs.detections(spark, sf_dir).withColumn("track_id", F.expr(_RAW_TRACK))
    return t.raw_summary(t.shape_raw_detections(boxes, ""))


@query(
    "confident_detections",
    "SELECT video_path, frame, track_id, xmin, ymin, xmax, ymax, confidence FROM detections WHERE confidence >= 0.25e0",
)
def confident_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.confident(inputs.detections(spark, sf_dir)).select("video_path", "frame", "track_id", "xmin", "ymin", "xmax", "ymax", "confidence")


@query(
    "track_statistics",
    _STATS
    + "SELECT video_path, track_id, track_life, max_conf, round(motion_x, 9) AS motion_x, round(motion_y, 9) AS motion_y FROM s",
)
def track_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.track_stats(_short(spark, sf_dir)).withColumns(
        {"motion_x": F.bround("motion_x", 9), "motion_y": F.bround("motion_y", 9)}
    )


@query(
    "true_positive_detections",
    _STATS
    + """SELECT e.video_path, e.track_id, e.frame, e.confidence, e.xmin, e.ymin, e.xmax, e.ymax
FROM short e JOIN k USING (video_path, track_id)""",
)
def true_positive_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.drop_false_positives(_short(spark, sf_dir), fps=3).select(
        "video_path", "track_id", "frame", "confidence", "xmin", "ymin", "xmax", "ymax"
    )


@query(
    "renumbered_tracks",
    _STATS
    + """SELECT video_path, track_id, dense_rank() OVER (PARTITION BY video_path ORDER BY track_id) - 1 AS new_track_id FROM k""",
)
def renumbered_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    survivors = t.surviving_tracks(_short(spark, sf_dir), fps=3).select("video_path", "track_id")
    return t.renumber_tracks(survivors)


@query(
    "track_offsets",
    _STATS
    + """, c AS (SELECT video_path, count(*) AS tracks_found FROM k GROUP BY video_path)
SELECT video_path, tracks_found, CAST(coalesce(sum(tracks_found) OVER (ORDER BY video_path
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_track_id FROM c""",
)
def track_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.track_offsets(t.surviving_tracks(_short(spark, sf_dir), fps=3))


@query(
    "globally_numbered_tracks",
    _STATS
    + """, i AS (SELECT video_path, track_id, row_number() OVER (ORDER BY video_path, track_id) - 1 AS new_id FROM k)
SELECT e.video_path, i.new_id AS track_id, frame, xmin, ymin, xmax, ymax, confidence FROM short e JOIN i USING (video_path, track_id)""",
)
def globally_numbered_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = _short(spark, sf_dir)
    return t.global_track_ids(short, t.surviving_tracks(short, fps=3)).select("video_path", "frame", "track_id", "xmin", "ymin", "xmax", "ymax", "confidence")


@query(
    "best_detections",
    "SELECT video_path, track_id, frame, confidence, xmin, ymin, xmax, ymax FROM best",
)
def best_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.best_detections(inputs.detections(spark, sf_dir), ties=_TIES).select(
        "video_path", "track_id", "frame", "confidence", "xmin", "ymin", "xmax", "ymax"
    )


@query(
    "middle_detections",
    """WITH r AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY video_path, track_id) AS detections
  FROM detections WINDOW w AS (PARTITION BY video_path, track_id ORDER BY frame, det_o, det_l, det_p, xmax))
SELECT video_path, track_id, detections, frame, xmin, ymin, xmax, ymax FROM r WHERE pos = detections // 2""",
)
def middle_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.middle_detections(inputs.detections(spark, sf_dir), ties=_TIES[1:], nulls_last=True).select(
        "video_path", "track_id", "detections", "frame", "xmin", "ymin", "xmax", "ymax"
    )


@query(
    "peek_ids",
    """WITH f AS (SELECT DISTINCT video_path, frame FROM detections)
SELECT video_path, frame, row_number() OVER (ORDER BY video_path, frame) - 1 AS peek_id FROM f""",
)
def peek_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.peek_ids(inputs.detections(spark, sf_dir))


@query(
    "result_summary",
    """SELECT count(*) AS total_detections, count(DISTINCT track_id) AS total_tracks,
  count(DISTINCT video_name) AS videos_processed FROM detections""",
)
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.result_summary(inputs.detections(spark, sf_dir))


@query("label_counts", "SELECT label, count(*) AS n FROM cleaned GROUP BY label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.label_counts(
        apply_human_labels(inputs.detections(spark, sf_dir), inputs.labeled(spark, sf_dir))
    )


@query(
    "result_preview",
    """SELECT video_path, frame, track_id, confidence FROM detections
ORDER BY video_path, frame, det_o, det_l, det_p, xmax LIMIT 10""",
)
def result_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs.detections(spark, sf_dir)
        .orderBy("video_path", "frame", "det_o", "det_l", "det_p", "xmax")
        .limit(10)
        .select("video_path", "frame", "track_id", "confidence")
    )


_VIDEOS = "SELECT concat('collection_', CAST(s_suppkey % 3 AS VARCHAR), '/BRUV ', CAST(s_suppkey % 20 AS VARCHAR), '/GH', CAST(s_suppkey AS VARCHAR), '.MP4') AS video_path FROM supplier"


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "supplier").selectExpr(
        "concat('collection_', CAST(s_suppkey % 3 AS STRING), '/BRUV ', CAST(s_suppkey % 20 AS STRING), "
        "'/GH', CAST(s_suppkey AS STRING), '.MP4') AS video_path"
    )


_OVERVIEW = (
    _STATS
    + f""", v AS ({_VIDEOS}), o AS (SELECT v.video_path, count(k.track_id) AS tracks_found
  FROM v LEFT JOIN k USING (video_path) GROUP BY v.video_path)
"""
)


@query("overview", _OVERVIEW + "SELECT * FROM o")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.overview(t.surviving_tracks(_short(spark, sf_dir), fps=3), _videos(spark, sf_dir))


@query(
    "resume_totals",
    _OVERVIEW + "SELECT count(DISTINCT video_path) AS videos_processed, CAST(sum(tracks_found) AS BIGINT) AS tracks_found FROM o",
)
def resume_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.run_totals(overview(spark, sf_dir))
