"""Survey-shaped tables derived from the given tables.

The column expressions are SQL that Spark and DuckDB read alike, so both sides
of a comparison start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.functions.clock import ms_to_clock
from reefline.operators.ranking import bucketed_index, top_rows

DETECTION_EXPRESSIONS = [
    "concat('collection_', CAST(l_suppkey % 3 AS STRING), '/BRUV ', CAST(l_suppkey % 20 AS STRING), '/GH', CAST(l_suppkey AS STRING), '.MP4') AS video_path",
    "concat('GH', CAST(l_suppkey AS STRING), '.MP4') AS video_name",
    "concat('collection_', CAST(l_suppkey % 3 AS STRING)) AS folder1",
    "concat('BRUV ', CAST(l_suppkey % 20 AS STRING)) AS folder2",
    "l_suppkey AS video_no",
    "l_orderkey AS det_o",
    "l_linenumber AS det_l",
    "l_partkey AS det_p",
    "l_partkey % 60 AS frame",
    "(l_partkey % 60) * 333 AS time_ms",
    "l_orderkey % 25 AS track_id",
    "CAST((l_partkey * 13 + l_linenumber * 101) % 1500 AS DOUBLE) AS xmin",
    "CAST((l_partkey * 29 + l_suppkey * 7) % 900 AS DOUBLE) AS ymin",
    "CAST((l_partkey * 13 + l_linenumber * 101) % 1500 AS DOUBLE) + 50e0 + l_quantity AS xmax",
    "CAST((l_partkey * 29 + l_suppkey * 7) % 900 AS DOUBLE) + 30e0 + l_quantity AS ymax",
    "1920 AS w",
    "1080 AS h",
    "CAST((l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7) % 1000 AS DOUBLE) / 1e3 AS confidence",
    "'elasmobranch' AS label",
]

CLOCK_SQL = (
    "printf('%02dh:%02dm:%02ds:%03dms', CAST(floor({0} / 3600000) AS BIGINT), "
    "CAST(floor({0} / 60000) AS BIGINT) % 60, CAST(floor({0} / 1000) AS BIGINT) % 60, {0} % 1000)"
)

LABEL_EXPRESSION = (
    "CASE WHEN (track_id + video_no) % 5 = 0 THEN 'ESU' WHEN (track_id + video_no) % 5 = 1 THEN NULL "
    "WHEN (track_id + video_no) % 5 = 2 THEN 'Ginglymostoma cirratum' ELSE 'Carcharhinus perezi' END"
)

VALIDATION_EXPRESSIONS = [
    "folder1 AS collection",
    "folder2 AS bruv_station",
    "replace(video_name, '.MP4', '') AS video_id",
    "track_id",
    "time_ms",
    "time_ms / 1e3 AS time_seconds",
    "confidence",
    "CASE track_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE ' WHEN 2 THEN 'false' ELSE '' END AS true_detection",
    "CASE track_id % 4 WHEN 2 THEN 'debris' WHEN 0 THEN 'shark' WHEN 1 THEN 'shark' ELSE '' END AS taxon_group",
    "CASE WHEN track_id % 4 IN (0, 1) AND (track_id + video_no) % 6 <> 0 THEN CASE (track_id + video_no) % 3 WHEN 0 THEN 'g. cirratum' WHEN 1 THEN 'Carcharhinus perezi' ELSE 'Tiger shark' END ELSE '' END AS species",
    "video_path",
    "video_no",
]

# Every detection of a track carries its reviewed group and species.
REVIEWED_EXPRESSIONS = [
    "folder1 AS collection",
    "folder2 AS bruv_station",
    "replace(video_name, '.MP4', '') AS video_id",
    "track_id",
    "frame",
    "time_ms",
    "confidence",
    "CASE (track_id + video_no) % 7 WHEN 0 THEN 'teleost' WHEN 1 THEN 'ray_skate' WHEN 2 THEN '' ELSE 'shark' END AS taxon_group",
    "CASE WHEN (track_id + video_no) % 7 > 3 THEN CASE track_id % 3 WHEN 0 THEN 'Ginglymostoma cirratum' WHEN 1 THEN 'Carcharhinus perezi' ELSE 'Galeocerdo cuvier' END ELSE '' END AS species",
]

LOCATION_EXPRESSIONS = [
    "c_custkey AS loc_id",
    "CAST((c_custkey * 37) % 1000 AS DOUBLE) / 2e3 + CAST(c_nationkey AS DOUBLE) * 6 - 72 AS lat",
    "CAST((c_custkey * 91) % 1000 AS DOUBLE) / 2e3 - 40 AS lon",
    "abs(c_acctbal) / 100 AS depth",
]

# A track's best detection; the last columns make the order total.
BEST_ORDER_SQL = "confidence DESC, frame, det_o, det_l, det_p, xmax"

VIEWS = {
    "detections": f"SELECT {', '.join(DETECTION_EXPRESSIONS)}, {CLOCK_SQL.format('((l_partkey % 60) * 333)')} AS time FROM lineitem",
    "labeled": f"SELECT DISTINCT video_path, track_id, {LABEL_EXPRESSION} AS human_label FROM detections WHERE (track_id + video_no) % 7 <> 0",
    "cleaned": "SELECT d.* REPLACE (CASE WHEN coalesce(trim(l.human_label), '') = '' THEN d.label ELSE l.human_label END AS label) FROM detections d JOIN labeled l USING (video_path, track_id)",
    "best": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_path, track_id ORDER BY {BEST_ORDER_SQL}) AS rn FROM detections) WHERE rn = 1",
    "validation": f"SELECT {', '.join(VALIDATION_EXPRESSIONS)} FROM best",
    "reviewed": f"SELECT {', '.join(REVIEWED_EXPRESSIONS)} FROM detections",
    "stability_samples": "SELECT user_id AS video_no, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx, value / (value + 20e0) AS motion_score FROM events",
    "locations": f"SELECT {', '.join(LOCATION_EXPRESSIONS)} FROM customer",
}


def with_views(sql: str) -> str:
    """Put the views a statement names, and those they name, in front of it as a WITH clause."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                add(VIEWS[name])
                needed.append(name)

    add(sql)
    if not needed:
        return sql.strip()
    heads = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .selectExpr(*DETECTION_EXPRESSIONS)
        .withColumn("time", ms_to_clock(F.col("time_ms")))
    )


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        detections(spark, sf_dir)
        .filter("(track_id + video_no) % 7 <> 0")
        .selectExpr("video_path", "track_id", f"{LABEL_EXPRESSION} AS human_label")
        .distinct()
    )


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_rows(
        detections(spark, sf_dir),
        ["video_path", "track_id"],
        [F.col("confidence").desc(), *[F.col(c) for c in ("frame", "det_o", "det_l", "det_p", "xmax")]],
    )


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir).selectExpr(*VALIDATION_EXPRESSIONS)


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).selectExpr(*REVIEWED_EXPRESSIONS)


def stability_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by user, numbered in time; days are counted first, so no task sorts all of a user's events."""
    samples = table(spark, sf_dir, "events").selectExpr(
        "user_id AS video_no", "ts", "event_id", "value / (value + 20e0) AS motion_score"
    )
    day = F.to_date("ts")
    return bucketed_index(
        samples, ["video_no"], day, [F.col("ts"), F.col("event_id")], "sample_idx"
    ).select("video_no", "sample_idx", "motion_score")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*LOCATION_EXPRESSIONS)
