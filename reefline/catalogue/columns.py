"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.catalogue import inputs
from reefline.catalogue.registry import query
from reefline.functions import clock, names, paths, scores

_MS = "(l_orderkey * 60013 + l_partkey * 977 + l_linenumber) % 90000000"


@query(
    "clock_strings",
    f"""WITH m AS (SELECT {_MS} AS ms FROM lineitem)
SELECT ms, {inputs.CLOCK_SQL.format('ms')} AS clock, ms AS back_ms, ms / 1e3 AS seconds,
  CASE WHEN ms // 3600000 > 0 THEN printf('%dh %dm %ds', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60)
    WHEN ms // 60000 > 0 THEN printf('%dm %ds', ms // 60000, ms // 1000 % 60) ELSE printf('%ds', ms // 1000) END AS shown FROM m""",
)
def clock_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = clock.ms_to_clock(F.col("ms"))
    return (
        inputs.table(spark, sf_dir, "lineitem")
        .selectExpr(f"{_MS} AS ms")
        .select(
            "ms",
            text.alias("clock"),
            clock.clock_to_ms(text).alias("back_ms"),
            clock.clock_to_seconds(text).alias("seconds"),
            clock.seconds_to_display(clock.clock_to_seconds(text)).alias("shown"),
        )
    )


_COLON = "CASE o_orderkey % 5 WHEN 0 THEN '01:02:03' WHEN 1 THEN concat('2:', CAST(o_orderkey % 60 AS STRING), '.5') WHEN 2 THEN CAST(o_orderkey % 1000 AS STRING) WHEN 3 THEN '00h:00m:01s:000ms' ELSE 'x:y' END"


@query(
    "colon_times",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 3723000 WHEN 1 THEN 120000 + (o_orderkey % 60) * 1000 + 500 WHEN 2 THEN (o_orderkey % 1000) * 1000 ELSE 0 END AS ms,
  CASE o_orderkey % 5 WHEN 2 THEN CAST(o_orderkey % 1000 AS DOUBLE) WHEN 3 THEN 1e0 ELSE 0e0 END AS seconds FROM orders""",
)
def colon_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(_COLON)
    return inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        clock.colon_time_to_ms(text).alias("ms"),
        clock.clock_to_seconds(text).alias("seconds"),
    )


@query(
    "path_parts",
    """SELECT DISTINCT video_path, regexp_extract(video_path, '[^/]*$') AS name, regexp_replace(video_path, '/[^/]*$', '') AS parent,
  concat('GH', CAST(video_no AS VARCHAR)) AS stem, '.mp4' AS extension, regexp_replace(video_path, '[.]MP4$', '') AS key,
  regexp_replace(video_path, '/[^/]*$', '') AS chapter_key, video_no AS number FROM detections""",
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("video_path")
    return (
        inputs.detections(spark, sf_dir)
        .select("video_path")
        .distinct()
        .select(
            "video_path",
            paths.basename(p).alias("name"),
            paths.dirname(p).alias("parent"),
            paths.stem(p).alias("stem"),
            paths.extension(p).alias("extension"),
            paths.video_key(p).alias("key"),
            paths.video_key(p, chapters=True).alias("chapter_key"),
            paths.natural_number(paths.basename(p)).alias("number"),
        )
    )


@query(
    "thumbnail_names",
    """SELECT collection, bruv_station, video_id, track_id,
  concat('BRUV_', lpad(replace(bruv_station, 'BRUV ', ''), 3, '0'), '_', video_id, '_', CAST(track_id AS VARCHAR), '.jpg') AS thumbnail,
  bruv_station AS folder, CASE WHEN confidence >= 0.8e0 THEN 'high' WHEN confidence >= 0.5e0 THEN 'medium' ELSE 'low' END AS band,
  printf('%.1f%%', confidence * 100e0) AS shown FROM validation""",
)
def thumbnail_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    station = F.col("bruv_station")
    padded = F.concat(F.lit("BRUV "), F.lpad(F.replace(station, F.lit("BRUV "), F.lit("")), 3, "0"))
    return inputs.validation(spark, sf_dir).select(
        "collection",
        "bruv_station",
        "video_id",
        "track_id",
        paths.thumbnail_name(padded, F.col("video_id"), F.col("track_id")).alias("thumbnail"),
        paths.station_folder(padded).alias("folder"),
        scores.confidence_band(F.col("confidence")).alias("band"),
        scores.percent_text(F.col("confidence")).alias("shown"),
    )


@query(
    "crop_boxes",
    """SELECT video_path, track_id, det_o, det_l, det_p, greatest(0, CAST(xmin AS INTEGER) - 50) AS crop_x1, greatest(0, CAST(ymin AS INTEGER) - 50) AS crop_y1,
  least(w, CAST(xmax AS INTEGER) + 50) AS crop_x2, least(h, CAST(ymax AS INTEGER) + 50) AS crop_y2 FROM detections""",
)
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    crops = scores.crop_box(c("xmin"), c("ymin"), c("xmax"), c("ymax"), c("w"), c("h"), pixels=50)
    return inputs.detections(spark, sf_dir).select(
        "video_path", "track_id", "det_o", "det_l", "det_p", *[v.alias(k) for k, v in crops.items()]
    )


@query(
    "surface_filtered_detections",
    """WITH s AS (SELECT *, (video_no % 13) * 1e0 AS depth_m, (det_p % 100) / 100e0 AS blue, (det_o % 100) / 100e0 AS tex FROM detections),
p AS (SELECT *, (1 - CAST(ymin AS INTEGER) / 1080e0) * 0.3e0 + greatest(0, 1 - abs(CAST(ymin AS INTEGER) / 1080e0 - CASE WHEN depth_m <= 0 THEN 0.2e0 WHEN depth_m < 2 THEN 0.15e0
  WHEN depth_m < 5 THEN 0.1e0 WHEN depth_m < 10 THEN 0.05e0 ELSE 0.02e0 END) * 5) * 0.25e0 + blue * 0.25e0 + tex * 0.2e0 AS pr FROM s)
SELECT video_path, track_id, det_o, det_l, det_p, confidence AS original_confidence, round(pr, 9) AS surface_probability, pr > 0.7e0 AS surface_filtered,
  round(CASE WHEN pr > 0.7e0 THEN confidence * (1 - pr * 0.5e0) ELSE confidence END, 9) AS confidence FROM p""",
)
def surface_filtered_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reefline.operators.imaging import surface_filter

    scored = inputs.detections(spark, sf_dir).selectExpr(
        "*",
        "(video_no % 13) * 1e0 AS depth_m",
        "(det_p % 100) / 100e0 AS blue_variance",
        "(det_o % 100) / 100e0 AS texture",
    )
    return surface_filter(scored).select(
        "video_path",
        "track_id",
        "det_o",
        "det_l",
        "det_p",
        "original_confidence",
        F.bround("surface_probability", 9).alias("surface_probability"),
        "surface_filtered",
        F.bround("confidence", 9).alias("confidence"),
    )


@query(
    "json_round_trip",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "map<string,bigint>")
    again = F.from_json(F.to_json(parsed), "map<string,bigint>")
    return inputs.table(spark, sf_dir, "events").select("event_id", again["k"].alias("k"))


@query(
    "class_names",
    """SELECT p_partkey, translate(concat(p_brand, ' ', p_name, '/x.'), ' ./', '___') AS class FROM part""",
)
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "part").select(
        "p_partkey",
        names.class_name(F.concat("p_brand", F.lit(" "), "p_name", F.lit("/x."))).alias("class"),
    )
