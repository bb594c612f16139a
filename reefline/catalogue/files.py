"""Round trips through files and incremental runs, over the given tables.

Intermediate files go to a new folder below the shared checkpoint folder.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline import schemas
from reefline.catalogue import inputs
from reefline.catalogue.registry import query
from reefline.catalogue.suggestions import _LATER, _LATER_SPECIES, _VOTES, WINDOW_MS, votes_sql
from reefline.operators import maxn as m
from reefline.operators import metadata, training
from reefline.operators import tracks as t
from reefline.schemas import TRACK_KEY
from reefline.session import checkpoint_root
from reefline.sources import tables
from reefline.streaming import incremental


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/reefline-{uuid.uuid4().hex}"


_ROWS = ["video_path", "video_name", "frame", "time", "xmin", "ymin", "xmax", "ymax", "w", "h", "confidence", "label", "track_id"]


@query(
    "detections_through_csv",
    f"SELECT {', '.join(_ROWS)}, concat('/surveys/', video_path, '/', CAST(track_id AS VARCHAR)) AS track_metadata, folder1, folder2 FROM detections",
)
def detections_through_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    rows = inputs.detections(spark, sf_dir).select(
        *_ROWS,
        F.concat(F.lit("/surveys/"), "video_path", F.lit("/"), F.col("track_id").cast("string")).alias("track_metadata"),
        "folder1",
        "folder2",
    )
    tables.append_table(rows, folder, "csv")
    return tables.read_detections(spark, folder)


@query(
    "consolidated_results",
    f"""SELECT {', '.join(_ROWS)}, folder1, CASE WHEN video_no % 2 = 0 THEN folder2 END AS folder2, CASE WHEN video_no % 2 = 0 THEN 'run1' ELSE 'run2' END AS run
FROM detections""",
)
def consolidated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with different folder depths, read back as one table."""
    folder = _folder(spark)
    found = inputs.detections(spark, sf_dir).select(*_ROWS, "folder1", "folder2", "video_no")
    tables.write_table(found.filter("video_no % 2 = 0").drop("video_no"), f"{folder}/run1/internal_results", "csv")
    tables.write_table(
        found.filter("video_no % 2 = 1").drop("video_no", "folder2"), f"{folder}/run2/internal_results", "csv"
    )
    together = tables.consolidate(spark, f"{folder}/*/internal_results/*.csv")
    return together.select(*_ROWS, "folder1", "folder2", F.regexp_extract("source_file", "/(run[12])/", 1).alias("run"))


# Each run's tracker wrote other columns; the second run is appended twice, the first time cut short.
_RUN_SQL = "CASE WHEN video_no % 2 = 0 THEN 'day 1' ELSE 'day 2+' END AS run"


@query(
    "appended_raw_runs",
    f"""SELECT video_path, video_name, frame, time, xmin, ymin, xmax, ymax, w, h, confidence, label, track_id % 5 > 0 AS has_track_id,
  CASE WHEN video_no % 2 = 0 THEN track_id END AS track_id, {_RUN_SQL} FROM detections""",
)
def appended_raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of two runs in one CSV table."""
    folder = _folder(spark)
    rows = inputs.detections(spark, sf_dir).withColumn("has_track_id", F.col("track_id") % 5 > 0)
    raw = rows.select(*_ROWS[:-1], "has_track_id", "track_id", "video_no")
    second = raw.filter("video_no % 2 = 1").drop("track_id", "video_no")
    tables.append_run(raw.filter("video_no % 2 = 0").drop("video_no"), folder, "day 1", "csv")
    tables.append_run(second.filter("frame < 20"), folder, "day 2+", "csv")
    tables.append_run(second, folder, "day 2+", "csv")
    return tables.read_runs(spark, folder, schemas.RAW_DETECTIONS, "csv").select(
        *_ROWS[:-1], "has_track_id", "track_id", "run"
    )


@query(
    "appended_overviews",
    f"SELECT video_path, count(DISTINCT track_id) AS tracks_found, {_RUN_SQL} FROM detections GROUP BY video_path, video_no",
)
def appended_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overviews of two runs; the second run is appended twice."""
    folder = _folder(spark)
    counted = inputs.detections(spark, sf_dir).groupBy("video_path", "video_no").agg(F.count_distinct("track_id").alias("tracks_found"))
    for run, odd in (("day 1", 0), ("day 2+", 1), ("day 2+", 1)):
        tables.append_run(counted.filter(F.col("video_no") % 2 == odd).drop("video_no"), folder, run)
    return tables.read_runs(spark, folder, schemas.OVERVIEW)


_NOTES = (
    "CASE track_id % 5 WHEN 0 THEN concat('first line', chr(10), 'second, line') WHEN 1 THEN concat('said \"yes\"', chr(13), chr(10), ' at ', video_id)"
    " WHEN 2 THEN concat(chr(10), chr(10)) WHEN 3 THEN NULL ELSE 'plain' END"
)


@query(
    "reviews_with_line_breaks",
    f"""SELECT collection, bruv_station, video_id, track_id, lower(trim(true_detection)) AS true_detection, trim(species) AS species,
  coalesce(trim({_NOTES}), '') AS notes FROM validation""",
)
def reviews_with_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with line breaks, commas and quotes, through a CSV file."""
    folder = _folder(spark)
    table = inputs.validation(spark, sf_dir).withColumn("notes", F.expr(_NOTES))
    tables.write_table(table.drop("video_no", "time_ms"), folder, "csv")
    return tables.read_review_files(spark, folder).select(*TRACK_KEY, "true_detection", "species", "notes")


@query(
    "overview_with_missing_columns",
    """SELECT video_path, CAST(tracks_found AS BIGINT) AS tracks_found, note FROM (SELECT DISTINCT video_path, video_no % 7 AS tracks_found, NULL::VARCHAR AS note FROM detections WHERE video_no % 2 = 0
UNION ALL SELECT DISTINCT video_path, NULL, 'late' FROM detections WHERE video_no % 2 = 1)""",
)
def overview_with_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = inputs.detections(spark, sf_dir).select("video_path", "video_no").distinct()
    return tables.union_tables(
        videos.filter("video_no % 2 = 0").selectExpr("video_path", "video_no % 7 AS tracks_found"),
        videos.filter("video_no % 2 = 1").selectExpr("video_path", "'late' AS note"),
    )


@query(
    "exported_validation_through_csv",
    """SELECT collection, bruv_station, video_id, track_id, time_seconds, confidence, lower(trim(true_detection)) AS true_detection,
  trim(taxon_group) AS taxon_group, trim(species) AS species FROM validation""",
)
def exported_validation_through_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    tables.write_table(inputs.validation(spark, sf_dir).drop("video_no", "time_ms"), folder, "csv")
    return tables.read_review_files(spark, folder).select(
        *TRACK_KEY,
        "time_seconds",
        "confidence",
        "true_detection",
        "taxon_group",
        "species",
    )


# File names as reviewers leave them: labelled, renamed twice, plain, copied into a second folder, and unreadable.
_LABEL_FILES = (
    "CASE WHEN c_custkey % 7 = 6 THEN 'cover.jpg' WHEN c_custkey % 7 = 5 THEN concat(CAST(c_custkey AS STRING), '.jpg')"
    " ELSE concat(CAST(c_custkey AS STRING), '-', CASE c_custkey % 3 WHEN 0 THEN 'Tiger-shark' WHEN 1 THEN '' ELSE 'ESU' END, '.jpg') END"
)
_MORE_FILES = "CASE c_custkey % 5 WHEN 0 THEN {0} ELSE concat(' ', CAST(c_custkey AS STRING), ' - Ray.jpg') END"


@query(
    "labels_of_file_names",
    f"""WITH f AS (SELECT {_LABEL_FILES} AS name FROM customer UNION ALL SELECT {_MORE_FILES.format(_LABEL_FILES)} FROM customer WHERE c_custkey % 11 = 0),
p AS (SELECT name, CASE WHEN regexp_matches(name, '^[0-9]+[.]') THEN CAST(regexp_extract(name, '^([0-9]+)[.]', 1) AS BIGINT)
    WHEN regexp_matches(name, '^ *[0-9]+ *-') THEN CAST(regexp_extract(name, '^ *([0-9]+) *-', 1) AS BIGINT) END AS track_id,
  CASE WHEN regexp_matches(name, '^ *[0-9]+ *-') THEN replace(regexp_extract(name, '^[^-]*-(.*)$', 1), '.jpg', '') END AS human_label FROM f),
n AS (SELECT name, track_id, human_label, count(*) AS files FROM p GROUP BY ALL),
t AS (SELECT track_id, count(*) AS names FROM n WHERE track_id IS NOT NULL GROUP BY ALL)
SELECT name, track_id, human_label, CASE WHEN track_id IS NULL THEN 'name' WHEN files > 1 THEN 'duplicate' WHEN names > 1 THEN 'conflict' END AS problem
FROM n LEFT JOIN t USING (track_id)""",
)
def labels_of_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that reviewers wrote into the names of thumbnails."""
    files = inputs.table(spark, sf_dir, "customer")
    more = files.filter("c_custkey % 11 = 0").selectExpr(f"concat('/run/b/', {_MORE_FILES.format(_LABEL_FILES)}) AS path")
    return tables.parse_label_names(files.selectExpr(f"concat('/run/a/', {_LABEL_FILES}) AS path").unionByName(more))


@query(
    "metadata_of_text_files",
    """SELECT s_suppkey, s_name AS site, CAST(s_acctbal AS VARCHAR) AS depth, 'kept: with colon' AS notes FROM supplier""",
)
def metadata_of_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``key: value`` file per site; of equal keys the last counts, lines without a colon are passed over."""
    folder = _folder(spark)
    lines = F.array(
        F.lit("site: overwritten"),
        F.concat(F.lit("  site : "), "s_name"),
        F.lit("a line of text"),
        F.concat(F.lit("depth:"), F.col("s_acctbal").cast("string")),
        F.lit("notes: kept: with colon"),
    )
    # a fixed number of folders, so that none is listed for long
    place = F.concat((F.col("s_suppkey") % 256).cast("string"), F.lit("/"), F.col("s_suppkey").cast("string"), F.lit(".txt"))
    rows = inputs.table(spark, sf_dir, "supplier").repartition(64, "s_suppkey")
    tables.write_texts(rows.select(place.alias("path"), F.array_join(lines, "\n").alias("value")), folder)
    found = tables.read_metadata_text(spark, f"{folder}/*")
    key = F.regexp_extract("source_file", "/([0-9]+)[.]txt$", 1).cast("bigint").alias("s_suppkey")
    return found.select(key, *[F.col("metadata")[c].alias(c) for c in ("site", "depth", "notes")])


@query(
    "metadata_of_json_files",
    "SELECT concat('v', CAST(loc_id AS VARCHAR)) AS video_path, lat AS latitude, lon AS longitude, depth FROM locations",
)
def metadata_of_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested metadata through JSON files with a declared schema."""
    folder = _folder(spark)
    rows = inputs.locations(spark, sf_dir).select(
        F.concat(F.lit("v"), F.col("loc_id").cast("string")).alias("video_path"),
        F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("gps_location"),
        "depth",
    )
    tables.write_table(rows, folder, "json")
    found = tables.read_metadata_json(spark, folder, rows.schema, lines=True)
    return found.select("video_path", "gps_location.latitude", "gps_location.longitude", "depth")


@query(
    "class_mapping_file",
    """SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS VARCHAR) || chr(9) || label AS line FROM (SELECT DISTINCT label FROM cleaned)""",
)
def class_mapping_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping from class number to class, as it stands in its file."""
    folder = _folder(spark)
    labels = m.apply_human_labels(inputs.detections(spark, sf_dir), inputs.labeled(spark, sf_dir)).select(F.col("label").alias("class"))
    tables.write_class_mapping(training.class_index(labels), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


@query(
    "metadata_preview",
    """SELECT video_filename, coalesce(site_name, '') AS site_name, CAST(depth_m AS VARCHAR) AS depth_m FROM (
  SELECT concat('GH', CAST(c_custkey AS VARCHAR), '.MP4') AS video_filename, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS site_name, c_nationkey AS depth_m
  FROM customer ORDER BY c_custkey LIMIT 5)""",
)
def metadata_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a metadata table, with '' for what is missing."""
    rows = inputs.table(spark, sf_dir, "customer").orderBy("c_custkey").select(
        F.concat(F.lit("GH"), F.col("c_custkey").cast("string"), F.lit(".MP4")).alias("video_filename"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("site_name"),
        F.col("c_nationkey").alias("depth_m"),
    )
    return metadata.preview(rows)


@query(
    "incremental_maxn",
    """WITH f AS (SELECT video_path, video_name, frame, label, count(track_id) AS n, array_to_string(list_sort(list(track_id)), ',') AS tracks_in_maxn
  FROM detections GROUP BY ALL)
SELECT video_path, frame, label, n, tracks_in_maxn FROM f QUALIFY row_number() OVER (PARTITION BY video_path, video_name, label ORDER BY n DESC, frame) = 1""",
)
def incremental_maxn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows arrive as a stream, are appended once, and MaxN is read from the sink.

    The stream is run twice: the second run finds nothing new.
    """
    folder = _folder(spark)
    schema = inputs.table(spark, sf_dir, "lineitem").schema

    def shape(batch: DataFrame) -> DataFrame:
        return batch.selectExpr(*inputs.DETECTION_EXPRESSIONS).select(
            "video_path", "video_name", "frame", "label", "track_id", "time_ms"
        )

    for _ in range(2):
        stream = incremental.new_files(spark, sf_dir, schema, pattern="lineitem.parquet")
        incremental.process_new_results(stream, f"{folder}/sink", f"{folder}/progress", shape)
    stored = spark.read.parquet(f"{folder}/sink").withColumn("time", F.col("time_ms").cast("string"))
    return m.maxn_by_video(stored).select(
        "video_path", "frame", "label", "n", F.array_join("tracks_in_maxn", ",").alias("tracks_in_maxn")
    )


@query(
    "incremental_suggestion_history",
    _VOTES
    + """SELECT collection, bruv_station, video_id, track_id, suggested_species, suggestion_confidence, 'pending' AS outcome FROM pred WHERE status = 'suggested'""",
)
def incremental_suggestion_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validation table arrives as a stream and its suggestions become the first history."""
    folder = _folder(spark)
    table = inputs.validation(spark, sf_dir)
    tables.write_table(table, f"{folder}/reviews")
    stream = incremental.new_files(spark, f"{folder}/reviews", table.schema)
    incremental.update_history_state(stream, f"{folder}/state", f"{folder}/progress", WINDOW_MS)
    return incremental.read_history_state(spark, f"{folder}/state").select(
        *TRACK_KEY, "suggested_species", "suggestion_confidence", "outcome"
    )


# Three exports: some videos; the rest, with verdicts on the first; verdicts that come late.
_OTHERS = "video_no % 3 = 2"
_LATE = "CASE (track_id * 3 + video_no) % 5 WHEN 0 THEN ' True' WHEN 1 THEN 'false' ELSE '' END"
_REVIEW = "collection, bruv_station, video_id, track_id, time_ms, confidence, {} AS true_detection, {} AS species"
_EXPORTS = [
    (f"NOT {_OTHERS}", _REVIEW.format("true_detection", "species")),
    (
        "true",
        _REVIEW.format(
            f"CASE WHEN {_OTHERS} THEN true_detection ELSE {_LATER} END", f"CASE WHEN {_OTHERS} THEN species ELSE {_LATER_SPECIES} END"
        ),
    ),
    ("track_id % 4 = 3", _REVIEW.format(_LATE, "'Carcharhinus perezi'")),
]
_KEY_SQL = ", ".join(TRACK_KEY)


def _each(text: str, joint: str) -> str:
    return joint.join(text.replace("#", str(k)) for k in range(len(_EXPORTS)))


@query(
    "suggestion_history_of_three_batches",
    "WITH "
    + ", ".join(f"b{k} AS (SELECT {what} FROM validation WHERE {which})" for k, (which, what) in enumerate(_EXPORTS))
    + ", "
    + ", ".join(votes_sql(f"b{k}", str(k)) for k in range(len(_EXPORTS)))
    + ", s AS ("
    + _each(f"SELECT # AS batch, {_KEY_SQL}, suggested_species, suggestion_confidence FROM pred# WHERE status = 'suggested'", " UNION ALL ")
    + f"""), f AS (SELECT {_KEY_SQL}, arg_min(suggested_species, batch) AS suggested_species,
  arg_min(suggestion_confidence, batch) AS suggestion_confidence, min(batch) AS since FROM s GROUP BY ALL),
e AS ("""
    + _each(f"SELECT # AS batch, {_KEY_SQL}, td, trim(species) AS sp FROM t# WHERE td = 'false' OR (td = 'true' AND trim(species) <> '')", " UNION ALL ")
    + f"""), l AS (SELECT {_KEY_SQL}, arg_max(td, batch) AS td, arg_max(sp, batch) AS sp
  FROM e JOIN f USING ({_KEY_SQL}) WHERE batch >= since GROUP BY ALL)
SELECT {_KEY_SQL}, suggested_species, suggestion_confidence,
  CASE WHEN td IS NULL THEN 'pending' WHEN td = 'false' THEN 'incorrect_fp' WHEN lower(sp) = lower(suggested_species) THEN 'correct' ELSE 'incorrect' END AS outcome,
  CASE WHEN td = 'true' THEN sp END AS validated_species, td = 'true' AS validated_as_true
FROM f LEFT JOIN l USING ({_KEY_SQL})""",
)
def suggestion_history_of_three_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three exports arrive one after another; the second lists tracks twice, the third settles tracks late."""
    folder = _folder(spark)
    table = inputs.validation(spark, sf_dir)
    for k, (which, what) in enumerate(_EXPORTS):
        batch = table.filter(which).selectExpr(*_columns(what))
        if k == 1:  # an older export of the same tracks lies beside it
            batch = batch.unionByName(table.filter("track_id % 4 = 3 AND video_no % 3 = 0").selectExpr(*_columns(_EXPORTS[0][1])))
        tables.append_table(batch, f"{folder}/reviews")
        stream = incremental.new_files(spark, f"{folder}/reviews", batch.schema)
        incremental.update_history_state(stream, f"{folder}/state", f"{folder}/progress", WINDOW_MS)
    return incremental.read_history_state(spark, f"{folder}/state")


def _columns(what: str) -> list[str]:
    """The parts of a select list, cut at the commas outside brackets."""
    return re.split(r", (?![^()]*\))", what)


@query(
    "consolidated_track_ids",
    """WITH k AS (SELECT DISTINCT video_path, track_id FROM detections)
SELECT video_path, row_number() OVER (ORDER BY video_path, track_id) - 1 AS track_id FROM k""",
)
def consolidated_track_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that each start at track 0 get ids that do not collide."""
    found = inputs.detections(spark, sf_dir).select("video_path", "track_id")
    return t.global_track_ids(found, found.distinct()).distinct()
