"""Declared schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


STRING, LONG, DOUBLE, INT, BOOL = (
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.IntegerType(),
    T.BooleanType(),
)

_BOX = (("xmin", DOUBLE), ("ymin", DOUBLE), ("xmax", DOUBLE), ("ymax", DOUBLE))
_FRAME = (("video_path", STRING), ("video_name", STRING), ("frame", LONG), ("time", STRING))

DETECTIONS = _struct(
    *_FRAME,
    *_BOX,
    ("w", INT),
    ("h", INT),
    ("confidence", DOUBLE),
    ("label", STRING),
    ("track_metadata", STRING),
    ("track_id", LONG),
)

RAW_DETECTIONS = _struct(
    *_FRAME,
    *_BOX,
    ("w", INT),
    ("h", INT),
    ("confidence", DOUBLE),
    ("label", STRING),
    ("has_track_id", BOOL),
    ("track_id", LONG),
)

OVERVIEW = _struct(("video_path", STRING), ("tracks_found", LONG))

VALIDATION_COLUMNS = [
    "thumbnail",
    "collection",
    "bruv_station",
    "video_id",
    "track_id",
    "time",
    "time_seconds",
    "video_path",
    "confidence",
    "true_detection",
    "taxon_group",
    "species",
    "notes",
]

TRACK_KEY = ["collection", "bruv_station", "video_id", "track_id"]
VIDEO_KEY = ["collection", "bruv_station", "video_id"]

HISTORY = _struct(
    ("collection", STRING),
    ("bruv_station", STRING),
    ("video_id", STRING),
    ("track_id", LONG),
    ("suggested_species", STRING),
    ("suggestion_confidence", DOUBLE),
    ("outcome", STRING),
    ("validated_species", STRING),
    ("validated_as_true", BOOL),
)

TASKS = _struct(
    ("task_id", STRING),
    ("input_path", STRING),
    ("output_path", STRING),
    ("status", STRING),
    ("start_time", DOUBLE),
    ("end_time", DOUBLE),
    ("error_message", STRING),
    ("retry_count", INT),
    ("worker_id", STRING),
    ("file_size", LONG),
    ("checksum", STRING),
)

USER_METADATA_COLUMNS = [
    "video_filename",
    "site_name",
    "latitude",
    "longitude",
    "date",
    "time",
    "depth_m",
    "habitat",
    "substrate",
    "visibility_m",
    "water_temp_c",
    "notes",
]
