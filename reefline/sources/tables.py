"""Detection, overview, validation and metadata files in, result files out."""

from __future__ import annotations

import re
import struct
import sys
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reefline import schemas
from reefline.functions.paths import basename
from reefline.operators.metadata import normalise_user_metadata
from reefline.operators.review import clean_validation

# The functions below travel to the executors whole: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Quotes inside quoted text are doubled, as spreadsheet programs write them, and quoted text may hold line breaks:
# a file is then read from its start to its end by one task, row by row.
# White space around values is written as it is.
CSV = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


# One task reads a whole file, so a file holds at most this many rows.
CSV_ROWS = 250_000


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast text columns to declared types by name; a value that does not fit becomes null."""
    known = {f.name: f.dataType for f in schema.fields}
    return df.select(
        *[
            F.col(f"`{c}`").try_cast(known[c]).alias(c) if c in known else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def file_headers(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(``source_file``, ``header``): the first line of every file that has one.

    A first line that ends inside quotes is not the whole header; the file's path stands behind it.
    """
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return (
        lines.filter(F.col("_start") == 0)
        .groupBy("source_file")
        .agg(F.min_by("value", "_at").alias("header"))
        .withColumn("header", F.when(F.length(F.regexp_replace("header", '[^"]', "")) % 2 == 1, F.concat_ws("\n", "header", "source_file")).otherwise(F.col("header")))
    )


def csv_by_name(
    spark: SparkSession, path: str | list[str], known: Sequence[str], glob: str | None = None
) -> DataFrame:
    """CSV files as text columns by name, each row with its ``source_file``.

    Files may have their columns in different orders and numbers: files with the
    same first line are read together, and the tables are united by name. A file
    whose header names none of the ``known`` columns stops the job. Quoted
    text may hold commas, quotes and line breaks.
    """
    groups: dict[str, list[str]] = {}
    for r in file_headers(spark, path, glob).collect():  # one row per file, as in Spark's own listing
        groups.setdefault(r["header"], []).append(r["source_file"])
    tables = []
    for header, files in sorted(groups.items()):
        rows = spark.read.options(**CSV).csv(sorted(unquote(f) for f in files))
        if not set(known) & set(rows.columns):
            raise ValueError(f"no known column in the first line of {sorted(files)[0]}: {header!r}")
        tables.append(rows.withColumn("source_file", F.col("_metadata.file_path")))
    if not tables:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in [*known, "source_file"]]))
    return union_tables(*tables)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with a header, typed by column name; columns outside the schema stay text."""
    return typed(csv_by_name(spark, path, schema.names).drop("source_file"), schema)


def read_detections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_csv(spark, path, schemas.DETECTIONS)


def read_raw_detections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_csv(spark, path, schemas.RAW_DETECTIONS)


def read_overview(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_csv(spark, path, schemas.OVERVIEW)


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add rows as new files; nothing already written is read or rewritten."""
    writer = df.write.mode("append")
    if fmt == "csv":
        writer = writer.options(**CSV, maxRecordsPerFile=CSV_ROWS)
    writer.format(fmt).save(path)


RUN = "run"


def append_run(df: DataFrame, path: str, run: str, fmt: str = "parquet") -> None:
    """Add the rows of a run. Appending a run again, after a failure or by mistake, replaces its rows.

    Each run owns the folder ``run=<name>``; other runs are neither read nor
    rewritten. A run without rows leaves earlier rows of that name as they are.
    """
    writer = df.withColumn(RUN, F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN)
    if fmt == "csv":
        writer = writer.options(**CSV, maxRecordsPerFile=CSV_ROWS)
    writer.format(fmt).save(path)


def read_runs(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The rows of all appended runs with their ``run``; columns that a run lacks are null."""
    if fmt == "csv":
        rows = csv_by_name(spark, f"{path}/{RUN}=*", schema.names)
        name = F.regexp_extract("source_file", rf"/{RUN}=([^/]*)/[^/]*$", 1)
        for _ in range(2):  # a folder's name is encoded, and so is a file's address
            name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
        return typed(rows.withColumn(RUN, name).drop("source_file"), schema)
    kept = T.StructType([*schema.fields, T.StructField(RUN, T.StringType())])
    return spark.read.schema(kept).format(fmt).load(path)


def union_tables(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns one of them lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def consolidate(
    spark: SparkSession, pattern: str, schema: T.StructType = schemas.DETECTIONS
) -> DataFrame:
    """Many result CSV files as one table, each row with its ``source_file``."""
    return typed(csv_by_name(spark, pattern, schema.names), schema)


# --- validation files -----------------------------------------------------


def validation_precedence(name: Column) -> Column:
    """1 for the reviewer's file, 2 for the fixed name, 3 for dated ones, else null."""
    return (
        F.when(name == "validation_results_TG.csv", F.lit(1))
        .when(name == "validation_results.csv", F.lit(2))
        .when(name.rlike(r"^validation_results_.*\.csv$"), F.lit(3))
    )


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths and sizes under a folder. Contents are not read.

    Spark's reader leaves empty files out of its rows but not out of its listing,
    so they are added from there with size 0.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "length")
    )
    listed = [(unquote(re.sub("^file:/+", "file:/", f)),) for f in found.inputFiles()]
    return (
        spark.createDataFrame(listed, "path string")
        .join(found, "path", "left")
        .select("path", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"))
    )


def validation_files(spark: SparkSession, folder: str) -> DataFrame:
    """Validation files, best first: by precedence, dated ones from the latest name."""
    name = basename(F.col("path"))
    return (
        list_files(spark, folder, "validation_results*.csv")
        .select("path", name.alias("name"), validation_precedence(name).alias("precedence"))
        .filter(F.col("precedence").isNotNull())
        .orderBy(F.col("precedence").asc(), F.col("name").desc())
    )


def read_review_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The rows of given validation files, cleaned and typed."""
    raw = csv_by_name(spark, paths, schemas.VALIDATION_COLUMNS).drop("source_file")
    missing = [c for c in schemas.VALIDATION_COLUMNS if c not in raw.columns]
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in missing})
    return clean_validation(raw).withColumn("track_id", F.trim("track_id").try_cast("bigint"))


def read_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The validation table of the best file in a folder; no file gives no rows."""
    chosen = validation_files(spark, folder).limit(1).collect()
    if not chosen:
        return spark.createDataFrame([], _empty_validation())
    return read_review_files(spark, chosen[0]["path"])


def _empty_validation() -> T.StructType:
    kinds = {"track_id": T.LongType(), "time_seconds": T.DoubleType(), "confidence": T.DoubleType()}
    return T.StructType(
        [T.StructField(c, kinds.get(c, T.StringType())) for c in schemas.VALIDATION_COLUMNS]
    )


def read_all_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every validation file, with a ``precedence`` that is lowest for the best file."""
    files = csv_by_name(spark, folder, schemas.VALIDATION_COLUMNS, "validation_results*.csv")
    raw = files.withColumn("review_file", basename(F.col("source_file"))).drop("source_file")
    missing = [c for c in schemas.VALIDATION_COLUMNS if c not in raw.columns]
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in missing})
    kind = validation_precedence(F.col("review_file"))
    return (
        clean_validation(raw)
        .withColumn("track_id", F.trim("track_id").try_cast("bigint"))
        .filter(kind.isNotNull())
        .withColumn("precedence", F.struct(kind.alias("kind"), _descending(F.col("review_file"))))
    )


def _descending(text: Column) -> Column:
    """A key that sorts dated file names from the latest to the earliest."""
    return (
        -F.coalesce(
            F.regexp_replace(text, r"\D", "").try_cast("bigint"), F.lit(0).cast("bigint")
        )
    ).alias("date")


# --- labels in file names -------------------------------------------------


def parse_label_names(files: DataFrame) -> DataFrame:
    """(track_id, human_label) from names ``{track}-{label}.jpg`` or ``{track}.jpg``.

    ``problem`` is 'name' where a name does not parse, 'duplicate' where a name
    occurs twice, 'conflict' where a track has two names, else null.
    """
    name = basename(F.col("path"))
    head = F.regexp_extract(name, r"^\s*([+-]?\d+)\s*-", 1)
    number = F.regexp_extract(name, r"^(\d+)\.", 1)
    plain = number != ""
    parsed = files.select(
        name.alias("name"),
        F.when(plain, number.try_cast("bigint")).otherwise(head.try_cast("bigint")).alias("track_id"),
        F.when(
            ~plain & (head != ""),
            F.replace(F.regexp_extract(name, r"^[^-]*-(.*)$", 1), F.lit(".jpg"), F.lit("")),
        ).alias("human_label"),
    )
    names = parsed.groupBy("name", "track_id", "human_label").agg(F.count(F.lit(1)).alias("_files"))
    tracks = (
        names.filter(F.col("track_id").isNotNull())
        .groupBy("track_id")
        .agg(F.count(F.lit(1)).alias("_names"))
    )
    return names.join(tracks, "track_id", "left").select(
        "name",
        "track_id",
        "human_label",
        F.when(F.col("track_id").isNull(), F.lit("name"))
        .when(F.col("_files") > 1, F.lit("duplicate"))
        .when(F.col("_names") > 1, F.lit("conflict"))
        .alias("problem"),
    )


def read_label_names(spark: SparkSession, folder: str) -> DataFrame:
    return parse_label_names(list_files(spark, folder, "*jpg"))


def file_checksums(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """MD5 of every file's bytes."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "length", F.md5("content").alias("checksum"))
    )


# --- videos, frames, metadata ---------------------------------------------


def read_video_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under a folder as (video_path, size), paths relative to the folder."""
    root = folder.rstrip("/") + "/"
    return list_files(spark, folder, "*").select(
        F.substring_index(F.col("path"), root, -1).alias("video_path"), F.col("length").alias("size")
    )


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted frames ``<video path>/<frame number>.<ending>`` as image rows, blue first."""
    origin = F.col("image.origin")
    root = folder.rstrip("/") + "/"
    inside = F.substring_index(origin, root, -1)
    return (
        spark.read.format("image")
        .option("recursiveFileLookup", True)
        .option("dropInvalid", True)
        .load(folder)
        .select(
            F.regexp_replace(inside, "/[^/]*$", "").alias("video_path"),
            F.regexp_extract(inside, r"(\d+)\.[^./]*$", 1).try_cast("bigint").alias("frame"),
            "image.height",
            "image.width",
            "image.nChannels",
            "image.data",
        )
    )


def png(pixels: bytes, height: int, width: int, channels: int) -> bytes:
    """A PNG file of 8-bit pixels, grey or blue first."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    if channels > 1:
        rows = rows[:, :, 2::-1]
    marked = np.zeros((height, 1 + rows[0].size), np.uint8)  # a row starts with its filter, none
    marked[:, 1:] = rows.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels > 1 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(marked.tobytes(), 6)) + chunk(b"IEND", b"")


def write_frames(frames: DataFrame, folder: str) -> int:
    """Save frames as ``<folder>/<video path>/<frame>.png``, from the tasks that hold them; the number of files.

    A task that runs again writes the same files. ``folder`` is a path or an
    address that pyarrow's file systems know.
    """
    make, root = png, folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for batch in batches:
            for video, frame, height, width, channels, data in zip(*[c.to_pylist() for c in batch.columns]):
                system.create_dir(f"{base}/{video}", recursive=True)
                with system.open_output_stream(f"{base}/{video}/{frame}.png") as out:
                    out.write(make(data, height, width, channels))
            yield pa.record_batch([pa.array([batch.num_rows])], names=["files"])

    columns = ["video_path", "frame", "height", "width", "nChannels", "data"]
    return frames.select(*columns).mapInArrow(run, "files bigint").agg(F.sum("files")).first()[0] or 0


def write_texts(texts: DataFrame, folder: str) -> int:
    """Save ``value`` as the file ``<folder>/<path>``, from the tasks that hold the rows; the number of files.

    No file is moved after it is written, so the driver has no list of files to
    go through. A task that runs again writes the same files.
    """
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        made = set()
        for batch in batches:
            for path, value in zip(*[c.to_pylist() for c in batch.columns]):
                inside = path.rpartition("/")[0]
                if inside not in made:
                    system.create_dir(f"{base}/{inside}", recursive=True)
                    made.add(inside)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(value.encode())
            yield pa.record_batch([pa.array([batch.num_rows])], names=["files"])

    return texts.select("path", "value").mapInArrow(run, "files bigint").agg(F.sum("files")).first()[0] or 0


def read_user_metadata(spark: SparkSession, path: str) -> DataFrame:
    return normalise_user_metadata(spark.read.options(**CSV).csv(path))


def read_metadata_json(
    spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = False
) -> DataFrame:
    """JSON files of one object or array each; with ``lines``, of an object on every line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_metadata_text(spark: SparkSession, path: str) -> DataFrame:
    """``key: value`` files as (source_file, metadata map). The last of equal keys counts.

    A file that opens with ``---`` is read up to the closing ``---``.
    """
    content = F.col("value")
    front = F.when(
        content.startswith("---"), F.get(F.split(content, "---", 3), F.lit(1))
    ).otherwise(content)
    lines = F.filter(F.split(front, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.trim(F.get(F.split(x, ":", 2), F.lit(0))).alias("key"),
            F.trim(F.get(F.split(x, ":", 2), F.lit(1))).alias("value"),
        ),
    )
    last = F.filter(
        F.col("pairs"),
        lambda p, i: ~F.exists(
            F.slice(F.col("pairs"), i + 2, F.size("pairs")), lambda q: q["key"] == p["key"]
        ),
    )
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("source_file"), pairs.alias("pairs"))
        .select("source_file", F.map_from_entries(last).alias("metadata"))
    )


# --- sinks ----------------------------------------------------------------


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    """Write as csv, json or parquet, partitioned if wanted (for example by collection)."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported format: {fmt}")
    writer = (flat(df) if fmt == "csv" else df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.options(**CSV, maxRecordsPerFile=CSV_ROWS)
    writer.format(fmt).save(path)


def write_class_mapping(classes: DataFrame, path: str) -> None:
    """Lines ``index<TAB>class``."""
    classes.select(
        F.concat_ws("\t", F.col("class_idx").cast("string"), "class").alias("value")
    ).write.mode("overwrite").text(path)
