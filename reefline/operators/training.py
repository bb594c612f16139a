"""Training sets: classes, manifests, sampling, splits, replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefline.functions.clock import whole_div
from reefline.functions.names import blank, class_from_notes, training_class
from reefline.functions.paths import basename, dirname, stem, zero_pad, zero_pad_number
from reefline.functions.scores import crop_box, sample_times
from reefline.operators.ranking import bucketed_index, top_rows
from reefline.operators.tracks import TRACK, middle_detections

# Spellings of a confirmed detection in hand-made tables.
YES = ["true", "yes", "1", "t"]


def labels_from_validation(validation: DataFrame, source: str = "new_validation") -> DataFrame:
    """Training rows from the validation table; rows that are neither true nor false drop out."""
    return (
        validation.filter(~blank(F.col("thumbnail")))
        .select(
            F.lit(source).alias("source"),
            F.trim("thumbnail").alias("filename"),
            training_class(
                F.col("true_detection"), F.col("taxon_group"), F.col("species")
            ).alias("class"),
        )
        .filter(F.col("class").isNotNull())
    )


def labels_from_notes(validation: DataFrame, source: str = "notes_validation") -> DataFrame:
    """Training rows from the older table form with explanations in the notes."""
    return validation.select(
        F.lit(source).alias("source"),
        F.col("image_filename").alias("filename"),
        class_from_notes(F.col("true_detection"), F.col("species"), F.col("notes")).alias("class"),
    ).filter(F.col("class").isNotNull())


def all_labels(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def class_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("class").agg(F.count(F.lit(1)).alias("images"))


def class_index(labels: DataFrame) -> DataFrame:
    """Number the distinct classes 0..n-1 in name order."""
    return bucketed_index(
        labels.select("class").distinct(),
        [],
        F.substring("class", 1, 2),
        [F.col("class")],
        "class_idx",
    )


def track_windows(
    validation: DataFrame,
    detections: DataFrame,
    key: Sequence[str] = TRACK,
    ties: Sequence[str] = (),
    nulls_last: bool = False,
) -> DataFrame:
    """Confirmed tracks with a species: first and last time and the middle detection's box.

    Times come from ``time_ms``, the confidence is that of the middle detection.
    Missing frames and ties come first, or last with ``nulls_last``.
    """
    keys = list(key)
    confirmed = validation.filter(
        F.lower(F.trim(F.col("true_detection").cast("string"))).isin(*YES) & ~blank(F.col("species"))
    ).select(
        *keys,
        F.replace(F.replace(F.trim("species"), F.lit(" "), F.lit("_")), F.lit("."), F.lit("")).alias(
            "species"
        ),
    )
    middle = middle_detections(
        detections,
        keys,
        ties or ("xmin", "ymin", "xmax", "ymax"),
        over={"start_ms": F.min("time_ms"), "end_ms": F.max("time_ms")},
        nulls_last=nulls_last,
    ).select(
        *keys,
        "start_ms",
        "end_ms",
        *[c for c in ("video_path", "video_name") if c not in keys],
        "detections",
        "w",
        "h",
        "confidence",
        *[F.col(c).cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")],
    )
    return confirmed.join(middle, keys)


def frame_manifest(
    tracks: DataFrame, most: int = 20, every_ms: int = 200, padding: float = 0.2
) -> DataFrame:
    """One row per frame to cut: time, crop box and output name.

    A box with a coordinate of 0 is not cropped: the whole frame is kept.
    """
    box = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    whole = (box[0] == 0) | (box[1] == 0) | (box[2] == 0) | (box[3] == 0)
    crops = crop_box(*box, F.col("w"), F.col("h"), share=padding)
    full = {
        "crop_x1": F.lit(0),
        "crop_y1": F.lit(0),
        "crop_x2": F.col("w").cast("int"),
        "crop_y2": F.col("h").cast("int"),
    }
    return (
        tracks.withColumns({n: F.when(whole, full[n]).otherwise(c) for n, c in crops.items()})
        .select(
            "video_path",
            "video_name",
            "track_id",
            "species",
            "crop_x1",
            "crop_y1",
            "crop_x2",
            "crop_y2",
            F.posexplode(
                sample_times(F.col("start_ms"), F.col("end_ms"), most, every_ms)
            ).alias("frame_no", "frame_ms"),
        )
        .withColumn(
            "image_name",
            F.concat(
                F.col("species"),
                F.lit("/"),
                F.col("video_name"),
                F.lit("_track"),
                zero_pad_number(F.col("track_id"), 4),
                F.lit("_frame"),
                zero_pad(F.col("frame_no").cast("string"), 3),
                F.lit(".jpg"),
            ),
        )
    )


def extraction_stats(manifest: DataFrame) -> DataFrame:
    """Tracks and frames per species; a video's frames are shared evenly by its tracks, rounded down."""
    per_video = manifest.groupBy("video_path").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_distinct("track_id", "species").alias("tracks"),
    )
    tracks = manifest.groupBy("video_path", "species").agg(
        F.count_distinct("track_id").alias("n")
    )
    share = whole_div(F.col("frames"), F.col("tracks"))
    return (
        tracks.join(per_video, "video_path")
        .groupBy("species")
        .agg(F.sum("n").alias("tracks"), F.sum(F.col("n") * share).alias("frames"))
    )


def track_of_image(name: Column) -> Column:
    """Stem without its last ``_`` part; the stem itself when it has only one part."""
    return F.regexp_replace(stem(name), "_[^_]*$", "")


def training_summary(images: DataFrame) -> DataFrame:
    """Per class: tracks and frames of the images (class, filename)."""
    return images.groupBy("class").agg(
        F.count_distinct(track_of_image(F.col("filename"))).alias("tracks"),
        F.count(F.lit(1)).alias("frames"),
    )


def videos_included(images: DataFrame) -> DataFrame:
    """Distinct first name parts of the images."""
    return images.select(F.element_at(F.split(stem(F.col("filename")), "_"), 1).alias("video")).distinct()


def seeded_hash(seed: int, *columns: str) -> Column:
    """A reproducible 60-bit number from a seed and the columns' text."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def diverse_sample(
    images: DataFrame, n: int, seed: int = 0, track: Column | None = None, name: str = "filename"
) -> DataFrame:
    """Up to ``n`` images per class, taking one per track in each round.

    A track can give at most ``n`` images, so both steps are limited before they shuffle.
    """
    track = track_of_image(F.col(name)) if track is None else track
    shuffled = images.withColumns({"_track": track, "_h": seeded_hash(seed, name)})
    rounds = Window.partitionBy("class", "_track").orderBy("_h", name)
    placed = shuffled.withColumn("_round", F.row_number().over(rounds)).filter(F.col("_round") <= n)
    return top_rows(
        placed, ["class"], [F.col("_round").asc(), F.col("_track").asc(), F.col(name).asc()], n
    ).drop("_track", "_h", "_round")


def label_by_folder(images: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """Class from the parent folder. Given classes, images of other folders drop out."""
    labelled = images.withColumn("class", basename(dirname(F.col("path"))))
    return labelled.filter(F.col("path").isNotNull() if classes is None else F.col("class").isin(*classes))


def label_by_name(images: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Class whose name, with or without its dots, the file name contains; the first listed wins."""
    name = stem(F.col("path"))
    found = F.lit(None).cast("string")
    for c in reversed(list(classes)):
        found = F.when(name.contains(c) | name.contains(c.replace(".", "")), F.lit(c)).otherwise(found)
    return images.withColumn("class", found).filter(F.col("class").isNotNull())


def stratified_split(
    rows: DataFrame,
    keys: Sequence[str],
    validation_share: float = 0.2,
    seed: int = 42,
    by: str = "class",
) -> DataFrame:
    """Mark ``ceil(share * n)`` rows of each class, in seeded hash order, as validation.

    Positions come from hash runs, so a class of any size spreads over many tasks.
    """
    ranked = bucketed_index(
        rows.withColumn("_h", seeded_hash(seed, *keys)),
        [by],
        F.shiftright("_h", 48),
        [F.col("_h"), *[F.col(k) for k in keys]],
        "_at",
    )
    sizes = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) * validation_share).alias("_take"))
    return (
        ranked.join(sizes, by)
        .withColumn(
            "split", F.when(F.col("_at") < F.col("_take"), F.lit("validation")).otherwise(F.lit("train"))
        )
        .drop("_h", "_at", "_take")
    )


def with_replay(images: DataFrame, replay: DataFrame) -> DataFrame:
    """New training images and replayed ones, whose names get the prefix ``replay_``."""
    return images.withColumn("replayed", F.lit(False)).unionByName(
        replay.withColumns(
            {
                "filename": F.concat(F.lit("replay_"), F.col("filename")),
                "replayed": F.lit(True),
            }
        )
    )
