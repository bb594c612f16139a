"""MaxN: the largest number of individuals of a label in any single frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.functions.clock import ms_to_clock
from reefline.functions.names import UNCLASSIFIABLE, blank, metric_columns
from reefline.functions.paths import folder_columns
from reefline.operators.ranking import null_safe_join, running_total, top_rows


def apply_human_labels(
    detections: DataFrame, labels: DataFrame, on: Sequence[str] = ("video_path", "track_id")
) -> DataFrame:
    """Keep tracks a reviewer kept; an empty human label falls back to the model's.

    ``labels`` has the key columns and ``human_label``, one row per key.
    """
    return (
        detections.join(labels.select(*on, "human_label"), list(on), "inner")
        .withColumn(
            "label",
            F.when(blank(F.col("human_label")), F.col("label")).otherwise(F.col("human_label")),
        )
        .drop("human_label")
    )


def label_confidence(labels: DataFrame) -> DataFrame:
    """Share of kept tracks that carry a usable label; no label counts as usable."""
    usable = ~F.col("human_label").eqNullSafe(F.lit(UNCLASSIFIABLE))
    return labels.agg(F.avg(usable.cast("double")).alias("maxn_confidence"))


def frame_counts(detections: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Boxes per frame and label. Counting starts before the shuffle, so frames stay small.

    With a ``time_ms`` column the time is taken from it: the least of a number is
    hash aggregated, the least of a string would sort every row first.
    """
    keys = ["video_path", "video_name", "frame", "label", *folder_columns(detections), *extra]
    if "time_ms" not in detections.columns:
        return detections.groupBy(*keys).agg(
            F.min("time").alias("time"), F.count("track_id").alias("n")
        )
    return (
        detections.groupBy(*keys)
        .agg(F.min("time_ms").alias("time_ms"), F.count("track_id").alias("n"))
        .select(*keys, ms_to_clock(F.col("time_ms")).alias("time"), "n")
    )


def _with_tracks(best: DataFrame, detections: DataFrame) -> DataFrame:
    """Attach the tracks of the winning frames only, so no other frame builds a list."""
    keys = ["video_path", "video_name", "frame", "label", *folder_columns(detections)]
    return (
        null_safe_join(detections.select(*keys, "track_id"), best, keys)
        .groupBy(*keys, "time", "n")
        .agg(F.sort_array(F.collect_list("track_id")).alias("tracks_in_maxn"))
    )


def maxn_by_video(detections: DataFrame, with_tracks: bool = True) -> DataFrame:
    """One row per video and label; a tie goes to the lowest frame."""
    best = top_rows(
        frame_counts(detections),
        ["video_path", "video_name", "label"],
        [F.col("n").desc(), F.col("frame").asc()],
    )
    return _with_tracks(best, detections) if with_tracks else best


def maxn_by_chapter(detections: DataFrame, with_tracks: bool = True) -> DataFrame:
    """One row per folder and label, for videos cut into chapter files.

    Without folder columns the label alone is the group.
    """
    best = top_rows(
        frame_counts(detections),
        [*folder_columns(detections), "label"],
        [
            F.col("n").desc(),
            F.col("video_path").asc(),
            F.col("video_name").asc(),
            F.col("frame").asc(),
        ],
    )
    return _with_tracks(best, detections) if with_tracks else best


def maxn_ordered(maxn: DataFrame) -> DataFrame:
    """Report order: video, then count from high to low."""
    return maxn.orderBy(
        F.col("video_path").asc(), F.col("n").desc(), F.col("label").asc(), F.col("frame").asc()
    )


def maxn_wide(
    maxn: DataFrame, labels: Sequence[str] | None = None, key: str = "video_path"
) -> DataFrame:
    """One row per video: a column per label, the total and the number of labels seen.

    Give ``labels`` for a fixed schema; otherwise the distinct labels become the
    columns, however many there are (a schema is known to the driver in any case).
    Rows without a label count for nothing.
    """
    per_label = maxn.filter(F.col("label").isNotNull()).groupBy(key, "label").agg(F.max("n").alias("n"))
    if labels is None:
        labels = [r["label"] for r in per_label.select("label").distinct().orderBy("label").collect()]
    wide = per_label.groupBy(key).pivot("label", list(labels)).agg(F.max("n"))
    names = [c for c in wide.columns if c != key]
    columns = metric_columns("maxn_", names)
    wide = wide.select(
        F.col(key),
        *[
            F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("bigint").alias(column)
            for c, column in zip(names, columns)
        ],
    )
    totals = per_label.groupBy(key).agg(
        F.sum("n").alias("maxn_total"),
        F.count_if(F.col("n") > 0).alias("species_richness"),
    )
    return wide.join(totals, key)


def maxn_moment_boxes(detections: DataFrame, maxn: DataFrame) -> DataFrame:
    """Every box visible at each MaxN moment, one row per moment and box."""
    moments = maxn.select(
        "video_path", "time", F.col("label").alias("maxn_label"), F.col("n").alias("maxn")
    )
    return detections.join(moments, ["video_path", "time"], "inner").select(
        "video_path", "time", "maxn_label", "maxn", "track_id", "label", "xmin", "ymin", "xmax", "ymax"
    )


def maxn_wide_key(maxn: DataFrame) -> DataFrame:
    """Fill an empty relative path with the file name, as for a single-file run."""
    return maxn.withColumn(
        "video_path",
        F.when(blank(F.col("video_path")), F.col("video_name")).otherwise(F.col("video_path")),
    )


def distinct_track_maxn(
    detections: DataFrame, group: Column, name: str, video: Sequence[str]
) -> DataFrame:
    """MaxN counted over distinct tracks, per video and value of ``group``."""
    per_frame = (
        detections.select(*video, "frame", "track_id", group.alias(name))
        .filter(F.col(name).isNotNull())
        .groupBy(*video, "frame", name)
        .agg(F.count_distinct("track_id").alias("n"))
    )
    return per_frame.groupBy(*video, name).agg(F.max("n").alias("maxn"))


def track_spans(detections: DataFrame, video: Sequence[str], fps: Column | float) -> DataFrame:
    """Per track: the seconds between its first and last frame, its group and species."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    return detections.groupBy(*video, "track_id", "taxon_group", "species").agg(
        ((F.max("frame") - F.min("frame")) / F.first(rate)).alias("seconds")
    )


def video_metrics(
    detections: DataFrame,
    video: Sequence[str] = ("collection", "bruv_station", "video_id"),
    fps: float = 5.0,
) -> DataFrame:
    """Per-video abundance metrics from detections that carry taxon_group and species."""
    video = list(video)
    groups = distinct_track_maxn(detections, F.col("taxon_group"), "taxon_group", video)
    wide = groups.groupBy(*video).agg(
        *[
            F.coalesce(F.max(F.when(F.col("taxon_group") == g, F.col("maxn"))), F.lit(0))
            .cast("bigint")
            .alias(f"maxn_{g}")
            for g in ("shark", "ray_skate", "teleost")
        ]
    ).withColumn("maxn_elasmobranch", F.col("maxn_shark") + F.col("maxn_ray_skate"))
    sharks = F.col("taxon_group") == "shark"
    spans = track_spans(detections, video, fps).filter(sharks)
    named = F.when(~blank(F.col("species")), F.col("species"))
    totals = spans.groupBy(*video).agg(
        F.count_distinct("track_id").alias("n_shark_tracks"),
        F.sum("seconds").alias("shark_total_time_sec"),
        F.count_distinct(named).alias("shark_species_richness"),
        F.array_join(F.array_sort(F.collect_set(named)), ",").alias("shark_species_list"),
    )
    return wide.join(totals, video, "left").na.fill(
        {
            "n_shark_tracks": 0,
            "shark_total_time_sec": 0.0,
            "shark_species_richness": 0,
            "shark_species_list": "",
        }
    )


def species_maxn(
    detections: DataFrame, video: Sequence[str] = ("collection", "bruv_station", "video_id")
) -> DataFrame:
    """MaxN per video and shark species over distinct tracks, in long form."""
    species = F.when(
        (F.col("taxon_group") == "shark") & ~blank(F.col("species")), F.col("species")
    )
    return distinct_track_maxn(detections, species, "species", list(video))


def station_metrics(
    per_video: DataFrame,
    species: DataFrame,
    station: Sequence[str] = ("collection", "bruv_station"),
) -> DataFrame:
    """Per station: the largest video MaxN, sums of counts and time, species of any video.

    ``species`` is the long table of :func:`species_maxn`; richness is counted anew
    from it, because species repeat between videos of a station.
    """
    station = list(station)
    base = per_video.groupBy(*station).agg(
        *[
            F.max(c).alias(c)
            for c in ("maxn_shark", "maxn_ray_skate", "maxn_teleost")
        ],
        F.sum("n_shark_tracks").alias("n_shark_tracks"),
        F.sum("shark_total_time_sec").alias("shark_total_time_sec"),
    ).withColumn("maxn_elasmobranch", F.col("maxn_shark") + F.col("maxn_ray_skate"))
    names = (
        species.select(*station, "species")
        .distinct()
        .groupBy(*station)
        .agg(
            F.count(F.lit(1)).alias("shark_species_richness"),
            F.array_join(F.array_sort(F.collect_list("species")), ",").alias("shark_species_list"),
        )
    )
    return base.join(names, station, "left").na.fill(
        {"shark_species_richness": 0, "shark_species_list": ""}
    )


def appearance(
    detections: DataFrame, video: Sequence[str] = ("collection", "bruv_station", "video_id")
) -> DataFrame:
    """First and last time and mean confidence per video and species."""
    return (
        detections.filter(~blank(F.col("species")))
        .groupBy(*video, "species")
        .agg(
            F.min("time_ms").alias("first_ms"),
            F.max("time_ms").alias("last_ms"),
            F.avg("confidence").alias("mean_confidence"),
        )
    )


def species_accumulation(
    sightings: DataFrame, station_rank: DataFrame, station: str = "station"
) -> DataFrame:
    """Species known after each station, in station order.

    ``sightings`` has (station, species), ``station_rank`` (station, position).
    A species is counted at the first station that has it.
    """
    ranked = sightings.distinct().join(station_rank, station)
    first = ranked.groupBy("species").agg(F.min("position").alias("position"))
    new = first.groupBy("position").agg(F.count(F.lit(1)).alias("new_species"))
    filled = station_rank.join(new, "position", "left").na.fill({"new_species": 0})
    return running_total(filled, ["position"], "new_species", "known_before").select(
        station,
        "position",
        "new_species",
        (F.col("known_before") + F.col("new_species")).alias("species_so_far"),
    )


def misplaced_species(tracks: DataFrame) -> DataFrame:
    """Species found under more than one taxon group, with the tracks of each group.

    The group with most tracks (then the first by name) is taken as right.
    """
    counts = (
        tracks.filter(~blank(F.col("species")) & ~blank(F.col("taxon_group")))
        .groupBy("species", "taxon_group")
        .agg(F.count(F.lit(1)).alias("tracks"))
    )
    usual = top_rows(counts, ["species"], [F.col("tracks").desc(), F.col("taxon_group").asc()]).select(
        "species", F.col("taxon_group").alias("usual_group")
    )
    return counts.join(usual, "species").filter(F.col("taxon_group") != F.col("usual_group"))


def station_positions(stations: DataFrame, station: str = "station") -> DataFrame:
    """Zero-based position of each distinct station in name order."""
    return running_total(
        stations.select(station).distinct().withColumn("_one", F.lit(1).cast("bigint")),
        [station],
        "_one",
        "position",
    ).drop("_one")
