"""One metadata row per video, checks of metadata tables, and batch summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.functions.names import blank
from reefline.functions.paths import basename
from reefline.functions.places import zone
from reefline.operators.ranking import exact_median, top_rows
from reefline.schemas import USER_METADATA_COLUMNS

# Accepted names of the file-name column, best first.
FILENAME_ALIASES = ["video_filename", "filename", "video", "file", "video_name"]
CHECKED_ALIASES = ["video_filename", "filename", "video", "Video", "Filename", "VIDEO"]
RECOMMENDED = ["latitude", "longitude", "date", "time", "depth_m", "site_name", "habitat"]

# File-name keywords of substrates, first rule wins.
SUBSTRATE_KEYWORDS = [
    ("sand", "sand|sandy"),
    ("coral_reef", "coral|reef"),
    ("rock", "rock|rocky|boulder"),
    ("seagrass", "seagrass|grass"),
    ("kelp", "kelp"),
    ("rubble", "rubble"),
]


def normalise_user_metadata(df: DataFrame) -> DataFrame:
    """Rename the first known file-name column and cut paths down to the file name."""
    found = next((c for c in FILENAME_ALIASES if c in df.columns), None)
    if found is None:
        raise ValueError(f"no file-name column; expected one of {FILENAME_ALIASES}")
    out = df.withColumnRenamed(found, "video_filename")
    return out.withColumn("video_filename", basename(F.col("video_filename").cast("string")))


def check_user_metadata(df: DataFrame) -> DataFrame:
    """A one-row report: the file-name column, missing recommended columns, rows."""
    names = {c.lower() for c in df.columns}
    found = next((c for c in CHECKED_ALIASES if c in df.columns), None)
    missing = [c for c in RECOMMENDED if c not in names]
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(True).alias("valid"),
        F.lit(",".join(df.columns)).alias("columns"),
        F.lit(found).alias("filename_column"),
        F.lit(",".join(missing)).alias("missing_columns"),
        "row_count",
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows with '' for what is missing."""
    return df.limit(n).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def metadata_template(inventory: DataFrame) -> DataFrame:
    """Distinct sorted file names and empty columns to fill in."""
    return (
        inventory.select(basename(F.col("video_path")).alias("video_filename"))
        .distinct()
        .select(
            "video_filename",
            *[F.lit("").alias(c) for c in USER_METADATA_COLUMNS if c != "video_filename"],
        )
        .orderBy("video_filename")
    )


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail when ``keys`` repeat: a join on them would multiply rows."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{list(keys)} is not unique, for example {twice[0].asDict()}")
    return df


def _suffixed(df: DataFrame, taken: Sequence[str], suffix: str, key: str) -> DataFrame:
    return df.select(
        *[
            F.col(c).alias(f"{c}{suffix}" if c in taken and c != key else c)
            for c in df.columns
            if c == key or c not in ("video_path", "video_filename")
        ]
    )


def combine_metadata(
    videos: DataFrame,
    user: DataFrame | None = None,
    camera: DataFrame | None = None,
    maxn_wide: DataFrame | None = None,
    user_key: str = "video_filename",
    camera_key: str = "video_path",
    maxn_key: str = "video_path",
) -> DataFrame:
    """Left joins of every video with the three sources.

    File names repeat between folders, so a source joined by file name must hold
    each name once. Label columns of a video without MaxN become 0; its species
    richness stays null.
    """
    out = videos.select("video_filename", "video_path")
    for source, key, suffix in (
        (user, user_key, "_user"),
        (camera, camera_key, "_gopro"),
        (maxn_wide, maxn_key, "_maxn"),
    ):
        if source is None:
            continue
        if key == "video_filename":
            require_unique(source.filter(F.col(key).isNotNull()), [key])
        out = out.join(_suffixed(source, out.columns, suffix, key), key, "left")
    counts = sorted(c for c in out.columns if c.startswith("maxn_"))
    out = out.na.fill(0, counts)
    first = ["video_filename", "video_path"]
    last = [c for c in out.columns if c == "species_richness"]
    camera_columns = [c for c in out.columns if c.startswith("gopro_")]
    others = [
        c for c in out.columns if c not in (*first, *last, *counts, *camera_columns)
    ]
    return out.select(*first, *others, *camera_columns, *counts, *last)


def camera_row(meta: DataFrame) -> DataFrame:
    """Flat camera columns from the nested video metadata table."""
    env = F.col("environment")
    gps = F.col("gps_location")
    size = F.col("resolution")
    return meta.select(
        basename(F.col("file_path")).alias("video_filename"),
        F.col("file_path").alias("video_path"),
        F.col("duration").alias("gopro_duration_sec"),
        F.col("fps").alias("gopro_fps"),
        F.when(
            size.isNotNull(),
            F.concat_ws("x", size["width"].cast("string"), size["height"].cast("string")),
        ).alias("gopro_resolution"),
        F.bround(F.col("file_size") / (1024 * 1024), 2).alias("gopro_file_size_mb"),
        F.date_format("creation_time", "yyyy-MM-dd'T'HH:mm:ss").alias("gopro_creation_time"),
        F.col("camera_model").alias("gopro_camera_model"),
        F.col("camera_serial").alias("gopro_camera_serial"),
        gps["latitude"].alias("gopro_latitude"),
        gps["longitude"].alias("gopro_longitude"),
        gps["altitude"].alias("gopro_altitude"),
        F.col("iso").alias("gopro_iso"),
        F.col("field_of_view").alias("gopro_fov"),
        F.col("white_balance").alias("gopro_white_balance"),
        F.bround(env["water_clarity"], 3).alias("gopro_water_clarity"),
        F.bround(env["light_level"], 3).alias("gopro_light_level"),
        env["substrate_type"].alias("gopro_substrate_auto"),
        F.bround(env["substrate_confidence"], 3).alias("gopro_substrate_confidence"),
    )


def substrate_from_name(name: Column) -> Column:
    """Substrate named in a file name; null when none is."""
    out = F.lit(None).cast("string")
    for substrate, words in reversed(SUBSTRATE_KEYWORDS):
        out = F.when(F.lower(name).rlike(words), F.lit(substrate)).otherwise(out)
    return out


def completeness(
    gps: Column, depth: Column, substrate: Column, settings: Sequence[Column],
    environment: Column,
) -> dict[str, Column]:
    """How many of about fifteen metadata fields are there; three always are."""
    any_setting = F.lit(False)
    for c in settings:
        any_setting = any_setting | c.isNotNull()
    known = [
        gps.isNotNull(),
        depth.isNotNull(),
        substrate.isNotNull(),
        any_setting,
        environment.isNotNull(),
    ]
    n = F.lit(3)
    for k in known:
        n = n + k.cast("int")
    return {
        "fields_filled": n.cast("bigint"),
        "percent_filled": F.bround(n / F.lit(15.0) * F.lit(100.0), 3),
    }


def enrich(
    videos: DataFrame, bathymetry: DataFrame | None = None, temperature: DataFrame | None = None,
    key: str = "video_path",
) -> DataFrame:
    """Fill depth, substrate and temperature from a location's best source.

    Depth is filled when absent or 0; substrate when absent or less sure than 0.5.
    ``bathymetry`` has (key, depth, substrate_prediction, confidence) and
    ``temperature`` (key, temperature), one row per key.
    """
    out = videos
    if bathymetry is not None:
        best = bathymetry.select(
            key,
            F.abs("depth").alias("_depth"),
            F.col("substrate_prediction").alias("_substrate"),
            F.col("confidence").alias("_confidence"),
            F.lit(True).alias("_found"),
        )
        out = out.join(best, key, "left")
        lacking = blank(F.col("substrate_type")) | (
            F.coalesce("substrate_confidence", F.lit(0.0)) < 0.5
        )
        replace = F.coalesce("_found", F.lit(False)) & lacking
        absent = F.coalesce("depth_estimate", F.lit(0.0)) == 0.0
        out = out.withColumns(
            {
                "depth_estimate": F.when(absent, F.coalesce("_depth", "depth_estimate")).otherwise(
                    F.col("depth_estimate")
                ),
                "substrate_type": F.when(replace, F.col("_substrate")).otherwise(
                    F.col("substrate_type")
                ),
                "substrate_confidence": F.when(replace, F.col("_confidence")).otherwise(
                    F.col("substrate_confidence")
                ),
            }
        ).drop("_depth", "_substrate", "_confidence", "_found")
    if temperature is not None:
        out = (
            out.join(temperature.select(key, F.col("temperature").alias("_t")), key, "left")
            .withColumn("temperature", F.coalesce(F.nullif("temperature", F.lit(0.0)), "_t"))
            .drop("_t")
        )
    return out


def expected_species(videos: DataFrame, ranges: DataFrame, key: str = "video_path", above: float = 0.2) -> DataFrame:
    """``videos`` with ``expected_species``, the sorted species whose given range holds the latitude.

    ``ranges`` has (species, low, high, probability); both ends belong to the
    range, and rows of at most ``above`` are left out. Ranges and videos meet by
    whole degrees of latitude.
    """
    bands = ranges.filter(F.col("probability") > above).select(
        "species", "low", "high", F.explode(F.sequence(F.floor("low"), F.floor("high"))).alias("_degree")
    )
    found = (
        videos.select(key, "latitude", F.floor("latitude").alias("_degree"))
        .join(bands, "_degree")
        .filter(F.col("latitude").between(F.col("low"), F.col("high")))
        .groupBy(key)
        .agg(F.sort_array(F.collect_set("species")).alias("expected_species"))
    )
    none = F.array().cast("array<string>")
    return videos.join(found, key, "left").withColumn("expected_species", F.coalesce("expected_species", none))


def best_source(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most confident row per key; no confidence counts as 0, ties by source name."""
    return top_rows(
        candidates,
        keys,
        [F.coalesce("confidence", F.lit(0.0)).desc(), F.col("source").asc()],
    )


def batch_table(results: DataFrame) -> DataFrame:
    """One flat row per completed video."""
    env, gps = F.col("environment"), F.col("gps_location")
    return results.filter(F.col("status") == "completed").select(
        "video_path",
        env["substrate_type"].alias("substrate_type"),
        env["substrate_confidence"].alias("substrate_confidence"),
        gps["latitude"].alias("latitude"),
        gps["longitude"].alias("longitude"),
        env["depth_estimate"].alias("depth"),
        env["water_clarity"].alias("water_clarity"),
        env["light_level"].alias("light_level"),
        "processing_timestamp",
    )


def zone_counts(batch: DataFrame) -> DataFrame:
    return (
        batch.withColumn("region", zone(F.col("latitude")))
        .filter(F.col("region").isNotNull())
        .groupBy("region")
        .agg(F.count(F.lit(1)).alias("videos"))
    )


def substrate_counts(batch: DataFrame) -> DataFrame:
    return (
        batch.filter(~blank(F.col("substrate_type")))
        .groupBy("substrate_type")
        .agg(F.count(F.lit(1)).alias("videos"))
    )


def clarity_stats(batch: DataFrame) -> DataFrame:
    """Mean, exact median, least and greatest water clarity, and the videos where it is known."""
    known = batch.filter(F.col("water_clarity").isNotNull())
    simple = known.agg(
        F.count(F.lit(1)).alias("videos"),
        F.avg("water_clarity").alias("mean_clarity"),
        F.min("water_clarity").alias("min_clarity"),
        F.max("water_clarity").alias("max_clarity"),
    )
    # clarity lies between 0 and 1
    middle = exact_median(known, "water_clarity", 0.01).withColumnRenamed("median", "median_clarity")
    names = ("videos", "mean_clarity", "min_clarity", "max_clarity", "median_clarity")
    return simple.unionByName(middle, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])


def depth_stats(batch: DataFrame) -> DataFrame:
    """Mean, exact median, least and greatest depth of videos whose depth is known and not 0."""
    known = batch.filter(F.coalesce("depth", F.lit(0.0)) != 0.0)
    names = ("mean_depth", "min_depth", "max_depth")
    simple = known.agg(
        F.avg("depth").alias("mean_depth"),
        F.min("depth").alias("min_depth"),
        F.max("depth").alias("max_depth"),
    )
    # depths are bucketed by metre for the median
    middle = exact_median(known, "depth", 1.0).withColumnRenamed("median", "median_depth")
    return (
        simple.unionByName(middle, allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in (*names, "median_depth")])
    )
