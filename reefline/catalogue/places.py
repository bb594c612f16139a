"""Metadata rows, locations, inventories and work estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.catalogue import inputs
from reefline.catalogue.registry import query
from reefline.functions import places, scores
from reefline.functions.clock import iso_to_timestamp
from reefline.functions.names import metric_column
from reefline.operators import inventory as inv
from reefline.operators import lookup as lk
from reefline.operators import maxn as m
from reefline.operators import metadata as md

# --- metadata per video ---------------------------------------------------

_FILE = "concat('GH', lpad(CAST(c_custkey AS STRING), 8, '0'), '.MP4')"
_PATH = f"concat('site_', CAST(c_nationkey AS STRING), '/', {_FILE})"

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_WIDE_NAMES = [metric_column("maxn_", p) for p in _PRIORITIES]
_WIDE_SQL = ", ".join(
    f"coalesce(max(n) FILTER (label = '{p}'), 0) AS {c}"
    for p, c in zip(_PRIORITIES, _WIDE_NAMES, strict=True)
)

_VIDEO_SQL = f"""
WITH vid AS (SELECT {_FILE} AS video_filename, {_PATH} AS video_path, c_custkey FROM customer),
usr AS (SELECT {_FILE} AS video_filename, c_mktsegment AS site_name, abs(c_acctbal) / 100 AS depth_m, 'note' AS gopro_fps
  FROM customer WHERE c_custkey % 3 <> 0),
cam AS (SELECT {_PATH} AS video_path, CAST(24 + c_nationkey AS DOUBLE) AS gopro_fps, c_acctbal / 7 AS gopro_file_size_mb
  FROM customer WHERE c_custkey % 4 <> 1),
mx AS (SELECT {_PATH} AS video_path, o_orderpriority AS label, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
wide AS (SELECT video_path, {_WIDE_SQL},
  CAST(sum(n) AS BIGINT) AS maxn_total, count(*) AS species_richness FROM mx GROUP BY video_path)
"""


def _maxn_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.table(spark, sf_dir, "orders")
    customers = inputs.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS o_custkey", f"{_PATH} AS video_path"
    )
    counts = (
        orders.join(customers, "o_custkey")
        .groupBy("video_path", F.col("o_orderpriority").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return m.maxn_wide(counts, _PRIORITIES)


@query(
    "combined_metadata",
    _VIDEO_SQL
    + """SELECT video_filename, video_path, site_name, depth_m, cam.gopro_fps, usr.gopro_fps AS gopro_fps_user, gopro_file_size_mb, """
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _WIDE_NAMES)
    + """, coalesce(maxn_total, 0) AS maxn_total, species_richness
FROM vid LEFT JOIN usr USING (video_filename) LEFT JOIN cam USING (video_path) LEFT JOIN wide USING (video_path)""",
)
def combined_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = inputs.table(spark, sf_dir, "customer")
    videos = customers.selectExpr(f"{_FILE} AS video_filename", f"{_PATH} AS video_path")
    user = md.normalise_user_metadata(
        customers.filter("c_custkey % 3 <> 0").selectExpr(
            f"concat('/card/', {_FILE}) AS filename",
            "c_mktsegment AS site_name",
            "abs(c_acctbal) / 100 AS depth_m",
            "'note' AS gopro_fps_user",
        )
    )
    camera = customers.filter("c_custkey % 4 <> 1").selectExpr(
        f"{_PATH} AS video_path",
        "CAST(24 + c_nationkey AS DOUBLE) AS gopro_fps",
        "c_acctbal / 7 AS gopro_file_size_mb",
    )
    return md.combine_metadata(videos, user, camera, _maxn_of_orders(spark, sf_dir))


@query(
    "metadata_check",
    """SELECT true AS valid, 'filename,latitude,depth_m,site' AS columns, 'filename' AS filename_column,
  'longitude,date,time,site_name,habitat' AS missing_columns, count(*) AS row_count FROM customer""",
)
def metadata_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = inputs.table(spark, sf_dir, "customer").selectExpr(
        f"{_FILE} AS filename", "c_acctbal AS latitude", "c_acctbal AS depth_m", "c_name AS site"
    )
    return md.check_user_metadata(user)


@query(
    "metadata_template",
    """SELECT DISTINCT concat('GH', CAST(s_suppkey % 50 AS VARCHAR), '.MP4') AS video_filename, '' AS site_name, '' AS latitude, '' AS longitude,
  '' AS date, '' AS time, '' AS depth_m, '' AS habitat, '' AS substrate, '' AS visibility_m, '' AS water_temp_c, '' AS notes FROM supplier""",
)
def metadata_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = inputs.table(spark, sf_dir, "supplier").selectExpr(
        "concat('a/', CAST(s_suppkey AS STRING), '/GH', CAST(s_suppkey % 50 AS STRING), '.MP4') AS video_path"
    )
    return md.metadata_template(files)


_GAPS = (
    "CASE WHEN c_custkey % {0} = 0 THEN NULL ELSE {1} END"
)


@query(
    "metadata_completeness",
    """WITH f AS (SELECT c_custkey AS video_no, 3 + CAST(c_custkey % 2 <> 0 AS INTEGER) + CAST(c_custkey % 3 <> 0 AS INTEGER)
  + CAST(c_custkey % 5 <> 0 AS INTEGER) + CAST(c_custkey % 7 <> 0 OR c_custkey % 4 <> 0 AS INTEGER) + CAST(c_custkey % 11 <> 0 AS INTEGER) AS n FROM customer)
SELECT video_no, CAST(n AS BIGINT) AS fields_filled, round(n / 15e0 * 100e0, 3) AS percent_filled FROM f""",
)
def metadata_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = inputs.table(spark, sf_dir, "customer")

    def gap(k: int) -> Column:
        return F.expr(_GAPS.format(k, "c_acctbal"))

    return have.select(
        F.col("c_custkey").alias("video_no"),
        *[
            c.alias(n)
            for n, c in md.completeness(gap(2), gap(3), gap(5), [gap(7), gap(4)], gap(11)).items()
        ],
    )


@query(
    "clarity_and_light",
    """SELECT l_returnflag, l_linestatus,
  CASE WHEN v > 0.8e0 THEN 'Excellent' WHEN v > 0.6e0 THEN 'Good' WHEN v > 0.4e0 THEN 'Fair' WHEN v IS NOT NULL THEN 'Poor' ELSE 'Not analysed' END AS clarity,
  CASE WHEN v > 0.7e0 THEN 'Bright' WHEN v > 0.4e0 THEN 'Moderate' WHEN v IS NOT NULL THEN 'Low light conditions' ELSE 'Not analysed' END AS light, count(*) AS n
FROM (SELECT *, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE (l_partkey % 100) / 100e0 END AS v FROM lineitem) GROUP BY ALL""",
)
def clarity_and_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE (l_partkey % 100) / 100e0 END")
    return (
        inputs.table(spark, sf_dir, "lineitem")
        .groupBy(
            "l_returnflag",
            "l_linestatus",
            scores.clarity_label(v).alias("clarity"),
            scores.light_label(v).alias("light"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- batch summaries ------------------------------------------------------

_SUBSTRATE = "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'sand' WHEN 2 THEN 'rock' WHEN 3 THEN 'coral_reef' ELSE NULL END"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested batch results, one row per video."""
    return (
        inputs.table(spark, sf_dir, "customer")
        .selectExpr("*", *inputs.LOCATION_EXPRESSIONS)
        .select(
            F.expr(_PATH).alias("video_path"),
            F.when(F.col("c_custkey") % 9 == 0, F.lit("failed"))
            .otherwise(F.lit("completed"))
            .alias("status"),
            F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias(
                "gps_location"
            ),
            F.struct(
                F.expr(_SUBSTRATE).alias("substrate_type"),
                ((F.col("c_custkey") % 10) / 10.0).alias("substrate_confidence"),
                F.when(F.col("c_custkey") % 6 != 0, F.col("depth")).alias("depth_estimate"),
                ((F.col("c_custkey") % 100) / 100.0).alias("water_clarity"),
                ((F.col("c_custkey") % 50) / 50.0).alias("light_level"),
            ).alias("environment"),
            F.lit("2024-01-01T00:00:00").alias("processing_timestamp"),
        )
    )


_BATCH = f"""
WITH bat AS (SELECT {_PATH} AS video_path, {_SUBSTRATE} AS substrate_type, (c_custkey % 10) / 10e0 AS substrate_confidence,
  lat AS latitude, lon AS longitude, CASE WHEN c_custkey % 6 <> 0 THEN depth END AS depth, (c_custkey % 100) / 100e0 AS water_clarity,
  (c_custkey % 50) / 50e0 AS light_level, '2024-01-01T00:00:00' AS processing_timestamp
  FROM customer JOIN locations ON loc_id = c_custkey WHERE c_custkey % 9 <> 0)
"""


@query("batch_table", _BATCH + "SELECT * FROM bat")
def batch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.batch_table(_results(spark, sf_dir))


@query(
    "zone_counts",
    _BATCH
    + """SELECT CASE WHEN latitude BETWEEN -30 AND 30 THEN 'tropical' WHEN abs(latitude) > 60 THEN 'polar' ELSE 'temperate' END AS region,
  count(*) AS videos FROM bat GROUP BY ALL""",
)
def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.zone_counts(md.batch_table(_results(spark, sf_dir)))


@query(
    "substrate_counts",
    _BATCH + "SELECT substrate_type, count(*) AS videos FROM bat WHERE substrate_type <> '' GROUP BY ALL",
)
def substrate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.substrate_counts(md.batch_table(_results(spark, sf_dir)))


@query(
    "depth_statistics",
    _BATCH
    + """SELECT round(avg(depth), 6) AS mean_depth, round(median(depth), 6) AS median_depth, min(depth) AS min_depth, max(depth) AS max_depth
FROM bat WHERE depth <> 0""",
)
def depth_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = md.depth_stats(md.batch_table(_results(spark, sf_dir)))
    return stats.withColumns(
        {c: F.bround(c, 6) for c in ("mean_depth", "median_depth")}
    )


@query(
    "clarity_statistics",
    _BATCH
    + """SELECT count(water_clarity) AS videos, round(avg(water_clarity), 6) AS mean_clarity, round(median(water_clarity), 6) AS median_clarity,
  min(water_clarity) AS min_clarity, max(water_clarity) AS max_clarity FROM bat""",
)
def clarity_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = md.clarity_stats(md.batch_table(_results(spark, sf_dir)))
    return stats.withColumns({c: F.bround(c, 6) for c in ("mean_clarity", "median_clarity")})


# --- places ---------------------------------------------------------------

@query(
    "expected_species",
    """WITH r AS (SELECT n_name AS species, n_nationkey * 6e0 - 75 AS low, n_nationkey * 6e0 - 55 AS high, (n_nationkey % 5) / 5e0 AS probability FROM nation)
SELECT loc_id, coalesce(string_agg(DISTINCT species, ',' ORDER BY species), '') AS expected
FROM locations LEFT JOIN r ON lat BETWEEN low AND high AND probability > 0.2e0 GROUP BY loc_id""",
)
def expected_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species by a given table of latitude ranges."""
    ranges = inputs.table(spark, sf_dir, "nation").selectExpr(
        "n_name AS species", "n_nationkey * 6e0 - 75 AS low", "n_nationkey * 6e0 - 55 AS high", "(n_nationkey % 5) / 5e0 AS probability"
    )
    spots = inputs.locations(spark, sf_dir).select("loc_id", F.col("lat").alias("latitude"))
    found = md.expected_species(spots, ranges, key="loc_id")
    return found.select("loc_id", F.array_join("expected_species", ",").alias("expected"))


@query(
    "sun_heights",
    """WITH s AS (SELECT o_orderkey, (o_orderkey * 37 % 180) - 89.5e0 AS lat, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS taken FROM orders),
d AS (SELECT *, radians(23.45e0 * sin(radians(360e0 * (284 + dayofyear(taken)) / 365e0))) AS decl,
  radians(15e0 * (hour(taken) + minute(taken) / 60e0 - 12)) AS angle FROM s)
SELECT o_orderkey AS video_no, round(degrees(asin(sin(decl) * sin(radians(lat)) + cos(decl) * cos(radians(lat)) * cos(angle))), 6) AS sun_height FROM d""",
)
def sun_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("o_orderdate + make_interval(0, 0, 0, 0, 0, CAST(o_orderkey % 1440 AS INT), 0)")
    lat = F.expr("(o_orderkey * 37 % 180) - 89.5e0")
    return inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("video_no"),
        F.bround(places.solar_elevation(lat, at), 6).alias("sun_height"),
    )


@query(
    "decimal_degrees",
    """SELECT c_custkey AS loc_id, 0e0 + round((CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END) * (c_custkey % 90 + (c_custkey % 60) / 60e0 + (c_custkey % 47) / 3600e0), 9) AS degrees,
  epoch_ms(CAST(strptime('2024-05-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0'), '%Y-%m-%d') AS TIMESTAMP)) AS taken_ms FROM customer""",
)
def decimal_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    parts = F.array(
        (key % 90).cast("double"), (key % 60).cast("double"), (key % 47).cast("double")
    )
    side = F.when(key % 2 == 0, F.lit("S")).otherwise(F.lit("N"))
    stamp = F.concat(
        F.lit("2024-05-"), F.lpad((1 + key % 28).cast("string"), 2, "0"), F.lit("T00:00:00Z")
    )
    return inputs.table(spark, sf_dir, "customer").select(
        key.alias("loc_id"),
        F.bround(places.dms_to_degrees(parts, side), 9).alias("degrees"),
        F.unix_millis(iso_to_timestamp(stamp)).alias("taken_ms"),
    )


# Locations close enough together that cells of the lookup hold several rows.
_SPOT = [
    "c_custkey AS loc_id",
    "CAST((c_custkey * 37) % 997 AS DOUBLE) / 5e3 AS lat",
    "CAST((c_custkey * 91) % 991 AS DOUBLE) / 5e3 AS lon",
    "CASE c_custkey % 3 WHEN 0 THEN 'gebco' ELSE 'noaa' END AS source",
    "CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 1e3 AS confidence",
    "1700000000 - (c_custkey % 40) * 86400 AS timestamp",
    "abs(c_acctbal) AS depth",
    "c_mktsegment AS substrate_prediction",
]
_NOW = 1_700_000_000

_NEAR = f"""
WITH spot AS (SELECT {', '.join(_SPOT)} FROM customer),
cand AS (SELECT * FROM spot WHERE timestamp > {_NOW} - 30 * 86400
  QUALIFY row_number() OVER (PARTITION BY lat, lon, source ORDER BY confidence DESC, timestamp DESC) = 1),
hit AS (SELECT p.lat, p.lon, c.source, c.lat AS match_lat, c.lon AS match_lon, c.confidence, c.depth, c.substrate_prediction
  FROM (SELECT DISTINCT lat, lon FROM spot) p JOIN cand c ON abs(p.lat - c.lat) < 0.01e0 AND abs(p.lon - c.lon) < 0.01e0
  QUALIFY row_number() OVER (PARTITION BY p.lat, p.lon, c.source ORDER BY c.confidence DESC,
    (CAST(floor(c.lat * 1e7) AS BIGINT) * 7919 + CAST(floor(c.lon * 1e7) AS BIGINT) * 104729) % 1000003 DESC, c.lat, c.lon) = 1)
"""


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "customer").selectExpr(*_SPOT)


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = _spots(spark, sf_dir)
    return lk.nearby_best(spots, spots, ["depth", "substrate_prediction"], _NOW)


@query("nearby_bathymetry", _NEAR + "SELECT * FROM hit")
def nearby_bathymetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)


@query(
    "best_bathymetry",
    _NEAR
    + """SELECT lat, lon, source, confidence, substrate_prediction FROM hit
QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY confidence DESC, source) = 1""",
)
def best_bathymetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.best_source(_near(spark, sf_dir), ["lat", "lon"]).select(
        "lat", "lon", "source", "confidence", "substrate_prediction"
    )


@query(
    "enriched_metadata",
    _NEAR
    + """, bst AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY confidence DESC, source) = 1),
v AS (SELECT loc_id, lat, lon, CASE WHEN loc_id % 4 = 0 THEN NULL ELSE depth / 10 END AS depth_estimate,
  CASE WHEN loc_id % 3 = 0 THEN NULL ELSE 'sand' END AS substrate_type, (loc_id % 10) / 10e0 AS substrate_confidence FROM spot)
SELECT loc_id, CASE WHEN coalesce(depth_estimate, 0) = 0 THEN coalesce(abs(b.depth), depth_estimate) ELSE depth_estimate END AS depth_estimate,
  CASE WHEN b.depth IS NOT NULL AND (substrate_type IS NULL OR substrate_confidence < 0.5e0) THEN b.substrate_prediction ELSE substrate_type END AS substrate_type,
  CASE WHEN b.depth IS NOT NULL AND (substrate_type IS NULL OR substrate_confidence < 0.5e0) THEN b.confidence ELSE substrate_confidence END AS substrate_confidence
FROM v LEFT JOIN bst b USING (lat, lon)""",
)
def enriched_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = _spots(spark, sf_dir)
    found = md.best_source(_near(spark, sf_dir), ["lat", "lon"]).join(
        spots.select("loc_id", "lat", "lon"), ["lat", "lon"]
    )
    videos = spots.selectExpr(
        "loc_id",
        "lat AS latitude",
        "CASE WHEN loc_id % 4 = 0 THEN NULL ELSE depth / 10 END AS depth_estimate",
        "CASE WHEN loc_id % 3 = 0 THEN NULL ELSE 'sand' END AS substrate_type",
        "(loc_id % 10) / 10e0 AS substrate_confidence",
    )
    return md.enrich(videos, found, key="loc_id").select(
        "loc_id",
        "depth_estimate",
        "substrate_type",
        "substrate_confidence",
    )


# --- inventories ----------------------------------------------------------

_ENDING = "CASE s_suppkey % 6 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MP4' WHEN 2 THEN '.avi' WHEN 3 THEN '.mov' WHEN 4 THEN '.mp4k' ELSE '.MKV' END"
_HIDDEN = "CASE WHEN s_suppkey % 10 = 7 THEN '.' ELSE '' END"
_STEREO = "CASE WHEN s_suppkey % 2 = 0 THEN 'L' ELSE 'R' END"
_FILES = [
    f"concat('deploy/BRUV ', CAST(s_suppkey % 20 AS STRING), '/part', CAST(s_nationkey AS STRING), '/', {_HIDDEN}, {_STEREO}, CAST(s_suppkey AS STRING), {_ENDING}) AS video_path",
    "s_suppkey * 1000003 AS size",
    "s_suppkey",
]
_FILES_SQL = f"WITH fil AS (SELECT {', '.join(_FILES)} FROM supplier), nam AS (SELECT *, regexp_extract(video_path, '[^/]*$') AS name FROM fil)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "supplier").selectExpr(*_FILES)


@query(
    "video_inventory",
    _FILES_SQL
    + " SELECT video_path FROM nam WHERE regexp_matches(lower(name), '[.](mp4|avi)$') AND name[1] <> '.' AND name[1] = 'L'",
)
def video_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = inv.video_inventory(_files(spark, sf_dir), stereo_prefix="L")
    return inv.natural_order(kept).select("video_path")


_DONE = _FILES_SQL + ", don AS (SELECT video_path, s_suppkey % 7 AS tracks_found FROM fil WHERE s_suppkey % 3 = 0)"


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).filter("s_suppkey % 3 = 0").selectExpr(
        "video_path", "s_suppkey % 7 AS tracks_found"
    )


@query(
    "incremental_status",
    _DONE
    + """ SELECT (SELECT count(*) FROM fil) AS total_videos, (SELECT count(*) FROM don) AS already_processed,
  (SELECT count(*) FROM fil) - (SELECT count(*) FROM don) AS new_videos, (SELECT CAST(sum(tracks_found) AS BIGINT) FROM don) AS tracks_found_so_far,
  (SELECT count(*) > 0 FROM don) AS has_existing_results""",
)
def incremental_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.incremental_status(_files(spark, sf_dir), _done(spark, sf_dir))


@query(
    "new_video_preview",
    _DONE + " SELECT video_path FROM fil ANTI JOIN don USING (video_path) ORDER BY video_path LIMIT 10",
)
def new_video_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = inv.new_videos(_files(spark, sf_dir), _done(spark, sf_dir))
    return new.select("video_path").orderBy("video_path").limit(10)


@query(
    "next_videos",
    _DONE
    + """ SELECT video_path FROM nam ANTI JOIN don USING (video_path)
ORDER BY regexp_replace(video_path, '/[^/]*$', ''), CAST(regexp_extract(name, '[0-9]+') AS BIGINT), name LIMIT (SELECT greatest(0, 400 - count(*)) FROM don)""",
)
def next_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.next_videos(_files(spark, sf_dir), _done(spark, sf_dir), 400).select("video_path")


@query(
    "video_set_operations",
    _DONE
    + """ SELECT 'both' AS part, video_path FROM (SELECT video_path FROM fil INTERSECT SELECT video_path FROM don)
UNION ALL SELECT 'new', video_path FROM (SELECT video_path FROM fil EXCEPT SELECT video_path FROM don)""",
)
def video_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _files(spark, sf_dir).select("video_path")
    done = _done(spark, sf_dir).select("video_path")
    return (
        every.intersect(done)
        .select(F.lit("both").alias("part"), "video_path")
        .unionByName(every.subtract(done).select(F.lit("new").alias("part"), "video_path"))
    )


@query(
    "deployment_videos",
    _FILES_SQL
    + """ SELECT concat('BRUV ', CAST(s_suppkey % 20 AS VARCHAR), '_', regexp_extract(video_path, '/(part[0-9]+)/', 1)) AS deployment_id,
  count(*) AS videos FROM fil GROUP BY ALL""",
)
def deployment_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.deployments(_files(spark, sf_dir))


@query(
    "storage_estimate",
    _FILES_SQL
    + """ SELECT round(sum(size) / 1073741824e0, 6) AS input_size_gb, count(*) AS video_count,
  round(sum(size) / 1073741824e0 * 0.05e0, 6) AS analysis_size_gb, round(sum(size) / 1073741824e0 * 0.1e0, 6) AS temp_space_gb,
  round(sum(size) / 1073741824e0 * 1.15e0, 6) AS total_required_gb, round(sum(size) / 1073741824e0 * 1.15e0 * 1.2e0, 6) AS safety_margin_gb FROM fil""",
)
def storage_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inv.storage_estimate(_files(spark, sf_dir))
    return found.select("video_count", *[F.bround(c, 6).alias(c) for c in found.columns if c != "video_count"])


@query(
    "time_estimate",
    _FILES_SQL
    + """ SELECT round(count(*) * 2 / 60e0, 6) AS reformat_hours, round(count(*) * 1.2e0 / 60, 6) AS detection_hours,
  round(count(*) * 0.5e0 / 60, 6) AS metadata_hours, round(count(*) * 3.7e0 / 60, 6) AS total_hours, round(60 / 3.7e0, 6) AS videos_per_hour FROM fil""",
)
def time_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inv.time_estimate(_files(spark, sf_dir))
    return found.select(*[F.bround(c, 6).alias(c) for c in found.columns])


_TASK = [
    "CAST(o_orderkey AS STRING) AS task_id",
    "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status",
    "CAST(o_orderkey % 1000 AS DOUBLE) AS start_time",
    "CAST(o_orderkey % 1000 + o_custkey % 300 AS DOUBLE) AS end_time",
]
_TASK_SQL = f"""WITH tsk AS (SELECT {', '.join(_TASK)} FROM orders), c AS (SELECT count(*) AS total_tasks,
  count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
  sum(end_time - start_time) FILTER (status = 'completed') AS total_seconds, avg(end_time - start_time) FILTER (status = 'completed') AS mean_seconds FROM tsk)
"""


@query(
    "task_statistics",
    _TASK_SQL
    + """SELECT total_tasks, completed, failed, skipped, total_seconds, round(mean_seconds, 6) AS mean_seconds, round(100e0 * completed / total_tasks, 1) AS success_percent FROM c""",
)
def task_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = inputs.table(spark, sf_dir, "orders").selectExpr(*_TASK)
    return inv.task_stats(tasks).withColumn("mean_seconds", F.bround("mean_seconds", 6))


@query(
    "task_progress",
    _TASK_SQL
    + """SELECT total_tasks, completed, failed, skipped, total_tasks - completed - failed - skipped AS remaining,
  round(100e0 * completed / total_tasks, 6) AS completion_percent, 2e0 AS elapsed_hours, round(completed / 2e0, 6) AS throughput_per_hour,
  round((total_tasks - completed - failed - skipped) / (completed / 2e0), 6) AS hours_to_go FROM c""",
)
def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = inputs.table(spark, sf_dir, "orders").selectExpr(*_TASK)
    return inv.progress(tasks, started=0, now=7200).withColumns(
        {c: F.bround(c, 6) for c in ("completion_percent", "throughput_per_hour", "hours_to_go")}
    )


@query(
    "original_folders",
    _FILES_SQL
    + """, h AS (SELECT name AS video_name, min(regexp_replace(video_path, '/[^/]*$', '')) AS folder FROM nam WHERE s_suppkey % 4 <> 0 GROUP BY ALL)
SELECT name AS video_name, coalesce(folder, 'orphaned') AS folder FROM nam LEFT JOIN h ON name = video_name""",
)
def original_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    results = files.select(F.element_at(F.split("video_path", "/"), -1).alias("video_name"))
    return inv.original_folders(results, files.filter("s_suppkey % 4 <> 0")).select("video_name", "folder")


@query(
    "collection_folders",
    """SELECT folder1 AS collection, CASE folder1 WHEN 'collection_0' THEN '/data/summer' WHEN 'collection_1' THEN '/data/winter' ELSE 'orphaned' END AS base_dir,
  count(*) AS boxes FROM detections GROUP BY ALL""",
)
def collection_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inputs.detections(spark, sf_dir).withColumnRenamed("folder1", "collection")
    mapped = inv.map_collections(
        found, {"collection_0": "/data/summer", "collection_1": "/data/winter"}
    )
    return mapped.groupBy("collection", "base_dir").agg(F.count(F.lit(1)).alias("boxes"))


@query(
    "substrate_in_names",
    """WITH n AS (SELECT p_partkey, lower(concat(p_name, '_', CASE p_partkey % 8 WHEN 0 THEN 'Sandy' WHEN 1 THEN 'Reef' WHEN 2 THEN 'boulder_sand'
  WHEN 3 THEN 'seagrass' WHEN 4 THEN 'KELP' WHEN 5 THEN 'rubble' WHEN 6 THEN 'rock reef' ELSE 'x' END, '.mp4')) AS name FROM part)
SELECT p_partkey AS video_no, CASE WHEN regexp_matches(name, 'sand') THEN 'sand' WHEN regexp_matches(name, 'coral|reef') THEN 'coral_reef'
  WHEN regexp_matches(name, 'rock|boulder') THEN 'rock' WHEN regexp_matches(name, 'grass') THEN 'seagrass' WHEN regexp_matches(name, 'kelp') THEN 'kelp'
  WHEN regexp_matches(name, 'rubble') THEN 'rubble' END AS substrate FROM n""",
)
def substrate_in_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(
        "concat(p_name, '_', CASE p_partkey % 8 WHEN 0 THEN 'Sandy' WHEN 1 THEN 'Reef' WHEN 2 THEN 'boulder_sand' "
        "WHEN 3 THEN 'seagrass' WHEN 4 THEN 'KELP' WHEN 5 THEN 'rubble' WHEN 6 THEN 'rock reef' ELSE 'x' END, '.mp4')"
    )
    return inputs.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("video_no"), md.substrate_from_name(name).alias("substrate")
    )
