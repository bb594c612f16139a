"""MaxN in all its forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.catalogue import inputs
from reefline.catalogue.registry import query
from reefline.operators import maxn as m


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.apply_human_labels(inputs.detections(spark, sf_dir), inputs.labeled(spark, sf_dir))


_FRAMES = """
WITH f AS (SELECT video_path, video_name, folder1, folder2, frame, label, min(time) AS time, count(track_id) AS n,
  array_to_string(list_sort(list(track_id)), ',') AS tracks_in_maxn
  FROM cleaned GROUP BY ALL)
"""


@query(
    "maxn_by_video",
    _FRAMES
    + """SELECT video_path, video_name, frame, label, time, n, tracks_in_maxn FROM f
QUALIFY row_number() OVER (PARTITION BY video_path, video_name, label ORDER BY n DESC, frame) = 1""",
)
def maxn_by_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = m.maxn_ordered(m.maxn_by_video(_cleaned(spark, sf_dir)))
    return best.select(
        "video_path",
        "video_name",
        "frame",
        "label",
        "time",
        "n",
        F.array_join("tracks_in_maxn", ",").alias("tracks_in_maxn"),
    )


@query(
    "maxn_by_chapter",
    _FRAMES
    + """SELECT folder1, folder2, video_path, frame, label, time, n, tracks_in_maxn FROM f
QUALIFY row_number() OVER (PARTITION BY folder1, folder2, label ORDER BY n DESC, video_path, video_name, frame) = 1""",
)
def maxn_by_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.maxn_by_chapter(_cleaned(spark, sf_dir)).select(
        "folder1",
        "folder2",
        "video_path",
        "frame",
        "label",
        "time",
        "n",
        F.array_join("tracks_in_maxn", ",").alias("tracks_in_maxn"),
    )


@query(
    "maxn_by_label",
    _FRAMES
    + """SELECT label, video_path, frame, n, tracks_in_maxn FROM f
QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, video_path, video_name, frame) = 1""",
)
def maxn_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _cleaned(spark, sf_dir).drop("folder1", "folder2")
    return m.maxn_by_chapter(flat).select(
        "label", "video_path", "frame", "n", F.array_join("tracks_in_maxn", ",").alias("tracks_in_maxn")
    )


@query(
    "frame_label_counts",
    """SELECT video_path, frame, label, min(time) AS time, count(track_id) AS n
FROM cleaned GROUP BY ALL""",
)
def frame_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.frame_counts(_cleaned(spark, sf_dir)).select("video_path", "frame", "label", "time", "n")


@query(
    "labelled_detections",
    "SELECT video_path, label, frame, track_id, xmin, ymin, xmax, ymax, confidence FROM cleaned",
)
def labelled_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("video_path", "label", "frame", "track_id", "xmin", "ymin", "xmax", "ymax", "confidence")


LABELS = ["Carcharhinus perezi", "ESU", "Ginglymostoma cirratum", "elasmobranch"]


@query(
    "maxn_wide",
    """WITH f AS (SELECT video_path, frame, label, count(track_id) AS n FROM cleaned GROUP BY ALL),
m AS (SELECT video_path, label, max(n) AS n FROM f GROUP BY ALL)
SELECT video_path,
  CAST(coalesce(max(n) FILTER (label = 'Carcharhinus perezi'), 0) AS BIGINT) AS maxn_Carcharhinus_perezi,
  CAST(coalesce(max(n) FILTER (label = 'ESU'), 0) AS BIGINT) AS "maxn_ESU",
  CAST(coalesce(max(n) FILTER (label = 'Ginglymostoma cirratum'), 0) AS BIGINT) AS maxn_Ginglymostoma_cirratum,
  CAST(coalesce(max(n) FILTER (label = 'elasmobranch'), 0) AS BIGINT) AS maxn_elasmobranch,
  CAST(sum(n) AS BIGINT) AS maxn_total, count(*) FILTER (n > 0) AS species_richness
FROM m GROUP BY video_path""",
)
def maxn_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.maxn_wide(m.maxn_by_video(_cleaned(spark, sf_dir), with_tracks=False), LABELS)


@query(
    "maxn_label_confidence",
    """SELECT avg(CASE WHEN human_label = 'ESU' THEN 0e0 ELSE 1e0 END) AS maxn_confidence FROM labeled""",
)
def maxn_label_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.label_confidence(inputs.labeled(spark, sf_dir))


@query(
    "maxn_moment_boxes",
    """WITH f AS (SELECT video_path, video_name, frame, label, min(time) AS time, count(track_id) AS n FROM cleaned GROUP BY ALL),
m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY video_path, video_name, label ORDER BY n DESC, frame) = 1)
SELECT m.video_path, m.time, m.label AS maxn_label, m.n AS maxn, c.track_id, c.label, c.xmin, c.ymin, c.xmax, c.ymax
FROM m JOIN cleaned c ON c.video_path = m.video_path AND c.time = m.time""",
)
def maxn_moment_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _cleaned(spark, sf_dir)
    return m.maxn_moment_boxes(cleaned, m.maxn_by_video(cleaned, with_tracks=False))


_METRICS = """
WITH fr AS (SELECT collection, bruv_station, video_id, frame, taxon_group, count(DISTINCT track_id) AS n
  FROM reviewed GROUP BY ALL),
g AS (SELECT collection, bruv_station, video_id,
  CAST(coalesce(max(n) FILTER (taxon_group = 'shark'), 0) AS BIGINT) AS maxn_shark,
  CAST(coalesce(max(n) FILTER (taxon_group = 'ray_skate'), 0) AS BIGINT) AS maxn_ray_skate,
  CAST(coalesce(max(n) FILTER (taxon_group = 'teleost'), 0) AS BIGINT) AS maxn_teleost
  FROM fr GROUP BY ALL),
s AS (SELECT collection, bruv_station, video_id, track_id, species, (max(frame) - min(frame)) / 5e0 AS seconds
  FROM reviewed WHERE taxon_group = 'shark' GROUP BY ALL),
t AS (SELECT collection, bruv_station, video_id, count(DISTINCT track_id) AS n_shark_tracks,
  sum(seconds) AS shark_total_time_sec, count(DISTINCT nullif(species, '')) AS shark_species_richness,
  coalesce(string_agg(DISTINCT nullif(species, ''), ',' ORDER BY nullif(species, '')), '') AS shark_species_list
  FROM s GROUP BY ALL),
v AS (SELECT collection, bruv_station, video_id, maxn_shark, maxn_ray_skate, maxn_teleost,
  maxn_shark + maxn_ray_skate AS maxn_elasmobranch, coalesce(n_shark_tracks, 0) AS n_shark_tracks,
  coalesce(shark_total_time_sec, 0e0) AS shark_total_time_sec,
  coalesce(shark_species_richness, 0) AS shark_species_richness,
  coalesce(shark_species_list, '') AS shark_species_list
  FROM g LEFT JOIN t USING (collection, bruv_station, video_id))
"""


def _video_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.video_metrics(inputs.reviewed(spark, sf_dir))


@query(
    "video_metrics",
    _METRICS + "SELECT * REPLACE (round(shark_total_time_sec, 3) AS shark_total_time_sec) FROM v",
)
def video_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _video_metrics(spark, sf_dir).withColumn(
        "shark_total_time_sec", F.bround("shark_total_time_sec", 3)
    )


@query(
    "species_maxn_by_video",
    """WITH f AS (SELECT collection, bruv_station, video_id, frame, species, count(DISTINCT track_id) AS n
  FROM reviewed WHERE taxon_group = 'shark' AND species <> '' GROUP BY ALL)
SELECT collection, bruv_station, video_id, species, max(n) AS maxn FROM f GROUP BY ALL""",
)
def species_maxn_by_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.species_maxn(inputs.reviewed(spark, sf_dir))


@query(
    "station_metrics",
    _METRICS
    + """, u AS (SELECT collection, bruv_station, count(DISTINCT species) AS shark_species_richness,
  string_agg(DISTINCT species, ',' ORDER BY species) AS shark_species_list
  FROM reviewed WHERE taxon_group = 'shark' AND species <> '' GROUP BY ALL),
b AS (SELECT collection, bruv_station, max(maxn_shark) AS maxn_shark, max(maxn_ray_skate) AS maxn_ray_skate,
  max(maxn_teleost) AS maxn_teleost, CAST(sum(n_shark_tracks) AS BIGINT) AS n_shark_tracks,
  round(sum(shark_total_time_sec), 3) AS shark_total_time_sec FROM v GROUP BY ALL)
SELECT b.*, maxn_shark + maxn_ray_skate AS maxn_elasmobranch,
  coalesce(shark_species_richness, 0) AS shark_species_richness, coalesce(shark_species_list, '') AS shark_species_list
FROM b LEFT JOIN u USING (collection, bruv_station)""",
)
def station_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.station_metrics(
        _video_metrics(spark, sf_dir), m.species_maxn(inputs.reviewed(spark, sf_dir))
    ).withColumn("shark_total_time_sec", F.bround("shark_total_time_sec", 3))


@query(
    "species_appearance",
    """SELECT collection, bruv_station, video_id, species, min(time_ms) AS first_ms, max(time_ms) AS last_ms,
  round(avg(confidence), 12) AS mean_confidence FROM reviewed WHERE species <> '' GROUP BY ALL""",
)
def species_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.appearance(inputs.reviewed(spark, sf_dir)).withColumn(
        "mean_confidence", F.bround("mean_confidence", 12)
    )


# Each station has a few species of its own and shares some with its neighbours.
_STATION_SPECIES = "concat('species ', CAST(floor((video_no % 60 * 3 + track_id % 5) / 4) AS STRING))"


@query(
    "species_accumulation",
    f"""WITH s AS (SELECT DISTINCT concat(folder1, '/', folder2) AS station, {_STATION_SPECIES.replace('floor(', 'CAST(floor(').replace(' / 4)', ' / 4) AS BIGINT)')} AS species FROM detections),
st AS (SELECT DISTINCT concat(folder1, '/', folder2) AS station FROM detections),
r AS (SELECT station, row_number() OVER (ORDER BY station) - 1 AS position FROM st),
f AS (SELECT species, min(position) AS position FROM s JOIN r USING (station) GROUP BY species)
SELECT r.station, r.position, count(f.species) AS new_species,
  CAST(sum(count(f.species)) OVER (ORDER BY r.position) AS BIGINT) AS species_so_far
FROM r LEFT JOIN f USING (position) GROUP BY r.station, r.position""",
)
def species_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = inputs.detections(spark, sf_dir).withColumn("station", F.concat_ws("/", "folder1", "folder2"))
    stations = placed.select("station").distinct()
    sightings = placed.selectExpr("station", f"{_STATION_SPECIES} AS species")
    return m.species_accumulation(sightings, m.station_positions(stations))


@query(
    "misplaced_species",
    """WITH t AS (SELECT CASE WHEN track_id % 9 = 0 THEN 'ray_skate' ELSE taxon_group END AS taxon_group, species
  FROM validation WHERE species <> ''),
c AS (SELECT species, taxon_group, count(*) AS tracks FROM t WHERE taxon_group <> '' GROUP BY ALL),
u AS (SELECT species, taxon_group AS usual_group FROM c
  QUALIFY row_number() OVER (PARTITION BY species ORDER BY tracks DESC, taxon_group) = 1)
SELECT species, taxon_group, tracks, usual_group FROM c JOIN u USING (species) WHERE taxon_group <> usual_group""",
)
def misplaced_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = inputs.validation(spark, sf_dir).withColumn(
        "taxon_group", F.expr("CASE WHEN track_id % 9 = 0 THEN 'ray_skate' ELSE taxon_group END")
    )
    return m.misplaced_species(tracks)
