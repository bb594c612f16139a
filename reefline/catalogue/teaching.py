"""Training labels, manifests, sampling, splits, duplicate boxes, typed species names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.catalogue import inputs
from reefline.catalogue.registry import query
from reefline.functions.names import NOTE_CLASSES, SPELLINGS, TAXON_CLASSES
from reefline.operators import dedup, lookup, training

# --- training classes -----------------------------------------------------

_REVIEW = [
    "p_partkey",
    "concat('t', CAST(p_partkey AS STRING), '.jpg') AS thumbnail",
    "CASE p_partkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN ' TRUE' WHEN 2 THEN 'false' WHEN 3 THEN 'False ' ELSE '' END AS true_detection",
    "CASE p_partkey % 7 WHEN 0 THEN 'shark' WHEN 1 THEN 'Teleost' WHEN 2 THEN '' WHEN 3 THEN 'sea turtle' WHEN 4 THEN 'ray_skate' WHEN 5 THEN 'debris' ELSE ' ' END AS taxon_group",
    "CASE p_partkey % 11 WHEN 0 THEN 'G. cirratum' WHEN 1 THEN 'Tiger Shark ' WHEN 2 THEN '' WHEN 3 THEN 'Manta birostris' WHEN 4 THEN 'human' WHEN 5 THEN ' ' WHEN 6 THEN 'c. perezi' WHEN 7 THEN 'A/B sp.' ELSE '' END AS species",
    "CASE p_partkey % 9 WHEN 0 THEN 'surface human and chum box' WHEN 1 THEN 'Chum box' WHEN 2 THEN 'a snapper' WHEN 3 THEN 'Sargassum mat' WHEN 4 THEN 'surface wave' WHEN 5 THEN NULL WHEN 6 THEN 'human arm' WHEN 7 THEN 'boat hull' ELSE 'nothing' END AS notes",
]


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in table.items())


_CLASS_SQL = f"""
WITH rev AS (SELECT {', '.join(_REVIEW)} FROM part),
spell(k, v) AS (VALUES {_values(SPELLINGS)}), taxon(k, v) AS (VALUES {_values(TAXON_CLASSES)}),
n AS (SELECT p_partkey, thumbnail, lower(trim(true_detection)) AS td, trim(taxon_group) AS g, trim(species) AS sp, t.v AS tv,
  coalesce(s.v, translate(trim(species), ' ./', '___')) AS spn, coalesce(sg.v, translate(trim(taxon_group), ' ./', '___')) AS gn
  FROM rev LEFT JOIN spell s ON s.k = lower(trim(species)) LEFT JOIN spell sg ON sg.k = lower(trim(taxon_group)) LEFT JOIN taxon t ON t.k = lower(trim(taxon_group))),
lab AS (SELECT 'new_validation' AS source, thumbnail AS filename, CASE td WHEN 'true' THEN
    CASE WHEN sp <> '' THEN spn WHEN g <> '' THEN coalesce(tv, 'UNKNOWN_' || gn) ELSE 'UNKNOWN_elasmobranch' END
  WHEN 'false' THEN CASE WHEN tv IS NOT NULL THEN tv WHEN sp <> '' THEN CASE WHEN starts_with(spn, 'FALSE_') THEN spn ELSE 'FALSE_' || spn END
    WHEN g <> '' THEN 'FALSE_' || gn ELSE 'FALSE_other' END END AS class FROM n)
"""


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "part").selectExpr(*_REVIEW)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.labels_from_validation(_review(spark, sf_dir))


@query("training_labels", _CLASS_SQL + "SELECT * FROM lab WHERE class IS NOT NULL")
def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


_NOTES_TRUE = "CASE p_partkey % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' ELSE 'true' END"
_NOTES_SQL = (
    f"""not_ AS (SELECT p_partkey, thumbnail, {_NOTES_TRUE} AS td, species, lower(coalesce(notes, '')) AS notes FROM rev),
lab2 AS (SELECT 'notes_validation' AS source, thumbnail AS filename, CASE WHEN td = 'TRUE' AND species <> '' THEN
    coalesce((SELECT v FROM spell WHERE k = lower(trim(species))), translate(species, ' ./', '___'))
  WHEN td = 'FALSE' THEN CASE """
    + " ".join(f"WHEN contains(notes, '{k}') THEN '{v}'" for k, v in NOTE_CLASSES.items())
    + " ELSE 'FALSE_other' END END AS class FROM not_)\n"
)


def _note_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _review(spark, sf_dir).withColumns(
        {"image_filename": F.col("thumbnail"), "true_detection": F.expr(_NOTES_TRUE)}
    )
    return training.labels_from_notes(old)


@query(
    "combined_training_labels",
    _CLASS_SQL
    + ", "
    + _NOTES_SQL
    + "SELECT * FROM lab WHERE class IS NOT NULL UNION ALL SELECT * FROM lab2 WHERE class IS NOT NULL",
)
def combined_training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.all_labels(_labels(spark, sf_dir), _note_labels(spark, sf_dir))


@query(
    "class_distribution",
    _CLASS_SQL + "SELECT class, count(*) AS images FROM lab WHERE class IS NOT NULL GROUP BY class",
)
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.class_distribution(_labels(spark, sf_dir))


@query(
    "class_index",
    _CLASS_SQL
    + "SELECT class, row_number() OVER (ORDER BY class) - 1 AS class_idx FROM (SELECT DISTINCT class FROM lab WHERE class IS NOT NULL)",
)
def class_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.class_index(_labels(spark, sf_dir))


# --- manifests ------------------------------------------------------------

_WINDOWS = """
WITH ok AS (SELECT video_path, track_id, replace(replace(trim(species), ' ', '_'), '.', '') AS species FROM validation
  WHERE lower(trim(true_detection)) IN ('true', 'yes', '1', 't') AND trim(species) <> ''),
r AS (SELECT d.*, row_number() OVER k - 1 AS pos, count(*) OVER p AS detections, min(time_ms) OVER p AS start_ms, max(time_ms) OVER p AS end_ms
  FROM detections d WINDOW p AS (PARTITION BY video_path, track_id), k AS (PARTITION BY video_path, track_id ORDER BY frame, det_o, det_l, det_p, xmax)),
win AS (SELECT r.video_path, r.video_name, r.track_id, ok.species, start_ms, end_ms, detections, confidence, CAST(xmin AS INTEGER) AS xmin,
  CAST(ymin AS INTEGER) AS ymin, CAST(xmax AS INTEGER) AS xmax, CAST(ymax AS INTEGER) AS ymax, w, h
  FROM r JOIN ok USING (video_path, track_id) WHERE pos = detections // 2)
"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.track_windows(
        inputs.validation(spark, sf_dir),
        inputs.detections(spark, sf_dir),
        ties=("det_o", "det_l", "det_p", "xmax"),
        nulls_last=True,
    )


@query("track_windows", _WINDOWS + "SELECT * FROM win")
def track_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)


_MANIFEST = (
    _WINDOWS
    + """, c AS (SELECT *, greatest(3, least(20, (CASE WHEN end_ms - start_ms < 100 THEN 2000 ELSE end_ms - start_ms END) // 200)) AS n FROM win),
e AS (SELECT c.*, i, CASE WHEN i = n - 1 THEN end_ms ELSE CAST(trunc(start_ms + i * ((end_ms - start_ms) / CAST(n - 1 AS DOUBLE))) AS BIGINT) END AS frame_ms
  FROM c, unnest(range(CAST(n AS BIGINT))) AS u(i)),
man AS (SELECT video_path, track_id, species, CAST(i AS INTEGER) AS frame_no, frame_ms,
  CASE WHEN z THEN 0 ELSE greatest(0, xmin - CAST(trunc((xmax - xmin) * 0.2e0) AS INTEGER)) END AS crop_x1,
  CASE WHEN z THEN 0 ELSE greatest(0, ymin - CAST(trunc((ymax - ymin) * 0.2e0) AS INTEGER)) END AS crop_y1,
  CASE WHEN z THEN w ELSE least(w, xmax + CAST(trunc((xmax - xmin) * 0.2e0) AS INTEGER)) END AS crop_x2,
  CASE WHEN z THEN h ELSE least(h, ymax + CAST(trunc((ymax - ymin) * 0.2e0) AS INTEGER)) END AS crop_y2,
  concat(species, '/', video_name, printf('_track%04d_frame%03d.jpg', track_id, i)) AS image_name
  FROM (SELECT *, xmin = 0 OR ymin = 0 OR xmax = 0 OR ymax = 0 AS z FROM e))
"""
)


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.frame_manifest(_windows(spark, sf_dir))


@query("frame_manifest", _MANIFEST + "SELECT * FROM man")
def frame_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir).drop("video_name")


@query(
    "extraction_statistics",
    _MANIFEST
    + """, pv AS (SELECT video_path, count(*) AS frames, count(DISTINCT (track_id, species)) AS tracks FROM man GROUP BY ALL),
t AS (SELECT DISTINCT video_path, track_id, species FROM man)
SELECT species, count(*) AS tracks, CAST(sum(frames // tracks) AS BIGINT) AS frames FROM t JOIN pv USING (video_path) GROUP BY species""",
)
def extraction_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.extraction_stats(_manifest(spark, sf_dir))


# --- image sets -----------------------------------------------------------

_IMAGE = [
    "concat('GH', CAST(doc_id % 7 AS STRING), '_track', CAST(doc_id % 97 AS STRING), '_', CAST(doc_id AS STRING), '.jpg') AS filename",
    "source AS class",
]
_IMAGES_SQL = f"WITH img AS (SELECT {', '.join(_IMAGE)} FROM documents), trk AS (SELECT *, regexp_replace(replace(filename, '.jpg', ''), '_[^_]*$', '') AS track FROM img)"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").selectExpr(*_IMAGE)


@query(
    "training_summary",
    _IMAGES_SQL + " SELECT class, count(DISTINCT track) AS tracks, count(*) AS frames FROM trk GROUP BY class",
)
def training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.training_summary(_images(spark, sf_dir))


@query("videos_included", _IMAGES_SQL + " SELECT DISTINCT split_part(filename, '_', 1) AS video FROM img")
def videos_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.videos_included(_images(spark, sf_dir))


def _hash_sql(seed: int, text: str) -> str:
    return f"CAST('0x' || substr(md5(concat('{seed}|', {text})), 1, 15) AS BIGINT)"


_SAMPLE = (
    _IMAGES_SQL
    + f""", rd AS (SELECT *, row_number() OVER (PARTITION BY class, track ORDER BY {_hash_sql(5, 'filename')}, filename) AS rnd FROM trk),
smp AS (SELECT class, filename FROM rd QUALIFY row_number() OVER (PARTITION BY class ORDER BY rnd, track, filename) <= 60)
"""
)


@query("diverse_sample", _SAMPLE + "SELECT * FROM smp")
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.diverse_sample(_images(spark, sf_dir), 60, seed=5)


@query(
    "training_with_replay",
    _SAMPLE
    + """SELECT class, filename, false AS replayed FROM img UNION ALL SELECT class, 'replay_' || filename, true FROM smp""",
)
def training_with_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    return training.with_replay(images, training.diverse_sample(images, 60, seed=5))


@query(
    "stratified_split",
    _IMAGES_SQL
    + f""", s AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {_hash_sql(42, 'filename')}, filename) AS at_, count(*) OVER (PARTITION BY class) AS n FROM img)
SELECT filename, class, CASE WHEN at_ <= ceil(n * 0.2e0) THEN 'validation' ELSE 'train' END AS split FROM s""",
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.stratified_split(_images(spark, sf_dir), ["filename"])


_PATHS = "concat('train/', source, '/', CASE doc_id % 4 WHEN 0 THEN 'G.cirratum' WHEN 1 THEN 'Gcirratum' WHEN 2 THEN 'x-C.perezi' ELSE 'none' END, '_', CAST(doc_id AS STRING), '.jpg') AS path"


@query(
    "images_labelled_by_name",
    f"""WITH p AS (SELECT {_PATHS} FROM documents)
SELECT path, CASE WHEN contains(path, 'cirratum') THEN 'G.cirratum' ELSE 'C.perezi' END AS class FROM p WHERE NOT contains(path, '/none_')""",
)
def images_labelled_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = inputs.table(spark, sf_dir, "documents").selectExpr(_PATHS)
    return training.label_by_name(paths, ["G.cirratum", "C.perezi"])


@query(
    "images_labelled_by_folder",
    f"""WITH p AS (SELECT {_PATHS}, source FROM documents) SELECT path, source AS class FROM p WHERE source IS NOT NULL""",
)
def images_labelled_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = inputs.table(spark, sf_dir, "documents").selectExpr(_PATHS)
    return training.label_by_folder(paths)


# --- duplicate boxes ------------------------------------------------------

_ORDER = "det_o * 100000000 + det_l * 10000000 + det_p"


@query(
    "near_duplicate_boxes",
    f"""WITH b AS (SELECT video_path, CAST(xmin AS INTEGER) AS xmin, CAST(ymin AS INTEGER) AS ymin, CAST(xmax AS INTEGER) AS xmax, CAST(ymax AS INTEGER) AS ymax,
  min({_ORDER}) AS first_seen, count(*) AS detections FROM detections GROUP BY ALL)
SELECT b.*, EXISTS (SELECT 1 FROM b e WHERE e.video_path = b.video_path AND e.first_seen < b.first_seen AND abs(e.xmin - b.xmin) <= 2
  AND abs(e.ymin - b.ymin) <= 2 AND abs(e.xmax - b.xmax) <= 2 AND abs(e.ymax - b.ymax) <= 2) AS duplicate FROM b""",
)
def near_duplicate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inputs.detections(spark, sf_dir).withColumn("seen", F.expr(_ORDER))
    return dedup.near_duplicates(found, "seen")


@query(
    "exact_duplicate_boxes",
    f"""WITH k AS (SELECT *, md5(concat('b', CAST(det_p % 4 AS VARCHAR), '_', CAST(CAST(xmin AS INTEGER) AS VARCHAR), '_', CAST(CAST(ymin AS INTEGER) AS VARCHAR), '_',
  CAST(CAST(xmax AS INTEGER) AS VARCHAR), '_', CAST(CAST(ymax AS INTEGER) AS VARCHAR))) AS detection_hash FROM detections)
SELECT video_path, detection_hash, track_id, frame FROM k QUALIFY row_number() OVER (PARTITION BY video_path, detection_hash ORDER BY {_ORDER}) = 1""",
)
def exact_duplicate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.concat(F.lit("b"), (F.col("det_p") % 4).cast("string"))
    return dedup.first_of_duplicates(
        inputs.detections(spark, sf_dir), bits, [F.expr(_ORDER).asc()]
    ).select("video_path", "detection_hash", "track_id", "frame")


# --- typed species names --------------------------------------------------

SPECIES_LISTS = {
    "shark": ["Carcharhinus perezi", "Ginglymostoma cirratum", "Galeocerdo cuvier"],
    "ray_skate": ["Hypanus americanus", "Aetobatus narinari"],
}
_TYPED = [
    "p_partkey",
    "CASE p_partkey % 3 WHEN 0 THEN 'shark' WHEN 1 THEN 'ray_skate' ELSE 'teleost' END AS taxon_group",
    "CASE p_partkey % 10 WHEN 0 THEN 'Carcharhinus perezii' WHEN 1 THEN 'carcharhinus perezi ' WHEN 2 THEN 'Ginglimostoma ciratum' WHEN 3 THEN 'Tiger' WHEN 4 THEN '' WHEN 5 THEN 'Hypanus americana' WHEN 6 THEN 'aetobatus narinari' WHEN 7 THEN 'Galeocerdo cuvieri' WHEN 8 THEN NULL ELSE 'unknown' END AS species",
]
_NAMES = ", ".join(
    f"('{g}', {i}, '{n}')"
    for i, (g, n) in enumerate((g, n) for g, names in SPECIES_LISTS.items() for n in names)
)


@query(
    "matched_species",
    f"""WITH t AS (SELECT {', '.join(_TYPED)} FROM part), names(g, i, n) AS (VALUES {_NAMES}),
c AS (SELECT DISTINCT species, taxon_group, n, i, levenshtein(lower(trim(species)), lower(n)) AS d, g = taxon_group AS own FROM t, names WHERE trim(species) <> ''),
m AS (SELECT * FROM c WHERE d <= 3 QUALIFY row_number() OVER (PARTITION BY species, taxon_group ORDER BY own DESC, d, i) = 1)
SELECT p_partkey, t.taxon_group, t.species, n AS match, d AS distance, CASE WHEN own THEN 'group' WHEN n IS NOT NULL THEN 'all' END AS scope
FROM t LEFT JOIN m ON m.species = t.species AND m.taxon_group = t.taxon_group""",
)
def matched_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = inputs.table(spark, sf_dir, "part").selectExpr(*_TYPED)
    return lookup.match_species(typed, SPECIES_LISTS)


# A list as long as the customers, of names of one length, and what was typed for them.
_LISTED = ["c_custkey AS position", "c_mktsegment AS `group`", "concat('S ', substring(md5(c_name), 1, 11)) AS name"]
_ENTERED = [
    "o_orderkey",
    "c_mktsegment",
    "CASE o_orderkey % 3 WHEN 0 THEN 'BUILDING' ELSE c_mktsegment END AS taxon_group",
    "CASE o_orderkey % 6 WHEN 0 THEN name WHEN 1 THEN concat(upper(name), ' ') WHEN 2 THEN concat(substring(name, 1, 4), substring(name, 6))"
    " WHEN 3 THEN concat('x', substring(name, 1, 6), 'y', substring(name, 8)) WHEN 4 THEN concat(substring(name, 2, 9), 'zz') ELSE substring(name, 5) END AS species",
]


@query(
    "species_of_a_long_list",
    f"""WITH l AS (SELECT {', '.join(_LISTED).replace('`', '"')} FROM customer),
t AS (SELECT {', '.join(c for c in _ENTERED if c != 'c_mktsegment')} FROM (SELECT o_orderkey, "group" AS c_mktsegment, name FROM orders JOIN l ON position = o_custkey)),
d AS (SELECT DISTINCT species, taxon_group FROM t),
w AS (SELECT DISTINCT lower(trim(species)) AS low FROM d),
c AS (SELECT low, name, position, "group", levenshtein(low, lower(name)) AS dist FROM w JOIN l ON abs(length(low) - length(name)) <= 3 AND levenshtein(low, lower(name)) <= 3),
m AS (SELECT species, taxon_group, name, dist, "group" = taxon_group AS own FROM d JOIN c ON c.low = lower(trim(species))
  QUALIFY row_number() OVER (PARTITION BY species, taxon_group ORDER BY "group" = taxon_group DESC, dist, position) = 1)
SELECT o_orderkey, t.taxon_group, t.species, name AS match, dist AS distance, CASE WHEN own THEN 'group' WHEN name IS NOT NULL THEN 'all' END AS scope
FROM t LEFT JOIN m ON m.species = t.species AND m.taxon_group = t.taxon_group""",
)
def species_of_a_long_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names against a list that is a table."""
    listed = inputs.table(spark, sf_dir, "customer").selectExpr(*_LISTED)
    orders = inputs.table(spark, sf_dir, "orders")
    rows = orders.join(listed, F.col("o_custkey") == F.col("position")).selectExpr("o_orderkey", "`group` AS c_mktsegment", "name")
    return lookup.match_species(rows.selectExpr(*_ENTERED).drop("c_mktsegment"), listed)
