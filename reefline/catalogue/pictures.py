"""Frame images. Pixels come from the embeddings: 64 numbers make one small frame."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.catalogue import inputs
from reefline.catalogue.registry import query
from reefline.operators import dedup
from reefline.operators import imaging as im
from reefline.session import checkpoint_root, spread
from reefline.sources import tables

ROWS, COLS = 8, 9
PER_VIDEO = 25

# Pixel number p of a frame; the three colours read the vector with different strides.
_STRIDES = (1, 1, 1)
_COLOUR_STRIDES = (1, 7, 13)

_LEVEL_SQL = "CAST(floor(least(255e0, greatest(0e0, (CAST(x AS DOUBLE) + 0.5e0) * 255e0))) AS INTEGER)"
_FRAMES_SQL = f"""
WITH q AS (SELECT vec_id, vec_id // {PER_VIDEO} AS video, vec_id % {PER_VIDEO} AS k, list_transform(embedding, lambda x: {_LEVEL_SQL}) AS v FROM embeddings),
fr AS (SELECT *, list_transform(range(0, {ROWS * COLS}), lambda p: v[p % 64 + 1]) AS px,
  list_transform(range(0, {ROWS * COLS}), lambda p: v[(p * 7) % 64 + 1]) AS gpx FROM q)
"""


def frames(
    spark: SparkSession, sf_dir: str, strides: tuple[int, int, int] = _STRIDES, enlarge: int = 1
) -> DataFrame:
    """One 8 x 9 frame per vector, as rows of the ``image`` source look; ``enlarge`` makes squares of its pixels."""
    vectors = inputs.table(spark, sf_dir, "embeddings")
    if enlarge > 1:  # a few vectors make very many pixels, so their rows are spread first
        vectors = vectors.repartition(spread(spark), "vec_id")
    levels = F.transform(
        "embedding",
        lambda x: F.floor(
            F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x.cast("double") + 0.5) * 255.0))
        ).cast("int"),
    )

    def pixel(p):
        return F.concat(
            *[
                F.lpad(F.hex(F.get(F.col("v"), ((p * s) % 64).cast("int"))), 2, "0")
                for s in strides
            ]
        )

    def line(y):
        wide = F.transform(F.sequence(y * COLS, y * COLS + COLS - 1), lambda p: F.repeat(pixel(p), enlarge))
        return F.repeat(F.array_join(wide, ""), enlarge)

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(ROWS - 1)), line), "")
    return vectors.withColumn("v", levels).select(
        F.concat(F.lit("v"), F.floor(F.col("vec_id") / PER_VIDEO).cast("string")).alias("video_path"),
        (F.col("vec_id") % PER_VIDEO).alias("frame"),
        F.col("label").alias("kind"),
        F.lit(ROWS * enlarge).alias("height"),
        F.lit(COLS * enlarge).alias("width"),
        F.lit(3).alias("nChannels"),
        F.unhex(text).alias("data"),
    )


_BITS = f"""list_aggregate(list_transform(range(0, {ROWS * (COLS - 1)}), lambda b: CASE WHEN px[(b // {COLS - 1}) * {COLS} + b % {COLS - 1} + 2]
  > px[(b // {COLS - 1}) * {COLS} + b % {COLS - 1} + 1] THEN '1' ELSE '0' END), 'string_agg', '')"""


@query(
    "frame_hashes",
    _FRAMES_SQL
    + f"""SELECT concat('v', CAST(video AS VARCHAR)) AS video_path, k AS frame, {_BITS} AS image_bits,
  md5(concat({_BITS}, '_10_20_', CAST(30 + k AS VARCHAR), '_40')) AS detection_hash FROM fr""",
)
def frame_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = im.frame_hashes(frames(spark, sf_dir))
    boxed = bits.withColumns(
        {"xmin": F.lit(10.2), "ymin": F.lit(20.0), "xmax": F.col("frame") + 30.7, "ymax": F.lit(40.0)}
    )
    return boxed.select(
        "video_path", "frame", "image_bits", dedup.detection_hash(F.col("image_bits")).alias("detection_hash")
    )


@query(
    "frame_hashes_of_files",
    _FRAMES_SQL
    + f"""SELECT concat('v', CAST(video AS VARCHAR)) AS video_path, k AS frame, {ROWS * 40} AS rows, {COLS * 40} AS cols, {_BITS} AS image_bits FROM fr""",
)
def frame_hashes_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 320 x 360 pixels, saved as PNG files, decoded and shrunk again."""
    folder = f"{checkpoint_root(spark)}/frames-{uuid.uuid4().hex}"
    tables.write_frames(frames(spark, sf_dir, enlarge=40), folder)
    read = tables.read_frames(spark, folder).withColumns({"rows": F.col("height"), "cols": F.col("width")})
    return im.frame_hashes(read, ["video_path", "frame", "rows", "cols"])


@query(
    "motion_scores",
    _FRAMES_SQL
    + f""", d AS (SELECT a.video, a.k, list_transform(range(1, {ROWS * COLS + 1}), lambda i: abs(a.px[i] - b.px[i])) AS df
  FROM fr a JOIN fr b ON a.video = b.video AND a.k = b.k + 1)
SELECT concat('v', CAST(video AS VARCHAR)) AS video_path, k AS sample_idx, round(len(list_filter(df, lambda x: x > 25)) / {ROWS * COLS}e0 * 0.6e0
  + list_avg(df) / 255e0 * 0.3e0 + list_max(df) / 255e0 * 0.1e0, 9) AS motion_score, round(list_avg(df), 9) AS mean_difference FROM d""",
)
def motion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = frames(spark, sf_dir).withColumnRenamed("frame", "sample_idx")
    return im.motion_scores(sampled).select(
        "video_path",
        "sample_idx",
        F.bround("motion_score", 9).alias("motion_score"),
        F.bround("mean_difference", 9).alias("mean_difference"),
    )


@query("frame_flow")
def frame_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far grid points move between frames of 80 x 90 pixels, and the mean of each video."""
    sampled = frames(spark, sf_dir, enlarge=10).withColumnRenamed("frame", "sample_idx")
    flows = im.flow_magnitudes(sampled)
    return flows.join(im.motion_magnitude(flows), "video_path")


# A box of two by two pixels in the middle of the frame, and an empty one.
@query(
    "crop_scores",
    _FRAMES_SQL
    + f""", c AS (SELECT *, [px[{3 * COLS + 4 + 1}], px[{3 * COLS + 5 + 1}], px[{4 * COLS + 4 + 1}], px[{4 * COLS + 5 + 1}]] AS cr FROM fr)
SELECT concat('v', CAST(video AS VARCHAR)) AS video_path, k AS frame, b AS box_id,
  CASE b WHEN 0 THEN round(least(list_var_pop(cr) / 1e4, 1e0), 9) ELSE 0e0 END AS blue_variance FROM c, (VALUES (0::BIGINT), (1::BIGINT)) AS u(b)""",
)
def crop_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = frames(spark, sf_dir)
    boxes = every.select(
        "video_path",
        "frame",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("box_id"), F.lit(4).alias("xmin"), F.lit(3).alias("ymin"), F.lit(6).alias("xmax"), F.lit(5).alias("ymax")),
                F.struct(F.lit(1).alias("box_id"), F.lit(4).alias("xmin"), F.lit(3).alias("ymin"), F.lit(4).alias("xmax"), F.lit(5).alias("ymax")),
            )
        ).alias("b"),
    ).select("video_path", "frame", "b.*")
    return im.crop_scores(every, boxes).select(
        "video_path", "frame", "box_id", F.bround("blue_variance", 9).alias("blue_variance")
    )


_GREY_SQL = "(1868 * px[i] + 9617 * gpx[i] + 4899 * v[((i - 1) * 13) % 64 + 1] + 8192) // 16384"


@query(
    "substrate_colour_features",
    _FRAMES_SQL
    + f""", p AS (SELECT video, px[i] AS b, gpx[i] AS g, v[((i - 1) * 13) % 64 + 1] AS r, {_GREY_SQL} AS y
  FROM fr, unnest(range({4 * COLS + 1}, {ROWS * COLS + 1})) AS u(i))
SELECT concat('v', CAST(video AS VARCHAR)) AS video_path, round(avg(greatest(b, g, r)), 6) AS mean_value, round(stddev_pop(greatest(b, g, r)), 6) AS std_value,
  round(var_pop(y), 4) AS texture_variance, round(avg(b) / (avg(g) + 1e-6), 6) AS blue_green_ratio FROM p GROUP BY video""",
)
def substrate_colour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = im.substrate_features(frames(spark, sf_dir, _COLOUR_STRIDES))
    return found.select(
        "video_path",
        F.bround("mean_value", 6).alias("mean_value"),
        F.bround("std_value", 6).alias("std_value"),
        F.bround("texture_variance", 4).alias("texture_variance"),
        F.bround("blue_green_ratio", 6).alias("blue_green_ratio"),
    )


# Every pixel with its colours as the frame has them: grey, hue, saturation, value. Row and column count from 0.
_PIXELS_SQL = (
    _FRAMES_SQL
    + f""", rgb AS (SELECT video, k, i - 1 AS p, px[i] AS b, gpx[i] AS g, v[((i - 1) * 13) % 64 + 1] AS r, {_GREY_SQL} AS y
  FROM fr, unnest(range(1, {ROWS * COLS + 1})) AS u(i)),
ext AS (SELECT *, greatest(b, g, r) AS val, greatest(b, g, r) - least(b, g, r) AS span FROM rgb),
hue AS (SELECT *, CASE WHEN span = 0 THEN 0e0 WHEN val = r THEN 60 * (g - b) / CAST(span AS DOUBLE) WHEN val = g THEN 120 + 60 * (b - r) / CAST(span AS DOUBLE)
  ELSE 240 + 60 * (r - g) / CAST(span AS DOUBLE) END AS deg FROM ext),
pix AS (SELECT video, k, p // {COLS} AS row, p % {COLS} AS col, b, g, r, y, val, round_even(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END / 2, 0) AS h,
  CASE WHEN val = 0 THEN 0e0 ELSE round_even(255e0 * span / val, 0) END AS s FROM hue)
"""
)


def _laplace_sql(first: int, rows: int, name: str) -> str:
    """Laplacian and neighbour pattern of each pixel of the part that starts at row ``first``; borders are mirrored."""
    def side(c: str, d: int, n: int, least: int) -> str:
        return f"CASE WHEN q.{c} + {d} < {least} THEN q.{c} - {d} WHEN q.{c} + {d} >= {least + n} THEN q.{c} - {d} ELSE q.{c} + {d} END"

    near = " + ".join(
        f"(SELECT y FROM {name}_of z WHERE z.video = q.video AND z.k = q.k AND z.row = {side('row', dy, rows, first)} AND z.col = {side('col', dx, COLS, 0)})"
        for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))
    )
    return f"""{name}_of AS (SELECT video, k, row, col, y FROM pix WHERE row >= {first}),
{name} AS (SELECT q.video, q.k, {near} - 4 * q.y AS lap FROM {name}_of q)"""


_LIGHT_SQL = """CASE WHEN lin > 0.008856e0 THEN 116 * cbrt(lin) - 16 ELSE 903.3e0 * lin END * 255 / 100"""
_LINEAR_SQL = "CASE WHEN {0} / 255e0 <= 0.04045e0 THEN {0} / 255e0 / 12.92e0 ELSE pow(({0} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END"


@query(
    "substrate_texture_features",
    _PIXELS_SQL
    + ", "
    + _laplace_sql(4, 4, "low")
    + f""", c AS (SELECT video, avg(h) AS mh, stddev_pop(h) AS sh, avg(s) AS ms, stddev_pop(s) AS ss FROM pix WHERE row >= 4 GROUP BY video),
l AS (SELECT video, var_pop(lap) AS rough FROM low GROUP BY video),
n AS (SELECT a.video, a.k, a.row, a.col, count(*) FILTER (b.y >= a.y) - 1 AS pattern FROM low_of a JOIN low_of b
  ON a.video = b.video AND a.k = b.k AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1
  WHERE a.row BETWEEN 5 AND 6 AND a.col BETWEEN 1 AND {COLS - 2} GROUP BY ALL),
t AS (SELECT video, stddev_pop(pattern) AS lbp FROM n GROUP BY video),
e AS (SELECT video, k, avg(y) FILTER (row = 4) AS top, avg(y) FILTER (row = 7) AS bottom FROM low_of GROUP BY ALL),
d AS (SELECT video, abs(avg(top) - avg(bottom)) AS slope FROM e GROUP BY video)
SELECT concat('v', CAST(video AS VARCHAR)) AS video_path, round(mh, 6) AS mean_hue, round(sh, 6) AS std_hue, round(ms, 6) AS mean_saturation, round(ss, 6) AS std_saturation,
  round(lbp, 6) AS local_binary_pattern, round(slope, 6) AS depth_gradient, round(rough, 4) AS surface_roughness
FROM c JOIN l USING (video) JOIN t USING (video) JOIN d USING (video)""",
)
def substrate_texture_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = im.substrate_features(frames(spark, sf_dir, _COLOUR_STRIDES))
    six = ("mean_hue", "std_hue", "mean_saturation", "std_saturation", "local_binary_pattern", "depth_gradient")
    return found.select("video_path", *[F.bround(c, 6).alias(c) for c in six], F.bround("surface_roughness", 4).alias("surface_roughness"))


@query("substrate_features")
def substrate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.substrate_features(frames(spark, sf_dir, _COLOUR_STRIDES))


@query(
    "clarity_and_light_of_frames",
    _PIXELS_SQL
    + ", "
    + _laplace_sql(0, ROWS, "every")
    + f""", c AS (SELECT video, k, least(var_pop(lap) / 1000e0, 1e0) AS clarity FROM every GROUP BY ALL),
i AS (SELECT video, k, 0.072169e0 * {_LINEAR_SQL.format('b')} + 0.715160e0 * {_LINEAR_SQL.format('g')} + 0.212671e0 * {_LINEAR_SQL.format('r')} AS lin FROM pix),
l AS (SELECT video, k, avg(round_even({_LIGHT_SQL}, 0)) / 255e0 AS light FROM i GROUP BY ALL)
SELECT concat('v', CAST(video AS VARCHAR)) AS video_path, round(avg(clarity), 9) AS water_clarity, round(avg(light), 9) AS light_level FROM c JOIN l USING (video, k) GROUP BY video""",
)
def clarity_and_light_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = im.clarity_and_light(frames(spark, sf_dir, _COLOUR_STRIDES))
    return found.select("video_path", *[F.bround(c, 9).alias(c) for c in ("water_clarity", "light_level")])


@query(
    "substrate_votes",
    _PIXELS_SQL
    + """, f AS (SELECT video, k, avg(h) AS hue, avg(s) AS sat, stddev_pop(y) AS std FROM pix WHERE row >= 5 GROUP BY ALL),
o AS (SELECT video, CASE WHEN sat < 50 AND std < 30 THEN 'sand' WHEN hue > 40 AND hue < 80 AND sat > 80 THEN 'seagrass' WHEN std > 60 THEN 'rock'
  WHEN sat > 60 AND hue < 30 THEN 'coral' ELSE 'unknown' END AS substrate_type FROM f),
n AS (SELECT video, substrate_type, count(*) AS votes, list_position(['sand', 'rock', 'coral', 'seagrass', 'unknown'], substrate_type) AS place FROM o GROUP BY ALL)
SELECT concat('v', CAST(video AS VARCHAR)) AS video_path, arg_max(substrate_type, votes * 10 - place) AS substrate_type,
  max(votes) / CAST(sum(votes) AS DOUBLE) AS substrate_confidence FROM n GROUP BY video""",
)
def substrate_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.substrate_votes(im.frame_floor_colours(frames(spark, sf_dir, _COLOUR_STRIDES)))


_FEATURES = [
    "p_partkey AS video_no",
    "CAST(p_partkey * 7 % 180 AS DOUBLE) AS mean_hue",
    "CAST(p_partkey * 31 % 200 AS DOUBLE) AS mean_saturation",
    "CAST(p_partkey * 17 % 255 AS DOUBLE) AS mean_value",
    "CAST(p_partkey * 101 % 1500 AS DOUBLE) AS texture_variance",
    "CAST(p_partkey * 13 % 40 AS DOUBLE) / 1e2 AS edge_density",
    "CAST(p_partkey * 211 % 3000 AS DOUBLE) AS surface_roughness",
    "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 5 AS DOUBLE) END AS motion_magnitude",
]
_RULES_SQL = f"""
WITH f AS (SELECT {', '.join(_FEATURES)} FROM part), g AS (SELECT *, coalesce(motion_magnitude, 0) AS mv FROM f),
rul AS (SELECT video_no, CASE WHEN mean_saturation < 60 AND texture_variance < 500 AND edge_density < 0.1e0 THEN CASE WHEN mean_value < 100 THEN 'muddy_sand' ELSE 'sand' END
  WHEN mean_saturation > 80 AND texture_variance > 1000 AND edge_density > 0.2e0 THEN CASE WHEN mean_saturation < 100 THEN 'dead_coral' ELSE 'coral_reef' END
  WHEN texture_variance > 800 AND edge_density > 0.15e0 AND mean_saturation < 70 THEN CASE WHEN surface_roughness > 2000 THEN 'boulder' ELSE 'rock' END
  WHEN mean_hue > 40 AND mean_hue < 80 AND mean_saturation > 100 AND mv > 2 THEN 'seagrass'
  WHEN mean_hue > 80 AND mean_saturation > 120 THEN CASE WHEN mv > 3 THEN 'kelp' ELSE 'algae' END
  WHEN edge_density > 0.25e0 AND texture_variance > 600 AND surface_roughness > 1500 THEN 'rubble' ELSE 'unknown' END AS substrate_type FROM g),
con(substrate_type, confidence) AS (VALUES ('muddy_sand', 0.7e0), ('sand', 0.8e0), ('dead_coral', 0.7e0), ('coral_reef', 0.75e0), ('boulder', 0.7e0), ('rock', 0.7e0),
  ('seagrass', 0.75e0), ('kelp', 0.65e0), ('algae', 0.65e0), ('rubble', 0.6e0), ('unknown', 0.5e0))
"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.substrate_by_rules(inputs.table(spark, sf_dir, "part").selectExpr(*_FEATURES))


@query("substrate_by_rules", _RULES_SQL + "SELECT video_no, substrate_type, confidence FROM rul JOIN con USING (substrate_type)")
def substrate_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("video_no", "substrate_type", "confidence")


@query(
    "chosen_substrate",
    _RULES_SQL
    + """, cnd AS (SELECT video_no, 'cv_analysis' AS method, substrate_type, confidence FROM rul JOIN con USING (substrate_type)
UNION ALL SELECT p_partkey, 'user_input', CASE p_partkey % 2 WHEN 0 THEN 'Sand' ELSE 'lava' END, 0.1e0 FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 'ml_model', 'kelp', (p_partkey % 10) / 10e0 FROM part WHERE p_partkey % 3 = 0)
SELECT video_no, method, CASE method WHEN 'user_input' THEN lower(substrate_type) ELSE substrate_type END AS substrate_type,
  CASE method WHEN 'user_input' THEN 1e0 ELSE confidence END AS confidence FROM cnd
WHERE CASE method WHEN 'user_input' THEN substrate_type = 'Sand' WHEN 'ml_model' THEN confidence > 0.7e0 ELSE true END
QUALIFY row_number() OVER (PARTITION BY video_no ORDER BY CASE method WHEN 'user_input' THEN 4 WHEN 'ml_model' THEN 3 WHEN 'cv_analysis' THEN 2 ELSE 1 END DESC) = 1""",
)
def chosen_substrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = inputs.table(spark, sf_dir, "part")
    user = part.filter("p_partkey % 5 = 0").selectExpr(
        "p_partkey AS video_no",
        "'user_input' AS method",
        "CASE p_partkey % 2 WHEN 0 THEN 'Sand' ELSE 'lava' END AS substrate_type",
        "0.1e0 AS confidence",
    )
    model = part.filter("p_partkey % 3 = 0").selectExpr(
        "p_partkey AS video_no",
        "'ml_model' AS method",
        "'kelp' AS substrate_type",
        "(p_partkey % 10) / 10e0 AS confidence",
    )
    rules = _rules(spark, sf_dir).select(
        "video_no", F.lit("cv_analysis").alias("method"), "substrate_type", "confidence"
    )
    return im.choose_substrate(rules.unionByName(user).unionByName(model), ["video_no"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _brightness_model():
    """A stand-in for a user's model: bright crops are 'pale', dark ones 'dark'."""
    import numpy as np

    def score(crops):
        level = np.array([c.mean() / 255.0 for c in crops])
        return np.stack([level, 1.0 - level], axis=1)

    return score


@query(
    "classified_tracks",
    _FRAMES_SQL
    + f""", c AS (SELECT video, k, list_avg(list_transform(range(1, {ROWS * COLS + 1}), lambda i: px[i])) / 255e0 AS lv FROM fr),
s AS (SELECT video, k, CASE WHEN greatest(lv, 1 - lv) < 0.52e0 THEN 'ESU' WHEN lv >= 1 - lv THEN 'pale' ELSE 'dark' END AS label, round(greatest(lv, 1 - lv), 9) AS classification_confidence FROM c)
SELECT concat('v', CAST(video AS VARCHAR)) AS video_path, k AS track_id, d AS frame, label, classification_confidence FROM s, (VALUES (0::BIGINT), (1::BIGINT)) AS u(d)""",
)
def classified_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = frames(spark, sf_dir)
    boxes = every.select(
        "video_path",
        "frame",
        F.col("frame").alias("box_id"),
        F.lit(0).alias("xmin"),
        F.lit(0).alias("ymin"),
        F.lit(COLS).alias("xmax"),
        F.lit(ROWS).alias("ymax"),
    )
    species = im.classify_crops(every, boxes, _brightness_model, ["pale", "dark"], least=0.52)
    tracks = species.select(
        "video_path", F.col("box_id").alias("track_id"), "species", "classification_confidence"
    )
    detections = every.select(
        "video_path",
        F.col("frame").alias("track_id"),
        F.lit("elasmobranch").alias("label"),
        F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("frame"),
    )
    return im.label_tracks(detections, tracks).withColumn(
        "classification_confidence", F.bround("classification_confidence", 9)
    )


@query("substrate_model_report")
def substrate_model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest trained on the features of every frame; its label is the vector's label."""
    from reefline.operators import substrate_model as sm

    keyed = frames(spark, sf_dir, _COLOUR_STRIDES)
    rows = im.substrate_features(keyed, ["video_path", "frame", "kind"]).withColumns(
        {
            "label": F.concat(F.lit("kind"), F.col("kind").cast("string")),
            "id": F.concat_ws("/", "video_path", "frame"),
        }
    )
    features = [c for c in im.FEATURES if c != "motion_magnitude"]
    from reefline.session import reliable_checkpoint

    marked = reliable_checkpoint(sm.split(rows, "id"))
    model = sm.train(marked.filter("NOT is_test"), features)
    return sm.report(model, marked.filter("is_test"), features)
