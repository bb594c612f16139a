"""Frame images: colour and texture features, hashes, motion, crop scores, models.

Frames are rows (video_path, frame, height, width, nChannels, data). Python sees
one Arrow batch at a time, which Spark bounds by bytes
(spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless the cluster says
otherwise), and returns a few numbers per frame; grouping, joining and all rules
on the numbers stay in Spark.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from reefline.functions import pixels as px
from reefline.functions.names import UNCLASSIFIABLE
from reefline.functions.scores import surface_probability
from reefline.operators.ranking import top_rows
from reefline.session import spread

# The functions below travel to the executors whole: the package need not be installed there.
cloudpickle.register_pickle_by_value(px)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIXELS = ["height", "width", "nChannels", "data"]
FRAME = ["video_path", "frame"]

# Boxes of one frame travel to Python in groups of about this many.
BOXES_TOGETHER = 256
# The flow of frame pairs of one size is found together, for about this many pixels.
FLOW_PIXELS = 100_000


def _per_frame(frames: DataFrame, keys: Sequence[str], measure: Callable, schema: str) -> DataFrame:
    """``measure(image array)`` -> dict, for every frame, beside the keys."""
    names = [*keys, *PIXELS]
    kinds = dict(frames.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame(
                [
                    measure(px.to_array(d, h, w, c))
                    for h, w, c, d in zip(*(pdf[n] for n in PIXELS), strict=True)
                ]
            )
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), found], axis=1)

    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return frames.select(*names).mapInPandas(run, f"{head}, {schema}")


# --- features -------------------------------------------------------------

_MOMENTS = ("hue", "saturation", "value", "grey", "laplacian", "pattern")


def _bottom_moments(bgr: np.ndarray) -> dict[str, float]:
    """Counts, sums and squares over the bottom 40 % of a frame, where the sea floor is."""
    part = bgr[int(bgr.shape[0] * 0.6) :]
    h, s, v = px.hsv(part)
    g = px.grey(part)
    planes = (h, s, v, g, px.laplacian(g), px.neighbour_pattern(g))
    out: dict[str, float] = {"pixels": float(g.size), "inner_pixels": float(planes[5].size)}
    for name, plane in zip(_MOMENTS, planes, strict=True):
        out[f"sum_{name}"] = float(plane.sum())
        out[f"sq_{name}"] = float((plane**2).sum())
    quarter = max(g.shape[0] // 4, 1)
    out["edges"] = float(px.thin_edges(g).sum())
    out["top"] = float(g[:quarter].mean())
    out["bottom"] = float(g[-quarter:].mean())
    out["blue"] = float(part[..., 0].sum())
    out["green"] = float(part[..., 1].sum())
    return out


_MOMENT_SCHEMA = ", ".join(
    f"{c} double"
    for c in (
        "pixels",
        "inner_pixels",
        *[f"{p}_{n}" for n in _MOMENTS for p in ("sum", "sq")],
        "edges",
        "top",
        "bottom",
        "blue",
        "green",
    )
)


def substrate_features(frames: DataFrame, video: Sequence[str] = ("video_path",)) -> DataFrame:
    """Twelve features per video over the bottom of all its frames.

    Means and deviations of all pixels together come from per-frame sums, so no
    task ever holds more than one frame.
    """
    sums = _per_frame(frames, video, _bottom_moments, _MOMENT_SCHEMA)
    n = F.sum("pixels")

    def mean(name: str, size: Column = n) -> Column:
        return F.coalesce(F.try_divide(F.sum(f"sum_{name}"), size), F.lit(0.0))

    def variance(name: str, size: Column = n) -> Column:
        square = F.coalesce(F.try_divide(F.sum(f"sq_{name}"), size), F.lit(0.0))
        return F.greatest(F.lit(0.0), square - mean(name, size) * mean(name, size))

    return sums.groupBy(*video).agg(
        *[mean(c).alias(f"mean_{c}") for c in ("hue", "saturation", "value")],
        *[F.sqrt(variance(c)).alias(f"std_{c}") for c in ("hue", "saturation", "value")],
        variance("grey").alias("texture_variance"),
        (F.sum("edges") / n).alias("edge_density"),
        F.sqrt(variance("pattern", F.sum("inner_pixels"))).alias("local_binary_pattern"),
        F.abs(F.avg("top") - F.avg("bottom")).alias("depth_gradient"),
        variance("laplacian").alias("surface_roughness"),
        ((F.sum("blue") / n) / (F.sum("green") / n + 1e-6)).alias("blue_green_ratio"),
    )


FEATURES = [
    "mean_hue",
    "mean_saturation",
    "mean_value",
    "std_hue",
    "std_saturation",
    "std_value",
    "texture_variance",
    "edge_density",
    "local_binary_pattern",
    "depth_gradient",
    "surface_roughness",
    "blue_green_ratio",
    "motion_magnitude",
]


def frame_hashes(frames: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Difference bits of each frame."""
    return _per_frame(
        frames, keys, lambda a: {"image_bits": px.difference_bits(a)}, "image_bits string"
    )


def _light(bgr: np.ndarray) -> dict[str, float]:
    return {
        "clarity": min(float(px.laplacian(px.grey(bgr)).var()) / 1000.0, 1.0),
        "light": float(px.lightness(bgr).mean()) / 255.0,
    }


def clarity_and_light(frames: DataFrame, video: Sequence[str] = ("video_path",)) -> DataFrame:
    """Mean water clarity and light level per video."""
    return (
        _per_frame(frames, video, _light, "clarity double, light double")
        .groupBy(*video)
        .agg(F.avg("clarity").alias("water_clarity"), F.avg("light").alias("light_level"))
    )


def _floor_colour(bgr: np.ndarray) -> dict[str, float]:
    part = bgr[int(bgr.shape[0] * 0.7) :]
    h, s, _ = px.hsv(part)
    return {
        "hue": float(h.mean()),
        "saturation": float(s.mean()),
        "grey_std": float(px.grey(part).std()),
    }


def frame_floor_colours(frames: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Mean hue and saturation and grey deviation of the bottom 30 % of each frame."""
    return _per_frame(frames, keys, _floor_colour, "hue double, saturation double, grey_std double")


# Substrates of the frame vote; the earlier one wins a tie.
VOTE_ORDER = ["sand", "rock", "coral", "seagrass", "unknown"]


def substrate_votes(colours: DataFrame, video: Sequence[str] = ("video_path",)) -> DataFrame:
    """Most voted substrate per video and its share of the frames. Limits are fixed values."""
    hue, sat, std = F.col("hue"), F.col("saturation"), F.col("grey_std")
    vote = (
        F.when((sat < 50) & (std < 30), F.lit("sand"))
        .when((hue > 40) & (hue < 80) & (sat > 80), F.lit("seagrass"))
        .when(std > 60, F.lit("rock"))
        .when((sat > 60) & (hue < 30), F.lit("coral"))
        .otherwise(F.lit("unknown"))
    )
    counts = colours.groupBy(*video, vote.alias("substrate_type")).agg(F.count(F.lit(1)).alias("votes"))
    frames = counts.groupBy(*video).agg(F.sum("votes").alias("frames"))
    place = F.array_position(F.array(*[F.lit(v) for v in VOTE_ORDER]), F.col("substrate_type"))
    return (
        top_rows(counts, video, [F.col("votes").desc(), place.asc()])
        .join(frames, list(video))
        .select(
            *video, "substrate_type", (F.col("votes") / F.col("frames")).alias("substrate_confidence")
        )
    )


def substrate_by_rules(features: DataFrame) -> DataFrame:
    """Substrate and confidence from the features; ``motion_magnitude`` may be null. Limits and confidences are fixed values."""
    sat, val, hue = (F.col(f"mean_{c}") for c in ("saturation", "value", "hue"))
    texture, edge, rough = (F.col(c) for c in ("texture_variance", "edge_density", "surface_roughness"))
    moving = F.coalesce("motion_magnitude", F.lit(0.0))
    rules: list[tuple[Column, Column, float]] = [
        ((sat < 60) & (texture < 500) & (edge < 0.1) & (val < 100), F.lit("muddy_sand"), 0.7),
        ((sat < 60) & (texture < 500) & (edge < 0.1), F.lit("sand"), 0.8),
        ((sat > 80) & (texture > 1000) & (edge > 0.2) & (sat < 100), F.lit("dead_coral"), 0.7),
        ((sat > 80) & (texture > 1000) & (edge > 0.2), F.lit("coral_reef"), 0.75),
        (
            (texture > 800) & (edge > 0.15) & (sat < 70),
            F.when(rough > 2000, F.lit("boulder")).otherwise(F.lit("rock")),
            0.7,
        ),
        ((hue > 40) & (hue < 80) & (sat > 100) & (moving > 2), F.lit("seagrass"), 0.75),
        (
            (hue > 80) & (sat > 120),
            F.when(moving > 3, F.lit("kelp")).otherwise(F.lit("algae")),
            0.65,
        ),
        ((edge > 0.25) & (texture > 600) & (rough > 1500), F.lit("rubble"), 0.6),
    ]
    kind, sure = F.lit("unknown"), F.lit(0.5)
    for test, name, confidence in reversed(rules):
        kind = F.when(test, name).otherwise(kind)
        sure = F.when(test, F.lit(confidence)).otherwise(sure)
    return features.withColumns({"substrate_type": kind, "confidence": sure})


# Substrate names a user may give.
SUBSTRATES = [
    "sand",
    "muddy_sand",
    "coral_reef",
    "dead_coral",
    "rock",
    "boulder",
    "seagrass",
    "kelp",
    "algae",
    "rubble",
    "artificial",
    "mixed",
    "unknown",
]


def choose_substrate(candidates: DataFrame, video: Sequence[str] = ("video_path",)) -> DataFrame:
    """One answer per video from rows (method, substrate_type, confidence).

    A user's known substrate wins with confidence 1; then a model surer than 0.7,
    then the rules, then the location.
    """
    known = F.lower("substrate_type").isin(*SUBSTRATES)
    method = F.col("method")
    usable = (
        ((method == "user_input") & known)
        | ((method == "ml_model") & (F.col("confidence") > 0.7))
        | method.isin("cv_analysis", "database_lookup")
    )
    rank = (
        F.when(method == "user_input", F.lit(4))
        .when(method == "ml_model", F.lit(3))
        .when(method == "cv_analysis", F.lit(2))
        .otherwise(F.lit(1))
    )
    given = F.col("method") == "user_input"
    best = top_rows(
        candidates.filter(usable),
        list(video),
        [rank.desc(), F.col("confidence").desc(), F.col("substrate_type").asc()],
    )
    return best.withColumns(
        {
            "substrate_type": F.when(given, F.lower("substrate_type")).otherwise(F.col("substrate_type")),
            "confidence": F.when(given, F.lit(1.0)).otherwise(F.col("confidence")),
        }
    )


# --- motion ---------------------------------------------------------------


def _small_grey(bgr: np.ndarray) -> dict:
    g = px.grey(bgr)
    if g.shape[0] > 180 or g.shape[1] > 320:
        g = px.area_resize(g, 180, 320)
    return {"small": g.astype(np.uint8).tobytes()}


def motion_scores(frames: DataFrame, video: str = "video_path", index: str = "sample_idx") -> DataFrame:
    """Motion between each sampled frame and the one before.

    Frames shrink to at most 320 x 180 grey bytes first; those are paired by a
    join on the sample number, so a long video spreads over many tasks. The first
    sample of a video has no score.
    """
    small = _per_frame(frames, [video, index], _small_grey, "small binary")
    before = small.select(video, (F.col(index) + 1).alias(index), F.col("small").alias("before"))

    @F.pandas_udf("struct<motion_score: double, mean_difference: double>")
    def score(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        pairs = [
            px.motion(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
            for x, y in zip(a, b, strict=True)
        ]
        return pd.DataFrame(pairs, columns=["motion_score", "mean_difference"], dtype="float64")

    return (
        small.join(before, [video, index])
        .withColumn("m", score("before", "small"))
        .select(video, index, "m.motion_score", "m.mean_difference")
    )


def flow_magnitudes(frames: DataFrame, video: str = "video_path", index: str = "sample_idx") -> DataFrame:
    """Mean length of the motion of grid points (see ``pixels.flow``) from each sampled frame to the next.

    Frames become grey bytes first and are paired by a join on the sample number,
    so a long video spreads over many tasks. A pair whose sizes differ has none.
    """
    plain = _per_frame(
        frames,
        [video, index],
        lambda a: {"height": a.shape[0], "width": a.shape[1], "grey": px.grey(a).astype(np.uint8).tobytes()},
        "height int, width int, grey binary",
    )
    before = plain.select(video, (F.col(index) + 1).alias(index), "height", "width", F.col("grey").alias("before"))

    @F.pandas_udf("double")
    def length(a: pd.Series, b: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        found = np.zeros(len(a))
        for (h, w), at in pd.DataFrame({"h": height, "w": width}).groupby(["h", "w"]).indices.items():
            together = max(1, FLOW_PIXELS // (h * w))
            for part in np.split(at, range(together, len(at), together)):
                old, new = (np.stack([np.frombuffer(x, np.uint8) for x in s.iloc[part]]).reshape(-1, h, w).astype(np.float64) for s in (a, b))
                found[part] = [np.hypot(*moved.T).mean() for moved in px.flows(old, new)]
        return pd.Series(found, dtype="float64")

    # both sides in fixed parts: the pairs are few bytes, but each takes milliseconds
    keys = [video, index, "height", "width"]
    parts = spread(frames.sparkSession)
    return plain.repartition(parts, *keys).join(before.repartition(parts, *keys), keys).select(
        video, index, length("before", "grey", "height", "width").alias("flow")
    )


def motion_magnitude(flows: DataFrame, video: Sequence[str] = ("video_path",)) -> DataFrame:
    """Mean motion per video, in pixels from frame to frame."""
    return flows.groupBy(*video).agg(F.avg("flow").alias("motion_magnitude"))


# --- crops ----------------------------------------------------------------

_BOX = "box_id bigint, xmin int, ymin int, xmax int, ymax int"


def frames_with_boxes(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each frame once with its boxes (box_id, xmin, ymin, xmax, ymax) as an array.

    A frame with very many boxes is repeated for groups of them, so an array
    stays near ``BOXES_TOGETHER`` entries. Spark chooses the join by size.
    """
    sizes = boxes.groupBy(*FRAME).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(BOXES_TOGETHER)).alias("_groups")
    )
    box = F.struct(
        F.col("box_id").cast("bigint").alias("box_id"),
        *[F.col(c).cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")],
    )
    grouped = (
        boxes.join(sizes, FRAME)
        .withColumn("_group", F.pmod(F.xxhash64("box_id"), F.col("_groups")))
        .groupBy(*FRAME, "_group")
        .agg(F.collect_list(box).alias("boxes"))
        .drop("_group")
    )
    return frames.select(*FRAME, *PIXELS).join(grouped, FRAME)


def _cut(image: np.ndarray, box) -> np.ndarray:
    return image[max(box["ymin"], 0) : max(box["ymax"], 0), max(box["xmin"], 0) : max(box["xmax"], 0)]


def _crop_scores(crop: np.ndarray) -> tuple[float, float]:
    if crop.size == 0:
        return 0.0, 0.0
    g = px.grey(crop)
    slope = px.gradient(g)
    blue = min(float(crop[..., 0].astype(np.float64).var()) / 10000.0, 1.0)
    texture = float(px.thin_edges(g).mean()) * 0.5 + float(slope.mean()) / 255.0 * 0.5
    return blue, min(texture, 1.0)


def crop_scores(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Blue variance and texture of every box, keyed by (video_path, frame, box_id)."""
    joined = frames_with_boxes(frames, boxes)
    kind = dict(joined.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                image = px.to_array(r.data, r.height, r.width, r.nChannels)
                for b in r.boxes:
                    rows.append((r.video_path, r.frame, b["box_id"], *_crop_scores(_cut(image, b))))
            yield pd.DataFrame(rows, columns=[*FRAME, "box_id", "blue_variance", "texture"])

    return joined.mapInPandas(
        run,
        f"video_path {kind['video_path']}, frame {kind['frame']}, box_id bigint, "
        "blue_variance double, texture double",
    )


def surface_filter(
    detections: DataFrame, threshold: float = 0.7, penalty: float = 0.5
) -> DataFrame:
    """Lower the confidence of boxes that probably show the water surface.

    Needs ymin, h, depth_m, blue_variance and texture (see :func:`crop_scores`).
    """
    p = surface_probability(
        F.col("ymin"), F.col("h"), F.col("depth_m"), F.col("blue_variance"), F.col("texture")
    )
    return (
        detections.withColumn("surface_probability", p)
        .withColumn("original_confidence", F.col("confidence"))
        .withColumn("surface_filtered", F.col("surface_probability") > threshold)
        .withColumn(
            "confidence",
            F.when(
                F.col("surface_filtered"),
                F.col("confidence") * (F.lit(1.0) - F.col("surface_probability") * penalty),
            ).otherwise(F.col("confidence")),
        )
    )


def crops_of_boxes(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """(video_path, frame, box_id, height, width, crop): the pixels of every box, blue first; ``crop`` may be empty."""
    joined = frames_with_boxes(frames, boxes)
    kind = dict(joined.dtypes)
    names = [*FRAME, "box_id", "height", "width", "crop"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                image = px.to_array(r.data, r.height, r.width, r.nChannels)
                for b in r.boxes:
                    crop = _cut(image, b)
                    rows.append((r.video_path, r.frame, b["box_id"], *crop.shape[:2], crop.tobytes()))
            yield pd.DataFrame(rows, columns=names)

    return joined.mapInPandas(
        run, f"video_path {kind['video_path']}, frame {kind['frame']}, box_id bigint, height int, width int, crop binary"
    )


def classify_crops(
    frames: DataFrame,
    boxes: DataFrame,
    make_model: Callable[[], Callable[[list[np.ndarray]], np.ndarray]],
    classes: Sequence[str],
    least: float = 0.45,
    batch: int = 16,
) -> DataFrame:
    """Species of every box by a model of the user's.

    ``make_model`` runs once per Python worker, however many tasks and Arrow
    batches that worker sees, and returns a function from a list of crops to
    probabilities (crops x classes). An empty crop, and a best probability below
    ``least``, give no species. The first of equal classes wins.
    """

    def make_predict() -> Callable:
        model = make_model()

        def predict(crops: np.ndarray, heights: np.ndarray, widths: np.ndarray) -> np.ndarray:
            shares = np.zeros((len(crops), size))
            whole = np.flatnonzero([len(c) for c in crops])
            if len(whole):
                shaped = [np.frombuffer(crops[k], np.uint8).reshape(heights[k], widths[k], 3) for k in whole]
                shares[whole] = model(shaped)
            return shares

        return predict

    size = len(classes)
    predict = predict_batch_udf(make_predict, return_type=ArrayType(DoubleType()), batch_size=batch)
    scored = crops_of_boxes(frames, boxes).withColumn("shares", predict("crop", "height", "width"))
    best = F.array_max("shares")
    name = F.get(F.array(*[F.lit(c) for c in classes]), F.array_position("shares", best).cast("int") - 1)
    return scored.select(
        *FRAME,
        "box_id",
        F.when((best >= least) & (F.octet_length("crop") > 0), name).alias("species"),
        best.alias("classification_confidence"),
    )


def label_tracks(detections: DataFrame, classified: DataFrame) -> DataFrame:
    """Give every detection of a classified track the track's species.

    ``classified`` has (video_path, track_id, species, classification_confidence),
    one row per track; no species becomes the unclassifiable label.
    """
    result = classified.select(
        "video_path",
        "track_id",
        F.coalesce("species", F.lit(UNCLASSIFIABLE)).alias("_label"),
        "classification_confidence",
    )
    return (
        detections.join(result, ["video_path", "track_id"], "left")
        .withColumn("label", F.coalesce("_label", "label"))
        .drop("_label")
    )
