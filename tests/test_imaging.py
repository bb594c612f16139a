"""Pixel functions against plain loops, and the image operators."""

import hashlib
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reefline.functions import pixels as px
from reefline.operators import dedup
from reefline.operators import imaging as im
from reefline.operators import substrate_model as sm

RNG = np.random.default_rng(0)
SCHEMA = "video_path string, frame bigint, height int, width int, nChannels int, data binary"


def image(h=12, w=16):
    return RNG.integers(0, 256, (h, w, 3)).astype(np.uint8)


def frames_of(spark, *images):
    return spark.createDataFrame(
        [(v, k, a.shape[0], a.shape[1], 3, bytearray(a.tobytes())) for v, k, a in images], SCHEMA
    )


def test_hsv_of_known_colours():
    bgr = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [128, 128, 128], [0, 0, 0]]], np.uint8)
    h, s, v = px.hsv(bgr)
    assert h.tolist() == [[0, 60, 120, 0, 0]]
    assert s.tolist() == [[255, 255, 255, 0, 0]]
    assert v.tolist() == [[255, 255, 255, 128, 0]]


def test_lightness_and_grey_ends():
    ends = np.array([[[0, 0, 0], [255, 255, 255]]], np.uint8)
    assert px.lightness(ends).tolist() == [[0, 255]]
    assert px.grey(ends).tolist() == [[0, 255]]


def test_filters_against_loops():
    g = px.grey(image())
    p = np.pad(g, 1, mode="reflect")
    lap, grad = px.laplacian(g), px.gradient(g)
    pattern = px.neighbour_pattern(g)
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    for y, x in [(0, 0), (3, 5), (11, 15), (0, 7)]:
        win = p[y : y + 3, x : x + 3]
        assert lap[y, x] == win[0, 1] + win[2, 1] + win[1, 0] + win[1, 2] - 4 * win[1, 1]
        assert grad[y, x] == pytest.approx(np.hypot((win * kx).sum(), (win * kx.T).sum()))
    win = g[4:7, 8:11]
    assert pattern[4, 8] == (win >= win[1, 1]).sum() - 1


def test_area_resize_is_a_mean():
    a = image(16, 18).astype(float)
    small = px.area_resize(a, 8, 9)
    assert small[2, 3].tolist() == np.rint(a[4:6, 6:8].mean(axis=(0, 1))).tolist()
    assert px.area_resize(image(5, 7), 8, 9).shape == (8, 9, 3)


@pytest.mark.parametrize("shape, target", [((190, 330), (180, 320)), ((7, 11), (3, 4)), ((5, 5), (8, 9))])
def test_area_resize_by_parts_of_pixels(shape, target):
    a = RNG.integers(0, 256, shape).astype(float)
    sy, sx = shape[0] / target[0], shape[1] / target[1]
    got = px.area_resize(a, *target)
    for i, j in [(0, 0), (1, 2), (target[0] - 1, target[1] - 1)]:
        total = 0.0
        for y in range(shape[0]):
            for x in range(shape[1]):
                tall = max(0.0, min(y + 1, (i + 1) * sy) - max(y, i * sy))
                wide = max(0.0, min(x + 1, (j + 1) * sx) - max(x, j * sx))
                total += a[y, x] * tall * wide
        assert abs(got[i, j] - total / (sy * sx)) <= 0.5 + 1e-6


def test_motion_of_frames_that_are_shrunk(spark):
    a, b = image(190, 330), image(190, 330)
    small = [px.area_resize(px.grey(x), 180, 320).astype(np.uint8).astype(float) for x in (a, b)]
    gap = np.abs(small[1] - small[0])
    got = im.motion_scores(frames_of(spark, ("v", 0, a), ("v", 1, b)).withColumnRenamed("frame", "sample_idx")).first()
    assert got.motion_score == pytest.approx((gap > 25).mean() * 0.6 + gap.mean() / 255 * 0.3 + gap.max() / 255 * 0.1)


def test_features_of_all_pixels_together(spark):
    a, b = image(20, 16), image(20, 16)
    got = im.substrate_features(frames_of(spark, ("v", 0, a), ("v", 1, b))).first()
    parts = [x[12:] for x in (a, b)]
    h, s, v = (np.concatenate([px.hsv(p)[k].ravel() for p in parts]) for k in range(3))
    g = np.concatenate([px.grey(p).ravel() for p in parts])
    both = np.concatenate([p.reshape(-1, 3) for p in parts]).astype(float)
    assert got.mean_hue == pytest.approx(h.mean()) and got.std_hue == pytest.approx(h.std())
    assert got.mean_saturation == pytest.approx(s.mean()) and got.std_value == pytest.approx(v.std())
    assert got.texture_variance == pytest.approx(g.var())
    assert got.blue_green_ratio == pytest.approx(both[:, 0].mean() / (both[:, 1].mean() + 1e-6))
    lap = np.concatenate([px.laplacian(px.grey(p)).ravel() for p in parts])
    assert got.surface_roughness == pytest.approx(lap.var())


def test_clarity_and_light(spark):
    flat, a = np.full((6, 6, 3), 255, np.uint8), image(6, 6)
    got = im.clarity_and_light(frames_of(spark, ("v", 0, flat), ("v", 1, a))).first()
    assert got.water_clarity == pytest.approx((0 + min(px.laplacian(px.grey(a)).var() / 1000, 1)) / 2)
    assert got.light_level == pytest.approx((1 + px.lightness(a).mean() / 255) / 2)


def test_motion(spark):
    a, b = np.zeros((4, 5, 3), np.uint8), np.zeros((4, 5, 3), np.uint8)
    b[0, 0] = 255
    df = frames_of(spark, ("v", 0, a), ("v", 1, b), ("w", 0, a)).withColumnRenamed("frame", "sample_idx")
    got = im.motion_scores(df).collect()
    assert [(r.video_path, r.sample_idx) for r in got] == [("v", 1)]
    assert got[0].motion_score == pytest.approx(0.6 / 20 + 0.3 / 20 + 0.1)
    big = frames_of(spark, ("v", 0, image(200, 340)), ("v", 1, image(200, 340))).withColumnRenamed("frame", "sample_idx")
    assert 0 < im.motion_scores(big).first().motion_score < 1


def test_hash_and_duplicates(spark):
    a = image(16, 18)
    df = im.frame_hashes(frames_of(spark, ("v", 0, a), ("v", 1, a), ("w", 0, a))).withColumns(
        {c: F.lit(x) for c, x in zip(("xmin", "ymin", "xmax", "ymax"), (1.9, 2.0, 3.0, 4.0), strict=True)}
    )
    kept = dedup.first_of_duplicates(df, F.col("image_bits"), [F.col("frame").asc()]).collect()
    assert sorted((r.video_path, r.frame) for r in kept) == [("v", 0), ("w", 0)]
    bits = px.difference_bits(a)
    assert kept[0].detection_hash == hashlib.md5(f"{bits}_1_2_3_4".encode()).hexdigest()


def test_near_duplicates_against_pairs(spark):
    data = [("v", int(x), int(y), int(x) + 5, int(y) + 5, i) for i, (x, y) in enumerate(RNG.integers(-6, 12, (60, 2)))]
    df = spark.createDataFrame(data, "video_path string, xmin int, ymin int, xmax int, ymax int, seen bigint")
    got = {(r.xmin, r.ymin): r.duplicate for r in dedup.near_duplicates(df, "seen").collect()}
    first = {}
    for _, x, y, _, _, i in data:
        first.setdefault((x, y), i)
    want = {k: any(abs(k[0] - o[0]) <= 2 and abs(k[1] - o[1]) <= 2 and j < i for o, j in first.items()) for k, i in first.items()}
    assert got == want


def boxes_of(spark):
    return spark.createDataFrame(
        [("v", 0, 1, 0, 0, 4, 4), ("v", 0, 2, 5, 5, 5, 9), ("v", 0, 3, 10, 8, 99, 99)],
        "video_path string, frame bigint, box_id bigint, xmin int, ymin int, xmax int, ymax int",
    )


def test_crop_scores(spark):
    a = image()
    got = {r.box_id: r for r in im.crop_scores(frames_of(spark, ("v", 0, a)), boxes_of(spark)).collect()}
    assert got[1].blue_variance == pytest.approx(min(a[:4, :4, 0].astype(float).var() / 10000, 1))
    assert (got[2].blue_variance, got[2].texture) == (0.0, 0.0)
    assert got[3].blue_variance == pytest.approx(min(a[8:, 10:, 0].astype(float).var() / 10000, 1))


def test_crop_classes_reach_the_tracks(spark):
    def make_model():
        def score(crops):
            return np.array([[0.9, 0.1] if c.shape[:2] == (4, 4) else [0.4, 0.44] for c in crops])

        return score

    found = im.classify_crops(frames_of(spark, ("v", 0, image())), boxes_of(spark), make_model, ["x", "y"])
    got = {r.box_id: (r.species, round(r.classification_confidence, 3)) for r in found.collect()}
    assert got == {1: ("x", 0.9), 2: (None, 0.0), 3: (None, 0.44)}
    detections = spark.createDataFrame([("v", 1, "e"), ("v", 1, "e"), ("v", 3, "e"), ("v", 7, "e")], "video_path string, track_id bigint, label string")
    tracks = found.withColumnRenamed("box_id", "track_id")
    labels = sorted((r.track_id, r.label) for r in im.label_tracks(detections, tracks).collect())
    assert labels == [(1, "x"), (1, "x"), (3, "ESU"), (7, "e")]


def test_a_worker_loads_the_model_once(spark, tmp_path):
    loads = str(tmp_path)

    def make_model():
        import os
        import uuid

        open(f"{loads}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda crops: np.array([[c.mean() / 255, 1 - c.mean() / 255] for c in crops])

    df = frames_of(spark, *[("v", k, np.full((4, 4, 3), k, np.uint8)) for k in range(60)]).repartition(12)
    boxes = df.select("video_path", "frame", F.col("frame").alias("box_id"), F.lit(0).alias("xmin"), F.lit(0).alias("ymin"), F.lit(4).alias("xmax"), F.lit(4).alias("ymax"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        found = im.classify_crops(df, boxes, make_model, ["pale", "dark"], least=0.8, batch=16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.box_id: (r.species, r.classification_confidence) for r in found} == {
        k: ("dark" if 1 - k / 255 >= 0.8 else None, max(k / 255, 1 - k / 255)) for k in range(60)}
    workers = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert 0 < len(workers) == len(set(workers)) < 30  # of 12 tasks or more and 30 batches


def edges_by_hand(g, weak=50, strong=150):
    """Pixel by pixel, chains by a stack."""
    h, w = g.shape

    def value(y, x):
        return g[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]

    slopes = {}
    for y in range(h):
        for x in range(w):
            dx = sum(k * (value(y + d, x + 1) - value(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            dy = sum(k * (value(y + 1, x + d) - value(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            slopes[y, x] = (dx, dy, abs(dx) + abs(dy))

    def peak(y, x):
        dx, dy, m = slopes[y, x]

        def size(v, u):
            return slopes.get((y + v, x + u), (0, 0, 0))[2]

        if abs(dy) < abs(dx) * np.tan(np.pi / 8):
            return m > size(0, -1) and m >= size(0, 1)
        if abs(dy) > abs(dx) * np.tan(3 * np.pi / 8):
            return m > size(-1, 0) and m >= size(1, 0)
        s = -1 if (dx < 0) != (dy < 0) else 1
        return m > size(-1, -s) and m > size(1, s)

    some = {p for p in slopes if slopes[p][2] > weak and peak(*p)}
    stack = [p for p in some if slopes[p][2] > strong]
    out = set(stack)
    while stack:
        y, x = stack.pop()
        for q in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if q in some and q not in out:
                out.add(q)
                stack.append(q)
    return out


def test_thin_edges():
    step = np.zeros((10, 12))
    step[:, 6:] = 200
    assert np.argwhere(px.thin_edges(step)).tolist() == [[y, 5] for y in range(10)]  # one pixel wide
    assert not px.thin_edges(step / 20).any()
    fading = np.zeros((12, 12))
    fading[:, 6:] = np.linspace(20, 60, 12)[:, None]  # weak at one end, strong at the other
    assert px.thin_edges(fading).sum() == 12 and not px.thin_edges(fading, strong=300).any()
    rng = np.random.default_rng(4)
    for shape in ((20, 30), (1, 9), (2, 2), (17, 3)):
        for scale in (20, 60, 255):
            g = np.rint(rng.random(shape) * scale)
            assert {tuple(p) for p in np.argwhere(px.thin_edges(g)).tolist()} == edges_by_hand(g)


def scene(dy, dx, height=200, width=260):
    y, x = np.mgrid[0:height, 0:width].astype(float)
    y, x = y - dy, x - dx
    return np.rint(128 + 40 * np.sin(x / 9 + 1) * np.cos(y / 7) + 30 * np.sin((x + 2 * y) / 13) + 20 * np.cos((x - y) / 5))


@pytest.mark.parametrize("shift", [(0, 0), (3, -2), (0.5, 1.25), (12, 9), (-8, 11)])
def test_flow_finds_the_shift(shift):
    found = px.flow(scene(0, 0), scene(*shift)).reshape(10, 13, 2)[2:-2, 2:-2].reshape(-1, 2)
    assert (np.abs(found - np.array(shift)).max(axis=1) < 0.1).mean() > 0.95


def test_flow_of_plain_and_small_frames():
    assert not px.flow(np.zeros((100, 100)), np.full((100, 100), 9.0)).any()
    assert px.flow(np.zeros((3, 4)), np.zeros((3, 4))).shape == (1, 2)


def test_motion_magnitude(spark):
    moves = [(0, 0), (3, 4), (3, 4), (6, 8)]
    rows = [("v", k, np.repeat(scene(*m, 120, 160).astype(np.uint8)[:, :, None], 3, axis=2)) for k, m in enumerate(moves)]
    df = frames_of(spark, *rows, ("w", 0, rows[0][2]), ("w", 1, rows[0][2][:50])).withColumnRenamed("frame", "sample_idx")
    flows = im.flow_magnitudes(df)
    got = {(r.video_path, r.sample_idx): r.flow for r in flows.collect()}
    assert set(got) == {("v", 1), ("v", 2), ("v", 3)}  # frames of two sizes have no flow
    assert abs(got["v", 1] - 5) < 0.5 and got["v", 2] == 0 and abs(got["v", 3] - 5) < 0.5
    assert abs(im.motion_magnitude(flows).first().motion_magnitude - 10 / 3) < 0.4


def test_surface_filter(spark):
    df = spark.createDataFrame([(0.0, 100, 0.0, 1.0, 1.0, 0.8), (90.0, 100, 20.0, 0.0, 0.0, 0.8)], "ymin double, h int, depth_m double, blue_variance double, texture double, confidence double")
    got = im.surface_filter(df).orderBy("ymin").collect()
    assert got[0].surface_probability == pytest.approx(0.3 + 0.0 + 0.25 + 0.2)
    assert got[0].surface_filtered and got[0].confidence == pytest.approx(0.8 * (1 - 0.75 * 0.5))
    assert not got[1].surface_filtered and got[1].confidence == 0.8 and got[1].original_confidence == 0.8


def test_votes_and_choice(spark):
    colours = spark.createDataFrame([("v", 0, 10.0, 10.0, 5.0), ("v", 1, 50.0, 90.0, 40.0), ("w", 0, 10.0, 70.0, 40.0)], "video_path string, frame bigint, hue double, saturation double, grey_std double")
    got = {r.video_path: (r.substrate_type, r.substrate_confidence) for r in im.substrate_votes(colours).collect()}
    assert got == {"v": ("sand", 0.5), "w": ("coral", 1.0)}
    rows = [("v", "user_input", "Rock", 0.2), ("v", "cv_analysis", "sand", 0.8), ("w", "user_input", "lava", 0.2), ("w", "ml_model", "kelp", 0.71), ("w", "cv_analysis", "sand", 0.8), ("x", "ml_model", "kelp", 0.7), ("x", "database_lookup", "rock", 0.9), ("x", "cv_analysis", "sand", 0.5)]
    df = spark.createDataFrame(rows, "video_path string, method string, substrate_type string, confidence double")
    got = {r.video_path: (r.method, r.substrate_type, r.confidence) for r in im.choose_substrate(df).collect()}
    assert got == {"v": ("user_input", "rock", 1.0), "w": ("ml_model", "kelp", 0.71), "x": ("cv_analysis", "sand", 0.5)}


def test_forest_learns_a_simple_rule(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.random((200, len(im.FEATURES))), columns=im.FEATURES)
    pdf["label"] = np.where(pdf.mean_hue > 0.5, "sand", "rock")
    pdf["id"] = range(len(pdf))
    rows = sm.split(spark.createDataFrame(pdf), "id")
    model = sm.train(rows.filter("NOT is_test"), trees=10, depth=4)
    report = sm.report(model, rows.filter("is_test")).collect()
    assert {r.label for r in report} == {"sand", "rock"} and report[0].accuracy > 0.85
    with pytest.raises(ValueError):
        sm.train(rows.limit(3), trees=1)


def test_flows_of_many_pairs_are_those_of_each():
    frames = [scene(k, 2 * k) for k in range(5)]
    together = px.flows(np.stack(frames[:-1]), np.stack(frames[1:]))
    assert together.shape == (4, 130, 2)
    for k, moved in enumerate(together):
        assert np.array_equal(moved, px.flow(frames[k], frames[k + 1]))


def test_large_frames_shrink_one_axis_at_a_time_and_halves_round_to_even():
    start = time.perf_counter()
    for _ in range(20):
        px.difference_bits(image(320, 360))
    assert (time.perf_counter() - start) / 20 < 0.03
    a = np.array([[0, 1, 2, 3, 4, 5]] * 3, np.uint8)
    assert px.area_resize(a, 1, 3).tolist() == [[0, 2, 4]]


def test_large_frames_are_made_in_many_tasks(spark):
    from reefline.catalogue.pictures import frames
    from reefline.session import spread

    assert frames(spark, "/root/testdata/sf0.001", enlarge=2).rdd.getNumPartitions() >= spread(spark)
