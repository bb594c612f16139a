import pytest
from pyspark.sql import functions as F

from reefline.functions import clock, names, paths, places, scores
from reefline.operators import inventory, metadata


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0)])
    return df.select(col.alias("x")).first()["x"]


TIMES = [
    (0, "00h:00m:00s:000ms"),
    (1000, "00h:00m:01s:000ms"),
    (61000, "00h:01m:01s:000ms"),
    (3600000, "01h:00m:00s:000ms"),
    (3661000, "01h:01m:01s:000ms"),
    (1, "00h:00m:00s:001ms"),
    (999, "00h:00m:00s:999ms"),
    (86399999, "23h:59m:59s:999ms"),
    (360000000, "100h:00m:00s:000ms"),
]


@pytest.mark.parametrize("ms, text", TIMES)
def test_clock_both_ways(spark, ms, text):
    assert one(spark, clock.ms_to_clock(F.col("v")), v=ms) == text
    assert one(spark, clock.clock_to_ms(F.col("v")), v=text) == ms


@pytest.mark.parametrize(
    "text, seconds",
    [("00h:05m:46s:880ms", 346.88), ("12.5", 12.5), ("", 0.0), ("soon", 0.0), ("1h:2m", 0.0)],
)
def test_clock_to_seconds(spark, text, seconds):
    assert one(spark, clock.clock_to_seconds(F.col("v")), v=text) == seconds


@pytest.mark.parametrize(
    "text, ms",
    [("01:02:03", 3723000), ("02:03.5", 123500), ("7.25", 7250), ("00h:00m:01s:000ms", 0), ("x", 0)],
)
def test_colon_times(spark, text, ms):
    assert one(spark, clock.colon_time_to_ms(F.col("v")), v=text) == ms


@pytest.mark.parametrize(
    "path, key, chapter",
    [
        ("hello/sample.mp4", "hello/sample", "hello"),
        ("sample.mp4", "sample", ""),
        ("a/b.c/d", "a/b.c/d", "a/b.c"),
        ("a/.mp4", "a/.mp4", "a"),
    ],
)
def test_video_key(spark, path, key, chapter):
    assert one(spark, paths.video_key(F.col("v")), v=path) == key
    assert one(spark, paths.video_key(F.col("v"), chapters=True), v=path) == chapter


def test_prefix_and_folders(spark, rows):
    assert one(spark, paths.strip_prefix(F.col("v"), "/in"), v="/in/a/b.mp4") == "a/b.mp4"
    assert one(spark, paths.strip_prefix(F.col("v"), "/in/b.mp4"), v="/in/b.mp4") == ""
    df = paths.with_folder_columns(rows("video_path string", ("a/b/c.mp4",), ("c.mp4",)), 2)
    assert [tuple(r)[1:] for r in df.orderBy("video_path").collect()] == [("a", "b"), (None, None)]


def test_natural_order(rows):
    files = [(f"LG0{n}01.MP4",) for n in range(12, 0, -1)]
    got = [r[0] for r in inventory.natural_order(rows("video_path string", *files)).collect()]
    assert got == [f[0] for f in files[::-1]]
    plain = [(f"test{'x' * n}",) for n in range(10)]
    got = [r[0] for r in inventory.natural_order(rows("video_path string", *plain)).collect()]
    assert got == [f[0] for f in plain]


@pytest.mark.parametrize(
    "name, ok",
    [
        ("video.MP4", True), ("video.mp4", True), ("video.AVI", True), ("video.avi", True),
        ("video", False), ("video.mp4k", False), ("video.kmp4", False), ("kmp4", False), (".v.mp4", False),
    ],
)
def test_video_names(spark, name, ok):
    assert one(spark, inventory.is_video(F.col("v")), v=name) is ok


@pytest.mark.parametrize(
    "path, deployment",
    [("x/BRUV_1/100GO/a.mp4", "BRUV_1_100GO"), ("x/BRUV_1/a.mp4", "BRUV_1_a.mp4"), ("x/y/a.mp4", "y")],
)
def test_deployment(spark, path, deployment):
    assert one(spark, paths.deployment_id(F.col("v")), v=path) == deployment


def test_thumbnail(spark):
    col = paths.thumbnail_name(F.col("s"), F.lit("GH1"), F.lit(7))
    assert one(spark, col, s="BRUV 7") == "BRUV_007_GH1_7.jpg"
    assert one(spark, col, s="BRUV 1234") == "BRUV_1234_GH1_7.jpg"
    assert one(spark, paths.station_folder(F.col("s")), s="BRUV 007") == "BRUV 7"


@pytest.mark.parametrize("c, band", [(0.8, "high"), (0.5, "medium"), (0.4999, "low")])
def test_band(spark, c, band):
    assert one(spark, scores.confidence_band(F.col("v")), v=c) == band


@pytest.mark.parametrize(
    "verdict, group, species, expected",
    [
        ("false", "Teleost", "", "FALSE_teleost"),
        ("TRUE ", "shark", "", "UNKNOWN_shark"),
        ("true", "", "", "UNKNOWN_elasmobranch"),
        ("true", "", "nurse shark", "Ginglymostoma_cirratum"),
        ("true", "sea turtle", "", "UNKNOWN_sea_turtle"),
        ("false", "", "human", "FALSE_human"),
        ("false", "", "A. b", "FALSE_A__b"),
        ("false", "", "", "FALSE_other"),
        ("", "shark", "x", None),
    ],
)
def test_training_class(spark, verdict, group, species, expected):
    col = names.training_class(F.col("v"), F.col("g"), F.col("s"))
    assert one(spark, col, v=verdict, g=group, s=species) == expected


def test_class_from_notes(spark):
    col = names.class_from_notes(F.col("v"), F.col("s"), F.col("n"))
    assert one(spark, col, v="FALSE", s="", n="surface human and chum box") == "FALSE_human"
    assert one(spark, col, v="FALSE", s="", n="rock") == "FALSE_other"
    assert one(spark, col, v="true", s="x", n="") is None


def test_sample_times(spark):
    col = scores.sample_times(F.col("a"), F.col("b"), every_ms=400)
    assert one(spark, col, a=100, b=900) == [100, 500, 900]
    import numpy as np

    for a, b in [(0, 0), (333, 19000), (5, 4017), (10, 95)]:
        length = 2000 if b - a < 100 else b - a
        n = max(min(20, length // 200), 3)
        want = np.linspace(a, b, n).astype(int).tolist()
        assert one(spark, scores.sample_times(F.col("a"), F.col("b")), a=a, b=b) == want


def test_places(spark):
    lat = F.col("v")
    assert [one(spark, places.zone(lat), v=x) for x in (0.0, -30.0, 45.0, -61.0)] == [
        "tropical", "tropical", "temperate", "polar"]
    got = one(spark, places.dms_to_degrees(F.array(*[F.lit(x) for x in (10.0, 30.0, 36.0)]), F.col("v")), v="W")
    assert got == pytest.approx(-10.51)


def test_name_keywords(spark):
    col = metadata.substrate_from_name(F.col("v"))
    assert one(spark, col, v="Rocky_sand.mp4") == "sand"
    assert one(spark, col, v="SeaGrass.mp4") == "seagrass"
    assert one(spark, col, v="deep.mp4") is None


def test_surface_height(spark):
    col = scores.expected_surface_height(F.col("v"))
    assert [one(spark, col, v=x) for x in (0.0, 1.0, 4.0, 9.0, 10.0)] == [0.2, 0.15, 0.1, 0.05, 0.02]


def test_labels_of_measurements(spark):
    assert one(spark, scores.clarity_label(F.col("v")), v=0.0) == "Poor"
    assert one(spark, scores.clarity_label(F.lit(None).cast("double"))) == "Not analysed"
    assert one(spark, scores.light_label(F.col("v")), v=0.71) == "Bright"
