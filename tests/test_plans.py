"""End-to-end jobs on small inputs."""

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reefline import schemas
from reefline.plans import detection_run as dr
from reefline.plans import reports
from reefline.sources import tables

BOXES = "video_path string, frame bigint, time string, xmin double, ymin double, xmax double, ymax double, w int, h int, confidence double, label string, track_id bigint"


def moving(video, track, frames, conf=0.9):
    return [(video, k, f"00h:00m:0{k}s:000ms", 10.0 * k, 5.0, 10.0 * k + 8, 9.0, 100, 100, conf, "elasmobranch", track) for k in frames]


def boxes_of(rows):
    data = moving("/in/a/1.mp4", 4, range(4)) + moving("/in/a/1.mp4", 9, range(1), 0.3) + moving("/in/b/2.mp4", 2, range(3)) + moving("/in/b/2.mp4", 3, [2])
    return rows(BOXES, *data)


def test_a_run_and_its_continuation(rows, spark):
    boxes = boxes_of(rows)
    run = dr.detection_run(boxes, "/in", fps=3, folder_depth=1)
    assert {(r.video_path, r.tracks_found) for r in run.overview.collect()} == {("a/1.mp4", 1), ("b/2.mp4", 2)}
    assert {(r.video_path, r.folder1, r.track_id) for r in run.detections.collect()} == {("a/1.mp4", "a", 0), ("b/2.mp4", "b", 1), ("b/2.mp4", "b", 2)}
    assert run.best.count() == 3
    done = rows("video_path string, tracks_found bigint", ("a/1.mp4", 7))
    rest = dr.continue_run(boxes, done, "/in", fps=3)
    assert sorted({r.track_id for r in rest.detections.collect()}) == [7, 8]
    periods = rows("video_path string, start_frame bigint, end_frame bigint", ("a/1.mp4", 1, 3), ("b/2.mp4", 0, 9))
    kept = dr.detection_run(boxes, "/in", fps=3, periods=periods).detections
    assert kept.filter("video_path = 'a/1.mp4'").agg(F.min("frame")).first()[0] == 1
    folder = tempfile.mkdtemp(prefix="spark-")
    dr.save_run(run, folder)
    dr.save_run(rest, folder)
    assert spark.read.parquet(f"{folder}/overview").count() == 3


def test_maxn_report(rows, spark):
    run = dr.detection_run(boxes_of(rows), "/in", fps=3)
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    for name in ("0-nurse.jpg", "1.jpg", "2-ESU.jpg"):
        (folder / name).write_bytes(b"x")
    table, sure = reports.maxn_report(run.detections, tables.read_label_names(spark, str(folder)))
    assert [(r.video_path, r.label, r.n, r.frame) for r in table.collect()] == [
        ("a/1.mp4", "nurse", 1, 0), ("b/2.mp4", "ESU", 1, 2), ("b/2.mp4", "elasmobranch", 1, 0)]
    assert sure.first()[0] == pytest.approx(2 / 3)
    (folder / "bad.jpg").write_bytes(b"x")
    with pytest.raises(ValueError):
        reports.maxn_report(run.detections, tables.read_label_names(spark, str(folder)))


def test_suggestions_from_files(rows, spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    head = ",".join(schemas.VALIDATION_COLUMNS)
    lines = [f'"t{k}.jpg","c","BRUV 1","GH1","{k}","","{s}","","0.8","{v}","shark","{sp}",""' for k, s, v, sp in ((1, 1.5, "true", "x"), (2, 3, "", ""), (3, 500, "", ""))]
    (folder / "validation_results.csv").write_text("\n".join([head, *lines]) + "\n")
    empty = spark.createDataFrame([], schemas.HISTORY)
    update = reports.suggestion_update(tables.read_validation(spark, str(folder)), empty)
    got = {r.track_id: (r.status, r.suggested_species) for r in update["predictions"].collect()}
    assert got == {1: ("validated", None), 2: ("suggested", "x"), 3: ("unvalidated", None)}
    assert update["accuracy"].first().pending == 1
    reports.save_suggestions(update, str(folder), "run1")
    saved = spark.read.json(str(folder / "run1" / "predictions"))
    assert {r.key for r in saved.collect()} == {"c|BRUV 1|GH1|1", "c|BRUV 1|GH1|2", "c|BRUV 1|GH1|3"}


def test_thumbnails_and_training(rows, spark):
    tracks = rows(
        "collection string, bruv_station string, video_id string, track_id bigint, frame bigint, time string, time_ms bigint, confidence double, xmin double, ymin double, xmax double, ymax double, w int, h int, video_name string, video_path string",
        ("s", "BRUV 007", "GH1", 3, 1, "00h:00m:01s:500ms", 1500, 0.4, 10.0, 10.0, 20.0, 20.0, 100, 100, "GH1.MP4", "p"),
        ("s", "BRUV 007", "GH1", 3, 2, "00h:00m:02s:000ms", 2000, 0.9, 11.0, 10.0, 20.0, 20.0, 100, 100, "GH1.MP4", "p"),
    )
    t = reports.thumbnail_table(tracks, {"s": "/data"}).first()
    assert (t.thumbnail, t.frame, t.time_seconds, t.video_path) == ("BRUV_007_GH1_3.jpg", 2, 2.0, "/data/BRUV 7/GH1.MP4")
    checked = rows(
        "collection string, bruv_station string, video_id string, track_id bigint, true_detection string, taxon_group string, species string, thumbnail string",
        ("s", "BRUV 007", "GH1", 3, "true", "shark", "G. cirratum", "a.jpg"))
    made = reports.training_set(checked, tracks, schemas.TRACK_KEY)
    assert made["classes"].first()["class"] == "Ginglymostoma_cirratum"
    first = made["manifest"].orderBy("frame_no").first()
    assert (first.image_name, first.frame_ms, first.crop_x1) == ("G_cirratum/GH1.MP4_track0003_frame000.jpg", 1500, 10)


def test_metadata_of_a_folder(rows, spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    (folder / "v" / "a").mkdir(parents=True)
    (folder / "v" / "a" / "G1.MP4").write_bytes(b"x")
    (folder / "v" / "notes.txt").write_bytes(b"x")
    (folder / "user.csv").write_text("filename,site_name\nG1.MP4,A\n")
    maxn = rows("video_path string, video_name string, label string, n bigint", ("a/G1.MP4", "G1.MP4", "x", 2))
    got = reports.combined_metadata(spark, str(folder / "v"), str(folder / "user.csv"), maxn=maxn, labels=["x", "y"])
    assert [r.asDict() for r in got.collect()] == [
        {"video_filename": "G1.MP4", "video_path": "a/G1.MP4", "site_name": "A", "maxn_total": 2, "maxn_x": 2, "maxn_y": 0, "species_richness": 1}]
    assert tables.file_checksums(spark, str(folder / "v")).first().checksum == "9dd4e461268c8034f5c8564e155c67a6"
