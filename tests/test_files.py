"""File sources and sinks, and incremental runs."""

import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reefline import schemas
from reefline.operators import review
from reefline.operators import training
from reefline.sources import tables
from reefline.streaming import incremental


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="spark-"))


HEADER = "video_path,video_name,frame,time,xmin,ymin,xmax,ymax,w,h,confidence,label,track_metadata,track_id"


def test_detections_with_different_folder_depths(spark, folder):
    for run, extra, row in (
        ("r1", ",folder1", "a/G.MP4,G.MP4,3,00h:00m:01s:000ms,1.5,2,3,4,1920,1080,0.5,elasmobranch,x/0,0,a"),
        ("r2", ",folder1,folder2", "a/b/G.MP4,G.MP4,4,00h:00m:02s:000ms,1,2,3,4,1920,1080,bad,elasmobranch,y/0,0,a,b"),
    ):
        (folder / run).mkdir()
        (folder / run / "output.csv").write_text(f"{HEADER}{extra}\n{row}\n")
    got = tables.consolidate(spark, f"{folder}/*/output.csv").orderBy("frame").collect()
    assert [(r.frame, r.xmin, r.confidence, r.folder1, r.folder2) for r in got] == [(3, 1.5, 0.5, "a", None), (4, 1.0, None, "a", "b")]
    assert len({r.source_file for r in got}) == 2
    one = tables.read_detections(spark, str(folder / "r1" / "output.csv"))
    assert dict(one.dtypes)["track_id"] == "bigint" and one.count() == 1


def test_appending_adds_rows(spark, folder, rows):
    path = str(folder / "raw")
    for k in (1, 2):
        tables.append_table(rows("video_path string, tracks_found bigint", (f"v{k}", k)), path, "csv")
    assert {tuple(r) for r in tables.read_overview(spark, path).collect()} == {("v1", 1), ("v2", 2)}


def _validation(path, track, verdict, species="x"):
    head = ",".join(schemas.VALIDATION_COLUMNS)
    path.write_text(f'{head}\n"t.jpg","c","BRUV 1","GH1","{track}","","","","0.5","{verdict}"," shark ","{species} ",""\n')


def test_best_validation_file(spark, folder):
    _validation(folder / "validation_results_2024-01-01.csv", 1, "true")
    _validation(folder / "validation_results_2024-02-01.csv", 2, " TRUE")
    assert [(r.track_id, r.true_detection, r.taxon_group, r.time_seconds, r.species) for r in tables.read_validation(spark, str(folder)).collect()] == [
        (2, "true", "shark", 0.0, "x")]
    _validation(folder / "validation_results.csv", 3, "false")
    assert tables.read_validation(spark, str(folder)).first().track_id == 3
    _validation(folder / "validation_results_TG.csv", 4, "false")
    assert tables.read_validation(spark, str(folder)).first().track_id == 4


def test_reviewers_are_merged(spark, folder):
    _validation(folder / "validation_results_2024-01-01.csv", 1, "true", "old")
    _validation(folder / "validation_results_2024-02-01.csv", 1, "true", "new")
    merged = review.merge_reviewers(tables.read_all_reviews(spark, str(folder))).first()
    assert (merged.species, merged.reviews, merged.conflict) == ("new", 2, True)
    _validation(folder / "validation_results_TG.csv", 1, "false", "new")
    merged = review.merge_reviewers(tables.read_all_reviews(spark, str(folder))).first()
    assert (merged.true_detection, merged.reviews) == ("false", 3)


def test_labels_in_file_names(spark, folder):
    for name in ("12.jpg", "13-a-b.jpg", "x.jpg", "14-c.jpg", "14-d.jpg"):
        (folder / name).write_bytes(b"x")
    got = {r.name: (r.track_id, r.human_label, r.problem) for r in tables.read_label_names(spark, str(folder)).collect()}
    assert got == {
        "12.jpg": (12, None, None), "13-a-b.jpg": (13, "a-b", None), "x.jpg": (None, None, "name"),
        "14-c.jpg": (14, "c", "conflict"), "14-d.jpg": (14, "d", "conflict")}
    (folder / "sub").mkdir()
    (folder / "sub" / "12.jpg").write_bytes(b"x")
    twice = tables.read_label_names(spark, str(folder)).filter("name = '12.jpg'").collect()
    assert [r.problem for r in twice] == ["duplicate"]


def test_video_listing(spark, folder):
    (folder / "a").mkdir()
    (folder / "a" / "G.MP4").write_bytes(b"1234")
    assert [tuple(r) for r in tables.read_video_files(spark, str(folder)).collect()] == [("a/G.MP4", 4)]


def png(path, height, width, rgb):
    path.write_bytes(tables.png(bytes(rgb[::-1]) * (height * width), height, width, 3))


def test_frames_are_blue_first(spark, folder):
    (folder / "s" / "G.MP4").mkdir(parents=True)
    png(folder / "s" / "G.MP4" / "17.png", 2, 3, (10, 20, 30))
    r = tables.read_frames(spark, str(folder)).first()
    assert (r.video_path, r.frame, r.height, r.width, r.nChannels) == ("s/G.MP4", 17, 2, 3, 3)
    assert list(bytes(r.data)[:3]) == [30, 20, 10]


def test_frames_come_back_from_their_files(spark, folder):
    pixels = {k: bytes((k * 7 + i * i) % 256 for i in range(190 * 330 * c)) for k, c in ((3, 3), (4, 1))}
    rows = [("a b/G.MP4", k, 190, 330, len(d) // (190 * 330), bytearray(d)) for k, d in pixels.items()]
    frames = spark.createDataFrame(rows, "video_path string, frame bigint, height int, width int, nChannels int, data binary")
    assert tables.write_frames(frames, str(folder)) == 2 == tables.write_frames(frames, f"file://{folder}")
    back = {r.frame: r for r in tables.read_frames(spark, str(folder)).collect()}
    assert {k: bytes(r.data) for k, r in back.items()} == pixels
    assert [(r.height, r.width, r.nChannels) for _, r in sorted(back.items())] == [(190, 330, 3), (190, 330, 1)]


def test_user_metadata(spark, folder):
    (folder / "m.csv").write_text("video,site_name\n/card/G1.MP4,A\n")
    assert [tuple(r) for r in tables.read_user_metadata(spark, str(folder / "m.csv")).collect()] == [("G1.MP4", "A")]
    (folder / "bad.csv").write_text("name,site\nx,y\n")
    with pytest.raises(ValueError):
        tables.read_user_metadata(spark, str(folder / "bad.csv"))
    (folder / "m.json").write_text(json.dumps({"site": "A", "depth": 3.5}, indent=2))
    assert tables.read_metadata_json(spark, str(folder / "m.json")).first().asDict() == {"site": "A", "depth": 3.5}
    (folder / "m.txt").write_text("Site: A\nTime: 10:30\nnothing\nSite: B\n")
    assert tables.read_metadata_text(spark, str(folder / "m.txt")).first().metadata == {"Time": "10:30", "Site": "B"}
    (folder / "f.md").write_text("---\nsite: A\n---\nOther: x\n")
    assert tables.read_metadata_text(spark, str(folder / "f.md")).first().metadata == {"site": "A"}


def test_sinks(spark, folder, rows):
    df = rows("k string, xs array<bigint>, m map<string,double>", ("a", [1, 2], {"x": 0.5}))
    tables.write_table(df, str(folder / "csv"), "csv")
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(folder / "csv")).collect()] == [
        ("a", "[1,2]", '{"x":0.5}')]
    tables.write_table(df, str(folder / "pq"), partition_by=["k"])
    assert (folder / "pq" / "k=a").is_dir()
    tables.write_table(df, str(folder / "js"), "json")
    assert spark.read.json(str(folder / "js")).first().xs == [1, 2]
    with pytest.raises(ValueError):
        tables.write_table(df, str(folder / "x"), "xlsx")
    classes = training.class_index(rows("class string", ("b",), ("a",), ("b",)))
    tables.write_class_mapping(classes, str(folder / "map"))
    assert sorted(r[0] for r in spark.read.text(str(folder / "map")).collect()) == ["0\ta", "1\tb"]


# --- incremental runs -----------------------------------------------------


def test_files_are_processed_once(spark, folder, rows):
    source, sink, progress = (str(folder / n) for n in ("in", "out", "cp"))

    def run():
        stream = incremental.new_files(spark, source, schemas.OVERVIEW, files_per_batch=1)
        incremental.process_new_results(stream, sink, progress, lambda d: d.filter("tracks_found > 0"))
        return sorted(r.video_path for r in spark.read.parquet(sink).collect())

    rows("video_path string, tracks_found bigint", ("a", 1), ("z", 0)).coalesce(1).write.parquet(source)
    rows("video_path string, tracks_found bigint", ("b", 1)).coalesce(1).write.mode("append").parquet(source)
    assert run() == ["a", "b"]
    assert run() == ["a", "b"]
    rows("video_path string, tracks_found bigint", ("c", 1)).coalesce(1).write.mode("append").parquet(source)
    assert run() == ["a", "b", "c"]


def test_history_grows_over_runs(spark, folder, rows):
    source, state, progress = (str(folder / n) for n in ("in", "state", "cp"))
    schema = "collection string, bruv_station string, video_id string, track_id bigint, time_ms bigint, confidence double, true_detection string, species string"

    def run(*data):
        rows(schema, *data).coalesce(1).write.mode("append").parquet(source)
        stream = incremental.new_files(spark, source, rows(schema, data[0]).schema)
        incremental.update_history_state(stream, state, progress)
        return {r.track_id: (r.suggested_species, r.outcome) for r in incremental.read_history_state(spark, state).collect()}

    voter = ("c", "s", "v", 1, 0, 0.9, "true", "x")
    assert run(voter, ("c", "s", "v", 2, 10, 0.5, "", "")) == {2: ("x", "pending")}
    later = run(voter, ("c", "s", "v", 2, 10, 0.5, "true", "y"), ("c", "s", "v", 3, 20, 0.5, "", ""))
    assert later[2] == ("x", "incorrect")
    assert set(later) == {2, 3}
    # only what a batch adds or changes is written
    assert {(r.batch, r.track_id) for r in incremental.read_history_changes(spark, state).collect()} == {(0, 2), (1, 2), (1, 3)}
    # two exports in one batch: the shared track counts once
    last = run(("c", "s", "v", 3, 20, 0.5, "true", "x"), ("c", "s", "v", 3, 20, 0.5, "", ""))
    assert last[3][1] == "correct" and len(last) == 2
    assert incremental.read_history_state(spark, state).count() == 2
    # a verdict that comes late; an open row or a run without news changes nothing
    assert run(("c", "s", "v", 2, 10, 0.5, "FALSE ", ""))[2] == ("x", "incorrect_fp")
    assert run(("c", "s", "v", 2, 10, 0.5, "", ""))[2] == ("x", "incorrect_fp")
    assert {(r.batch, r.track_id) for r in incremental.read_history_changes(spark, state).collect()} == {(0, 2), (1, 2), (1, 3), (2, 3), (3, 2)}


def test_a_batch_reads_and_saves_only_the_tracks_it_names(spark, folder, rows):
    source, state, progress = (str(folder / n) for n in ("in", "state", "cp"))
    schema = "collection string, bruv_station string, video_id string, track_id bigint, time_ms bigint, confidence double, true_detection string, species string"

    def run(*data):
        rows(schema, *data).coalesce(1).write.mode("append").parquet(source)
        incremental.update_history_state(incremental.new_files(spark, source, rows(schema, data[0]).schema), state, progress)

    run(("c", "s", "v", 0, 0, 0.9, "true", "x"), *[("c", "s", "v", k, 10, 0.5, "", "") for k in range(1, 400)])
    for n in (5, 6, 7):
        run(("c", "s", "v", n, 10, 0.5, "true", "x"))
    said = spark.read.parquet(f"{state}/events").groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in said} == {0: 400, 1: 1, 2: 1, 3: 1}
    changed = incremental.read_history_changes(spark, state).groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in changed} == {0: 399, 1: 1, 2: 1, 3: 1}
    history = incremental.read_history_state(spark, state)
    assert history.groupBy("outcome").count().collect() and history.filter("outcome = 'correct'").count() == 3


def write_text(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_files_with_other_column_orders_are_read_by_name(spark, tmp_path):
    write_text(tmp_path / "a" / "output.csv", "video_path,frame,confidence\nv1,1,0.5\n")
    write_text(tmp_path / "b" / "output.csv", '"frame","confidence","video_path"\n2,0.25,v2\n')
    write_text(tmp_path / "c" / "output.csv", "confidence,extra,frame\n0.75,x,3\n")
    write_text(tmp_path / "d" / "output.csv", "")
    for rows in (
        tables.consolidate(spark, f"{tmp_path}/*/output.csv").collect(),
        tables.read_detections(spark, f"{tmp_path}/*/output.csv").collect(),
    ):
        assert {(r.video_path, r.frame, r.confidence, r.extra) for r in rows} == {
            ("v1", 1, 0.5, None), ("v2", 2, 0.25, None), (None, 3, 0.75, "x"),
        }
    write_text(tmp_path / "e" / "output.csv", "1,2,3\n4,5,6\n")
    with pytest.raises(ValueError, match="no known column"):
        tables.consolidate(spark, f"{tmp_path}/*/output.csv")


def test_line_breaks_commas_and_quotes_in_notes(spark, tmp_path):
    """As other programs write them: one file by hand, one by Python's csv module."""
    import csv

    note = 'first line\r\nsecond, line with "quotes"\n\nlast'
    head = ["collection", "bruv_station", "video_id", "track_id", "true_detection", "species", "notes"]
    for name, track in (("validation_results_TG.csv", "1"), ("validation_results_2024.csv", "2")):
        path = tmp_path / "reviews" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("w", newline="") as f:
            csv.writer(f).writerows([head, ["c", "s", "v", track, "true", "x", note], ["c", "s", "v", "9", "", "", ""]])
    folder, note = str(tmp_path / "reviews"), note.replace("\r\n", "\n")  # where lines end so, text has plain line breaks
    assert [(r.track_id, r.notes) for r in tables.read_validation(spark, folder).collect()] == [(1, note), (9, "")]
    assert sorted((r.track_id, r.notes) for r in tables.read_all_reviews(spark, folder).collect()) == [(1, note), (2, note), (9, ""), (9, "")]
    write_text(tmp_path / "meta" / "m.csv", 'video_filename,notes\na.MP4,"one\ntwo, three"\nb.MP4,\n')
    rows = tables.read_user_metadata(spark, str(tmp_path / "meta")).collect()
    assert [(r.video_filename, r.notes) for r in rows] == [("a.MP4", "one\ntwo, three"), ("b.MP4", None)]
    write_text(tmp_path / "wide" / "a.csv", '"video_path","odd\nname",frame\nv,x,1\n')
    write_text(tmp_path / "wide" / "b.csv", '"video_path","odd\nname",confidence\nw,y,0.5\n')
    wide = tables.read_detections(spark, str(tmp_path / "wide")).collect()
    assert {(r.video_path, r["odd\nname"], r.frame, r.confidence) for r in wide} == {("v", "x", 1, None), ("w", "y", None, 0.5)}


def test_a_run_that_is_appended_again_replaces_its_rows(spark, tmp_path, rows):
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        for run, found in (("a+b %", 1), ("c", 2), ("a+b %", 3)):
            tables.append_run(rows("video_path string, tracks_found bigint", (f"v{found}", found), ("w", None)), path, run, fmt)
        tables.append_run(rows("tracks_found bigint", (4,)), path, "d", fmt)
        got = {tuple(r) for r in tables.read_runs(spark, path, schemas.OVERVIEW, fmt).select("run", "video_path", "tracks_found").collect()}
        assert got == {("a+b %", "v3", 3), ("a+b %", "w", None), ("c", "v2", 2), ("c", "w", None), ("d", None, 4)}


def test_more_header_forms_than_any_limit(spark, tmp_path):
    for k in range(120):
        write_text(tmp_path / f"r{k}" / "output.csv", f"video_path,depth_{k}\nv{k},{k}\n")
    got = tables.consolidate(spark, f"{tmp_path}/*/output.csv")
    assert got.select("video_path").distinct().count() == 120 == got.count()


def test_reviews_with_other_column_orders(spark, tmp_path):
    write_text(tmp_path / "validation_results_2024-01-01.csv", "collection,station,video_name,track_id,species,true_detection\nc,s,v,1,Tiger,true\n")
    write_text(tmp_path / "validation_results_TG.csv", "true_detection,track_id,video_name,station,collection,species\nfalse,2,v,s,c,\n")
    got = {r.track_id: (r.collection, r.true_detection) for r in tables.read_all_reviews(spark, str(tmp_path)).collect()}
    assert got == {1: ("c", "true"), 2: ("c", "false")}


def test_empty_files_are_listed(spark, tmp_path):
    write_text(tmp_path / "x" / "13-b.jpg", "")
    write_text(tmp_path / "x" / "14-a b%c.jpg", "12")
    got = {r.path.rsplit("/", 1)[1]: r.length for r in tables.list_files(spark, str(tmp_path), "*jpg").collect()}
    assert got == {"13-b.jpg": 0, "14-a b%c.jpg": 2}
    assert {r.track_id for r in tables.read_label_names(spark, str(tmp_path)).collect()} == {13, 14}


def test_history_is_kept_without_python_rows(spark, rows):
    events = spark.createDataFrame([], incremental.EVENTS).selectExpr("*", "0L AS batch")
    plan = incremental.keep_history(events)._jdf.queryExecution().toString()
    assert "Aggregate" in plan and "Python" not in plan and "Pandas" not in plan


def test_a_verdict_counts_from_the_suggestion_on(spark, folder, rows):
    source, state, progress = (str(folder / n) for n in ("in", "state", "cp"))
    schema = "collection string, bruv_station string, video_id string, track_id bigint, time_ms bigint, confidence double, true_detection string, species string"

    def run(*data):
        rows(schema, *data).coalesce(1).write.mode("append").parquet(source)
        incremental.update_history_state(incremental.new_files(spark, source, rows(schema, data[0]).schema), state, progress)
        return [(r.track_id, r.outcome, r.validated_species, r.validated_as_true) for r in incremental.read_history_state(spark, state).collect()]

    voter = ("c", "s", "v", 1, 0, 0.9, "true", "x")
    assert run(("c", "s", "v", 2, 10, 0.5, "false", "")) == []
    assert run(voter, ("c", "s", "v", 2, 10, 0.5, "", "")) == [(2, "pending", None, None)]
    assert run(("c", "s", "v", 2, 10, 0.5, "true", "X ")) == [(2, "correct", "X", True)]
    assert {(r.batch, r.track_id) for r in incremental.read_history_changes(spark, state).collect()} == {(1, 2), (2, 2)}


def test_text_files_are_written_in_place(spark, folder):
    texts = spark.range(300).selectExpr("concat(id % 7, '/', id, '.txt') AS path", "concat('a: ', id, chr(10), 'b: é') AS value")
    assert tables.write_texts(texts.repartition(3), str(folder / "t")) == 300
    found = tables.read_metadata_text(spark, f"{folder}/t/*").selectExpr("source_file", "metadata['a'] AS a", "metadata['b'] AS b").collect()
    assert sorted(int(r.a) for r in found) == list(range(300)) and {r.b for r in found} == {"é"}
    assert all(r.source_file.endswith(f"/{int(r.a) % 7}/{r.a}.txt") for r in found)


def test_csv_files_hold_a_bounded_number_of_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "CSV_ROWS", 10)
    for k, write in enumerate((lambda d, p: tables.append_table(d, p, "csv"), lambda d, p: tables.write_table(d, p, "csv"))):
        path = f"{folder}/{k}"
        write(spark.range(35).coalesce(1).selectExpr("id AS frame", "'v' AS video_path"), path)
        assert len(tables.list_files(spark, path, "*.csv").collect()) == 4
        assert sorted(r.frame for r in tables.read_detections(spark, path).collect()) == list(range(35))
