"""Hand-worked cases of the table operators."""

import itertools
import os
import random
import subprocess
import sys
from math import floor

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from oracle import differences
from pyspark import cloudpickle
from pyspark.sql import functions as F

from reefline.catalogue import REGISTRY
from reefline.functions import forms
from reefline.operators import dedup, history, inventory, lookup, maxn, metadata, ranking, review, stability, suggest, tracks, training

BOX = "video_path string, video_name string, frame bigint, time string, track_id bigint, label string"


def plain(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_maxn_of_one_video(rows):
    path = "2020_RS_004/100GOPRO/GH044053.MP4"
    # Detections of one published video.
    found = [
        (732, "02:26:40", 0), (733, "02:26:60", 0), (734, "02:26:80", 0), (737, "02:27:40", 0), (738, "02:27:60", 0),
        (2481, "08:16:20", 1), (2483, "08:16:60", 1), (2484, "08:16:80", 1), (2532, "08:26:40", 2), (2533, "08:26:60", 2),
    ]
    df = rows(BOX, *[(path, "GH044053.MP4", f, t, k, "elasmobranch") for f, t, k in found])
    want = (path, "GH044053.MP4", 732, "elasmobranch", "02:26:40", 1, [0])
    columns = ["video_path", "video_name", "frame", "label", "time", "n", "tracks_in_maxn"]
    assert plain(maxn.maxn_by_video(df).select(*columns)) == [want]
    assert plain(maxn.maxn_by_chapter(df).select(*columns)) == [want]


def test_maxn_tie_and_repeats(rows):
    df = rows(
        BOX,
        ("v", "v", 5, "t5", 1, "a"), ("v", "v", 5, "t5", 2, "a"), ("v", "v", 3, "t3", 1, "a"), ("v", "v", 3, "t3", 1, "a"),
        ("v", "v", 9, "t9", 4, None),
    )
    got = plain(maxn.maxn_by_video(df).select("label", "frame", "n", "tracks_in_maxn"), "label")
    assert got == [(None, 9, 1, [4]), ("a", 3, 2, [1, 1])]
    distinct = maxn.distinct_track_maxn(df, F.col("label"), "label", ["video_path"])
    assert plain(distinct) == [("v", "a", 2)]
    assert maxn.maxn_by_video(df.limit(0)).count() == 0


def test_chapters_group_by_folder(rows):
    df = rows(
        BOX + ", folder1 string",
        ("s/1", "1", 1, "t", 1, "a", "s"), ("s/2", "2", 1, "t", 1, "a", "s"), ("s/2", "2", 1, "t", 2, "a", "s"), ("x/1", "1", 1, "t", 1, "a", "x"),
    )
    got = plain(maxn.maxn_by_chapter(df).select("folder1", "video_path", "n"), "folder1")
    assert got == [("s", "s/2", 2), ("x", "x/1", 1)]


def test_labels(rows):
    df = rows(BOX, ("v", "v", 1, "t", 1, "model"), ("v", "v", 1, "t", 2, "model"), ("v", "v", 1, "t", 3, "model"))
    labels = rows("video_path string, track_id bigint, human_label string", ("v", 1, ""), ("v", 2, "b"))
    got = plain(maxn.apply_human_labels(df, labels).select("track_id", "label"), "track_id")
    assert got == [(1, "model"), (2, "b")]
    kept = rows("human_label string", ("a",), ("ESU",), (None,), ("b",))
    assert maxn.label_confidence(kept).first()[0] == 0.75


def test_wide_maxn_without_given_labels(rows):
    df = rows("video_path string, label string, n bigint", ("v", "C. perezi", 2), ("v", "x", 1), ("w", "x", 3))
    got = maxn.maxn_wide(df).orderBy("video_path").collect()
    assert [r.asDict() for r in got] == [
        {"video_path": "v", "maxn_C__perezi": 2, "maxn_x": 1, "maxn_total": 3, "species_richness": 2},
        {"video_path": "w", "maxn_C__perezi": 0, "maxn_x": 3, "maxn_total": 3, "species_richness": 1},
    ]


DET = "video_path string, track_id bigint, frame bigint, xmin double, ymin double, xmax double, ymax double, w int, h int, confidence double"


def test_false_positive_rule(rows):
    def track(k, life, dx, conf):
        return [("v", k, i, dx * 100 * i / max(life - 1, 1), 0.0, 10.0 + dx * 100 * i / max(life - 1, 1), 10.0, 100, 100, conf) for i in range(life)]

    data = track(1, 2, 0.5, 0.69) + track(2, 2, 0.5, 0.70) + track(3, 3, 0.08, 0.1) + track(4, 3, 0.07, 0.69) + track(5, 3, 0.0, 0.9)
    kept = tracks.drop_false_positives(rows(DET, *data), fps=3)
    assert sorted({r.track_id for r in kept.collect()}) == [2, 3, 5]
    ids = plain(tracks.renumber_tracks(kept.select("video_path", "track_id").distinct()).select("track_id", "new_track_id"), "track_id")
    assert ids == [(2, 0), (3, 1), (5, 2)]


def test_offsets_are_running_totals(rows):
    df = rows("video_path string, track_id bigint", ("a", 5), ("a", 9), ("b", 1), ("c", 1), ("c", 70000), ("c", 2))
    assert plain(tracks.track_offsets(df), "video_path") == [("a", 2, 0), ("b", 1, 2), ("c", 3, 3)]
    ids = plain(tracks.global_track_ids(df, df), "track_id")
    assert [r[1] for r in ids] == list(range(6))


def test_middle_detection(rows):
    data = [("v", 1, f, 1.0, 1.0, 2.0, 2.0, 9, 9, 0.5) for f in (1, 5000, 5001, 9000)] + [("v", 2, 3, 1.0, 1.0, 2.0, 2.0, 9, 9, 0.5)]
    got = plain(tracks.middle_detections(rows(DET, *data)).select("track_id", "frame", "detections"), "track_id")
    assert got == [(1, 5001, 4), (2, 3, 1)]


@pytest.mark.parametrize("whole", [0, 6, 65_536])
def test_middle_of_short_and_long_tracks(rows, whole):
    rng = random.Random(13)
    data = [
        (rng.choice(["v", "w", None]), rng.choice([1, 2, None]), rng.choice([None, 0, 1, 2, 4095, 4096, 9000]), float(i), 1.0, 2.0, 2.0, 9, 9, 0.5)
        for i in rng.sample(range(500), 90)
    ] + [("x", 1, 7, 1.0, 1.0, 2.0, 2.0, 9, 9, 0.5)]
    groups = {}
    for r in sorted(data, key=lambda r: (r[2] is not None, r[2] or 0, r[3])):
        groups.setdefault(r[:2], []).append(r)
    want = {k: (g[len(g) // 2][2:4], len(g), min(r[3] for r in g)) for k, g in groups.items()}
    over = {"least": F.min("xmin")}
    got = tracks.middle_detections(rows(DET, *data), over=over, whole=whole).collect()
    assert len(got) == len(want)
    assert {(r.video_path, r.track_id): ((r.frame, r.xmin), r.detections, r.least) for r in got} == want


def test_a_track_keeps_its_middle_in_a_frame_without_number(rows):
    df = rows(DET, *[("v", 1, f, x, 1.0, 2.0, 2.0, 9, 9, 0.5) for f, x in ((None, 1.0), (None, 2.0), (5, 3.0))])
    assert plain(tracks.middle_detections(df).select("frame", "xmin", "detections")) == [(None, 2.0, 3)]


@pytest.mark.parametrize("whole", [0, 6, 65_536])
def test_middle_with_missing_frames_and_ties_last(rows, whole):
    rng = random.Random(14)
    data = [
        ("v", rng.choice([1, 2, 3]), rng.choice([None, None, 0, 4096]), rng.choice([None, float(i)]), float(i), 2.0, 2.0, 9, 9, 0.5)
        for i in range(60)
    ]
    groups = {}
    for r in sorted(data, key=lambda r: (r[2] is None, r[2] or 0, r[3] is None, r[3] or 0, r[4])):
        groups.setdefault(r[1], []).append(r)
    want = {k: (g[len(g) // 2][2:5], len(g)) for k, g in groups.items()}
    got = tracks.middle_detections(rows(DET, *data), whole=whole, nulls_last=True).collect()
    assert {r.track_id: ((r.frame, r.xmin, r.ymin), r.detections) for r in got} == want


@pytest.mark.parametrize("name", ["track_windows", "frame_manifest", "middle_detections"])
def test_missing_parts_and_negative_tracks_as_in_sql(spark, tmp_path, name):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumns(
        {
            "l_orderkey": F.when(F.col("l_suppkey") % 2 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")),
            "l_partkey": F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey")),
            "l_linenumber": F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")),
        }
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    query = REGISTRY[name]
    assert differences(query.run(spark, str(tmp_path)), con, query.sql) == []


@pytest.mark.parametrize("name", ["track_windows", "frame_manifest"])
def test_windows_read_the_detections_three_times(spark, name):
    """For the best rows, for the long tracks, and for the window."""
    df = REGISTRY[name].run(spark, "/root/testdata/sf0.001")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= 3
    assert "Scan ExistingRDD" not in final


def test_overview_and_resume(rows):
    found = rows("video_path string, track_id bigint", ("a", 1), ("a", 2), ("a", 2))
    table = tracks.overview(found, rows("video_path string", ("a",), ("b",)))
    assert plain(table, "video_path") == [("a", 2), ("b", 0)]
    assert plain(tracks.run_totals(table)) == [(2, 2)]
    assert plain(tracks.run_totals(table.limit(0))) == [(0, 0)]


# --- ranking --------------------------------------------------------------


@pytest.mark.parametrize("partitions", ["1", "4", "200"])
def test_ranking_does_not_depend_on_partitions(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = random.Random(3)
        data = [(rng.choice("aaaab"), rng.randrange(10**6), rng.randrange(50)) for _ in range(500)]
        df = rows("g string, k bigint, v bigint", *data)
        got = ranking.bucketed_index(df.distinct(), ["g"], F.floor(F.col("k") / 1000), [F.col("k"), F.col("v")], "i").collect()
        want = {}
        for g in "ab":
            for i, (k, v) in enumerate(sorted({(k, v) for x, k, v in data if x == g})):
                want[(g, k, v)] = i
        assert {(r.g, r.k, r.v): r.i for r in got} == want
        total = ranking.running_total(df.distinct(), ["g", "k", "v"], "v", "before").orderBy("g", "k", "v").collect()
        seen = 0
        for r in total:
            assert r.before == seen
            seen += r.v
        for size in (1, 2, 7, 500):
            part = df.limit(size)
            values = sorted(r.v for r in part.collect())
            assert ranking.exact_median(part, "v", 7.0).first()[0] == np.median(values)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# --- stability ------------------------------------------------------------


def reference_period(scores, threshold, least, rate=1):
    w = min(5, len(scores))
    calm = np.convolve(scores, np.ones(w) / w, mode="same") < threshold
    best, start = None, None
    for i, c in enumerate([*calm, False]):
        if c and start is None:
            start = i
        elif not c and start is not None:
            if (i - start) * rate >= least and (best is None or i - start > best[1] - best[0] + 1):
                best = (start, i - 1)
            start = None
    if best:
        return (*best, False)
    margin = int(len(scores) * 0.1)
    return margin, (len(scores) - margin if margin else len(scores) - 1), True


def test_smoothing(rows):
    cases = {2: [0.5, 1.5], 4: [0.75, 1.5, 2.5, 2.25], 6: [1.2, 2, 3, 4, 3.6, 3]}
    first = {2: [1.0, 2.0], 4: [1.0, 2.0, 3.0, 4.0], 6: [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]}
    data = [(str(n), i, x) for n, xs in first.items() for i, x in enumerate(xs)]
    got = stability.smoothed(rows("video_path string, sample_idx bigint, motion_score double", *data), chunk=2)
    for n, want in cases.items():
        mine = [r.smoothed for r in got.filter(F.col("video_path") == str(n)).orderBy("sample_idx").collect()]
        assert mine == pytest.approx(np.convolve(first[n], np.ones(min(5, n)) / min(5, n), "same").tolist())
        if n < 6:
            assert mine == pytest.approx(want)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_stable_periods_against_a_loop(rows, chunk):
    rng = np.random.default_rng(1)
    videos = {f"v{n}": rng.random(n) * rng.choice([0.2, 0.5, 1.0]) for n in (1, 2, 3, 4, 5, 9, 10, 40, 77)}
    videos["calm"] = np.zeros(50)
    videos["two"] = np.array([0.0] * 12 + [9.0] * 12 + [0.0] * 12)
    data = [(v, i, float(x)) for v, xs in videos.items() for i, x in enumerate(xs)]
    df = rows("video_path string, sample_idx bigint, motion_score double", *data)
    got = {r.video_path: (r.start_idx, r.end_idx, r.fallback) for r in stability.stable_periods(df, 0.2, 4, chunk=chunk).collect()}
    assert got == {v: reference_period(xs, 0.2, 4) for v, xs in videos.items()}


# --- suggestions ----------------------------------------------------------

VAL = "collection string, bruv_station string, video_id string, track_id bigint, time_ms bigint, confidence double, true_detection string, species string"


def loop_votes(data, window):
    out = {}
    for c, b, v, t, at, conf, td, sp in data:
        if td.strip():
            continue
        votes = {}
        for c2, b2, v2, t2, at2, conf2, td2, sp2 in data:
            if (c2, b2, v2) == (c, b, v) and t2 != t and td2.strip().lower() == "true" and sp2.strip() and abs(at2 - at) <= window:
                n, w = votes.get(sp2.strip(), (0, 0.0))
                votes[sp2.strip()] = (n + 1, w + (1 - abs(at2 - at) / window) * conf2)
        for sp, (n, w) in votes.items():
            out[(c, b, v, t, at, sp)] = (n, round(w, 6))
    return out


def test_votes_against_pairs(rows):
    rng = random.Random(7)
    window = 1000
    data = []
    for i in range(400):
        hot = rng.random() < 0.4
        video = "hot" if hot else rng.choice(["b", "c"])
        at = rng.choice([0, 500, 1000, 1500, 2000, rng.randrange(6000)])
        td = rng.choice(["", "true", " TRUE", "false"])
        data.append(("c", "s", video, rng.randrange(60), at, rng.randrange(1000) / 1000, td, rng.choice(["x", "y", " z ", ""])))
    data = list({(d[2], d[3], d[4], d[6].strip().lower(), d[7].strip()): d for d in data}.values())
    got = {
        (r.collection, r.bruv_station, r.video_id, r.track_id, r.time_ms, r.species): (r.n, round(r.weight, 6))
        for r in suggest.species_votes(rows(VAL, *data), window).collect()
    }
    want = loop_votes(data, window)
    assert set(got) == set(want)
    for k, (n, w) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(w, abs=2e-6)


def test_vote_at_the_edge_and_own_track(rows):
    df = rows(
        VAL,
        ("c", "s", "v", 1, 0, 0.9, "", ""),
        ("c", "s", "v", 2, 120_000, 0.9, "true", "x"),
        ("c", "s", "w", 1, 0, 0.9, "", ""),
        ("c", "s", "w", 1, 10, 0.9, "true", "x"),
    )
    got = {r.video_id: r for r in suggest.predictions(df).filter("status <> 'validated'").collect()}
    assert (got["v"].suggested_species, got["v"].species_proportion, got["v"].alternatives) == ("x", 0.0, {"x": 0.0})
    assert got["w"].status == "unvalidated" and got["w"].suggestion_confidence == 0.0


def test_history_keeps_the_first_suggestion(rows):
    key = "collection string, bruv_station string, video_id string, track_id bigint"
    old = rows(
        key + ", suggested_species string, suggestion_confidence double, outcome string, validated_species string, validated_as_true boolean",
        *[("c", "s", "v", k, "A", 0.5, "pending", None, None) for k in (1, 2, 3, 4)],
    )
    new = rows(
        key + ", status string, suggested_species string, suggestion_confidence double",
        ("c", "s", "v", 1, "suggested", "B", 0.9), ("c", "s", "v", 9, "suggested", "B", 0.9),
    )
    checked = rows(
        key + ", true_detection string, species string",
        ("c", "s", "v", 1, "true", "a"), ("c", "s", "v", 2, "true", ""), ("c", "s", "v", 3, "false", "x"), ("c", "s", "v", 4, "true", "Z"),
    )
    done = history.update_history(old, new, checked)
    got = plain(done.select("track_id", "suggested_species", "outcome"), "track_id")
    assert got == [(1, "A", "correct"), (2, "A", "pending"), (3, "A", "incorrect_fp"), (4, "A", "incorrect"), (9, "B", "pending")]
    assert history.accuracy(done).first().asDict() == {
        "total_suggestions_made": 5, "correct": 1, "incorrect": 2, "pending": 1, "accuracy_percent": 33.3}
    assert plain(history.confusion(done), "actual") == [("A", "FALSE_POSITIVE", 1), ("A", "Z", 1)]


# --- review ---------------------------------------------------------------


def test_review_filters_and_orders(rows):
    key = "collection string, bruv_station string, video_id string, track_id bigint"
    df = rows(
        key + ", confidence double, true_detection boolean, taxon_group string, species string, has_suggestion boolean",
        ("c", "B 2", "v", 1, 0.9, True, "shark", "Zebra", False), ("c", "B 1", "v", 2, 0.6, False, "debris", "", False),
        ("d", "B 1", "v", 3, 0.3, None, None, None, True), ("d", "B 1", "v", 4, 0.85, True, "", "apex", False),
    )
    ids = lambda d: [r.track_id for r in d.collect()]
    assert ids(review.review_order(df, "species-asc")) == [4, 2, 1, 3]
    assert ids(review.review_order(df, "confidence-asc")) == [3, 2, 4, 1]
    assert ids(review.review_order(review.review_filter(df, status="true", taxon_group=review.BLANK))) == [4]
    assert ids(review.review_filter(df, status="suggested")) == [3]
    assert sorted(ids(review.review_filter(df, species=review.BLANK))) == [2, 3]
    assert plain(review.review_stats(df)) == [(4, 3, 2, 1, 66.7, 75.0)]
    assert {(r.taxon_group, r.tracks) for r in review.taxon_facet(df).collect()} == {("shark", 1), ("debris", 1), (None, 1)}


# --- lookups --------------------------------------------------------------


@pytest.mark.parametrize("levels", [50, 1])
@pytest.mark.parametrize("leaf", [128, 1, 20])
def test_band_lookup_in_a_crowded_cell(rows, levels, leaf, monkeypatch):
    monkeypatch.setattr(lookup, "LEAF_ROWS", leaf)
    rng = random.Random(5)
    cand = [(rng.random() * 0.03, rng.random() * 0.03, rng.choice(["a", "b"]), rng.randrange(levels) / 50, 1000 * 86400, float(i)) for i in range(600)]
    points = [(rng.random() * 0.05 - 0.01, rng.random() * 0.05 - 0.01) for _ in range(120)]
    got = lookup.nearby_best(
        rows("lat double, lon double", *points),
        rows("lat double, lon double, source string, confidence double, timestamp bigint, depth double", *cand),
        ["depth"], 1010 * 86400,
    ).collect()
    def spread(c):
        return (floor(c[0] * 1e7) * 7919 + floor(c[1] * 1e7) * 104729) % 1000003

    want = {}
    for lat, lon in points:
        for s in "ab":
            near = [c for c in cand if c[2] == s and abs(c[0] - lat) < 0.01 and abs(c[1] - lon) < 0.01]
            if near:
                want[(lat, lon, s)] = min(near, key=lambda c: (-c[3], -spread(c), c[0], c[1]))[5]
    assert {(r.lat, r.lon, r.source): r.depth for r in got} == want


def test_band_lookup_where_confidence_follows_the_place(rows, monkeypatch):
    monkeypatch.setattr(lookup, "LEAF_ROWS", 4)
    rng = random.Random(8)
    cand = [(rng.random() * 0.03, rng.random() * 0.03, "a", 0.0, 1000 * 86400, 0.0) for _ in range(500)]
    cand = [(lat, lon, s, lat + lon / 1000, t, lat) for lat, lon, s, _, t, _ in cand]
    points = [(rng.random() * 0.03, rng.random() * 0.03) for _ in range(150)]
    got = lookup.nearby_best(
        rows("lat double, lon double", *points),
        rows("lat double, lon double, source string, confidence double, timestamp bigint, depth double", *cand),
        ["depth"], 1010 * 86400,
    ).collect()
    want = {}
    for lat, lon in points:
        near = [c for c in cand if abs(c[0] - lat) < 0.01 and abs(c[1] - lon) < 0.01]
        if near:
            want[lat, lon] = max(near, key=lambda c: c[3])[5]
    assert {(r.lat, r.lon): r.depth for r in got} == want


def test_a_species_list_of_any_length(rows):
    lists = {"shark": [f"species number {k}" for k in range(6_000)], "ray": ["Manta"]}
    df = rows("species string, taxon_group string", ("species numbr 5999", "shark"), ("species number 17", "ray"), (None, "ray"))
    got = {(r.match, r.distance, r.scope) for r in lookup.match_species(df, lists).collect()}
    assert got == {("species number 5999", 1, "group"), ("species number 17", 0, "all"), (None, None, None)}


@pytest.mark.parametrize("window", [100, 7])
def test_votes_against_pairs(rows, window):
    """Bucket borders, window ends, tracks reviewed in one row and open in another, rows that repeat, null times."""
    rng = random.Random(window)
    made = [
        (rng.choice(["v", "w", None]), rng.randrange(12), rng.choice([None, *range(0, 500, 10)] if window == 100 else list(range(0, 60))), rng.random(),
         rng.choice(["true", "True ", "false", "", None]), rng.choice(["x", "y", "z ", ""]))
        for _ in range(150)
    ]
    made += made[:5]
    table = rows("video_id string, track_id bigint, time_ms bigint, confidence double, true_detection string, species string", *made)
    want = {}
    for v, t, x, _, verdict, _ in made:
        for v2, t2, x2, c, verdict2, sp in made:
            if (verdict or "").strip() or (verdict2 or "").strip().lower() != "true" or not sp.strip() or v != v2 or t == t2 or x is None or x2 is None:
                continue
            if abs(x - x2) <= window:
                n, weight = want.get((v, t, x, sp.strip()), (0, 0.0))
                want[v, t, x, sp.strip()] = (n + 1, weight + (1 - abs(x - x2) / window) * c)
    seen = {}  # rows that repeat were counted each time
    for key in {(v, t, x) for v, t, x, _, verdict, _ in made if not (verdict or "").strip()}:
        times = sum((v, t, x) == key and not (verdict or "").strip() for v, t, x, _, verdict, _ in made)
        seen.update({k: (n // times, w / times) for k, (n, w) in want.items() if k[:3] == key})
    got = {(r.video_id, r.track_id, r.time_ms, r.species): (r.n, r.weight) for r in suggest.species_votes(table, window, ["video_id"]).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in seen.items()}
    assert all(abs(w - seen[k][1]) < 1e-8 for k, (_, w) in got.items())


def test_every_row_has_one_prediction(rows):
    table = rows(
        "video_id string, track_id bigint, time_ms bigint, confidence double, true_detection string, species string",
        ("v", 1, 0, 0.5, "true", "x"), ("v", 2, 5, 0.5, "", ""), ("v", 2, 5, 0.5, "", ""), ("v", 3, None, 0.5, "", ""), ("v", 4, 900, 0.2, "", ""),
        (None, 5, 0, None, None, None), ("v", 6, 1, 0.1, None, None))
    got = sorted((r.track_id, r.status, r.suggested_species) for r in suggest.predictions(table, 100, ["video_id"]).collect())
    assert got == [(1, "validated", None), (2, "suggested", "x"), (2, "suggested", "x"), (3, "unvalidated", None), (4, "unvalidated", None), (5, "unvalidated", None), (6, "suggested", "x")]
    strong = suggest.predictions(table, 100, ["video_id"], least_confidence=0.3).filter("status = 'suggested'")
    assert [r.track_id for r in strong.collect()] == [2, 2]


def test_species_of_short_long_and_crowded_names(rows):
    rng = random.Random(9)

    def edited(name):
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(name) + 1)
            name = rng.choice([name[:k] + name[k + 1 :], name[:k] + "q" + name[k:], name[:k] + "z" + name[k + 1 :]])
        return name

    names = ["".join(rng.choices("ab", k=8)) for _ in range(40)] + ["ab", "c", "ba"] + ["".join(rng.choices("abc", k=n)) for n in (39, 40, 41, 42, 60)]
    listed = [(rng.choice(["shark", "ray"]), n, k) for k, n in enumerate(names)]
    typed = [(edited(rng.choice(names)), rng.choice(["shark", "ray", None])) for _ in range(120)] + [("x" * 3000, "ray")]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def want(text, group):
        near = [(g == group, distance(text, n), k, n) for g, n, k in listed if abs(len(n) - len(text)) <= 3]
        near = sorted((not own, d, k, n) for own, d, k, n in near if d <= 3)
        return (near[0][3], near[0][1], "all" if near[0][0] else "group") if near and text else (None, None, None)

    got = lookup.match_species(rows("species string, taxon_group string", *typed), rows("group string, name string, position int", *listed))
    assert {(r.species, r.taxon_group): (r.match, r.distance, r.scope) for r in got.collect()} == {t: want(*t) for t in typed}


def test_the_work_of_a_lookup_does_not_grow_with_names_of_one_length(spark, rows):
    listed = spark.range(3000).selectExpr("'shark' as `group`", "substr(md5(cast(id as string)), 1, 12) as name", "id as position")
    typed = listed.limit(20).selectExpr("concat(name, 'x') as species", "`group` as taxon_group")
    words = typed.selectExpr("species as _low")
    names = listed.selectExpr("name as _name_low")
    for most in (2000, 3000):
        forms = lookup.deletion_forms(names.limit(most), "_name_low", 3).join(lookup.deletion_forms(words, "_low", 3), "_form")
        assert forms.select("_low", "_name_low").distinct().count() == 20
    assert {(r.distance, r.scope) for r in lookup.match_species(typed, listed).collect()} == {(1, "group")}


def test_a_track_with_two_verdicts_has_one_history_row(rows):
    key = "collection string, bruv_station string, video_id string, track_id bigint"
    predicted = rows(f"{key}, suggested_species string, suggestion_confidence double, status string", *[("c", "s", "v", 1, "Tiger", 0.9, "suggested")] * 2)
    empty = rows(f"{key}, suggested_species string, suggestion_confidence double, outcome string, validated_species string, validated_as_true boolean")
    verdicts = rows(f"{key}, true_detection string, species string, precedence int", ("c", "s", "v", 1, "true", "Tiger", 1), ("c", "s", "v", 1, "false", "", 2))
    for table, want in ((verdicts, "correct"), (verdicts.withColumn("precedence", -F.col("precedence")), "incorrect_fp")):
        assert [r.outcome for r in history.update_history(empty, predicted, table).collect()] == [want]


def test_old_rows_are_not_found(rows):
    cand = rows("lat double, lon double, source string, confidence double, timestamp bigint", (0.0, 0.0, "a", 1.0, 0))
    assert lookup.nearby_best(rows("lat double, lon double", (0.0, 0.0)), cand, [], 31 * 86400).count() == 0


def test_species_names(rows):
    lists = {"shark": ["Carcharhinus perezi", "Tiger"], "ray": ["Manta"]}
    df = rows("species string, taxon_group string", ("Carcharhinus perezii", "shark"), ("manta", "shark"), ("zzzzzzzzz", "ray"), ("", "ray"))
    got = {r.species: (r.match, r.distance, r.scope) for r in lookup.match_species(df, lists).collect()}
    assert got == {
        "Carcharhinus perezii": ("Carcharhinus perezi", 1, "group"), "manta": ("Manta", 0, "all"),
        "zzzzzzzzz": (None, None, None), "": (None, None, None)}


# --- metadata -------------------------------------------------------------


def test_names_that_repeat_do_not_multiply_rows(rows):
    videos = rows("video_filename string, video_path string", ("G.MP4", "a/G.MP4"), ("G.MP4", "b/G.MP4"))
    camera = rows("video_path string, gopro_fps double", ("a/G.MP4", 25.0), ("b/G.MP4", 30.0))
    assert metadata.combine_metadata(videos, camera=camera).count() == 2
    twice = rows("video_filename string, site_name string", ("G.MP4", "x"), ("G.MP4", "y"))
    with pytest.raises(ValueError):
        metadata.combine_metadata(videos, user=twice)


def test_missing_maxn_is_zero_but_richness_stays_null(rows):
    videos = rows("video_filename string, video_path string", ("a", "a"), ("b", "b"))
    wide = rows("video_path string, maxn_x bigint, maxn_total bigint, species_richness bigint", ("a", 2, 2, 1))
    got = metadata.combine_metadata(videos, maxn_wide=wide)
    assert got.columns == ["video_filename", "video_path", "maxn_total", "maxn_x", "species_richness"]
    assert plain(got, "video_path") == [("a", "a", 2, 2, 1), ("b", "b", 0, 0, None)]


def test_enrich(rows):
    videos = rows(
        "video_path string, latitude double, depth_estimate double, substrate_type string, substrate_confidence double",
        ("a", 0.0, None, None, None), ("b", 40.0, 3.0, "sand", 0.4), ("c", 60.0, 3.0, "sand", 0.6))
    bathy = rows("video_path string, depth double, substrate_prediction string, confidence double", ("a", -7.0, "rock", 0.9), ("b", -8.0, "rock", 0.3), ("c", -9.0, "rock", 0.9))
    got = plain(metadata.enrich(videos, bathy).select("depth_estimate", "substrate_type", "substrate_confidence"), "video_path")
    assert got == [(7.0, "rock", 0.9), (3.0, "rock", 0.3), (3.0, "sand", 0.6)]


def test_depth_statistics(rows):
    got = metadata.depth_stats(rows("depth double", (1.0,), (5.0,), (0.0,), (None,), (10.0,), (4.0,))).first().asDict()
    assert got == {"mean_depth": 5.0, "median_depth": 4.5, "min_depth": 1.0, "max_depth": 10.0}


def test_progress(rows):
    tasks = rows("status string, start_time double, end_time double", ("completed", 0.0, 10.0), ("completed", 5.0, 25.0), ("failed", 0.0, 1.0), ("pending", None, None))
    got = inventory.task_stats(tasks).first()
    assert (got.total_seconds, got.mean_seconds, got.success_percent) == (30.0, 15.0, 50.0)
    p = inventory.progress(tasks, 0, 3600).first()
    assert (p.remaining, p.completion_percent, p.throughput_per_hour, p.hours_to_go) == (1, 50.0, 2.0, 0.5)
    assert inventory.progress(tasks.limit(0), 0, 3600).first().hours_to_go is None


# --- training -------------------------------------------------------------


def test_diverse_sample_takes_tracks_in_turn(rows):
    data = [("a", f"v_t1_{i}.jpg") for i in range(50)] + [("a", "v_t2_0.jpg"), ("a", "v_t3_0.jpg"), ("b", "w_t1_0.jpg")]
    got = training.diverse_sample(rows("class string, filename string", *data), 5, seed=1)
    names = [r.filename for r in got.filter("class = 'a'").collect()]
    assert len(names) == 5 and {"v_t2_0.jpg", "v_t3_0.jpg"} <= set(names)
    assert got.filter("class = 'b'").count() == 1


def test_split_is_exact_and_repeatable(rows):
    df = rows("class string, filename string", *[("a", f"{i}") for i in range(101)], ("b", "x"))
    one = training.stratified_split(df, ["filename"])
    counts = {(r["class"], r["split"]): r["count"] for r in one.groupBy("class", "split").count().collect()}
    assert counts == {("a", "validation"): 21, ("a", "train"): 80, ("b", "validation"): 1}
    again = training.stratified_split(df.repartition(7), ["filename"])
    assert one.exceptAll(again).count() == 0


def test_names_of_training_images(rows):
    df = rows("class string, filename string", ("a", "v_1_0.jpg"), ("a", "v_1_1.jpg"), ("a", "single.jpg"))
    assert plain(training.training_summary(df)) == [("a", 2, 3)]
    assert sorted(r[0] for r in training.videos_included(df).collect()) == ["single", "v"]
    by_name = training.label_by_name(rows("path string", ("t/1-Gcirratum.jpg",), ("t/x.jpg",)), ["G.cirratum"])
    assert plain(by_name) == [("t/1-Gcirratum.jpg", "G.cirratum")]




def test_labels_that_share_a_column_name_are_told_apart(rows):
    found = rows("video_path string, label string, n bigint, frame bigint", ("v", "C. perezi", 2, 1), ("v", "C  perezi", 3, 1))
    wide = maxn.maxn_wide(found)
    assert len(set(wide.columns)) == len(wide.columns)
    row = wide.first().asDict()
    assert {row["maxn_C__perezi"], row["maxn_C__perezi_2"]} == {2, 3} and row["maxn_total"] == 5


def test_names_meet_by_forms_of_the_lengths_there_are(spark):
    rng = np.random.default_rng(4)

    def made(n, low, high, letters):
        return {"".join(rng.choice(list(letters), rng.integers(low, high))) for _ in range(n)}

    for letters, low, high in (("ab", 1, 9), ("abc", 3, 13), ("ab", 37, 46)):
        typed, listed = made(60, low, high, letters), made(60, low, high, letters)
        words = spark.createDataFrame([(t,) for t in typed], "_low string")
        names = spark.createDataFrame([(t,) for t in listed | set(list(typed)[:5])], "_name_low string")
        got = lookup.near_names(words, names, 3).collect()
        want = words.crossJoin(names).withColumn("_distance", F.levenshtein("_low", "_name_low")).filter("_distance <= 3").collect()
        assert sorted((r._low, r._name_low, r._distance) for r in got) == sorted((r._low, r._name_low, r._distance) for r in want)


def test_forms_are_not_sent_whole_to_every_task(spark):
    words = spark.range(10).selectExpr("concat('word', id) AS _low")
    names = spark.range(10).selectExpr("concat('name', id) AS _name_low")
    plan = lookup.near_names(words, names, 3)._jdf.queryExecution().sparkPlan().toString()
    by_form = [line for line in plan.splitlines() if "Join" in line and "[_form#" in line]
    assert by_form and all("SortMergeJoin" in line for line in by_form)


def test_near_boxes_reach_few_buckets(rows):
    at = lambda k: (k * 37 % 400, k * 91 % 300)
    boxes = [("v", *at(k), at(k)[0] + 50 + k % 50, at(k)[1] + 30 + k % 50, k) for k in range(400)]
    found = rows("video_path string, xmin int, ymin int, xmax int, ymax int, seen bigint", *boxes)
    plan = dedup.near_duplicates(found, "seen")
    got = {(r.xmin, r.ymin, r.xmax, r.ymax): r.duplicate for r in plan.collect()}
    want = {b[1:5]: any(e[5] < b[5] and all(abs(x - y) <= 2 for x, y in zip(e[1:5], b[1:5], strict=True)) for e in boxes) for b in boxes}
    assert got == want
    keys = [line for line in plan._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "bucket#" in line]
    assert keys and all("b_xmin" not in line for line in keys)


def _edited(rng, text, letters):
    for _ in range(rng.randint(0, 4)):
        k = rng.randrange(len(text) + 1)
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + rng.choice(letters) + text[k:], text[:k] + rng.choice(letters) + text[k + 1 :]])
    return text


def test_forms_of_a_long_list_do_not_travel(spark, monkeypatch):
    # groups of few forms, so that there are many, by two letters and by three
    rng, store = random.Random(5), spark.sparkContext._jsc.sc().statusStore()
    listed = {"S " + "".join(rng.choices("0123456789abé🐟", k=11)) for _ in range(300)}
    typed = {name[: k % 13] + rng.choice("xyé🐟") + name[k % 13 + 1 :] for k, name in enumerate(sorted(listed))}
    words, names = (spark.createDataFrame([(t,) for t in side], f"{c} string") for side, c in ((typed, "_low"), (listed, "_name_low")))
    want = words.crossJoin(names).withColumn("_distance", F.levenshtein("_low", "_name_low")).filter("_distance <= 3").collect()

    def moved():
        executors = store.executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    for together, fullest in ((1 << 10, 1 << 60), (1 << 10, 1), (1 << 22, 1)):
        monkeypatch.setattr(lookup, "FORMS_TOGETHER", together, raising=False)
        monkeypatch.setattr(lookup, "FORMS_AT_MOST", fullest, raising=False)
        before = moved()
        got = lookup.near_names(words, names, 3).collect()
        assert sorted(map(tuple, got)) == sorted((r._name_low, r._low, r._distance) for r in want)
        # 286 forms of each text would be some 4,000 bytes
        assert moved() - before < 1000 * len(typed | listed)


def test_the_search_for_common_forms_travels_whole(tmp_path):
    (tmp_path / "meet").write_bytes(cloudpickle.dumps(lookup._meetings(3)))
    group = (((10 * 64 + 63) * 64 + 63) * 64 + 63) * lookup.SHARES_AT_MOST**2
    code = f"""import pickle, pyarrow as pa
batch = pa.RecordBatch.from_pydict({{"_typed": [True, False], "_text": ["abcdefghijklm", "abcdefghijkl"]}})
found = pickle.load(open({str(tmp_path / "meet")!r}, "rb"))((pa.scalar({group}),), iter([batch]))
print([b.to_pydict() for b in found])"""
    seen = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": os.environ["PATH"]}, capture_output=True, text=True, check=True)
    assert seen.stdout.strip() == "[{'_low': ['abcdefghijklm'], '_name_low': ['abcdefghijkl']}]"


def test_common_forms_are_found_by_parts(monkeypatch):
    rng = random.Random(6)
    names = sorted({"".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(150)})
    words = sorted({_edited(rng, n, "abc🐟") for n in names})
    near = lambda a, b, form: max(len(a), len(b)) == form + 3 and any(
        "".join(c) in set(map("".join, itertools.combinations(b, form))) for c in itertools.combinations(a, form))
    want = {(a, b) for a in words for b in names for form in (3, 5) if a != b and min(len(a), len(b)) >= form and near(a, b, form)}
    for kept, held, together in ((1 << 23, 1 << 21, 1 << 14), (64, 16, 7)):
        monkeypatch.setattr(forms, "FORMS_KEPT", kept)
        monkeypatch.setattr(forms, "PAIRS_HELD", held)
        monkeypatch.setattr(forms, "TEXTS_TOGETHER", together)
        monkeypatch.setattr(forms, "FORMS_AT_ONCE", together)
        for places, shares in (((), 1), ((0, 2), 3), ((0, 1, 2), 5)):
            got = set()
            for form, share in itertools.product((3, 5), range(shares)):
                for batch in forms.may_be_near(pa.array(words), pa.array(names), form, 3, places, share, shares):
                    got |= set(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            assert got == want
