"""Sources of an export on small files, and the operators on run records where SQL doesn't hold them."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from strideline.operators import lines, runs
from strideline.sources import archive

HEAD = "Activity ID,Activity Date,Activity Name,Activity Description,Activity Type,Filename,Distance,Moving Time,Elapsed Time,Elevation Gain,Elevation Loss,Average Heart Rate,Max Heart Rate,Gear"
ROWS = [
    '1,"Jan 2, 2024, 3:04:05 PM","Morning, run","two\nlines ""quoted""",Run,activities/1.fit.gz,5000,1500,1800,50,40,150,180,x',
    "2,not a date,Ride,,Ride,activities/2.fit,,600,600,,,,,",
    '3,"Feb 30, 2024, 1:00:00 AM",Odd,,Run,,n/a,1,1,1,1,300,,',
    '4,"Mar 1, 2024, 12:00:00 AM",Zero,,run,activities/4.fit,0,10,20,0,0,,,',
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "export_1").mkdir()
    (tmp_path / "export_1" / "activities.csv").write_text("﻿" + "\n".join([HEAD, *ROWS]) + "\n", encoding="utf-8")
    return tmp_path


def test_finding_and_unpacking_an_export(folder, tmp_path):
    assert archive.newest_export(str(folder)).endswith("export_1")
    with zipfile.ZipFile(folder / "export_9.zip", "w") as z:
        z.write(folder / "export_1" / "activities.csv", "b/activities.csv")
        z.writestr("a/other.txt", "x")
    with zipfile.ZipFile(folder / "export_8.zip", "w") as z:
        z.writestr("x.txt", "x")
    os.utime(folder / "export_8.zip", (1, 1))
    assert archive.newest_export(str(folder)).endswith("export_9.zip")
    assert archive.unpacked(str(folder / "export_9.zip"), str(tmp_path / "to")).endswith("b")
    with pytest.raises(FileNotFoundError):
        archive.unpacked(str(folder / "export_8.zip"), str(tmp_path / "none"))
    (tmp_path / "e").mkdir()
    with pytest.raises(FileNotFoundError):
        archive.newest_export(str(tmp_path / "e"))
    for n in ("activities_2.csv", "activities_10.csv"):
        (tmp_path / "e" / n).write_text("x")
    assert archive.newest_by_name(str(tmp_path / "e")).endswith("activities_2.csv")


def test_reading_and_typing_the_csv(spark, folder):
    raw = archive.read_activities(spark, str(folder / "export_1" / "activities.csv"))
    assert raw.columns[:3] == archive.COLUMNS[:3] and raw.columns[-1] == "Gear"
    got = {r.activity_id: r for r in archive.typed(raw).collect()}
    assert got["1"].description == 'two\nlines "quoted"' and got["1"].name == "Morning, run" and got["1"].epoch == 1704207845 and got["1"].recording == "1"
    assert got["2"].epoch is None and got["2"].dist_m is None and got["3"].epoch is None and got["3"].dist_m is None and got["3"].recording is None
    assert [r.activity_id for r in runs.usable(archive.typed(raw)).collect()] == ["1"]
    fit = spark.createDataFrame([("2", "running"), ("4", "cycling")], "fit_file string, fit_sport string")
    kept = lambda s: sorted(r.activity_id for r in runs.with_recordings(archive.typed(raw), fit, s).collect())
    assert kept("run") == ["1", "2", "3", "4"] and kept("running") == ["2"] and kept("ride") == ["2"] and len(kept("all")) == 4


def test_recordings_and_what_is_left_to_parse(spark):
    files = spark.createDataFrame([("a/1.fit",), ("b/1.fit.gz",), ("a/2.fit",), ("a/3.gpx",), ("a/4.fit.gz",)], "path string")
    r = archive.recordings(files)
    assert sorted(map(tuple, r.collect())) == [("1", "b/1.fit.gz"), ("2", "a/2.fit"), ("4", "a/4.fit.gz")]
    old = spark.createDataFrame([("1", "x", None), ("1", "y", None), ("2", None, ""), ("", "z", "z")], "fit_file string, fit_sport string, fit_time string").coalesce(1)
    done = archive.parsed_before(old)
    assert [(r.fit_file, r.fit_sport) for r in done.collect()] == [("1", "x")]
    assert sorted(x.recording for x in archive.still_to_parse(r, done).collect()) == ["2", "4"]


def test_settings_keep_what_is_valid(tmp_path, spark):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({
        "races": [{"name": "A", "distance_m": 5000, "date": "2027-05", "target_time_s": 1200, "activity_id": 7}, {"name": "B"}, "junk", {"name": "C", "distance_m": 1, "date": "soon"}],
        "duplicates": {"not_duplicates": [["1", "2"], ["3"]], "force_duplicate": {"4": "5"}, "force_primary": [6]},
        "physiology": {"hr_max": 190, "hr_rest": 500, "age": 40, "sex": "x"}, "segment_anchors": [{"name": "H", "center": [1, 2], "len_m": 300}, {"center": [1]}],
    }))
    s = archive.settings(str(p))
    assert [r.name for r in s.races] == ["A", "C"] and s.races[0].date == "2027-05" and s.races[1].date is None and s.races[0].activity_id == "7"
    assert s.not_duplicates == (("1", "2"),) and s.force_duplicate == {"4": "5"} and s.force_primary == ("6",) and len(s.segment_anchors) == 1
    assert (s.hr_max, s.hr_rest, s.age, s.sex) == (190, None, 40, None)
    assert archive.races_table(spark, s).count() == 2
    p.write_text("{broken")
    assert archive.settings(str(p)) == archive.Settings() == archive.settings(str(tmp_path / "none"))


def test_json_columns_caches_and_signatures(spark, tmp_path):
    df = spark.createDataFrame([(1, '[{"d":1.5,"t":2,"hr":90}]'), (2, "{broken"), (3, None), (4, "[]")], "id long, s string")
    a = df.select("id", archive.json_array("s", archive.POINT).alias("p"))
    assert {r.id: len(r.p) for r in a.collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert json.loads(a.where("id = 1").select(archive.to_json_array("p").alias("j")).first().j) == [{"d": 1.5, "t": 2.0, "hr": 90}]
    keys = spark.createDataFrame([("a",), ("b",), ("a",), ("c",)], "key string")
    cache = spark.createDataFrame([("a", 1.0), ("b", None)], "key string, value double")
    known, missing = archive.cached_values(keys, cache)
    assert known.count() == 4 and [r.key for r in missing.collect()] == ["c"]
    one = archive.input_signature(df, "v1")
    assert one == archive.input_signature(df.orderBy(F.desc("id")).repartition(3), "v1") != archive.input_signature(df, "v2")
    assert one != archive.input_signature(df.where("id > 1"), "v1")
    made = []
    make = lambda: made.append(1) or df
    for force in (False, False, True):
        assert archive.kept_or_made(spark, str(tmp_path / "k"), one, make, force).count() == 4
    assert len(made) == 2
    archive.write_csv(a, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 4


def test_classes_at_their_bounds(spark):
    from strideline.operators import summaries as sm

    cases = [  # km, interval, ratio, shares of five zones, type
        (0.9, True, 1.2, (1, 0, 0, 0, 0), "misc"), (1.0, True, 1.2, (1, 0, 0, 0, 0), "intervals"), (3.0, False, 0.98, (1, 0, 0, 0, 0), "race"), (2.9, False, 0.98, (1, 0, 0, 0, 0), "recovery"),
        (5.0, False, 0.97, (0.6, 0, 0, 0, 0.4), "race"), (5.0, False, None, (0.5, 0, 0, 0.5, 0), "threshold"), (5.0, False, None, (0.4, 0, 0, 0.25, 0.35), "threshold"), (5.0, False, None, (0.65, 0, 0.35, 0, 0), "tempo"),
        (5.0, False, None, (0.7, 0.3, 0, 0, 0), "recovery"), (5.0, False, None, (0.69, 0.31, 0, 0, 0), "easy"), (5.0, False, None, (0, 0, 0, 0, 0), "easy"),
    ]
    df = spark.createDataFrame([(k, i, r, *map(float, z), t) for k, i, r, z, t in cases], "km double, i boolean, ratio double, a double, b double, c double, d double, e double, want string")
    got = df.select("want", sm.classify(F.col("km"), F.col("i"), F.col("ratio"), [F.col(c) for c in "abcde"]).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_declared_races_and_long_rules(spark):
    r = spark.createDataFrame([("1", None, "easy"), ("2", "9", "tempo"), ("3", None, "easy")], "activity_id string, dup_of string, run_type string")
    done, left = runs.declared_races(r, spark.createDataFrame([("1",), ("9",), ("77",), (None,)], "activity_id string"))
    assert {x.activity_id: x.run_type for x in done.collect()} == {"1": "race", "2": "race", "3": "easy"} and [x.activity_id for x in left.collect()] == ["77"]
    many = spark.createDataFrame([(5.0, "easy")] * 20 + [(21.0, "easy"), (21.0, "tempo"), (21.0, "misc")], "dist_km double, run_type string")
    got = {(x.run_type, x.is_long) for x in runs.long_rules(many).where("dist_km > 20").collect()}
    assert got == {("long", True), ("tempo", True), ("misc", False)}


def test_repetitions_close_after_five_slow_samples_or_run_to_the_end(spark):
    fast, slow = [10.0] * 4, [0.5]
    steps = fast + slow * 4 + fast + slow * 5 + fast + slow * 3
    d, rows = 0.0, [("a", 0, 0, 0.0)]
    for i, s in enumerate(steps, 1):
        d += s
        rows.append(("a", i, i, d))
    got = sorted((r.start_t, r.end_t) for r in runs.reps(spark.createDataFrame(rows, "k string, i int, t int, d double"), "k").collect())
    assert got == [(0, 12), (17, 24)]


def test_nearby_places_across_the_date_line_and_far_north(spark):
    a = spark.createDataFrame([(1, 0.0, 179.9999), (2, 79.0, 10.0), (3, -33.0, 18.0)], "id int, lat double, lon double")
    b = spark.createDataFrame([(1, 0.0, -179.9999), (2, 79.0, 10.004), (3, -33.0, 18.5)], "id int, lat double, lon double")
    assert sorted((r.l.id, r.r.id) for r in lines.nearby(a, b, 100.0).collect()) == [(1, 1), (2, 2)]


def test_fastest_spans_that_do_not_meet(spark):
    df = spark.createDataFrame([("a", 0, 5, 10), ("a", 4, 9, 8), ("a", 10, 12, 20), ("b", 0, 1, 5)], "k string, lo int, hi int, t int")
    assert sorted(map(tuple, lines.fastest_spans(df, "k", "lo", "hi", "t").collect())) == [("a", 4, 9, 8), ("a", 10, 12, 20), ("b", 0, 1, 5)]


def plain_uptake(rows, hr_max, hr_rest):
    """One recording's windows and their uptake, sample by sample."""
    cost = lambda g: ((((155.4 * g - 30.4) * g - 43.3) * g + 46.3) * g + 19.5) * g + 3.6

    def speed(a, b):
        dt, dd = b[0] - a[0], b[1] - a[1]
        if dt <= 0 or dd <= 0:
            return None
        g = (b[2] - a[2]) / dd if a[2] is not None and b[2] is not None else 0.0
        g = max(-0.45, min(0.45, g))
        return dd / dt * cost(g) / cost(0), g

    out, at = [], 0
    while at < len(rows) and rows[at][0] < 300:
        at += 1
    end = at
    while end + 1 < len(rows):
        if rows[end + 1][0] - rows[end][0] > 20:
            at = end = end + 1
            continue
        end += 1
        if rows[end][0] - rows[at][0] < 150:
            continue
        hr = [x[3] for x in rows if x[3] is not None and rows[at][0] + 20 <= x[0] <= rows[end][0] + 20]
        cuts = [at + (end - at) * q // 4 for q in range(5)]
        whole, parts = speed(rows[at], rows[end]), [speed(rows[a], rows[b]) for a, b in zip(cuts, cuts[1:])]
        raw = (rows[end][1] - rows[at][1]) / (rows[end][0] - rows[at][0])
        at = end
        if len(hr) < 3 or not whole or None in parts or not 2 <= raw <= 7 or abs(whole[1]) > 0.15 or max(p[0] for p in parts) / min(p[0] for p in parts) > 1.35:
            continue
        share, v = (sum(hr) / len(hr) - hr_rest) / (hr_max - hr_rest), whole[0] * 60
        vo2 = -4.6 + 0.182258 * v + 0.000104 * v * v
        if 0.5 <= share <= 0.95 and vo2 > 3.5 and 25 <= 3.5 + (vo2 - 3.5) / share <= 90:
            out.append(3.5 + (vo2 - 3.5) / share)
    return out


def test_uptake_equals_a_plain_fold(spark):
    import random

    from strideline.operators import heart

    random.seed(11)
    rows, want = [], {}
    for k in range(12):
        t = d = 0.0
        own = []
        for i in range(300):
            t += random.choice([5, 8, 10] if random.random() < 0.98 else [40])
            d += random.choice([15, 24, 30, 33]) * (1 if k % 3 else random.choice([0.5, 1.5]))
            own.append((t, d, 100 + d / 200 if k % 2 else None, random.randint(130, 170) if random.random() < 0.7 else None))
        want[k] = plain_uptake(own, 190, 50)
        rows += [(k, i, *x) for i, x in enumerate(own)]
    df = spark.createDataFrame(rows, "k int, i long, t double, d double, elev double, hr int")
    got = {}
    for r in heart.window_uptake(df, "k", 190.0, 50.0).orderBy("k", "w").collect():
        got.setdefault(r.k, []).append(round(r.vo2max, 6))
    assert got == {k: [round(x, 6) for x in v] for k, v in want.items() if v} and sum(map(len, want.values())) > 20
    runs_ = {r.k: r.windows for r in heart.run_uptake(df, "k", 190.0, 50.0).collect()}
    assert runs_ == {k: len(v) for k, v in want.items() if len(v) >= 4}


def test_nearest_edges_and_heights(spark):
    p = spark.createDataFrame([(1, 40.0, 10.0), (2, 40.0002, 10.0005), (3, 41.0, 10.0)], "id int, lat double, lon double")
    e = spark.createDataFrame([(7, 39.9999, 9.99, 39.9999, 10.01), (8, 40.0001, 9.99, 40.0001, 10.01), (9, 40.00025, 9.99, 40.00025, 10.01)], "edge int, lat1 double, lon1 double, lat2 double, lon2 double")
    got = {r.id: (r.edge, round(r.m)) for r in lines.nearest_edges(p, e, "id").collect()}
    assert got == {1: (7, 11), 2: (9, 6)}
    t = spark.createDataFrame([("a", i, i * 30.0, 40 + i * 0.0003, 10.0, None) for i in range(20)] + [("b", i, i * 30.0, 40 + i * 0.0003, 10.0, 5.0 if i == 3 else None) for i in range(5)], "k string, i int, d double, lat double, lon double, elev double")
    cache = spark.createDataFrame([(f"{40 + i * 0.0003:.4f},{10.0:.4f}", 100.0) for i in range(20)], "place string, elev double")
    filled = lines.with_heights(t, cache, "k", "i").groupBy("k").agg(F.count("elev").alias("n"), F.min("elev").alias("lo")).collect()
    assert {r.k: (r.n, round(r.lo)) for r in filled} == {"a": (20, 100), "b": (1, 5)}
    few = lines.with_heights(t, cache.limit(3), "k", "i").where("k = 'a'").agg(F.count("elev").alias("n")).first()
    assert few.n == 0


def test_providers_stars_factors_and_arrivals(spark, tmp_path):
    from strideline.streaming import arrivals

    keys = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    assert archive.provided(keys).count() == 0
    assert sorted(map(tuple, archive.provided(keys, lambda ks: [1.0 if k == "a" else None for k in ks]).collect())) == [("a", 1.0), ("b", None)]

    def broken(ks):
        raise OSError("down")

    assert archive.provided(keys, broken).count() == 0
    archive.write_stars(["y", "x", "x"], str(tmp_path / "s.json"))
    assert archive.read_stars(str(tmp_path / "s.json")) == ["x", "y"] and archive.read_stars(str(tmp_path / "none")) == []
    (tmp_path / "f.json").write_text(json.dumps({"male": {"5k": {"age_min": 5, "open_s": 770, "factors": [0.5, 0.6]}, "10k": {"age_min": "x"}}}))
    assert archive.read_age_factors(spark, str(tmp_path / "f.json")).count() == 2 and archive.read_age_factors(spark, str(tmp_path / "none")).count() == 0
    arriving, done = tmp_path / "in", str(tmp_path / "done")
    arriving.mkdir()
    parse = lambda df: df.where("body <> 'bad'").select("recording", F.length("body").alias("n"))
    for k, lines_ in enumerate((['{"recording":"1","body":"xy"}', '{"recording":"2","body":"bad"}'], ['{"recording":"1","body":"again"}', '{"recording":"2","body":"ok now"}'])):
        (arriving / f"{k}.json").write_text("\n".join(lines_))
        arrivals.parse_new(spark, str(arriving), done, str(tmp_path / "check"), parse).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(done).collect())) == [("1", 2), ("2", 6)]
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c")], "k string, at int, v string")
    assert [tuple(r) for r in arrivals.latest(rows, "k", "at").collect()] == [("k", 2, "c")]


def test_compiling_an_export_twice_reads_it_once(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    fit = spark.createDataFrame([("1", "running")], "fit_file string, fit_sport string")
    one = archive.compile_export(spark, str(folder / "export_1"), out, fit, sport="running")
    assert [r.activity_id for r in one.collect()] == ["1"]
    archive.compile_export(spark, str(folder / "export_1"), out, fit, sport="running")
    assert len([p for p in os.listdir(out) if not p.startswith(".")]) == 1


def test_settings_as_they_are_documented(tmp_path):
    """Numbers in text, both ways to write a sex, ids with blanks, blank and equal ids, help entries."""
    (tmp_path / "c.json").write_text(json.dumps({
        "_races_help": ["x"], "races": [{"name": "14 km", "distance_m": "14000", "date": "2026-08", "target_time_s": "4200", "activity_id": " 12 "}, {"name": "Half", "distance_m": 21097.5, "target_wave_s": ["6000", 7200]}, {"name": "bad", "distance_m": "x"}, {"name": "bad", "distance_m": 5, "target_time_s": "soon"}, 7],
        "segment_anchors": [{"name": "H", "center": ["52.1", 5], "len_m": "300"}, {"center": [1, 2], "len_m": 3}, {"name": "H", "center": [1], "len_m": 3}, {"name": "H", "center": [1, 2], "len_m": "x"}],
        "physiology": {"hr_max": "190", "hr_rest": 25, "age": "35", "sex": "F"},
        "duplicates": {"not_duplicates": [[" 1 ", 2], ["3", "3"], ["", "4"], ["5"], 6], "force_duplicate": {" 7": "8 ", "1": "1", "2": ""}, "force_primary": [" 9 ", "", 10]},
    }))
    s = archive.settings(str(tmp_path / "c.json"))
    assert [(r.name, r.distance_m, r.date, r.target_time_s, r.target_wave_s, r.activity_id) for r in s.races] == [("14 km", 14000.0, "2026-08", 4200, None, "12"), ("Half", 21097.5, None, None, (6000, 7200), None)]
    assert [(a["center"], a["len_m"]) for a in s.segment_anchors] == [([52.1, 5.0], 300.0)]
    assert (s.hr_max, s.hr_rest, s.age, s.sex) == (190, 25, 35, "F") and s.not_duplicates == (("1", "2"),) and s.force_duplicate == {"7": "8"} and s.force_primary == ("9", "10")
    for sex, want in (("m", "M"), (" Male ", "M"), ("female", "F"), ("x", None), (None, None)):
        (tmp_path / "c.json").write_text(json.dumps({"physiology": {"sex": sex, "hr_rest": 24, "hr_max": "many", "age": True}}))
        s = archive.settings(str(tmp_path / "c.json"))
        assert (s.sex, s.hr_rest, s.hr_max, s.age) == (want, None, None, None)


def test_published_age_factors_with_a_source_entry(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"source": "standards of a year", "M": {"best_1mi_s": {"dist_m": 1609.344, "open_s": 227.0, "age_min": 5, "factors": [0.6, 0.65]}, "note": "x"}, "F": {"best_5k_s": {"open_s": 850, "age_min": "6", "factors": [0.7]}}}))
    got = sorted(tuple(r) for r in archive.read_age_factors(spark, str(tmp_path / "f.json")).collect())
    assert got == [("F", "best_5k_s", 6, 0.7, 850.0), ("M", "best_1mi_s", 5, 0.6, 227.0), ("M", "best_1mi_s", 6, 0.65, 227.0)]


def test_the_first_parsed_row_does_not_depend_on_files(spark):
    rows = [("a", "x", "z"), ("a", None, "b"), ("a", "x", "y"), ("b", None, "q"), (None, "x", "r")]
    for n in (1, 4):
        got = archive.parsed_before(spark.createDataFrame(rows, "fit_file string, fit_sport string, name string").repartition(n)).collect()
        assert [tuple(r) for r in got] == [("a", "x", "y")]
