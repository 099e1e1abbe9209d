"""Small cases worked out by hand or by plain loops."""

import math
import random

from pyspark.sql import functions as F

from strideline.functions import physiology as ph
from strideline.operators import graph, load, ordered, summaries


def test_flat_run_keeps_its_time(spark):
    df = spark.createDataFrame([(300.0, 0.0, 1.0), (300.0, 40.0, 1.0), (300.0, 0.0, 0.0)], "s double, g double, km double")
    flat, hill, none = (r[0] for r in df.select(ph.ga_seconds(F.col("s"), F.col("g"), F.col("km"))).collect())
    assert flat == 300 and hill < 300 and none == 300


def test_index_percentile_takes_the_place_not_a_mean(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(10)], "k int, v double")
    assert load.index_percentile(df, "k", "v", 0.15, "p").first().p == 1.0


def test_ewma_equals_the_recurrence_over_spans(spark):
    random.seed(1)
    x = [random.random() * 100 for _ in range(700)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, i int, load double")
    got = [r.e for r in load.ewma(df, "k", 7, "e", span=200).orderBy("i").collect()]
    e, want = 0.0, []
    for v in x:
        e += (1 - math.exp(-1 / 7)) * (v - e)
        want.append(e)
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-8


def test_band_join_makes_each_pair_once(spark):
    random.seed(2)
    rows = [(i, random.randint(0, 3000)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t int")
    got = [(r.l.id, r.r.id) for r in ordered.band_join(df, "t", 50, lambda x, y: F.lit(True)).collect()]
    want = {tuple(x[1] for x in sorted([(a[1], a[0]), (b[1], b[0])])) for a in rows for b in rows if a[0] < b[0] and abs(a[1] - b[1]) <= 50}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    got = {r.v: r.c for r in graph.components(spark.createDataFrame(path + star, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))


def test_asof_prefers_the_earlier_reading_on_ties(spark):
    p = spark.createDataFrame([(1, 10), (1, 25), (2, 5)], "k int, t int")
    r = spark.createDataFrame([(1, 5, 1), (1, 15, 2)], "k int, t int, v int")
    assert {(x.k, x.t): x.v for x in ordered.asof_nearest(p, r, "k", "t", "v", 8).collect()} == {(1, 10): 1, (1, 25): None, (2, 5): None}


def test_interval_merge(spark):
    s = spark.createDataFrame([(1, 0, 5), (1, 3, 9), (1, 20, 21), (1, 4, 4)], "k int, lo int, hi int")
    assert {(x.lo, x.hi) for x in ordered.merge_intervals(s, "k", "lo", "hi").collect()} == {(0, 9), (20, 21)}


def test_empty_tables_give_no_rows(spark):
    acts = spark.createDataFrame([], "activity_id long, squad long, day date, dist_m long, moving_s long, gain_m long, elapsed_s long")
    daily = load.daily_series(load.session_loads(acts, "squad"), "squad")
    assert load.plan_targets(daily, "squad").count() == summaries.eddington(summaries.daily_km(acts, "squad"), "squad").count() == 0
