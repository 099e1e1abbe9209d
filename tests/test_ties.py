"""Results that must not depend on the last bit of a number or on the order of equal rows."""

import datetime
from collections import Counter

from pyspark.sql import functions as F

from strideline.operators import ordered
from strideline.plans import trends


def test_equal_age_grades_go_to_the_smallest_activity(spark, monkeypatch):
    # 1592 s over 5615 m and three times that: 5000 m took equally long, but 1592 * (5000 / 5615) is larger by its last bit
    rows = [(1, 2, 0, datetime.date(2000, 1, 1), 5615, 1592, 1592, 0), (2, 2, 0, datetime.date(2000, 1, 1), 16845, 4776, 4776, 0)]
    df = spark.createDataFrame(rows, "activity_id long, athlete_id long, squad long, day date, dist_m long, moving_s long, elapsed_s long, gain_m long")
    monkeypatch.setattr(trends, "activities", lambda *_: df)
    got = {r.label: r.activity_id for r in trends.age_grade_best(spark, "").collect()}
    assert got["5k"] == 1 and got["10k"] == 2


def test_equal_intervals_are_numbered_together(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 5, 6), (1, 5, 6), (1, 6, 6), (1, 9, 9), (1, 9, 9)], "k long, lo long, hi long")
    for some in (df, df.orderBy(F.desc("lo"), F.desc("hi")).repartition(3)):
        assert sorted(tuple(r) for r in ordered.merge_intervals(some, "k", "lo", "hi").collect()) == [(1, 0, 2), (1, 5, 6), (1, 9, 9)]


def test_intervals_without_ends_or_turned_around(spark):
    # as in the SQL: nulls come last, and a row that no row before it reaches stands alone, though an equal one is there
    rows = [(1, 5, 9), (1, 5, 9), (1, 7, 12), (1, None, None), (1, 20, 21), (2, 5, 3), (2, 5, 3), (2, 8, None), (3, None, None), (3, None, None), (4, 6, None), (4, 6, None), (4, 7, 9), (None, 1, 2), (None, 2, 3)]
    got = ordered.merge_intervals(spark.createDataFrame(rows, "k long, lo long, hi long"), "k", "lo", "hi").collect()
    want = Counter()
    last = lambda x: (x is None, x or 0)
    for k in {r[0] for r in rows}:
        groups, e = [], None
        for _, lo, hi in sorted((r for r in rows if r[0] == k), key=lambda r: (last(r[1]), last(r[2]))):
            if e is None or (lo is not None and lo > e):
                groups.append([])
            groups[-1].append((lo, hi))
            e = max((x for x in (e, hi) if x is not None), default=None)
        for g in groups:
            want[k, min((lo for lo, _ in g if lo is not None), default=None), max((hi for _, hi in g if hi is not None), default=None)] += 1
    assert Counter(map(tuple, got)) == want and want[2, 5, 3] == 2 and want[1, 5, 12] == 1
