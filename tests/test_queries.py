"""Each registered query that has SQL, held against DuckDB on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strideline.plans import catalog, geometry, matches, mining, places, running, trends  # noqa: F401  the others add to the catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return f"{v:.3f}".replace("-0.000", "0.000") if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = con.execute(catalog.ORACLE_SQL[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(tuple(shown(dict(zip(cols, r))[k]) for k in order) for r in got.fetchall())
    assert sorted(tuple(shown(r[k]) for k in order) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_vertices_of_athletes_with_many_events_stay_apart(spark, monkeypatch):
    rows = [(1, 100001, 0, 5.0, 100), (3, 1, 1, 5.0, 100), (2, 1, 9000, 5.0, 120), (4, 1, 9001, 5.0, 120)]
    df = spark.createDataFrame(rows, "athlete_id long, i int, epoch long, step_m double, hr long").withColumn("step_m", F.col("step_m").cast("decimal(18,2)"))
    monkeypatch.setattr(catalog, "records", lambda *_: df)
    got = catalog.duplicate_components(spark, "").collect()
    assert len({r.v for r in got}) == 4 and len({r.c for r in got}) == 2
    assert sorted(r.n for r in catalog.duplicate_winner(spark, "").collect()) == [2, 2]


def test_rows_of_one_athlete_in_one_second_pair_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1, 50, 5.0, 100), (1, 2, 50, 5.0, 100), (2, 1, 50, 5.0, 100)], "athlete_id long, i int, epoch long, step_m double, hr long")
    monkeypatch.setattr(catalog, "records", lambda *_: df.withColumn("step_m", F.col("step_m").cast("decimal(18,2)")))
    assert sorted((r.la, r.li, r.ra, r.ri) for r in catalog.duplicate_band_join(spark, "").collect()) == [(1, 1, 1, 2), (1, 1, 2, 1), (1, 2, 2, 1)]


def test_every_run_has_a_threshold_of_its_era(spark, monkeypatch):
    runs = [(1, 1, 0, 5000, 1000), (2, 1, 10, 2000, 500), (3, 1, 61, 2000, 500), (4, 1, 200, 2000, 500), (5, 1, 480, 2000, 500), (6, 1, 3000, 2000, 500), (7, 1, 2000, 6000, 1000), (8, 2, 0, 2000, 500)]
    df = spark.createDataFrame(runs, "activity_id long, squad long, n int, dist_m long, moving_s long").withColumn("day", F.expr("date_add(date'2000-01-01', n)")).drop("n")
    monkeypatch.setattr(catalog, "activities", lambda *_: df)
    got = {r.activity_id: (r.era, r.ratio) for r in catalog.threshold_of_every_run(spark, "").collect()}
    near, far = (round(5 / 6, 9), 0.8), (1.0, round(4 / 6, 9))
    assert got == {1: (near[0], 1.0), 2: near, 3: near, 4: near, 5: near, 6: far, 7: (1.0, 1.0), 8: (1.0, None)}
