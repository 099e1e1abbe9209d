"""Steps whose work must grow no faster than their input: their results against plain folds, and what their plans mustn't hold."""

import math
import random

from pyspark.sql import functions as F

from strideline.operators import benchmarks, graph, lines, ordered, segments
from strideline.plans import running


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_nearest_readings_take_one_pass_each_way(spark):
    rng = random.Random(1)
    probes = [(k, rng.randrange(200), i) for i, k in enumerate([1, 2, 3] * 30)]
    reads = [(k, rng.randrange(200), rng.randrange(9)) for k in [1, 2] * 12]
    got = ordered.asof_nearest(spark.createDataFrame(probes, "k long, t long, n long"), spark.createDataFrame(reads, "k long, t long, v long"), "k", "t", "v", 15)
    assert "unboundedfollowing" not in plan(got)
    for r in got.collect():
        near = min(((abs(t - r.t), t > r.t, -v) for k, t, v in reads if k == r.k), default=(99, 0, 0))
        assert r.v == (-near[2] if near[0] <= 15 else None)


def test_best_around_a_time_uses_whole_days(spark):
    rng = random.Random(2)
    rows = {(k, rng.randrange(30) * rng.choice((1, 40)) * 86400 + rng.choice((0, 1, 43200, 86399))) for k in (1, 2, 3) for _ in range(40)}
    rows = [(k, t - 86400 * 5, rng.choice((None, None, rng.random())) if k < 3 else None) for k, t in sorted(rows)]
    got = ordered.best_around(spark.createDataFrame(rows, "k long, t long, v double"), "k", "t", "v", (2, 4, 9))
    assert "86400l)), specifiedwindowframe(rangeframe" not in plan(got) and "172800" not in plan(got)
    have = {(r.k, r.t): r.best for r in got.collect()}
    assert len(have) == len(rows)
    for k, t, _ in rows:
        tops = (max((v for o, u, v in rows if o == k and v is not None and -n <= (u - t) // 86400 <= n), default=None) for n in (2, 4, 9))
        assert have[k, t] == next((x for x in tops if x is not None), None)


def components(ids, near):
    """Each id's least reachable one, by all pairs."""
    of = {i: i for i in ids}
    for _ in ids:
        now = {i: min([of[i], *(of[j] for j in ids if j != i and near(i, j))]) for i in ids}
        if now == of:
            return of
        of = now
    return of


def test_linked_rows_are_connected_without_all_pairs(spark):
    rng = random.Random(3)
    # dense bins, pairs across their edges, and opposite remainders of 7 that don't link
    rows = {i: rng.choice((rng.randrange(40), rng.randrange(600), 300 + rng.randrange(4) * 11)) for i in range(160)}
    df = spark.createDataFrame(list(rows.items()), "v long, x long").withColumn("at", F.floor(F.col("x") / 10).cast("long"))
    near = lambda p, q: (F.abs(p["x"] - q["x"]) <= 10) & ((p["v"] + q["v"]) % 7 != 0)
    node = F.struct("at", F.when(F.col("v") % 7 == 0, F.col("v")).otherwise(-F.col("v") % 7 - 1).alias("k"))
    got = {r.v: r.c for r in graph.linked(df, "v", node, ("x",), ("at",), (1,), near).collect()}
    assert got == components(rows, lambda i, j: abs(rows[i] - rows[j]) <= 10 and (i + j) % 7 != 0)
    assert len(set(got.values())) > 3


def test_copies_that_spark_sizes_too_low_are_not_broadcast(spark, tmp_path):
    few = spark.range(200_000).select(F.xxhash64("id").alias("k"), F.col("id").alias("root"))
    for rows, fits in ((few, False), (few.limit(20), True)):
        rows.coalesce(1).write.parquet(where := str(tmp_path / str(fits)))
        some = spark.read.parquet(where)  # 2.4 MB, and 16 times that as copies
        got = graph.salted(spark.range(50).select(F.xxhash64("id").alias("k"), "id"), some, "k", "id")
        assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == fits
        assert {(r.id, r.root) for r in got.collect()} == {(i, i) for i in range(20 if fits else 50)}


def test_recordings_of_one_run_in_dense_copies(spark, monkeypatch):
    rows = [(i, (i * 137 % 900) + 86400 * (i % 23), 1000 + i % 60 if i % 11 else 400, 900 + i % 90, 5000 + i * 97 % 3000, i % 3 != 0, (i % 5 // 4) * 0.001) for i in range(1, 170)]
    df = spark.createDataFrame(rows, "id long, s long, el long, mv long, d long, gps boolean, lat double")
    monkeypatch.setattr(running, "_recordings", lambda *_: df)
    pairs = {(r.a, r.b) for r in running.recording_pairs(spark, "").collect() if (r.a + r.b) % 29}
    want = components([r[0] for r in rows], lambda i, j: (min(i, j), max(i, j)) in pairs)
    assert {r.id: r.dup_of or r.id for r in running.duplicate_of(spark, "").collect()} == want
    assert 23 < len(set(want.values())) < len(want)


def test_equal_rows_of_a_band_are_held_against_others_once(spark):
    rng = random.Random(10)
    rows = [(i, t, t % 3, rng.choice((None, 0.0, 0.001)) if t % 5 == 0 else 0.0) for i in range(150) for t in [rng.choice((7, 8, 30, rng.randrange(-60, 200)))]]
    rows += [(3, 900, 0, 0.0), (3, 901, 0, 0.0), (4, 901, 0, 0.0), (4, 901, 0, 0.0), (4, 901, 1, 0.0), (5, 901, 1, 0.0), (None, 901, 1, 0.0), (6, None, 1, 0.0)]
    df = spark.createDataFrame(rows, "id long, t long, k long, lat double")
    near = lambda x, y: (x["k"] + y["k"] < 3) & (F.abs(x["lat"] - y["lat"]) < 0.0005)
    at = [r for r in rows if None not in r]
    want = sorted((min(p[0], q[0]), max(p[0], q[0])) for i, p in enumerate(at) for q in at[:i] if p[0] != q[0] and abs(p[1] - q[1]) <= 50 and p[2] + q[2] < 3 and abs(p[3] - q[3]) < 0.0005)
    for block, deal in ((64, 4096), (2, 3)):
        got = ordered.band_keys(df, "id", "t", 50, near, block, deal)
        assert sorted((min(r), max(r)) for r in got.collect()) == want


def test_pairs_of_copies_are_made_after_the_join(spark, monkeypatch):
    # 30 recordings, 20 copies of each, and one id that stands at two times: no pair with itself
    rows = [(100 * c + i, i * 20, 1000 + i, 900 + i, 5000 + i, i % 3 != 0, (i % 2) * 0.001) for c in range(20) for i in range(30)] + [(1, 25, 1001, 901, 5001, False, 0.0)]
    df = spark.createDataFrame(rows, "id long, s long, el long, mv long, d long, gps boolean, lat double")
    monkeypatch.setattr(running, "_recordings", lambda *_: df)
    got = running.recording_pairs(spark, "")
    one = lambda p, q: p[0] != q[0] and abs(p[1] - q[1]) <= 300 and not (p[5] and q[5] and p[6] != q[6])
    assert sorted(map(tuple, got.collect())) == sorted((min(p[0], q[0]), max(p[0], q[0])) for i, p in enumerate(rows) for q in rows[:i] if one(p, q))
    above = plan(got).split("join inner")[0]
    assert above.count("generate explode") == 2  # what meets are sets of equal recordings


def test_bands_are_shuffled_once_for_both_sides(spark):
    # half of the rows lie up to a width behind a border of buckets (1200 wide, at 600), a quarter just beyond it, and one bucket is hot
    rows = [(i, 600 + 1200 * (i % 5) + (i * 7 % 40) * 10) for i in range(60)] + [(100 + i, 1790 + i // 3) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, t long").repartition(3)
    got = ordered.band_keys(df, "id", "t", 300, lambda x, y: F.lit(True), deal=20)
    want = sorted((min(p[0], q[0]), max(p[0], q[0])) for i, p in enumerate(rows) for q in rows[:i] if abs(p[1] - q[1]) <= 300)
    assert sorted((min(r), max(r)) for r in got.collect()) == want
    done = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    assert len([x for x in done if "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" in x and "Reused" not in x]) == 1


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))


def dense_places(spark, rng, n):
    at = lambda: (52 + rng.choice((0, 0.0007, 0.004)) + rng.random() * rng.choice((1e-6, 1e-3)), 5 + rng.random() * rng.choice((1e-6, 3e-3)))
    rows = {i: at() for i in range(n)} | {n + i: (52.0, 5.0) for i in range(40)} | {n + 50: (53.0, 5.0)}
    return rows, spark.createDataFrame([(i, *p) for i, p in rows.items()], "id long, lat double, lon double")


def test_clusters_of_dense_places(spark):
    rows, df = dense_places(spark, random.Random(4), 120)
    got = {r.id: r.c for r in lines.clusters(df, 60.0).collect()}
    assert got == components(rows, lambda i, j: metres(rows[i], rows[j]) <= 60.0) and 2 < len(set(got.values())) < 120


def test_nearest_of_dense_places_begins_narrow(spark, monkeypatch):
    rows, df = dense_places(spark, random.Random(5), 300)
    asked = []
    nearby = lines.nearby
    monkeypatch.setattr(lines, "nearby", lambda a, b, m: asked.append(m) or nearby(a, b, m))
    got = {r.id: (r.r.id, r.m) for r in lines.nearest(df.where("id % 3 <> 0"), df.where("id % 3 = 0"), 300.0, "id", "id").collect()}
    want = {}
    for i, p in rows.items():
        near = [(round(metres(p, q), 6), -j) for j, q in rows.items() if j % 3 == 0 and metres(p, q) <= 300.0]
        if i % 3 and near:
            want[i] = -min(near)[1]
    assert {i: x[0] for i, x in got.items()} == want and len(asked) > 1 and asked[0] < 300.0


def test_crossings_send_no_row_for_each_cell_around(spark):
    df = spark.createDataFrame([(1, i, (i % 20) // 5, i % 5, 40.0 * i) for i in range(60)], "run long, i long, r long, c long, d double")
    got = segments.self_crossings(df, "run", "i")
    assert "generate" not in plan(got) and (0, 20) in {(r.i, r.j) for r in got.collect()}


def test_shared_cells_of_equal_sets(spark):
    rng = random.Random(6)
    sets = {k: {(x, 0) for x in rng.choice(((1, 2, 3), (1, 2), (3, 4, 5, 6), (7,), tuple(rng.sample(range(9), 3))))} for k in range(40)}
    df = spark.createDataFrame([(k, r, c) for k, s in sets.items() for r, c in s], "k long, r long, c long")
    got = {(r.a, r.b): r.share for r in lines.shared(df.union(df.limit(9)), "k", 0.5, block=3).collect()}
    want = {(a, b): len(s & t) / min(len(s), len(t)) for a, s in sets.items() for b, t in sets.items() if a < b and len(s & t) >= 0.5 * min(len(s), len(t))}
    assert got == want


def test_pairs_of_one_set_are_dealt_over_tasks(spark):
    df = spark.range(400).select(F.col("id").alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("r")).withColumn("c", F.when(F.col("k") < 30, 1).otherwise(0))
    rows = lines.shared(df, "k", 0.5, block=16).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b, r.share) for r in rows) == [(a, b, 1.0) for a in range(400) for b in range(a + 1, 400) if (a < 30) == (b < 30)]
    tasks = [r.task for r in rows]
    assert max(map(tasks.count, set(tasks))) < len(rows) / 4


def test_typical_laps_from_spans_and_cells(spark):
    rng = random.Random(7)
    at = lambda k: (52 + 0.002 * math.sin(k / 3) + rng.random() * 1e-4, 5 + 0.003 * math.cos(k / 3) + rng.random() * 1e-4)
    cells = spark.createDataFrame([(run, 2 * k, *at(k)) for run in range(9) for k in range(60)], "run long, i long, lat double, lon double")
    laps = [(g, f"{run}:{lo:03d}", run, lo, lo + rng.randrange(2, 40)) for g in ("p", "q") for run in range(9) for lo in sorted(rng.sample(range(80), 4))]
    laps += [("p", "0:200", 0, 2, 20), ("p", "0:200", 0, 50, 70), ("r", "1:000", 1, 0, 2), ("s", "2:000", 2, 0, 30), ("s", "3:000", 2, 0, 30)]
    laps = spark.createDataFrame(laps, "g string, lap string, run long, lo long, hi long")
    points = laps.join(cells, "run").where("i between lo and hi")
    want = {r.g: (r.lap, round(r.cost, 5)) for r in segments.medoids(segments.aligned_laps(points, "g", "lap", "i"), "g", "lap").collect()}
    assert set(want) == {"p", "q", "s"}
    for block in (1024, 7):
        assert {r.g: (r.lap, round(r.cost, 5)) for r in segments.typical(laps, cells, "g", "lap", "run", block).collect()} == want


def test_chains_grow_from_rows_in_the_order_of_their_seeds(spark):
    rng = random.Random(9)
    runs = {k: [rng.randrange(3)] for k in range(12)}
    for way in runs.values():
        for _ in range(40):
            way.append((way[-1] + rng.choice((1, 1, 1, 2, 3))) % 50)
    moves = {(k, a, b) for k, way in runs.items() for a, b in zip(way, way[1:])}
    hot = spark.createDataFrame(sorted(moves), "run long, a long, b long")
    seeds = hot.select(F.col("a").alias("sa"), F.col("b").alias("sb")).distinct()
    got = segments.grown(seeds, hot, 2, 30)
    assert "flatmapgroups" not in plan(got)  # a task takes many seeds, not one call each
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        have = {(r.sa, r.sb): r.chain for r in segments.grown(seeds, hot, 2, 30).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for (sa, sb), chain in have.items():
            on, back = {}, {}
            near = {k for k, a, b in moves if (a, b) == (sa, sb)}
            n = {}
            for k, a, b in moves:
                n[a, b] = n.get((a, b), 0) + (k in near)
            for (a, b), c in sorted(n.items(), key=lambda x: (x[1], -x[0][1], -x[0][0])):
                if c >= 2:
                    on[a] = b
            for (a, b), c in sorted(n.items(), key=lambda x: (x[1], -x[0][0])):
                if c >= 2:
                    back[b] = a
            want = segments._walk(on, sa, sb, 30)
            assert chain == (want if want[0] == want[-1] else segments._walk(back, sb, sa, 30)[:1:-1] + want)
        assert set(have) == {s for s in {(a, b) for _, a, b in moves} if len({k for k, a, b in moves if (a, b) == s}) >= 2}


def test_efforts_of_many_runs_come_from_rows_in_the_order_of_chain_and_run(spark):
    rng = random.Random(12)
    code = lambda r, c: r * (1 << 32) + c + (1 << 31)
    chains = [(f"c{k}", [code(4 * k, c) for c in range(6)], 125.0) for k in range(3)]
    cells = []
    for run in range(9):
        way = [(4 * k, c) for k in rng.sample(range(3), 3) for c in range(-2, 9)]
        cells += [(run, i, code(*x), 25.0 * i, float(i * (1 + run % 4))) for i, x in enumerate(way)]
    cells, chains = spark.createDataFrame(cells, "run long, i long, cell long, d double, t double"), spark.createDataFrame(chains, "id string, chain array<long>, length_m double")
    got = benchmarks.chain_efforts(cells, chains, "run")
    assert "flatmapgroups" not in plan(got)  # a task takes many runs, not one call each
    rows = {}
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        rows[size] = sorted(map(tuple, benchmarks.chain_efforts(cells, chains, "run").collect()))
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows["7"] == rows["10000"] and [r[:2] for r in rows["7"]] == [(f"c{k}", run) for k in range(3) for run in range(9)]
    # in beside the first cell, out beside the last but the way must hold 80 % of the cells: the fastest has four steps
    assert all((r[3] - r[2], r[4], r[5]) == (4, 100.0, 4.0 * (1 + r[1] % 4)) for r in rows["7"])
