"""Queries over recordings, corridors, laps and segments, on walks that are derived from the events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.operators import benchmarks, graph, heart, lines, pauses, segments
from strideline.plans.catalog import REC, query, r, rounded
from strideline.plans.geometry import _NEAR, A, beats
from strideline.sources import recordings
from strideline.sources.views import records, table

#: Metres between two samples of a walk, and of a degree.
STRIDE, DEGREE = 30, 111320.0
#: A walk goes around a square block of 420, 480, 540 or 600 m, by its athlete's number, after a straight way of 300 m that
#: all of its town share, twelve athletes each; heights rise along that way. It stands in for tracks, which the tables don't
#: hold.
WALK = f"""{REC}, step AS (SELECT athlete_id, i - 1 AS i, epoch, hr, (i - 1) * {STRIDE} AS d, 105 + athlete_id % 4 * 15 AS side FROM record),
leg AS (SELECT *, greatest(d - 300, 0) % (4 * side) AS m FROM step),
flat AS (SELECT *, CASE WHEN d < 300 THEN d - 300.0e0 WHEN m < side THEN m WHEN m < 2 * side THEN side WHEN m < 3 * side THEN 3 * side - m ELSE 0 END AS x,
  CASE WHEN d < 300 THEN 0.0e0 WHEN m < side THEN 0 WHEN m < 2 * side THEN m - side WHEN m < 3 * side THEN side ELSE 4 * side - m END AS y FROM leg),
walk AS (SELECT athlete_id, i, epoch, hr, d, 52 + (athlete_id // 12) * 0.01e0 + (y + hr % 3) / {DEGREE}e0 AS lat, 5 + (x + hr % 5) / 68535.0e0 AS lon, CASE WHEN d < 300 THEN d / 10.0e0 ELSE 30 END AS elev FROM flat)"""


def walks(spark, sf):
    """athlete_id, i, epoch, t, d, lat, lon, elev, hr of the walk that WALK tells."""
    s = records(spark, sf).select(A, (F.col("i") - 1).cast("long").alias("i"), "epoch", "hr", ((F.col("i") - 1) * STRIDE).cast("long").alias("d"), (105 + F.col(A) % 4 * 15).alias("side"))
    d, side = F.col("d"), F.col("side")
    m = F.greatest(d - 300, F.lit(0)) % (4 * side)
    x = F.when(d < 300, d - 300.0).when(m < side, m).when(m < 2 * side, side).when(m < 3 * side, 3 * side - m).otherwise(0)
    y = F.when((d < 300) | (m < side), 0.0).when(m < 2 * side, m - side).when(m < 3 * side, side).otherwise(4 * side - m)
    return s.select(
        A, "i", "epoch", (F.col("i") * 4 + F.col("hr") % 3).alias("t"), "d", (52 + F.floor(F.col(A) / 12) * 0.01 + (y + F.col("hr") % 3) / DEGREE).alias("lat"), (5 + (x + F.col("hr") % 5) / 68535.0).alias("lon"),
        F.when(d < 300, d / 10.0).otherwise(30.0).alias("elev"), "hr",
    )


def walk_cells(spark, sf):
    """A walk's samples where it comes into another cell, numbered from 0, with the cell's row and column."""
    s = walks(spark, sf)
    step = segments.CELL_M / DEGREE
    row = F.floor(F.col("lat") / step)
    s = s.withColumn("r", row.cast("long")).withColumn("c", F.floor(F.col("lon") / (segments.CELL_M / 68535.0)).cast("long"))
    w = W.partitionBy(A).orderBy("i")
    s = s.withColumn("_p", F.lag(F.struct("r", "c")).over(w)).where("_p is null or _p.r <> r or _p.c <> c").drop("_p")
    return s.withColumn("i", (F.row_number().over(w) - 1).cast("long")).withColumn("cell", segments.cell_code(F.col("r"), F.col("c")))


WALK_CELLS = f"{WALK}, rc AS (SELECT *, CAST(floor(lat / ({segments.CELL_M}e0 / {DEGREE}e0)) AS BIGINT) AS r, CAST(floor(lon / ({segments.CELL_M}e0 / 68535.0e0)) AS BIGINT) AS c, i * 4 + hr % 3 AS t FROM walk), cell AS (SELECT athlete_id, row_number() OVER (PARTITION BY athlete_id ORDER BY i) - 1 AS i, r, c, d, t, lat, lon FROM (SELECT *, lag(r) OVER w AS pr, lag(c) OVER w AS pc FROM rc WINDOW w AS (PARTITION BY athlete_id ORDER BY i)) x WHERE pr IS NULL OR pr <> r OR pc <> c)"


def _scratch(spark):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strideline-")
    return f"{base.rstrip('/')}/recordings-{uuid.uuid4().hex}"


#: Recordings hold places as so many parts of a degree.
SEMI = "(2147483648 / 180.0e0)"


@query(f"""{WALK} SELECT CAST(athlete_id AS VARCHAR) AS file, count(*) AS records, {r('max(d) / 1000.0e0')} AS total_km, max(epoch) - min(epoch) AS seconds, CAST(sum(hr) AS BIGINT) AS beats, {r(f'avg(round(lat * {SEMI}) / {SEMI})', 6)} AS lat, {r(f'avg(round(lon * {SEMI}) / {SEMI})', 6)} AS lon, {r('avg(round(elev * 5) / 5)', 3)} AS elev, 'running' AS sport FROM walk GROUP BY athlete_id""")
def recordings_read(spark, sf):
    """Walks written as binary recordings, one file each, and read back: what their records, laps and sessions say."""
    w = walks(spark, sf)
    where = _scratch(spark)
    samples = w.select(A, "i", F.col("epoch").alias("at"), "lat", "lon", F.col("elev").alias("altitude_m"), F.col("hr").cast("double").alias("heart_rate"), F.col("d").cast("double").alias("distance_m"))
    recordings.write_recordings(samples, A, "i", where).count()
    s = recordings.run_stats(recordings.read_recordings(spark, where))
    last = F.element_at("samples", -1)["at"]
    mean = lambda name: F.aggregate(F.transform("samples", lambda p: p[name]), F.lit(0.0), lambda a, b: a + b) / F.size("samples")
    total = F.aggregate("beats", F.lit(0.0), lambda a, b: a + b["heart_rate"]).cast("long")
    out = s.where("error is null").select("file", "records", F.col("total_km"), (last - F.element_at("samples", 1)["at"]).alias("seconds"), total.alias("beats"), mean("lat").alias("lat"), mean("lon").alias("lon"), mean("altitude_m").alias("elev"), "sport")
    return rounded(rounded(rounded(out, "total_km"), "lat", "lon", digits=6), "elev", digits=3)


@query()
def corridor_chains(spark, sf):
    """Corridors that two walks or more take, cut where they come back near themselves."""
    chains = segments.corridors(segments.steps(walk_cells(spark, sf), A, "i"))
    return segments.split_at_loops(chains).select("sa", "sb", "n", "piece", "chain")


@query(f"""{WALK_CELLS}, v AS (SELECT a.athlete_id, max(b.i) AS i, a.i AS j, arg_max(b.d, b.i) AS di, a.d AS dj FROM cell a JOIN cell b ON a.athlete_id = b.athlete_id AND b.i < a.i AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.athlete_id, a.i, a.d, b.r, b.c)
SELECT DISTINCT athlete_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM v WHERE j - i >= 8 AND dj - di BETWEEN 300 AND 12000""")
def self_crossings(spark, sf):
    """Where walks come back to themselves: from each sample to the last one before in each cell around."""
    return segments.self_crossings(walk_cells(spark, sf), A, "i")


@query(f"""{WALK_CELLS}, v AS (SELECT a.athlete_id, max(b.i) AS i, a.i AS j, arg_max(b.d, b.i) AS di, a.d AS dj FROM cell a JOIN cell b ON a.athlete_id = b.athlete_id AND b.i < a.i AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.athlete_id, a.i, a.d, b.r, b.c),
k AS (SELECT DISTINCT athlete_id, i, j, di, dj FROM v WHERE j - i >= 8 AND dj - di BETWEEN 300 AND 12000),
u AS (SELECT k.athlete_id, k.i, k.j, max(dj - di) AS dist_m, count(DISTINCT (c.r, c.c)) AS cells, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon FROM k JOIN cell c ON c.athlete_id = k.athlete_id AND c.i BETWEEN k.i AND k.j GROUP BY 1, 2, 3)
SELECT athlete_id, count(*) AS loops, CAST(sum(i) AS BIGINT) AS starts, CAST(sum(dist_m) AS BIGINT) AS metres, {r('avg(lat)', 6)} AS lat, {r('avg(lon)', 6)} AS lon FROM u WHERE cells >= 0.8e0 * n GROUP BY 1""")
def loops_at_all_scales(spark, sf):
    """Self-crossings that pass four fifths of their cells once."""
    g = segments.loop_instances(walk_cells(spark, sf), A, "i").groupBy(A).agg(F.count("*").alias("loops"), F.sum("i").alias("starts"), F.sum("dist_m").cast("long").alias("metres"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return rounded(g, "lat", "lon", digits=6)


@query(f"""{WALK_CELLS}, v AS (SELECT a.athlete_id, max(b.i) AS i, a.i AS j, arg_max(b.d, b.i) AS di, a.d AS dj FROM cell a JOIN cell b ON a.athlete_id = b.athlete_id AND b.i < a.i AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.athlete_id, a.i, a.d, b.r, b.c),
f AS (SELECT athlete_id, arg_min(i, (j, i)) AS lo, min(j) AS hi FROM v WHERE j - i >= 8 AND dj - di BETWEEN 300 AND 12000 GROUP BY 1)
SELECT f.athlete_id, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, CAST(b.t - a.t AS BIGINT) AS t FROM f JOIN cell a ON a.athlete_id = f.athlete_id AND a.i = lo JOIN cell b ON b.athlete_id = f.athlete_id AND b.i = hi""")
def first_spans(spark, sf):
    """Where each walk comes back to itself for the first time, and how long that took."""
    c = walk_cells(spark, sf)
    first = segments.self_crossings(c, A, "i").groupBy(A).agg(F.min_by(F.struct("i", "j"), F.struct("j", "i")).alias("s")).select(A, F.col("s.i").alias("lo"), F.col("s.j").alias("hi"))
    at = lambda name: c.select(A, F.col("i").alias(name), F.col("t").alias(f"t_{name}"))
    return first.join(at("lo"), [A, "lo"]).join(at("hi"), [A, "hi"]).select(A, "lo", "hi", (F.col("t_hi") - F.col("t_lo")).cast("long").alias("t"))


@query()
def run_laps(spark, sf):
    """The laps that each walk repeats."""
    return rounded(rounded(segments.closed_laps(walk_cells(spark, sf), A, "i"), "dist_m", "time_s", "round"), "lat", "lon", digits=6)


@query()
def typical_laps(spark, sf):
    """Of the laps around each block of each town the one that is nearest to all others."""
    c = graph.checkpointed(walk_cells(spark, sf))
    laps = segments.closed_laps(c, A, "i").withColumn("lap", F.concat_ws(":", A, F.lpad(F.col("i").cast("string"), 7, "0")))
    laps = laps.select(F.concat_ws("-", F.floor(F.col(A) / 12), F.col(A) % 4).alias("block"), "lap", A, F.col("i").alias("lo"), F.col("j").alias("hi"))
    laps = graph.checkpointed(laps)  # read twice
    return rounded(segments.typical(laps, c, "block", "lap", A), "cost", digits=3)


@query(f"""{WALK}, n AS (SELECT * FROM walk WHERE athlete_id % 8 < 4), m AS (SELECT * FROM walk WHERE athlete_id % 8 >= 4),
k AS (SELECT DISTINCT a.athlete_id, a.i FROM n a JOIN m b ON a.athlete_id // 12 = b.athlete_id // 12 AND {_NEAR} <= 25)
SELECT n.athlete_id, {r('count(k.i) / CAST(count(*) AS DOUBLE)')} AS share FROM n LEFT JOIN k USING (athlete_id, i) GROUP BY 1""")
def line_coverage(spark, sf):
    """How much of each walk of one half of the athletes lies within 25 m of any of the other half's."""
    s = walks(spark, sf).select(A, "i", "lat", "lon")
    return rounded(lines.coverage(s.where(f"{A} % 8 < 4"), s.where(f"{A} % 8 >= 4"), A, 25.0), "share")


@query(f"""{WALK}, n AS (SELECT * FROM walk WHERE athlete_id % 8 < 4), m AS (SELECT * FROM walk WHERE athlete_id % 8 >= 4)
SELECT a.athlete_id AS line, b.athlete_id AS run, count(DISTINCT a.i) AS vertices FROM n a JOIN m b ON a.athlete_id // 12 = b.athlete_id // 12 AND {_NEAR} <= 25 GROUP BY 1, 2 HAVING count(DISTINCT a.i) >= 2""")
def line_vertex_matches(spark, sf):
    """How many of a walk's points another comes within 25 m of, where it is two or more."""
    s = walks(spark, sf).select(A, "i", "lat", "lon")
    near = lines.nearby(s.where(f"{A} % 8 < 4"), s.where(f"{A} % 8 >= 4"), 25.0)
    once = near.groupBy(F.col(f"l.{A}").alias("line"), F.col(f"r.{A}").alias("run"), F.col("l.i").alias("i")).agg(F.lit(1).alias("_o"))
    return once.groupBy("line", "run").agg(F.count("*").alias("vertices")).where("vertices >= 2")


@query()
def pauses_on_line(spark, sf):
    """Stretches of each walk's line that its pauses take: a stop at every 40th sample, found on a line of every third one."""
    w = walks(spark, sf)
    line = w.where("i % 3 = 0").withColumn("i", (F.row_number().over(W.partitionBy(A).orderBy("i")) - 1).cast("long"))
    after = W.partitionBy(A).orderBy("i")
    ends = w.select(A, "i", (F.col("d") / 1000.0).alias("d"), "lat", "lon", (F.lead("d").over(after) / 1000.0).alias("d2"), F.lead("lat").over(after).alias("rlat"), F.lead("lon").over(after).alias("rlon"), (F.lead("d").over(after) - F.col("d")).cast("double").alias("move_m"))
    return pauses.snapped(line, ends.where("i % 40 = 39"), A, "i")


_TOWNS = f"""{WALK_CELLS}, chain AS (SELECT athlete_id // 12 AS id, i, r, c, d FROM cell WHERE athlete_id IN (SELECT min(athlete_id) FROM cell GROUP BY athlete_id // 12) AND d <= 300),
ends AS (SELECT id, arg_min(r, i) AS ar, arg_min(c, i) AS ac, arg_max(r, i) AS br, arg_max(c, i) AS bc, count(DISTINCT (r, c)) AS size, CAST(max(d) - min(d) AS DOUBLE) AS len FROM chain GROUP BY 1),
s AS (SELECT id, athlete_id, i, d, t FROM cell JOIN ends ON abs(r - ar) <= 1 AND abs(c - ac) <= 1), e AS (SELECT id, athlete_id, i, d, t FROM cell JOIN ends ON abs(r - br) <= 1 AND abs(c - bc) <= 1),
p AS (SELECT id, athlete_id, s.i AS si, e.i AS ei, e.d - s.d AS dist, e.t - s.t AS tm, size FROM s JOIN e USING (id, athlete_id) JOIN ends USING (id) WHERE e.i > s.i AND e.d - s.d BETWEEN 0.7e0 * len AND 1.4e0 * len AND e.t > s.t),
v AS (SELECT p.id, p.athlete_id, si, ei, dist, tm, max(size) AS size, count(DISTINCT (x.r, x.c)) AS n FROM p JOIN cell x ON x.athlete_id = p.athlete_id AND x.i BETWEEN si AND ei JOIN (SELECT DISTINCT id, r, c FROM chain) y ON y.id = p.id AND y.r = x.r AND y.c = x.c GROUP BY ALL)"""


def town_chains(spark, sf):
    """The straight way of each town's first athlete."""
    c = walk_cells(spark, sf).withColumn("id", F.floor(F.col(A) / 12).cast("long"))
    first = c.groupBy("id").agg(F.min(A).alias(A)).select(A)
    way = c.join(first, A, "left_semi").where("d <= 300")
    return way.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "cell"))), lambda x: x["cell"]).alias("chain"), (F.max("d") - F.min("d")).cast("double").alias("length_m"))


@query(f"""{_TOWNS} SELECT id, athlete_id, CAST(arg_min(si, (tm, si, ei)) AS BIGINT) AS si, CAST(arg_min(ei, (tm, si, ei)) AS BIGINT) AS ei, {r('arg_min(dist, (tm, si, ei))')} AS dist_m, {r('min(tm)')} AS time_s FROM v WHERE n >= 0.8e0 * size GROUP BY 1, 2""")
def chain_efforts(spark, sf):
    """Each walk's fastest way along each town's straight way."""
    return rounded(benchmarks.chain_efforts(walk_cells(spark, sf), town_chains(spark, sf), A), "dist_m", "time_s")


@query()
def corridor_segments(spark, sf):
    """Segments of all corridors that walks share, with their climbs: what they are, how often and how fast they were taken."""
    c = graph.checkpointed(walk_cells(spark, sf))  # read by every step
    days = c.select(A).distinct().withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.xxhash64(A), F.lit(120)).cast("int")))
    got = benchmarks.corridor_segments(c, days, A, segments.CELL_M / DEGREE, segments.CELL_M / 68535.0)
    return rounded(got.select("id", "kind", "length_m", "gain_m", "grade", "n_efforts", "runs", "span_days", "best_s"), "length_m", "gain_m", "grade", "best_s", digits=3)


@query()
def fastest_loops(spark, sf):
    """Of the loops of each walk, at all scales, the fastest ones that don't meet."""
    return lines.fastest_spans(segments.loop_instances(walk_cells(spark, sf), A, "i").select(A, "i", "j", "time_s"), A, "i", "j", "time_s")


@query()
def anchored_segments(spark, sf):
    """Laps of every walk along the line of an anchor in the middle of each town's smallest block, wherever they begin."""
    c = graph.checkpointed(walk_cells(spark, sf))
    towns = c.groupBy(F.floor(F.col(A) / 12).cast("string").alias("id")).agg(F.min(A).alias("_a"))
    anchors = towns.select("id", (52 + F.col("id").cast("int") * 0.01 + 52.5 / DEGREE).alias("lat"), F.lit(5 + 52.5 / 68535.0).alias("lon"), F.lit(420.0).alias("len_m"))
    track = walks(spark, sf)
    days = c.select(A).distinct().withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.xxhash64(A), F.lit(120)).cast("int")))
    got = benchmarks.anchored_segments(anchors, segments.loop_instances(c, A, "i"), c, track, days, A, least_days=0)
    return rounded(got.select("id", "kind", "length_m", "round", "n_efforts", "runs", "best_s"), "length_m", "round", "best_s", digits=3)


def mined(spark, sf):
    """Segments of the walks' legs in each town: id, kind, lengths, efforts and places, with who took them."""
    w = walks(spark, sf).withColumn("leg", F.floor(F.col("d") / 150))
    e = w.groupBy(A, "leg").agg(F.max("d").alias("hi"), F.min("d").alias("lo"), F.min_by(F.struct("lat", "lon"), "i").alias("s"), F.max_by(F.struct("lat", "lon"), "i").alias("e"), F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    e = e.withColumn("id", F.concat_ws("-", F.floor(F.col(A) / 12), F.col(A) % 3, "leg"))  # three groups of each town go over the same ground
    first = e.groupBy("id").agg(F.min_by(F.struct("s", "e", "c_lat", "c_lon"), A).alias("p"), F.max(F.col("hi") - F.col("lo")).cast("double").alias("length_m"), F.count_distinct(A).alias("n_efforts"), (F.min("leg") % 5 == 4).alias("is_loop"))
    s = first.select(
        "id", F.when(F.col("is_loop"), "loop").otherwise("segment").alias("kind"), "length_m", "n_efforts", (F.col("n_efforts") % 3 == 0).alias("auto"), F.lit(False).alias("curated"),
        *(F.col(f"p.{p}.{x}").alias(f"{p}_{x}") for p in ("s", "e") for x in ("lat", "lon")), F.col("p.c_lat").alias("c_lat"), F.col("p.c_lon").alias("c_lon"),
    )
    return s, e.select("id", F.col(A).alias("run"))


@query()
def segments_deduplicated(spark, sf):
    s, e = mined(spark, sf)
    return segments.deduplicated(s, e).select("id", "kind", "length_m", "n_efforts")


@query()
def canonical_loops(spark, sf):
    """The shortest loop of each place with the efforts that it takes over."""
    s, e = mined(spark, sf)
    stay, pooled = segments.canonical_loops(s.where("kind = 'loop'"), e)
    return stay.select("id", "length_m").join(pooled.groupBy("id").agg(F.count_distinct("run").alias("runs")), "id")


@query()
def monthly_uptake(spark, sf):
    """The best oxygen uptake by heart rate of each month, with how many runs and windows it rests on."""
    b = beats(spark, sf)
    day = table(spark, sf, "events").groupBy(F.col("user_id").alias(A)).agg(F.to_date(F.min("ts")).alias("day"))
    beating = b.groupBy(A).agg(F.count("hr").alias("hr_pts"))
    return heart.monthly_uptake(heart.run_uptake(b, A, 190.0, 50.0), beating.join(day, A), A)


STD = "('5 km', 5000.0e0), ('10 km', 10000.0e0), ('Half marathon', 21097.5e0), ('Marathon', 42195.0e0)"


@query(f"""WITH race AS (SELECT p_partkey AS n, p_name AS name, CAST(round(p_retailprice, 0) * 20 AS DOUBLE) AS d FROM part), std(label, d) AS (VALUES {STD}),
near AS (SELECT label, min_by(name, n) AS race FROM std JOIN race ON abs(race.d - std.d) / std.d <= 0.02e0 GROUP BY 1)
SELECT label, std.d AS dist_m, race FROM std LEFT JOIN near USING (label) UNION ALL SELECT name, race.d, name FROM race WHERE NOT EXISTS (SELECT 1 FROM std WHERE abs(race.d - std.d) / std.d <= 0.02e0)""")
def prediction_rows(spark, sf):
    """Standard distances with the first configured race within 2 %, and the races that are near none of them."""
    race = table(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.col("p_name").alias("name"), (F.round("p_retailprice", 0) * 20).cast("double").alias("d"))
    standard = [("5 km", 5000.0), ("10 km", 10000.0), ("Half marathon", 21097.5), ("Marathon", 42195.0)]
    near = F.array_compact(F.array(*(F.when(F.abs(F.col("d") - m) / m <= 0.02, F.lit(label)) for label, m in standard)))
    race = race.withColumn("near", near)  # four distances: an expression, no join
    first = race.select(F.explode("near").alias("label"), "n", "name").groupBy("label").agg(F.min_by("name", "n").alias("race"))
    std = spark.createDataFrame(standard, "label string, dist_m double").join(first, "label", "left")
    return std.unionByName(race.where("size(near) = 0").select(F.col("name").alias("label"), F.col("d").alias("dist_m"), F.col("name").alias("race")))
