"""Queries over tracks, places and segments, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.functions import physiology as ph
from strideline.operators import lines, ordered, ranking
from strideline.plans.catalog import ACT, HAV, REC, query, r, rounded
from strideline.sources.archive import POINT, json_array
from strideline.sources.views import activities, records, table

TRACK = f"{REC}, track AS (SELECT athlete_id, i, epoch, (i - 1) * 10 AS t, 40 + (hr - 60) % 40 / 100000.0e0 AS lat, 10 + athlete_id % 4 / 1000.0e0 + (hr * 7) % 13 / 100000.0e0 AS lon, (i - 1) * 30.0e0 + hr % 7 AS d, CASE WHEN i % 3 <> 0 THEN 100.0e0 + hr % 50 END AS elev, hr FROM record)"
DIST = HAV.replace("(radians(q) - radians(p))", "(radians(lat) - radians(p_lat))").replace("cos(radians(p)) * cos(radians(q))", "cos(radians(p_lat)) * cos(radians(lat))").replace("radians(t - s)", "radians(lon - p_lon)")
STEP = f"{TRACK}, step AS (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(d) OVER w AS p_d, lag(t) OVER w AS p_t FROM track WINDOW w AS (PARTITION BY athlete_id ORDER BY i)), gap AS (SELECT *, CASE WHEN p_lat IS NOT NULL THEN {DIST} END AS g FROM step)"
A = "athlete_id"


def track(spark, sf):
    """An athlete's events as a small track: place, time, distance, and height for two samples of three."""
    e, i, hr = records(spark, sf), F.col("i").cast("long"), F.col("hr")
    return e.select(
        A, i.alias("i"), "epoch", ((i - 1) * 10).alias("t"), (40 + (hr - 60) % 40 / 100000.0).alias("lat"), (10 + F.col(A) % 4 / 1000.0 + (hr * 7) % 13 / 100000.0).alias("lon"),
        ((i - 1) * 30.0 + hr % 7).alias("d"), F.when(i % 3 != 0, 100.0 + hr % 50).alias("elev"), "hr",
    )


@query(f"{STEP}, b AS (SELECT athlete_id, i, degrees(atan2(sin(radians(lon - p_lon)) * cos(radians(lat)), cos(radians(p_lat)) * sin(radians(lat)) - sin(radians(p_lat)) * cos(radians(lat)) * cos(radians(lon - p_lon)))) AS x FROM step WHERE p_lat IS NOT NULL AND (lat <> p_lat OR lon <> p_lon)) SELECT athlete_id, i, list_extract(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], CAST(floor(((CASE WHEN x < 0 THEN x + 360 ELSE x END) + 22.5e0) / 45) AS INT) % 8 + 1) AS bearing FROM b")
def bearing_labels(spark, sf):
    s = track(spark, sf).withColumns(lines.before(A, "i", "lat", "lon")).where("p_lat is not null and (lat <> p_lat or lon <> p_lon)")
    return s.select(A, "i", lines.bearing_label(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")).alias("bearing"))


@query(f"{STEP}, x AS (SELECT athlete_id, sqrt(pow((lon - p_lon) * 111320.0e0 * cos(radians(first_lat)), 2) + pow((lat - p_lat) * 111320.0e0, 2)) AS m FROM (SELECT *, first_value(lat) OVER (PARTITION BY athlete_id ORDER BY i) AS first_lat FROM step) q WHERE p_lat IS NOT NULL) SELECT athlete_id, {r('sum(m)', 2)} AS metres FROM x GROUP BY 1")
def flat_lengths(spark, sf):
    """A line's length in a flat projection around its first place."""
    s = track(spark, sf).withColumns(lines.before(A, "i", "lat", "lon")).withColumn("f", F.first("lat").over(W.partitionBy(A).orderBy("i"))).where("p_lat is not null")
    m = F.hypot((F.col("lon") - F.col("p_lon")) * lines.DEGREE_M * F.cos(F.radians("f")), (F.col("lat") - F.col("p_lat")) * lines.DEGREE_M)
    return rounded(s.groupBy(A).agg(F.sum(m).alias("metres")), "metres", digits=2)


@query(f"{STEP}, n AS (SELECT *, CASE WHEN g > 15 THEN CAST(floor(g / 15) AS INT) ELSE 0 END AS n FROM gap), x AS (SELECT *, unnest(range(0, coalesce(n, 0) + 1)) AS j FROM n) SELECT athlete_id, i, CAST(j AS INT) AS j, {r('CASE WHEN j = 0 THEN lat ELSE p_lat + j / (n + 1.0e0) * (lat - p_lat) END', 7)} AS lat, {r('CASE WHEN j = 0 THEN d ELSE p_d + j / (n + 1.0e0) * (d - p_d) END', 3)} AS d FROM x")
def densified(spark, sf):
    s = lines.densify(track(spark, sf), A, "i", ["lat", "lon", "d", "t"])
    return rounded(rounded(s.select(A, "i", "j", "lat", "d"), "lat", digits=7), "d", digits=3)


@query(f"{STEP}, n AS (SELECT *, CASE WHEN g IS NULL THEN 1 ELSE greatest(1, CAST(floor(g / 10) AS INT)) END AS n FROM gap WHERE g IS NULL OR g > 0), x AS (SELECT *, unnest(range(1, n + 1)) AS k FROM n) SELECT athlete_id, i, CAST(k AS INT) AS k, {r('coalesce(p_lat + k / CAST(n AS DOUBLE) * (lat - p_lat), lat)', 7)} AS lat, {r('coalesce(p_lon + k / CAST(n AS DOUBLE) * (lon - p_lon), lon)', 7)} AS lon FROM x")
def resampled(spark, sf):
    return rounded(lines.resample(track(spark, sf), A, "i", 10.0), "lat", "lon", digits=7)


@query(f"{TRACK}, n AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY i) - 1 AS q, count(*) OVER (PARTITION BY athlete_id) AS n FROM track), k AS (SELECT athlete_id, least(CAST(round_even(k * (n - 1) / 19.0e0, 0) AS BIGINT), n - 1) AS q FROM (SELECT athlete_id, max(n) AS n FROM n GROUP BY 1) x, range(0, 20) g(k)) SELECT athlete_id, i FROM n WHERE n <= 20 OR (athlete_id, q) IN (SELECT athlete_id, q FROM k)")
def decimated(spark, sf):
    return lines.decimate(track(spark, sf), A, "i", 20).select(A, "i")


_KEPT = HAV.replace("(radians(q) - radians(p))", "(radians(t.lat) - radians(f.lat))").replace("cos(radians(p)) * cos(radians(q))", "cos(radians(f.lat)) * cos(radians(t.lat))").replace("radians(t - s)", "radians(t.lon - f.lon)")


@query(f"{TRACK}, fold(athlete_id, i, lat, lon, keep) AS (SELECT athlete_id, i, lat, lon, true FROM track WHERE i = 1 UNION ALL SELECT t.athlete_id, t.i, CASE WHEN {_KEPT} >= 20 THEN t.lat ELSE f.lat END, CASE WHEN {_KEPT} >= 20 THEN t.lon ELSE f.lon END, {_KEPT} >= 20 FROM fold f JOIN track t ON t.athlete_id = f.athlete_id AND t.i = f.i + 1) SELECT athlete_id, i FROM fold WHERE keep OR (athlete_id, i) IN (SELECT athlete_id, max(i) FROM track GROUP BY 1)")
def anchor_points(spark, sf):
    return lines.anchors(track(spark, sf), A, "i", 20.0).select(A, "i")


@query(f"{TRACK}, e AS (SELECT athlete_id, i, elev, elev - lag(elev) OVER (PARTITION BY athlete_id ORDER BY i) AS x FROM track WHERE elev IS NOT NULL) SELECT athlete_id, {r('max_by(elev, i) - min_by(elev, i)')} AS net, {r('coalesce(sum(greatest(x, 0)), 0)')} AS gain FROM e GROUP BY 1 HAVING count(*) >= 2")
def net_climb(spark, sf):
    e = track(spark, sf).where("elev is not null").withColumns(lines.before(A, "i", "elev"))
    g = e.groupBy(A).agg((F.max_by("elev", "i") - F.min_by("elev", "i")).alias("net"), F.coalesce(F.sum(F.greatest(F.col("elev") - F.col("p_elev"), F.lit(0.0))), F.lit(0.0)).alias("gain"), F.count("*").alias("n"))
    return rounded(g.where("n >= 2").select(A, "net", "gain"), "net", "gain")


@query(f"{TRACK}, p AS (SELECT a.athlete_id, a.i AS lo, a.d AS ad, a.elev AS ae, (SELECT min(b.d) FROM track b WHERE b.athlete_id = a.athlete_id AND b.d >= a.d + 150) AS bd FROM track a), s AS (SELECT p.athlete_id, lo, b.i AS hi, (b.elev - ae) / (b.d - ad) AS grade FROM p JOIN track b ON b.athlete_id = p.athlete_id AND b.d = p.bd WHERE ae IS NOT NULL AND b.elev IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY grade DESC, lo) AS q FROM s) SELECT athlete_id, lo, hi, {r('grade', 6)} AS grade FROM t WHERE q = 1")
def steepest_windows(spark, sf):
    return rounded(lines.steepest_window(track(spark, sf), A, "i", "d", "elev"), "grade", digits=6)


CELLS = f"{TRACK}, cell AS (SELECT athlete_id, i, d, t, CAST(floor(lat / 0.00005e0) AS BIGINT) AS r, CAST(floor((lon - 10) / 0.0003e0) AS BIGINT) AS c FROM track), seq AS (SELECT * FROM (SELECT *, lag((r, c)) OVER (PARTITION BY athlete_id ORDER BY i) AS p FROM cell) x WHERE p IS NULL OR p <> (r, c))"


def cells(spark, sf):
    """Each track as its cells in order, neighbouring repeats left out."""
    s = track(spark, sf).select(A, "i", "d", "t", F.floor(F.col("lat") / 0.00005).alias("r"), F.floor((F.col("lon") - 10) / 0.0003).alias("c"))
    w = W.partitionBy(A).orderBy("i")
    return s.withColumn("p", F.lag(F.struct("r", "c")).over(w)).where("p is null or p.r <> r or p.c <> c").drop("p")


@query(f"{CELLS} SELECT athlete_id, i, r, c FROM seq")
def cell_sequences(spark, sf):
    return cells(spark, sf).select(A, "i", "r", "c")


@query(f"{CELLS}, e AS (SELECT athlete_id, r, c, lead(r) OVER w AS r2, lead(c) OVER w AS c2 FROM seq WINDOW w AS (PARTITION BY athlete_id ORDER BY i)), k AS (SELECT r, c, r2, c2, count(DISTINCT athlete_id) AS n FROM e WHERE r2 IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT athlete_id) >= 2) SELECT r, c, count(*) AS successors, array_to_string(list(r2 || ':' || c2 ORDER BY r2, c2), ' ') AS next FROM k GROUP BY 1, 2")
def cell_successors(spark, sf):
    """Cells with the cells that two runs or more went on to."""
    w = W.partitionBy(A).orderBy("i")
    e = cells(spark, sf).select(A, "r", "c", F.lead("r").over(w).alias("r2"), F.lead("c").over(w).alias("c2")).where("r2 is not null").distinct()
    k = e.groupBy("r", "c", "r2", "c2").agg(F.count("*").alias("n")).where("n >= 2")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r2", "c2"))), lambda x: F.concat_ws(":", x["r2"].cast("string"), x["c2"].cast("string"))), " ")
    return k.groupBy("r", "c").agg(F.count("*").alias("successors"), text.alias("next"))  # a cell has eight neighbours, and few others


@query(f"{CELLS}, s AS (SELECT DISTINCT athlete_id, r, c FROM seq), n AS (SELECT athlete_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.athlete_id AS a, b.athlete_id AS b, count(*) AS k FROM s a JOIN s b ON a.r = b.r AND a.c = b.c AND a.athlete_id < b.athlete_id GROUP BY 1, 2) SELECT a, b, {r('k / CAST(least(x.n, y.n) AS DOUBLE)')} AS share FROM p JOIN n x ON x.athlete_id = a JOIN n y ON y.athlete_id = b WHERE k >= 0.1e0 * least(x.n, y.n)")
def shared_cells(spark, sf):
    """Pairs of tracks by how much of the smaller one's cells they share."""
    return lines.shared(cells(spark, sf).select(A, "r", "c"), A, 0.1, digits=4)  # rounded before pairs are made


@query(f"{TRACK}, s AS (SELECT *, CASE WHEN i % 6 <> 0 THEN 300.0e0 + hr % 60 END AS pace FROM track), x AS (SELECT *, coalesce((lag(pace) OVER w + pace) / 2 * (d - lag(d) OVER w) / 1000, 0) AS dt FROM s WINDOW w AS (PARTITION BY athlete_id ORDER BY i)) SELECT athlete_id, i, {r('sum(dt) OVER (PARTITION BY athlete_id ORDER BY i)')} AS elapsed FROM x")
def elapsed_from_pace(spark, sf):
    """Elapsed time where none is recorded: the mean pace of two neighbouring samples times the way between them."""
    w = W.partitionBy(A).orderBy("i")
    s = track(spark, sf).withColumn("pace", F.when(F.col("i") % 6 != 0, 300.0 + F.col("hr") % 60))
    dt = F.coalesce((F.lag("pace").over(w) + F.col("pace")) / 2 * (F.col("d") - F.lag("d").over(w)) / 1000, F.lit(0.0))
    return rounded(s.withColumn("dt", dt).select(A, "i", F.sum("dt").over(w).alias("elapsed")), "elapsed")


@query(f"{TRACK}, n AS (SELECT a.athlete_id, a.i, a.d, a.t, (SELECT min(b.i) FROM track b WHERE b.athlete_id = a.athlete_id AND b.i >= a.i AND b.d - a.d >= 50) AS j, max(a.i) OVER (PARTITION BY a.athlete_id) AS l FROM track a), p AS (SELECT n.athlete_id, n.i, CASE WHEN b.d > n.d AND b.t > n.t THEN (b.t - n.t) / ((b.d - n.d) / 1000) END AS pace FROM n JOIN track b ON b.athlete_id = n.athlete_id AND b.i = coalesce(j, l)) SELECT athlete_id, i, {r('CASE WHEN pace BETWEEN 120 AND 1200 THEN pace END')} AS pace FROM p")
def lookahead_pace(spark, sf):
    """The pace over the next 50 m, to the first sample that is so far on, else to the last; none if it is implausible."""
    s = track(spark, sf)
    w = W.partitionBy(A)
    at = F.min(F.struct(F.col("d"), F.col("i"), F.col("t"))).over(w.orderBy("d").rangeBetween(50, W.unboundedFollowing))  # d grows with i
    last = F.max_by(F.struct("d", "i", "t"), "i").over(w)
    s = s.withColumn("e", F.coalesce(at, last))
    pace = F.when((F.col("e.d") > F.col("d")) & (F.col("e.t") > F.col("t")), (F.col("e.t") - F.col("t")) / ((F.col("e.d") - F.col("d")) / 1000))
    return rounded(s.withColumn("pace", pace).select(A, "i", F.when(F.col("pace").between(120, 1200), F.col("pace")).alias("pace")), "pace")


PROBES = f"{TRACK}, probe AS (SELECT athlete_id, i, d + 7.5e0 AS d FROM track WHERE i % 2 = 0), fix AS (SELECT athlete_id, d, max(elev) AS elev FROM track WHERE elev IS NOT NULL AND i % 4 <> 0 GROUP BY 1, 2)"


@query(f"""{PROBES} SELECT athlete_id, i, {r('CASE WHEN lo IS NULL THEN he WHEN hi IS NULL THEN le WHEN hi - lo > 60 THEN CASE WHEN d - lo <= hi - d THEN le ELSE he END WHEN hi = lo THEN le ELSE le + (d - lo) / (hi - lo) * (he - le) END')} AS elev FROM (
SELECT p.*, l.d AS lo, l.elev AS le, h.d AS hi, h.elev AS he FROM probe p ASOF LEFT JOIN fix l ON p.athlete_id = l.athlete_id AND p.d > l.d ASOF LEFT JOIN fix h ON p.athlete_id = h.athlete_id AND p.d <= h.d) x""")
def height_at_distance(spark, sf):
    """Heights at places between the fixes; where these are over 60 m apart, the nearer one's."""
    s = track(spark, sf)
    got = lines.bracket(s.where("i % 2 = 0").select(A, "i", (F.col("d") + 7.5).alias("d")), s.where("elev is not null and i % 4 <> 0").select(A, "d", "elev"), A, "d", ["elev"])
    return rounded(got.select(A, "i", "elev"), "elev")


@query(f"{REC}, v AS (SELECT athlete_id, epoch // 86400 AS e, max_by(hr, i) AS hr FROM record WHERE event_type = 'click' GROUP BY 1, 2), s AS (SELECT DISTINCT athlete_id, epoch // 86400 AS e FROM record) SELECT athlete_id, e, hr FROM s LEFT JOIN v USING (athlete_id, e)")
def exact_epoch_values(spark, sf):
    """Values at exactly a sample's time; of several at one time the last recorded counts."""
    s = records(spark, sf).withColumn("e", F.floor(F.col("epoch") / 86400))
    return s.select(A, "e").distinct().join(s.where("event_type = 'click'").groupBy(A, "e").agg(F.max_by("hr", "i").alias("hr")), [A, "e"], "left")


FIXES = f"{TRACK}, f AS (SELECT athlete_id, i, d, CASE WHEN i % 5 = 0 THEN lat END AS lat FROM track)"


@query(f"""{FIXES}, k AS (SELECT athlete_id, i, d, lat FROM f WHERE lat IS NOT NULL) SELECT f.athlete_id, f.i, {r('CASE WHEN l.i IS NULL THEN h.lat WHEN h.i IS NULL OR f.d - l.d <= h.d - f.d THEN l.lat ELSE h.lat END', 7)} AS lat FROM f ASOF LEFT JOIN k l ON f.athlete_id = l.athlete_id AND f.i >= l.i ASOF LEFT JOIN k h ON f.athlete_id = h.athlete_id AND f.i <= h.i""")
def nearest_fix(spark, sf):
    """The place of the nearest sample that has one by distance, the earlier of equals."""
    fix = F.when(F.col("i") % 5 == 0, F.struct("d", "lat"))
    (_, up), (_, down) = ordered.around(A, "i")
    s = track(spark, sf).withColumn("l", F.last(fix, ignorenulls=True).over(up)).withColumn("h", F.last(fix, ignorenulls=True).over(down))
    near = F.when(F.col("l").isNull(), F.col("h.lat")).when(F.col("h").isNull() | (F.col("d") - F.col("l.d") <= F.col("h.d") - F.col("d")), F.col("l.lat")).otherwise(F.col("h.lat"))
    return rounded(s.select(A, "i", near.alias("lat")), "lat", digits=7)


CENTRES = f"{TRACK}, centre AS (SELECT athlete_id AS id, avg(lat) + (athlete_id % 5) * 0.05e0 AS lat, avg(lon) AS lon, count(*) AS runs, max(d) / 1000 AS km FROM track GROUP BY 1)"
_NEAR = HAV.replace("(radians(q) - radians(p))", "(radians(b.lat) - radians(a.lat))").replace("cos(radians(p)) * cos(radians(q))", "cos(radians(a.lat)) * cos(radians(b.lat))").replace("radians(t - s)", "radians(b.lon - a.lon)")
CLUSTERS = f"{CENTRES}, e AS (SELECT a.id AS a, b.id AS b FROM centre a JOIN centre b ON a.id <> b.id AND {_NEAR} <= 1200), reach(v, c) AS (SELECT id, id FROM centre UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.v), comp AS (SELECT v, min(c) AS c FROM reach GROUP BY 1)"


def centres(spark, sf):
    g = track(spark, sf).groupBy(A).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("runs"), (F.max("d") / 1000).alias("km"))
    return g.select(F.col(A).alias("id"), (F.col("lat") + F.col(A) % 5 * 0.05).alias("lat"), "lon", "runs", "km")


@query(f"{CLUSTERS} SELECT v AS id, c FROM comp")
def centre_clusters(spark, sf):
    return lines.clusters(centres(spark, sf), 1200.0)


@query(f"{CLUSTERS}, g AS (SELECT c, count(*) AS n, sum(km) AS km, avg(lat) AS lat, avg(lon) AS lon, min(lat) AS s, max(lat) AS n_lat FROM comp JOIN centre ON v = id GROUP BY 1) SELECT c, n, {r('km', 3)} AS km, {r('lat', 6)} AS lat, {r('lon', 6)} AS lon, {r('s', 6)} AS south, {r('n_lat', 6)} AS north, CAST(row_number() OVER (ORDER BY n DESC, round(km, 6) DESC, round(lat, 4), round(lon, 4), c) AS INT) AS place FROM g")
def hotspots(spark, sf):
    """Clusters by members, kilometres and place; the first is home."""
    s = centres(spark, sf)
    g = lines.clusters(s, 1200.0).join(s, "id").groupBy("c").agg(F.count("*").alias("n"), F.sum("km").alias("km"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("lat").alias("south"), F.max("lat").alias("north"))
    order = [F.desc("n"), F.desc(F.round("km", 6)), F.round("lat", 4), F.round("lon", 4), F.col("c")]
    top = ranking.numbered(g, order, "place").withColumn("place", F.col("place").cast("int"))
    return rounded(rounded(top, "km", digits=3), "lat", "lon", "south", "north", digits=6)


@query(f"{CENTRES} SELECT a.id, max_by(b.id, (-round({_NEAR}, 6), b.id)) AS cached FROM centre a JOIN centre b ON b.id % 3 = 0 AND {_NEAR} <= 3000 WHERE a.id % 3 <> 0 GROUP BY 1")
def nearest_cached_name(spark, sf):
    """The nearest cached place within 3 km; of equally near ones the last."""
    s = centres(spark, sf)
    return lines.nearest(s.where("id % 3 <> 0").select("id", "lat", "lon"), s.where("id % 3 = 0").select("id", "lat", "lon"), 3000.0, "id", "id").select("id", F.col("r.id").alias("cached"))


@query(f"{CENTRES} SELECT a.id FROM centre a WHERE a.id % 3 = 0 AND EXISTS (SELECT 1 FROM centre b WHERE b.id % 3 <> 0 AND {_NEAR} <= 2000)")
def pruned_cache(spark, sf):
    """Cached places that some place in use is near."""
    s = centres(spark, sf).select("id", "lat", "lon")
    return lines.nearby(s.where("id % 3 = 0"), s.where("id % 3 <> 0"), 2000.0).select("l.id").distinct()


KEYS = f"{TRACK}, line AS (SELECT athlete_id AS id, list((lat, lon) ORDER BY i) AS p FROM track GROUP BY 1), keyed AS (SELECT id, array_to_string(list_transform([p[1], p[len(p) // 2 + 1], p[len(p)]], lambda x: printf('%.4f,%.4f', x[1] + 0.000013e0, x[2] + 0.000013e0)), '|') AS key FROM line)"


def _keys(spark, sf):
    line = track(spark, sf).groupBy(F.col(A).alias("id")).agg(F.sort_array(F.collect_list(F.struct("i", "lat", "lon"))).alias("p"))
    some = F.array(F.element_at("p", 1), F.element_at("p", (F.floor(F.size("p") / 2) + 1).cast("int")), F.element_at("p", -1))
    return line.select("id", F.array_join(F.transform(some, lambda x: F.format_string("%.4f,%.4f", x["lat"] + 0.000013, x["lon"] + 0.000013)), "|").alias("key"))


@query(f"{KEYS} SELECT id, key, {r('(CAST(split_part(split_part(key, chr(124), 1), chr(44), 1) AS DOUBLE) + CAST(split_part(split_part(key, chr(124), 2), chr(44), 1) AS DOUBLE) + CAST(split_part(split_part(key, chr(124), 3), chr(44), 1) AS DOUBLE)) / 3', 6)} AS lat FROM keyed")
def place_keys(spark, sf):
    """A line's key of three places, and their mean, read back from it."""
    k = _keys(spark, sf)
    parts = F.transform(F.split("key", r"\|"), lambda x: F.split(x, ",")[0].cast("double"))
    return rounded(k.select("id", "key", (F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 3).alias("lat")), "lat", digits=6)


@query(f"{KEYS}, c AS (SELECT athlete_id AS id, avg(lat) AS lat, avg(lon) AS lon FROM track GROUP BY 1) SELECT a.id, EXISTS (SELECT 1 FROM keyed s WHERE s.id % 4 = 0 AND s.key = a.key) OR EXISTS (SELECT 1 FROM c x JOIN c b ON b.id % 4 = 0 WHERE x.id = a.id AND {_NEAR.replace('a.l', 'x.l')} <= 40) AS starred FROM keyed a")
def starred(spark, sf):
    """Lines whose key is starred, or whose middle is within 40 m of a starred one's."""
    k = _keys(spark, sf)
    c = track(spark, sf).groupBy(F.col(A).alias("id")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    same = k.join(k.where("id % 4 = 0").select("key").distinct(), "key", "left_semi").select("id")
    near = lines.nearest(c, c.where("id % 4 = 0"), 40.0, "id", "id").select("id")
    return k.select("id").join(same.union(near).distinct().withColumn("s", F.lit(True)), "id", "left").select("id", F.coalesce("s", F.lit(False)).alias("starred"))


@query(f"{STEP}, x AS (SELECT athlete_id, i, lon - p_lon AS bx, lat - p_lat AS dy, lag(lon - p_lon) OVER w AS ax, lag(lat - p_lat) OVER w AS ay FROM step WINDOW w AS (PARTITION BY athlete_id ORDER BY i)) SELECT athlete_id, {r('count(*) FILTER (abs(degrees(atan2(CASE WHEN ax * dy - ay * bx = 0 THEN 0 ELSE ax * dy - ay * bx END, CASE WHEN ax * bx + ay * dy = 0 THEN 0 ELSE ax * bx + ay * dy END))) > 55) / CAST(count(*) AS DOUBLE)')} AS rate FROM x WHERE ax IS NOT NULL GROUP BY 1")
def sharp_turns(spark, sf):
    """The share of turns sharper than 55 degrees."""
    w = W.partitionBy(A).orderBy("i")
    s = track(spark, sf).withColumns(lines.before(A, "i", "lat", "lon")).withColumn("bx", F.col("lon") - F.col("p_lon")).withColumn("dy", F.col("lat") - F.col("p_lat"))
    s = s.withColumn("ax", F.lag("bx").over(w)).withColumn("ay", F.lag("dy").over(w)).where("ax is not null")
    turn = F.abs(F.degrees(F.atan2(F.col("ax") * F.col("dy") - F.col("ay") * F.col("bx"), F.col("ax") * F.col("bx") + F.col("ay") * F.col("dy"))))
    return rounded(s.groupBy(A).agg((F.count(F.when(turn > 55, 1)) / F.count("*")).alias("rate")), "rate")


@query(f"{TRACK} SELECT athlete_id % 10 AS part, {r('min(lat) - 0.0015e0', 6)} AS south, {r('max(lat) + 0.0015e0', 6)} AS north, {r('min(lon) - 0.0015e0', 6)} AS west, {r('max(lon) + 0.0015e0', 6)} AS east, max(lat) - min(lat) + 0.003e0 <= 0.6e0 AND max(lon) - min(lon) + 0.003e0 <= 0.6e0 AS fits FROM track GROUP BY 1")
def union_boxes(spark, sf):
    pad = 0.0015
    g = track(spark, sf).groupBy((F.col(A) % 10).alias("part")).agg((F.min("lat") - pad).alias("south"), (F.max("lat") + pad).alias("north"), (F.min("lon") - pad).alias("west"), (F.max("lon") + pad).alias("east"))
    return rounded(g.withColumn("fits", (F.col("north") - F.col("south") <= 0.6) & (F.col("east") - F.col("west") <= 0.6)), "south", "north", "west", "east", digits=6)


@query(f"{STEP}, c AS (SELECT *, sum(coalesce(g, 0)) OVER (PARTITION BY athlete_id ORDER BY i) AS cum FROM gap), h AS (SELECT *, max(cum) OVER (PARTITION BY athlete_id) / 2 AS half FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY i) AS q FROM h WHERE cum >= half AND g > 0) SELECT athlete_id, {r('p_lat + (half - (cum - g)) / g * (lat - p_lat)', 7)} AS lat FROM f WHERE q = 1")
def halfway_points(spark, sf):
    """The place at half of each line's length."""
    w = W.partitionBy(A)
    s = track(spark, sf).withColumns(lines.before(A, "i", "lat", "lon"))
    s = s.withColumn("g", ph.haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))).withColumn("cum", F.sum(F.coalesce("g", F.lit(0.0))).over(w.orderBy("i")))
    s = s.withColumn("half", F.max("cum").over(w) / 2).where("cum >= half and g > 0")
    at = s.groupBy(A).agg(F.min_by(F.struct("p_lat", "lat", "g", "cum", "half"), "i").alias("x"))
    return rounded(at.select(A, (F.col("x.p_lat") + (F.col("x.half") - (F.col("x.cum") - F.col("x.g"))) / F.col("x.g") * (F.col("x.lat") - F.col("x.p_lat"))).alias("lat")), "lat", digits=7)


@query(f"{TRACK}, c AS (SELECT athlete_id, CAST(floor(lat * 10000) AS BIGINT) AS r, CAST(floor(lon * 10000) AS BIGINT) AS k, i FROM track) SELECT athlete_id, r, k, min(i) AS i FROM c GROUP BY 1, 2, 3")
def first_in_cell(spark, sf):
    s = track(spark, sf).select(A, F.floor(F.col("lat") * 10000).alias("r"), F.floor(F.col("lon") * 10000).alias("k"), "i")
    return s.groupBy(A, "r", "k").agg(F.min("i").alias("i"))


@query(f"{REC}, f AS (SELECT athlete_id, event_type, min(i) AS i, count(*) AS n FROM record GROUP BY 1, 2) SELECT athlete_id, array_to_string(list(event_type ORDER BY i), ',') AS types, max_by(event_type, (n, -i)) AS most FROM f GROUP BY 1")
def ordered_distinct_and_mode(spark, sf):
    """The distinct kinds of an athlete's events by their first, and the most frequent, the first seen of equals."""
    f = records(spark, sf).groupBy(A, "event_type").agg(F.min("i").alias("i"), F.count("*").alias("n"))
    types = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "event_type"))), lambda x: x["event_type"]), ",")
    return f.groupBy(A).agg(types.alias("types"), F.max_by("event_type", F.struct("n", -F.col("i"))).alias("most"))


SEG = f"{ACT}, effort AS (SELECT athlete_id AS seg, activity_id AS run, day, moving_s AS time_s, dist_m, list_extract(['segment', 'climb', 'loop'], CAST(athlete_id % 3 + 1 AS INT)) AS kind FROM activity), seg AS (SELECT seg, max(kind) AS kind, count(*) AS efforts, max(dist_m) AS length_m, min(time_s) AS pr, max(day) AS last, count(DISTINCT run) AS runs FROM effort GROUP BY 1)"


def efforts(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("segment", "climb", "loop"))), (F.col(A) % 3 + 1).cast("int"))
    return activities(spark, sf).select(F.col(A).alias("seg"), F.col("activity_id").alias("run"), "day", F.col("moving_s").alias("time_s"), "dist_m", kind.alias("kind"))


def segments(spark, sf):
    return efforts(spark, sf).groupBy("seg").agg(F.max("kind").alias("kind"), F.count("*").alias("efforts"), F.max("dist_m").alias("length_m"), F.min("time_s").alias("pr"), F.max("day").alias("last"))


@query(f"{SEG}, t AS (SELECT *, row_number() OVER (ORDER BY efforts DESC, length_m DESC, seg) AS q FROM seg WHERE kind = 'loop' AND seg % 2 = 0) SELECT seg, efforts, length_m FROM t WHERE q <= 100")
def listed_segments(spark, sf):
    """Starred loops with the most efforts, then the longest; 100 at most."""
    return segments(spark, sf).where("kind = 'loop' and seg % 2 = 0").orderBy(F.desc("efforts"), F.desc("length_m"), "seg").limit(100).select("seg", "efforts", "length_m")


@query(f"{SEG} SELECT e.seg, e.run, e.time_s = pr AS is_best, CASE WHEN n > 1 THEN CAST(lap AS INT) END AS lap FROM (SELECT *, row_number() OVER (PARTITION BY seg, date_trunc('year', day) ORDER BY day, run) AS lap, count(*) OVER (PARTITION BY seg, date_trunc('year', day)) AS n FROM effort) e JOIN seg s USING (seg)")
def segment_attempts(spark, sf):
    """Each effort, whether it equals its segment's best, and its number among those of its group if there are several."""
    w = W.partitionBy("seg", F.trunc("day", "year"))
    e = efforts(spark, sf).withColumn("lap", F.row_number().over(w.orderBy("day", "run"))).withColumn("n", F.count("*").over(w))
    return e.join(segments(spark, sf).select("seg", "pr"), "seg").select("seg", "run", (F.col("time_s") == F.col("pr")).alias("is_best"), F.when(F.col("n") > 1, F.col("lap")).alias("lap"))


@query(f"{SEG} SELECT seg, n, count(*) AS attempts, min(time_s) AS best FROM effort JOIN seg USING (seg), (VALUES (30), (183), (365)) v(n) WHERE day >= last - n GROUP BY 1, 2")
def segment_trends(spark, sf):
    """Attempts within a time before each segment's own last one."""
    e = efforts(spark, sf).join(segments(spark, sf).select("seg", "last"), "seg")
    return e.withColumn("n", F.explode(F.array(*map(F.lit, (30, 183, 365))))).where("day >= date_sub(last, n)").groupBy("seg", "n").agg(F.count("*").alias("attempts"), F.min("time_s").alias("best"))


@query(f"{SEG}, o AS (SELECT * FROM effort WHERE seg % 7 = 1), more AS (SELECT seg - 1 AS seg, run, time_s FROM effort WHERE seg % 7 = 2), near AS (SELECT seg, run FROM o WHERE run % 2 = 0), pool AS (SELECT seg, run, time_s FROM o UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.seg = m.seg AND o.run = m.run)) SELECT seg, count(*) AS efforts, CAST(sum(time_s) AS BIGINT) AS seconds FROM pool GROUP BY 1")
def pooled_efforts(spark, sf):
    """Efforts of a place, with another's for the runs that it hasn't."""
    e = efforts(spark, sf).select("seg", "run", "time_s")
    own, more = e.where("seg % 7 = 1"), e.where("seg % 7 = 2").withColumn("seg", F.col("seg") - 1)
    return own.unionByName(more.join(own.select("seg", "run"), ["seg", "run"], "left_anti").select("seg", "run", "time_s")).groupBy("seg").agg(F.count("*").alias("efforts"), F.sum("time_s").alias("seconds"))


@query(f"{SEG}, n AS (SELECT seg, kind || ' ' || (length_m // 5000) AS name, length_m FROM seg) SELECT seg, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' · ' || length_m || ' m' ELSE name END AS name FROM n")
def told_apart_names(spark, sf):
    """Names; those that several segments have with the length after them."""
    n = segments(spark, sf).select("seg", F.concat_ws(" ", "kind", F.floor(F.col("length_m") / 5000).cast("string")).alias("name"), "length_m")
    often = n.groupBy("name").agg(F.count("*").alias("n"))  # counted before the join, so a common name is no large window
    return n.join(often, "name").select("seg", F.when(F.col("n") > 1, F.concat("name", F.lit(" · "), F.col("length_m").cast("string"), F.lit(" m"))).otherwise(F.col("name")).alias("name"))


@query(f"{SEG} SELECT run, array_to_string(list(seg || ':' || time_s ORDER BY seg), ' ') AS efforts FROM effort GROUP BY 1")
def efforts_of_runs(spark, sf):
    e = efforts(spark, sf)
    return e.groupBy("run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "time_s"))), lambda x: F.concat_ws(":", x["seg"].cast("string"), x["time_s"].cast("string"))), " ").alias("efforts"))


@query(f"{CELLS}, chain(n, r, c) AS (SELECT i, r, c FROM seq WHERE athlete_id = (SELECT min(athlete_id) FROM seq) AND i <= 6), ends AS (SELECT min_by(r, n) AS ar, min_by(c, n) AS ac, max_by(r, n) AS br, max_by(c, n) AS bc, count(DISTINCT (r, c)) AS size FROM chain), s AS (SELECT q.*, x.on FROM seq q LEFT JOIN (SELECT DISTINCT r, c, 1 AS on FROM chain) x USING (r, c)), p AS (SELECT a.athlete_id, a.i AS si, b.i AS ei, b.d - a.d AS dist, b.t - a.t AS tm, size FROM s a JOIN s b ON a.athlete_id = b.athlete_id AND b.i > a.i, ends WHERE abs(a.r - ar) <= 1 AND abs(a.c - ac) <= 1 AND abs(b.r - br) <= 1 AND abs(b.c - bc) <= 1 AND b.d - a.d BETWEEN 60 AND 400 AND b.t > a.t), v AS (SELECT p.athlete_id, si, ei, dist, tm, max(size) AS size, count(DISTINCT (s.r, s.c)) AS n FROM p JOIN s ON s.athlete_id = p.athlete_id AND s.i BETWEEN si AND ei AND s.on = 1 GROUP BY 1, 2, 3, 4, 5), w AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY tm, si, ei) AS q FROM v WHERE n >= 0.3e0 * size) SELECT athlete_id, si AS start_i, ei AS end_i, {r('dist')} AS dist_m, tm AS time_s FROM w WHERE q = 1")
def chain_traversals(spark, sf):
    """Each track's fastest way along the first track's first cells."""
    s = cells(spark, sf)
    first = s.agg(F.min(A).alias(A))  # one row
    chain = s.join(F.broadcast(first), A).where("i <= 6").select(F.col("i").alias("n"), "r", "c")
    return rounded(lines.traversals(s, chain, A, "i", 200.0, 0.3, 0.3, 2.0), "dist_m")


@query(f"""{TRACK}, j AS (SELECT athlete_id, i, CASE WHEN i % 10 = 0 THEN '{{broken' WHEN i % 11 = 0 THEN NULL ELSE '[' || '{{"d":' || d || ',"t":' || t || ',"hr":' || hr || '}},{{"d":' || (d + 1) || ',"t":' || (t + 5) || '}}]' END AS raw, d, t, hr FROM track)
SELECT athlete_id, i, CAST(CASE WHEN raw IS NULL OR i % 10 = 0 THEN 0 ELSE 2 END AS INT) AS points, CAST(CASE WHEN raw IS NULL OR i % 10 = 0 THEN 0 ELSE 1 END AS INT) AS with_hr, CAST(CASE WHEN raw IS NOT NULL AND i % 10 <> 0 THEN d + 1 END AS DOUBLE) AS last_d FROM j""")
def json_streams(spark, sf):
    """Streams in JSON; corrupt and missing ones have no points."""
    i = F.col("i")
    text = F.format_string('[{"d":%s,"t":%s,"hr":%s},{"d":%s,"t":%s}]', F.col("d").cast("string"), F.col("t").cast("string"), F.col("hr").cast("string"), (F.col("d") + 1).cast("string"), (F.col("t") + 5).cast("string"))
    s = track(spark, sf).select(A, "i", F.when(i % 10 == 0, "{broken").when(i % 11 == 0, F.lit(None)).otherwise(text).alias("raw")).withColumn("p", json_array("raw", POINT))
    return s.select(A, "i", F.size("p").alias("points"), F.size(F.filter("p", lambda x: x["hr"].isNotNull())).alias("with_hr"), F.try_element_at("p", F.lit(-1))["d"].alias("last_d"))


@query("SELECT l_orderkey AS run, CAST(row_number() OVER w AS INT) AS lap, l_quantity AS km FROM lineitem WHERE l_orderkey % 10 = 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)")
def lap_index(spark, sf):
    """A run's laps, numbered from 1 in their array's order."""
    li = table(spark, sf, "lineitem").where("l_orderkey % 10 = 0")
    laps = li.groupBy(F.col("l_orderkey").alias("run")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("laps"))
    return laps.select("run", F.posexplode("laps").alias("pos", "x")).select("run", (F.col("pos") + 1).alias("lap"), F.col("x.l_quantity").alias("km"))


@query("WITH w AS (SELECT l_orderkey AS way, l_partkey % 500 AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos FROM lineitem), k AS (SELECT * FROM w WHERE node % 10 <> 0), e AS (SELECT node AS a, lead(node) OVER (PARTITION BY way ORDER BY pos) AS b FROM k) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e WHERE b IS NOT NULL AND a <> b")
def walk_edges(spark, sf):
    """Undirected edges between neighbouring nodes of ways; nodes without a place are left out first."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = table(spark, sf, "lineitem").withColumn("node", F.col("l_partkey") % 500)
    known = li.select("node").distinct().where("node % 10 <> 0")  # stands for a node table
    e = li.join(known, "node").select(F.col("node").alias("a"), F.lead("node").over(order).alias("b")).where("b is not null and a <> b")
    return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query(f"{TRACK} SELECT athlete_id, count(*) AS n, {r('min(elev)')} AS lo, {r('max(elev)')} AS hi FROM track WHERE d BETWEEN 100 AND 100 + 1000 * 0.82e0 AND i % 5 <> 0 GROUP BY 1")
def zoomed_range(spark, sf):
    """A zoomed window of distance (1000 m at 0.82, from its left end); the scale leaves paused samples (each fifth) out."""
    s = track(spark, sf).where((F.col("d") >= 100) & (F.col("d") <= 100 + 1000 * 0.82) & (F.col("i") % 5 != 0))
    return rounded(s.groupBy(A).agg(F.count("*").alias("n"), F.min("elev").alias("lo"), F.max("elev").alias("hi")), "lo", "hi")


@query(f"{TRACK}, p AS (SELECT a.athlete_id, a.i, a.d, a.t, (SELECT min((b.t, b.d)) FROM track b WHERE b.athlete_id = a.athlete_id AND b.d >= a.d + 300) AS e FROM track a), s AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY e[1] - t, i) AS q FROM p WHERE e IS NOT NULL) SELECT athlete_id, d AS from_d, e[2] AS to_d, e[1] - t AS seconds FROM s WHERE q = 1")
def best_effort_spans(spark, sf):
    return lines.best_effort_span(track(spark, sf), A, "i", "d", "t", 300)


@query(f"{STEP}, a AS (SELECT athlete_id, i, lat, lon FROM track WHERE i % 2 = 0), b AS (SELECT athlete_id, p_lat, p_lon, lat, lon FROM (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM track WHERE i % 3 = 0 WINDOW w AS (PARTITION BY athlete_id ORDER BY i)) q WHERE p_lat IS NOT NULL), o AS (SELECT athlete_id, min_by(lat, i) AS olat, min_by(lon, i) AS olon FROM a GROUP BY 1), x AS (SELECT a.athlete_id, a.i, (a.lon - olon) * 111320.0e0 * cos(radians(olat)) AS x, (a.lat - olat) * 111320.0e0 AS y, (p_lon - olon) * 111320.0e0 * cos(radians(olat)) AS ax, (p_lat - olat) * 111320.0e0 AS ay, (b.lon - p_lon) * 111320.0e0 * cos(radians(olat)) AS dx, (b.lat - p_lat) * 111320.0e0 AS dy FROM a JOIN b USING (athlete_id) JOIN o USING (athlete_id)), t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM x), m AS (SELECT athlete_id, i, min(sqrt(pow(x - ax - t * dx, 2) + pow(y - ay - t * dy, 2))) AS d FROM t GROUP BY 1, 2) SELECT athlete_id, {r('avg(d)', 3)} AS metres FROM m GROUP BY 1")
def line_deviation(spark, sf):
    s = track(spark, sf).select(A, "i", "lat", "lon")
    return rounded(lines.deviation(s.where("i % 2 = 0"), s.where("i % 3 = 0"), A, "i"), "metres", digits=3)


def beats(spark, sf):
    """A track with a sample each 15 s at about 3 m/s and a slow drift of the heart rate."""
    i = F.col("i") - 1
    return track(spark, sf).select(A, i.alias("i"), (i * 15.0).alias("t"), (i * 45.0 + F.col("hr") % 4).alias("d"), F.lit(None).cast("double").alias("elev"), F.when(i % 5 != 0, 140 + i % 20).alias("hr"))


@query()
def hr_uptake(spark, sf):
    """Oxygen uptake by heart rate of each track; its windows follow from one another, so tests hold it against a plain fold."""
    from strideline.operators import heart

    return rounded(heart.run_uptake(beats(spark, sf), A, 190.0, 50.0), "vo2max")


@query()
def heights_filled(spark, sf):
    """Tracks without heights, filled from a cache of places that a few other tracks left."""
    s = track(spark, sf)
    cache = s.where("elev is not null").groupBy(F.format_string("%.4f,%.4f", F.col("lat"), F.col("lon")).alias("place")).agg(F.avg("elev").alias("elev"))
    bare = s.withColumn("elev", F.when(F.col(A) % 2 == 0, F.col("elev"))).select(A, "i", "d", "lat", "lon", "elev")
    return rounded(lines.with_heights(bare, cache, A, "i").groupBy(A).agg(F.count("*").alias("n"), F.count("elev").alias("heights"), F.avg("elev").alias("mean")), "mean")
