"""All registered queries of the activity analytics, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.functions import physiology as ph
from strideline.operators import graph, load, ordered
from strideline.operators import summaries as sm
from strideline.sources.views import ACTIVITIES_SQL, RECORDS_SQL, activities, records, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K = "squad"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def r(x: str, digits: int = 4) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits})"


COST = "((((155.4e0*({0})-30.4e0)*({0})-43.3e0)*({0})+46.3e0)*({0})+19.5e0)*({0})+3.6e0"
ACT = f"WITH RECURSIVE {ACTIVITIES_SQL}"
REC = f"WITH RECURSIVE {RECORDS_SQL}"
GA = f"(moving_s * 3.6e0 / ({COST.format('gain_m / 2.0e0 / dist_m')}))"
LOAD = f"""{ACT}, paced AS (SELECT *, {GA} / (dist_m / 1000.0e0) AS ga_pace FROM activity WHERE dist_m > 0 AND moving_s > 0),
thr AS (SELECT squad, ga_pace AS threshold_pace FROM (SELECT squad, ga_pace, row_number() OVER (PARTITION BY squad ORDER BY ga_pace) r, count(*) OVER (PARTITION BY squad) n FROM paced) x WHERE r = floor(n * 0.15e0) + 1),
loads AS (SELECT activity_id, squad, day, ga_pace, dist_m / 1000.0e0 * 10 * pow(greatest(0.5e0, least(1.5e0, threshold_pace / ga_pace)), 2) AS load FROM paced JOIN thr USING (squad))"""
DAILY = f"""{LOAD}, byday AS (SELECT squad, day, sum(load) AS load FROM loads GROUP BY 1, 2),
spine AS (SELECT squad, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM byday GROUP BY squad),
daily AS MATERIALIZED (SELECT squad, day, CAST(row_number() OVER (PARTITION BY squad ORDER BY day) - 1 AS INT) AS i, coalesce(load, 0) AS load FROM spine LEFT JOIN byday USING (squad, day))"""
FORM = f"""{DAILY}, step AS (
  SELECT squad, day, i, load, load * (1 - exp(-1/42.0e0)) AS ctl, load * (1 - exp(-1/7.0e0)) AS atl, 0.0e0 AS tsb FROM daily WHERE i = 0
  UNION ALL SELECT d.squad, d.day, d.i, d.load, s.ctl + (1 - exp(-1/42.0e0)) * (d.load - s.ctl), s.atl + (1 - exp(-1/7.0e0)) * (d.load - s.atl), s.ctl - s.atl
  FROM step s JOIN daily d ON d.squad = s.squad AND d.i = s.i + 1)"""
RATIO = f"""{FORM}, ratio AS (SELECT *, CASE WHEN chronic > 0 THEN acute / chronic ELSE 0 END AS acwr FROM (SELECT *, sum(load) OVER (PARTITION BY squad ORDER BY i ROWS 6 PRECEDING) AS acute, avg(load) OVER (PARTITION BY squad ORDER BY i ROWS 27 PRECEDING) * 7 AS chronic, max(i) OVER (PARTITION BY squad) AS l FROM step) x)"""
STRAIN = f"""{DAILY}, strain AS MATERIALIZED (SELECT squad, day, i, monotony, monotony * w AS strain FROM (SELECT *, CASE WHEN n >= 2 AND sd > 1e-9 THEN m / sd ELSE 0 END AS monotony FROM (
  SELECT *, avg(load) OVER v AS m, stddev_pop(load) OVER v AS sd, sum(load) OVER v AS w, count(*) OVER v AS n FROM daily WINDOW v AS (PARTITION BY squad ORDER BY i ROWS 6 PRECEDING)) x) y)"""


def _loads(spark, sf):
    return load.session_loads(activities(spark, sf), K)


def _daily(spark, sf):
    return load.daily_series(_loads(spark, sf), K)


@query(f"{LOAD} SELECT activity_id, squad, day, {r('ga_pace')} AS ga_pace, {r('load')} AS load FROM loads")
def session_load(spark, sf):
    return rounded(_loads(spark, sf), "ga_pace", "load")


@query(f"{DAILY} SELECT squad, day, i, {r('load')} AS load FROM daily")
def daily_load_gapfill(spark, sf):
    return rounded(_daily(spark, sf), "load")


@query(f"{FORM} SELECT squad, day, {r('load')} AS load, {r('ctl')} AS ctl, {r('atl')} AS atl, {r('tsb')} AS tsb FROM step")
def fitness_form(spark, sf):
    return rounded(load.fitness_form(_daily(spark, sf), K), "load", "ctl", "atl", "tsb").select(K, "day", "load", "ctl", "atl", "tsb")


@query(f"{RATIO} SELECT squad, day, {r('acute')} AS acute, {r('chronic')} AS chronic, {r('acwr')} AS acwr FROM ratio")
def acwr(spark, sf):
    return rounded(load.workload_ratio(_daily(spark, sf), K), "acute", "chronic", "acwr").select(K, "day", "acute", "chronic", "acwr")


@query(f"{STRAIN} SELECT squad, day, {r('monotony')} AS monotony, {r('strain', 2)} AS strain FROM strain")
def monotony_strain(spark, sf):
    d = load.monotony_strain(_daily(spark, sf), K)
    return rounded(rounded(d, "monotony"), "strain", digits=2).select(K, "day", "monotony", "strain")


@query(f"""{STRAIN}, old AS (SELECT *, row_number() OVER (PARTITION BY squad ORDER BY i DESC) k FROM (SELECT *, row_number() OVER (PARTITION BY squad ORDER BY i DESC) q FROM strain) x WHERE q > 7 AND strain > 0)
SELECT squad, {r('CASE WHEN count(*) >= 8 THEN avg(strain) + stddev_pop(strain) ELSE 0 END', 2)} AS safe, {r('CASE WHEN count(*) >= 8 THEN avg(strain) + 2 * stddev_pop(strain) ELSE 0 END', 2)} AS high FROM old WHERE k <= 90 GROUP BY squad""")
def strain_baseline(spark, sf):
    return rounded(load.strain_baseline(load.monotony_strain(_daily(spark, sf), K), K), "safe", "high", digits=2)


@query(f"""{RATIO} SELECT squad, advice, {r('acwr')} AS acwr, {r('tsb')} AS tsb, {r('greatest(0, least(t, 1.3e0 * chronic))')} AS target FROM (
SELECT *, CASE WHEN tsb < -25 OR acwr > 1.5e0 THEN 'recover' WHEN tsb < -10 OR acwr > 1.3e0 THEN 'hold' WHEN tsb > 12 AND acwr < 1.1e0 THEN 'build' ELSE 'build gradually' END AS advice,
CASE WHEN tsb < -25 OR acwr > 1.5e0 THEN 0.8e0 * chronic WHEN tsb < -10 OR acwr > 1.3e0 THEN chronic WHEN tsb > 12 AND acwr < 1.1e0 THEN greatest(acute, chronic) * 1.10e0 ELSE greatest(acute, chronic) * 1.05e0 END AS t
FROM ratio WHERE i = l AND i >= 13 AND chronic > 0) x""")
def plan_targets(spark, sf):
    return rounded(load.plan_targets(_daily(spark, sf), K), "acwr", "tsb", "target").select(K, "advice", "acwr", "tsb", "target")


@query(f"""{RATIO} SELECT squad, CAST(k AS INT) AS k, {r('ctl * exp(-k/42.0e0)')} AS ctl, {r('atl * exp(-k/7.0e0)')} AS atl, {r('CASE WHEN k = 0 THEN tsb ELSE ctl * exp(-(k-1)/42.0e0) - atl * exp(-(k-1)/7.0e0) END')} AS tsb FROM ratio, range(0, 8) q(k) WHERE i = l""")
def rest_day_preview(spark, sf):
    return rounded(load.rest_day_preview(_daily(spark, sf), K), "ctl", "atl", "tsb")


@query(f"""{RATIO}, e AS (SELECT squad, chronic / 7 AS m, ctl, atl FROM ratio WHERE i = l), f(squad, m, k, ctl, atl, hc, ha) AS (SELECT squad, m, 0, ctl, atl, ctl, atl FROM e UNION ALL
SELECT squad, m, k + 1, ctl + (1 - exp(-1/42.0e0)) * ((CASE WHEN k + 1 > 20 THEN 0.5e0 ELSE 1 END) * m - ctl), atl + (1 - exp(-1/7.0e0)) * ((CASE WHEN k + 1 > 20 THEN 0.5e0 ELSE 1 END) * m - atl), hc + (1 - exp(-1/42.0e0)) * (m - hc), ha + (1 - exp(-1/7.0e0)) * (m - ha) FROM f WHERE k < 34)
SELECT squad, {r('m')} AS load, {r('ctl')} AS ctl_race, {r('hc - ha')} AS tsb_hold, {r('ctl - atl')} AS tsb_taper FROM f WHERE k = 34""")
def taper_projection(spark, sf):
    return rounded(load.taper_projection(_daily(spark, sf), K, days=35, taper_days=14), "load", "ctl_race", "tsb_hold", "tsb_taper")


BANDS = ", ".join(f"('{n}', {m}e0)" for n, m in sm.DISTANCES)
POINTS = f"{ACT}, points AS (SELECT squad, label, band_m, min(moving_s * band_m / dist_m) AS best_s FROM activity JOIN (VALUES {BANDS}) b(label, band_m) ON dist_m >= band_m GROUP BY 1, 2, 3)"
CURVE = f"{POINTS}, curve AS (SELECT squad, exp(t - b * d) AS a, b FROM (SELECT squad, avg(ln(best_s)) t, avg(ln(band_m)) d, CASE WHEN count(*) < 2 THEN 1.06e0 ELSE greatest(1.0e0, least(1.15e0, regr_slope(ln(best_s), ln(band_m)))) END AS b FROM points GROUP BY squad) x)"


def _points(spark, sf):
    return sm.best_points(activities(spark, sf), K)


@query(f"{POINTS} SELECT squad, label, {r('best_s')} AS best_s FROM points")
def best_effort_points(spark, sf):
    return rounded(_points(spark, sf), "best_s").select(K, "label", "best_s")


@query(f"{POINTS} SELECT squad, {r('regr_slope(band_m, best_s)')} AS cs, {r('regr_intercept(band_m, best_s)', 2)} AS dprime, {r('regr_r2(band_m, best_s)')} AS r2 FROM points WHERE band_m >= 1200 GROUP BY squad HAVING count(*) >= 2")
def critical_speed_fit(spark, sf):
    return rounded(rounded(sm.critical_speed(_points(spark, sf), K), "cs", "r2"), "dprime", digits=2)


@query(f"{CURVE} SELECT squad, {r('a')} AS a, {r('b')} AS b FROM curve")
def riegel_fit(spark, sf):
    return rounded(sm.power_curve(_points(spark, sf), K), "a", "b")


@query(f"{CURVE} SELECT squad, label, {r('a * pow(band_m, b)')} AS seconds FROM curve, (VALUES {BANDS}) v(label, band_m)")
def race_predictions(spark, sf):
    bands = F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.lit(m).alias("band_m")) for n, m in sm.DISTANCES)))
    c = sm.power_curve(_points(spark, sf), K).withColumn("v", bands)
    return rounded(c.select(K, "v.label", (F.col("a") * F.pow(F.col("v.band_m"), F.col("b"))).alias("seconds")), "seconds")


@query(f"""{CURVE}, p AS (SELECT squad, label, band_m, a * pow(5000, b) / 5 AS p5, a * pow(band_m, b) / (band_m / 1000) AS own FROM curve, (VALUES {BANDS}) v(label, band_m))
SELECT squad, label, {r('CASE WHEN band_m >= 1500 THEN own * 0.97e0 WHEN band_m >= 900 THEN p5 * 0.96e0 WHEN band_m >= 700 THEN p5 * 0.93e0 ELSE p5 * 0.88e0 END')} AS lo, {r('CASE WHEN band_m >= 1500 THEN own WHEN band_m >= 900 THEN p5 * 0.98e0 WHEN band_m >= 700 THEN p5 * 0.96e0 ELSE p5 * 0.93e0 END')} AS hi FROM p""")
def training_targets(spark, sf):
    bands = F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.lit(m).alias("m")) for n, m in sm.DISTANCES)))
    c = sm.power_curve(_points(spark, sf), K).withColumn("v", bands).select(K, "v.label", F.col("v.m").alias("m"), "a", "b")
    five, own, m = F.col("a") * F.pow(F.lit(5000.0), F.col("b")) / 5, F.col("a") * F.pow("m", F.col("b")) / (F.col("m") / 1000), F.col("m")
    pick = lambda w, x, y, z: F.when(m >= 1500, own * w).when(m >= 900, five * x).when(m >= 700, five * y).otherwise(five * z)
    return rounded(c.select(K, "label", pick(0.97, 0.96, 0.93, 0.88).alias("lo"), pick(1.0, 0.98, 0.96, 0.93).alias("hi")), "lo", "hi")


V = "dist_m / (moving_s / 60.0e0)"
VDOT = f"((0.000104e0 * ({V}) * ({V}) + 0.182258e0 * ({V}) - 4.60e0) / (0.8e0 + 0.1894393e0 * exp(-0.012778e0 * moving_s / 60.0e0) + 0.2989558e0 * exp(-0.1932605e0 * moving_s / 60.0e0)))"


@query(f"{ACT} SELECT squad, CAST(date_trunc('month', day) AS DATE) AS month, {r(f'max({VDOT})')} AS vdot FROM activity WHERE dist_m >= 1000 GROUP BY 1, 2")
def vdot_monthly_max(spark, sf):
    return rounded(sm.monthly_best(activities(spark, sf).where("dist_m >= 1000"), K, sm.activity_vdot(), "vdot"), "vdot")


@query(f"{ACT} SELECT squad, CAST(date_trunc('month', day) AS DATE) AS month, {r('avg(150 + activity_id % 40)')} AS cadence FROM activity GROUP BY 1, 2")
def cadence_monthly_mean(spark, sf):
    a = activities(spark, sf).groupBy(K, F.trunc("day", "month").alias("month")).agg(F.avg(150 + F.col("activity_id") % 40).alias("cadence"))
    return rounded(a, "cadence")


def _totals(unit: str, step: str) -> str:
    return f"""{ACT}, t AS (SELECT squad, CAST(date_trunc('{unit}', day) AS DATE) AS period, sum(dist_m) m, sum(gain_m) g, sum(moving_s) s, count(*) c FROM activity GROUP BY 1, 2),
spine AS (SELECT squad, CAST(unnest(generate_series(min(period), max(period), INTERVAL {step})) AS DATE) AS period FROM t GROUP BY squad)
SELECT squad, period, {r('coalesce(m, 0) / 1000.0e0')} AS km, CAST(coalesce(g, 0) AS BIGINT) AS gain_m, CAST(coalesce(s, 0) AS BIGINT) AS seconds, CAST(coalesce(c, 0) AS BIGINT) AS runs FROM spine LEFT JOIN t USING (squad, period)"""


@query(_totals("week", "7 DAY"))
def period_totals_week(spark, sf):
    return rounded(sm.period_totals(activities(spark, sf), K, "week"), "km")


@query(_totals("month", "1 MONTH"))
def period_totals_month(spark, sf):
    return rounded(sm.period_totals(activities(spark, sf), K, "month"), "km")


@query(f"{ACT} SELECT squad, day, {r('sum(dist_m) / 1000.0e0')} AS km, CAST(sum(gain_m) AS BIGINT) AS gain_m, CAST(sum(moving_s) AS BIGINT) AS seconds, count(*) AS runs FROM activity GROUP BY 1, 2")
def daily_totals(spark, sf):
    a = activities(spark, sf).groupBy(K, "day").agg((F.sum("dist_m") / 1000).alias("km"), F.sum("gain_m").alias("gain_m"), F.sum("moving_s").alias("seconds"), F.count("*").alias("runs"))
    return rounded(a, "km")


DAYS = f"{ACT}, days AS (SELECT squad, day, sum(dist_m) / 1000.0e0 AS km FROM activity GROUP BY 1, 2)"


@query(f"""{DAYS}, k AS (SELECT squad, km, row_number() OVER (PARTITION BY squad ORDER BY km DESC) q FROM days), e AS (SELECT squad, coalesce(max(CASE WHEN km >= q THEN q END), 0) AS e FROM k GROUP BY 1)
SELECT squad, e, e + 1 - count(*) FILTER (km >= e + 1) AS need FROM days JOIN e USING (squad) GROUP BY squad, e""")
def eddington(spark, sf):
    return sm.eddington(sm.daily_km(activities(spark, sf), K), K).withColumn("e", F.col("e").cast("long"))


@query(f"{DAYS} SELECT squad, CAST(n AS BIGINT) AS n, (SELECT count(*) FROM days d WHERE d.squad = x.squad AND km >= n) AS days FROM (SELECT squad, unnest(range(1, CAST(floor(max(km)) AS BIGINT) + 1)) AS n FROM days GROUP BY squad) x")
def eddington_distribution(spark, sf):
    return sm.eddington_distribution(sm.daily_km(activities(spark, sf), K), K)


@query(f"""{DAYS}, m AS (SELECT DISTINCT squad, CAST(date_trunc('month', day) AS DATE) AS month FROM days), k AS (SELECT m.squad, month, km, row_number() OVER (PARTITION BY m.squad, month ORDER BY km DESC) q FROM m JOIN days d ON d.squad = m.squad AND date_trunc('month', d.day) <= month)
SELECT squad, month, CAST(coalesce(max(CASE WHEN km >= q THEN q END), 0) AS INT) AS e FROM k GROUP BY 1, 2""")
def eddington_progression(spark, sf):
    return sm.eddington_progression(sm.daily_km(activities(spark, sf), K), K)


@query(f"""{ACT} SELECT squad, label, rank, activity_id, {r('seconds')} AS seconds FROM (SELECT squad, label, activity_id, moving_s * band_m / dist_m AS seconds, CAST(row_number() OVER (PARTITION BY squad, label ORDER BY moving_s * band_m / dist_m, activity_id) AS INT) AS rank
FROM activity JOIN (VALUES {BANDS}) b(label, band_m) ON dist_m >= band_m AND (NOT (elapsed_s > 0 AND (elapsed_s - moving_s) / CAST(elapsed_s AS DOUBLE) >= 0.2e0) OR band_m < 1000)) x WHERE rank <= 3""")
def top3_by_band(spark, sf):
    return rounded(sm.top_by_band(activities(spark, sf), K), "seconds")


FRAC = "(1000.0e0 / ga_pace) / (1000.0e0 / threshold_pace)"
PACED = LOAD + f", zoned AS (SELECT *, {FRAC} AS f FROM paced JOIN thr USING (squad))"
ZONE = "CASE WHEN f < 0.71e0 THEN 0 WHEN f < 0.82e0 THEN 1 WHEN f < 0.88e0 THEN 2 WHEN f < 1.03e0 THEN 3 ELSE 4 END"


def _zoned(spark, sf):
    km = F.col("dist_m") / 1000
    p = activities(spark, sf).where("dist_m > 0 and moving_s > 0").withColumn("ga_pace", ph.ga_seconds(F.col("moving_s"), F.col("gain_m"), km) / km)
    t = load.index_percentile(p, K, "ga_pace", 0.15, "threshold_pace")
    return p.join(t, K).withColumn("f", (1000.0 / F.col("ga_pace")) / (1000.0 / F.col("threshold_pace")))


@query(f"{PACED} SELECT squad, CAST({ZONE} AS INT) AS zone, CAST(sum(moving_s) AS BIGINT) AS seconds FROM zoned GROUP BY 1, 2")
def zone_time(spark, sf):
    return _zoned(spark, sf).groupBy(K, sm.zone(F.col("f")).alias("zone")).agg(F.sum("moving_s").alias("seconds"))


SPLIT = f"""WITH s AS (SELECT l_orderkey AS activity_id, CASE WHEN f < 0.71e0 THEN 0 WHEN f < 0.82e0 THEN 1 WHEN f < 0.88e0 THEN 2 WHEN f < 1.03e0 THEN 3 ELSE 4 END AS zone, t FROM (SELECT l_orderkey, l_quantity AS t, 0.6e0 + l_discount * 5 AS f FROM lineitem) x)"""
RUNS = f"""{SPLIT}, act AS (SELECT activity_id, sum(t) AS total, sum(t) FILTER (zone = 0) / sum(t) AS z1, coalesce(sum(t) FILTER (zone = 2), 0) / sum(t) AS z3, coalesce(sum(t) FILTER (zone = 3), 0) / sum(t) AS z4, coalesce(sum(t) FILTER (zone = 4), 0) / sum(t) AS z5 FROM s GROUP BY 1)"""


def _splits(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("activity_id"), F.col("l_quantity").alias("t"), (0.6 + F.col("l_discount") * 5).alias("f"))
    return s.withColumn("zone", sm.zone(F.col("f")))


@query(f"{SPLIT} SELECT activity_id, " + ", ".join(f"coalesce(sum(t) FILTER (zone = {i}), 0) AS z{i + 1}" for i in range(5)) + " FROM s GROUP BY 1")
def zone_time_splits(spark, sf):
    s = _splits(spark, sf)
    return s.groupBy("activity_id").agg(*(F.sum(F.when(F.col("zone") == i, F.col("t")).otherwise(0.0)).alias(f"z{i + 1}") for i in range(5)))


@query(f"""{RUNS} SELECT activity_id, CASE WHEN total / 10.0e0 < 1.0e0 THEN 'misc' WHEN activity_id % 7 = 0 THEN 'intervals' WHEN 0.7e0 + (activity_id % 35) / 100.0e0 >= 0.98e0 AND total / 10.0e0 >= 3.0e0 THEN 'race' WHEN z5 >= 0.40e0 THEN 'race'
WHEN z4 >= 0.50e0 OR z4 + z5 >= 0.60e0 THEN 'threshold' WHEN z3 + z4 >= 0.35e0 THEN 'tempo' WHEN coalesce(z1, 0) >= 0.70e0 THEN 'recovery' ELSE 'easy' END AS run_type FROM act""")
def run_classification(spark, sf):
    z = zone_time_splits(spark, sf)
    total = sum((F.col(f"z{i}") for i in range(1, 6)), F.lit(0.0))
    share = [F.col(f"z{i}") / total for i in range(1, 6)]
    kind = sm.classify(total / 10, F.col("activity_id") % 7 == 0, 0.7 + (F.col("activity_id") % 35) / 100.0, share)
    return z.select("activity_id", kind.alias("run_type"))


@query(f"""{ACT}, q AS (SELECT squad, quantile_cont(dist_m, 0.75) p75, quantile_cont(dist_m, 0.5) p50 FROM activity GROUP BY 1)
SELECT activity_id, dist_m >= 10000 AND dist_m >= p75 AND dist_m >= 1.3e0 * p50 AS is_long FROM activity JOIN q USING (squad)""")
def long_tag(spark, sf):
    return sm.long_tag(activities(spark, sf), K).select("activity_id", "is_long")


@query(f"""{ACT}, s AS (SELECT *, dist_m / CAST(moving_s AS DOUBLE) AS v FROM activity WHERE dist_m >= 5000)
SELECT a.activity_id, {r('a.v / max(b.v)')} AS ratio FROM s a JOIN s b ON a.squad = b.squad AND abs(date_diff('day', a.day, b.day)) <= 60 GROUP BY a.activity_id, a.v""")
def contemporaneous_threshold(spark, sf):
    a = activities(spark, sf).where("dist_m >= 5000").withColumn("v", F.col("dist_m") / F.col("moving_s")).withColumn("n", F.unix_date("day"))
    w = W.partitionBy(K).orderBy("n").rangeBetween(-60, 60)
    days = a.groupBy(K, "n").agg(F.max("v").alias("b")).select(K, "n", F.max("b").over(w).alias("best"))  # a row a day goes through the window
    return rounded(a.join(days, [K, "n"]).select("activity_id", (F.col("v") / F.col("best")).alias("ratio")), "ratio")


@query(f"""{ACT}, s AS (SELECT *, dist_m / CAST(nullif(moving_s, 0) AS DOUBLE) AS v FROM activity), e AS (SELECT squad, day, max(v) AS b FROM s WHERE dist_m >= 5000 GROUP BY 1, 2),
n AS (SELECT activity_id, v, b, abs(date_diff('day', s.day, e.day)) AS gap FROM s LEFT JOIN e USING (squad)),
w AS (SELECT activity_id, v, max(b) AS peak, max(b) FILTER (gap <= 60) AS b1, max(b) FILTER (gap <= 120) AS b2, max(b) FILTER (gap <= 240) AS b4, max(b) FILTER (gap <= 480) AS b8 FROM n GROUP BY 1, 2)
SELECT activity_id, {r('coalesce(coalesce(b1, b2, b4, b8) / peak, 1)', 9)} AS era, {r('v / coalesce(b1, b2, b4, b8, peak)', 9)} AS ratio FROM w""")
def threshold_of_every_run(spark, sf):
    a = activities(spark, sf).withColumn("v", F.expr("try_divide(dist_m, moving_s)")).withColumn("n", F.unix_date("day"))
    days = a.groupBy(K, "n").agg(F.max(F.when(F.col("dist_m") >= 5000, F.col("v"))).alias("b"))  # a row a day goes through the windows
    w = W.partitionBy(K)
    spans = [F.max("b").over(w.orderBy("n").rangeBetween(-d, d)) for d in (60, 120, 240, 480)]
    days = days.select(K, "n", F.coalesce(*spans).alias("best"), F.max("b").over(w).alias("peak"))
    ratio = F.col("v") / F.coalesce("best", "peak")
    return rounded(a.join(days, [K, "n"]).select("activity_id", F.coalesce(F.col("best") / F.col("peak"), F.lit(1.0)).alias("era"), ratio.alias("ratio")), "era", "ratio", digits=9)


@query(f"""{POINTS}, p AS (SELECT * FROM points WHERE band_m >= 1200) SELECT h.squad, h.label, {r('regr_slope(p.band_m, p.best_s)')} AS cs FROM p h JOIN p ON p.squad = h.squad AND p.label <> h.label GROUP BY 1, 2 HAVING count(*) >= 2""")
def leave_one_out_fit(spark, sf):
    p = _points(spark, sf).where("band_m >= 1200")
    h = p.select(K, F.col("label").alias("left_out"))  # at most nine points a key
    c = h.join(p, K).where("label <> left_out").groupBy(K, F.col("left_out").alias("label")).agg(F.count("*").alias("n"), F.regr_slope("band_m", "best_s").alias("cs")).where("n >= 2")
    return rounded(c, "cs").select(K, "label", "cs")


@query("""SELECT o_orderkey AS activity_id, o_orderpriority AS name, o_totalprice AS price FROM orders WHERE lower(o_orderpriority) LIKE '%high%' AND o_totalprice BETWEEN 50000 AND 200000""")
def run_search_filter(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("activity_id"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"))
    return sm.search(o, "High", "name", {"price": (50000, 200000)}).drop("day")


@query(f"""{ACT}, q AS (SELECT squad, quantile_cont(dist_m, 0.75) p75, quantile_cont(dist_m, 0.5) p50 FROM activity GROUP BY 1), t AS (SELECT CASE WHEN dist_m < 5000 THEN 'short' ELSE 'base' END AS kind, dist_m >= 10000 AND dist_m >= p75 AND dist_m >= 1.3e0 * p50 AS is_long FROM activity JOIN q USING (squad))
SELECT kind, count(*) AS n FROM (SELECT kind FROM t UNION ALL SELECT 'long' FROM t WHERE is_long) x GROUP BY 1""")
def type_counts(spark, sf):
    a = sm.long_tag(activities(spark, sf), K)
    kinds = F.array_compact(F.array(F.when(F.col("dist_m") < 5000, "short").otherwise("base"), F.when(F.col("is_long"), "long")))
    return a.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""{ACT}, w AS (SELECT squad, min(dist_m) lo, max(dist_m) hi, greatest(5, least(12, CAST(round(sqrt(count(*))) AS INT))) bins FROM activity GROUP BY 1)
SELECT squad, CAST(CASE WHEN hi > lo THEN least(floor((dist_m - lo) * bins / CAST(hi - lo AS DOUBLE)), bins - 1) ELSE 0 END AS INT) AS bin, count(*) AS n FROM activity JOIN w USING (squad) GROUP BY 1, 2""")
def metric_histogram(spark, sf):
    return sm.histogram(activities(spark, sf), K, "dist_m")


@query(f"""{ACT}, d AS (SELECT squad, day, avg(moving_s / (dist_m / 1000.0e0)) AS pace FROM activity GROUP BY 1, 2), s AS (SELECT *, pow(2.0e0, date_diff('day', min(day) OVER (PARTITION BY squad), day) / 30.0e0) AS w FROM d)
SELECT squad, day, {r('sum(pace * w) OVER v / sum(w) OVER v')} AS trend FROM s WINDOW v AS (PARTITION BY squad ORDER BY day)""")
def pace_progression(spark, sf):
    d = activities(spark, sf).groupBy(K, "day").agg(F.avg(F.col("moving_s") / (F.col("dist_m") / 1000)).alias("pace"))
    return rounded(sm.recency_mean(d, K, "pace"), "trend").select(K, "day", "trend")


@query("""SELECT kind, n FROM (SELECT 'status:' || o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY 1) x WHERE n >= 2""")
def metric_availability(spark, sf):
    return table(spark, sf, "orders").groupBy(F.concat(F.lit("status:"), "o_orderstatus").alias("kind")).agg(F.count("*").alias("n")).where("n >= 2")


@query(f"{REC}, e AS (SELECT athlete_id, (SELECT min(b.epoch) FROM record b WHERE b.athlete_id = a.athlete_id AND CAST(b.d AS DOUBLE) >= CAST(a.d AS DOUBLE) + 500) - a.epoch AS e FROM record a) SELECT athlete_id, min(e) AS best_s FROM e GROUP BY 1 HAVING min(e) IS NOT NULL")
def best_effort_window(spark, sf):
    return ordered.best_effort(records(spark, sf), "athlete_id", 500.0)


@query(f"""{REC}, s AS (SELECT athlete_id, epoch, CAST(d AS DOUBLE) AS d, lag(CAST(d AS DOUBLE)) OVER w AS p, lag(epoch) OVER w AS q FROM record WINDOW w AS (PARTITION BY athlete_id ORDER BY i)), x AS (SELECT *, unnest(range(CAST(floor(p / 250) AS BIGINT) + 1, CAST(floor(d / 250) AS BIGINT) + 1)) AS n FROM s WHERE d > p)
SELECT athlete_id, n, {r('q + (n * 250.0e0 - p) / (d - p) * (epoch - q)', 3)} AS at_s FROM x""")
def km_splits(spark, sf):
    return rounded(ordered.crossings(records(spark, sf), "athlete_id", 250.0), "at_s", digits=3)


@query(f"""{REC}, s AS (SELECT *, floor((CAST(d AS DOUBLE) - min(CAST(d AS DOUBLE)) OVER (PARTITION BY athlete_id)) / 400) AS b FROM record), t AS (SELECT *, lag(b) OVER (PARTITION BY athlete_id ORDER BY i) AS p, max(i) OVER (PARTITION BY athlete_id) AS l FROM s)
SELECT athlete_id, i, epoch FROM t WHERE p IS NULL OR b > p OR i = l""")
def distance_resample(spark, sf):
    return ordered.downsample(records(spark, sf), "athlete_id", 400.0).select("athlete_id", F.col("i").cast("long").alias("i"), "epoch")


@query(f"""{REC}, s AS (SELECT *, epoch - lag(epoch) OVER (PARTITION BY athlete_id ORDER BY i) AS dt FROM record), t AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY dt) q, count(*) OVER (PARTITION BY athlete_id) n FROM s WHERE dt IS NOT NULL),
m AS (SELECT athlete_id, max(CASE WHEN q = floor(n / 2.0e0) + 1 THEN dt END) AS m FROM t GROUP BY 1), f AS (SELECT t.*, i - row_number() OVER (PARTITION BY athlete_id ORDER BY i) AS g FROM t JOIN m USING (athlete_id) WHERE dt >= greatest(20, 2.0e0 * m))
SELECT athlete_id, min(i) AS first_i, CAST(sum(dt) AS BIGINT) AS seconds, count(*) AS steps FROM f GROUP BY athlete_id, g""")
def pause_islands(spark, sf):
    return ordered.pauses(records(spark, sf), "athlete_id", factor=2.0).withColumn("first_i", F.col("first_i").cast("long"))


@query(f"{REC}, s AS (SELECT athlete_id, i, hr >= 100 AS fast FROM record), f AS (SELECT athlete_id, i, i - row_number() OVER (PARTITION BY athlete_id ORDER BY i) AS g FROM s WHERE fast) SELECT athlete_id, min(i) AS lo, max(i) AS hi, count(*) AS n FROM f GROUP BY athlete_id, g HAVING count(*) >= 2")
def rep_detection(spark, sf):
    f = ordered.islands(records(spark, sf), "athlete_id", F.col("hr") >= 100)
    return f.groupBy("athlete_id", "island").agg(F.min("i").cast("long").alias("lo"), F.max("i").cast("long").alias("hi"), F.count("*").alias("n")).where("n >= 2").drop("island")


@query("""WITH s AS (SELECT l_suppkey AS k, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS lo, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + l_linenumber AS BIGINT) AS hi FROM lineitem),
t AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s), u AS (SELECT *, sum(CASE WHEN e IS NULL OR lo > e THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM t)
SELECT k, min(lo) AS lo, max(hi) AS hi FROM u GROUP BY k, g""")
def interval_merge(spark, sf):
    lo = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return ordered.merge_intervals(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), lo.alias("lo"), (lo + F.col("l_linenumber")).alias("hi")), "k", "lo", "hi")


@query(f"{REC} SELECT athlete_id, i, {r('avg(hr) OVER (PARTITION BY athlete_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS smooth FROM record")
def moving_mean(spark, sf):
    m = ordered.moving_mean(records(spark, sf), "athlete_id", "hr", 3, "smooth")
    return rounded(m, "smooth").select("athlete_id", F.col("i").cast("long").alias("i"), "smooth")


PROBE = "probe AS (SELECT athlete_id, epoch, i FROM record WHERE event_type = 'click'), reading AS (SELECT athlete_id, epoch, max(hr) AS hr FROM record WHERE event_type = 'purchase' GROUP BY 1, 2)"


def _sides(spark, sf):
    e = records(spark, sf)
    return e.where("event_type = 'click'").select("athlete_id", "epoch", F.col("i").cast("long").alias("i")), e.where("event_type = 'purchase'").select("athlete_id", "epoch", "hr")


@query(f"""{REC}, {PROBE} SELECT athlete_id, epoch, i, CASE WHEN hg IS NULL OR lg <= hg THEN CASE WHEN lg <= 40000 THEN lv END ELSE CASE WHEN hg <= 40000 THEN hv END END AS hr FROM (
SELECT p.*, p.epoch - l.epoch AS lg, l.hr AS lv, h.epoch - p.epoch AS hg, h.hr AS hv FROM probe p ASOF LEFT JOIN reading l ON p.athlete_id = l.athlete_id AND p.epoch >= l.epoch ASOF LEFT JOIN reading h ON p.athlete_id = h.athlete_id AND p.epoch <= h.epoch) x""")
def asof_nearest(spark, sf):
    return ordered.asof_nearest(*_sides(spark, sf), "athlete_id", "epoch", "hr", 40000)


@query(f"""{REC}, {PROBE} SELECT athlete_id, epoch, i, {r('CASE WHEN ht = epoch THEN hv WHEN lt IS NULL THEN hv WHEN ht IS NULL THEN lv ELSE lv + (epoch - lt) / CAST(ht - lt AS DOUBLE) * (hv - lv) END')} AS hr FROM (
SELECT p.*, l.epoch AS lt, l.hr AS lv, h.epoch AS ht, h.hr AS hv FROM probe p ASOF LEFT JOIN reading l ON p.athlete_id = l.athlete_id AND p.epoch >= l.epoch ASOF LEFT JOIN reading h ON p.athlete_id = h.athlete_id AND p.epoch <= h.epoch) x""")
def asof_interpolate(spark, sf):
    return rounded(ordered.asof_linear(*_sides(spark, sf), "athlete_id", "epoch", "hr"), "hr")


PAIRS = f"""{REC}, pair AS (SELECT l.i AS li, l.athlete_id AS la, r.i AS ri, r.athlete_id AS ra, l.epoch AS le, r.epoch AS re FROM record l JOIN record r ON r.epoch BETWEEN l.epoch AND l.epoch + 300 AND (l.epoch, l.athlete_id) < (r.epoch, r.athlete_id) AND abs(l.step_m - r.step_m) <= 0.10 * greatest(l.step_m, r.step_m) AND l.hr = r.hr)"""


def _pairs(spark, sf):
    e = records(spark, sf).select(F.col("athlete_id").alias("id"), "i", "epoch", F.col("step_m").cast("double").alias("m"), F.col("step_m").alias("step_m"), "hr")
    close = lambda x, y: (F.abs(F.col(f"{x}.step_m") - F.col(f"{y}.step_m")) <= F.lit(0.10).cast("decimal(3,2)") * F.greatest(f"{x}.step_m", f"{y}.step_m")) & (F.col(f"{x}.hr") == F.col(f"{y}.hr"))
    return ordered.band_join(e, "epoch", 300, close, row=("id", "i"), equal=("hr",))


@query(f"{PAIRS} SELECT la, li, ra, ri FROM pair")
def duplicate_band_join(spark, sf):
    return _pairs(spark, sf).select(F.col("l.id").alias("la"), F.col("l.i").cast("long").alias("li"), F.col("r.id").alias("ra"), F.col("r.i").cast("long").alias("ri"))


VERTEX = f"{PAIRS}, edge AS (SELECT la * 100000 + li AS a, ra * 100000 + ri AS b FROM pair UNION ALL SELECT ra * 100000 + ri, la * 100000 + li FROM pair), reach(v, c) AS (SELECT a, a FROM edge UNION SELECT e.b, reach.c FROM reach JOIN edge e ON e.a = reach.v), comp AS (SELECT v, min(c) AS c FROM reach GROUP BY 1)"


def _vertex(athlete: str, i: str):
    return F.struct(F.col(athlete).cast("long").alias("athlete_id"), F.col(i).cast("long").alias("i"))


def _number(v: str):
    """A vertex's number, never shared: the SQL's up to 99,999 events of an athlete, a negative one from there (athletes below 2^31; others overflow with an error)."""
    athlete, i = F.col(f"{v}.athlete_id"), F.col(f"{v}.i")
    return F.when(i < 100000, athlete * 100000 + i).otherwise(-(athlete * (1 << 32) + i))


def _components(spark, sf):
    """v, c: each event and the first one that pairs lead to from it, itself where it has none. Events of one heart rate, bin
    of 300 s and bin of a step's logarithm (or without a step) pair for sure."""
    e = records(spark, sf).where("step_m >= 0 and hr is not null").select(_vertex("athlete_id", "i").alias("v"), "epoch", "step_m", "hr")
    e = e.withColumn("at", F.floor(F.col("epoch") / 300).cast("long")).withColumn("size", F.coalesce(F.floor(F.ln(F.col("step_m").cast("double")) / 0.105).cast("long"), F.lit(-1000)))
    close = lambda x, y: F.abs(x["step_m"] - y["step_m"]) <= F.lit(0.10).cast("decimal(3,2)") * F.greatest(x["step_m"], y["step_m"])
    near = lambda x, y: (F.abs(x["epoch"] - y["epoch"]) <= 300) & (x["hr"] == y["hr"]) & close(x, y)
    return graph.linked(e, "v", F.struct("hr", "at", "size"), ("epoch", "step_m"), ("hr", "at", "size"), (0, 1, 2), near)


@query(f"{VERTEX} SELECT v, c FROM comp")
def duplicate_components(spark, sf):
    comp = graph.checkpointed(_components(spark, sf))
    several = comp.where("v <> c").select("c").distinct()  # an event without a pair is no vertex
    return comp.join(several, "c", "left_semi").select(_number("v").alias("v"), _number("c").alias("c"))


@query(f"{VERTEX} SELECT c, min_by(v, (-hr, -step_m, v)) AS winner, count(*) AS n FROM comp JOIN record ON v = athlete_id * 100000 + i GROUP BY 1")
def duplicate_winner(spark, sf):
    e = records(spark, sf).select(_vertex("athlete_id", "i").alias("v"), "hr", "step_m")
    best = _components(spark, sf).join(e, "v").groupBy("c").agg(F.min_by("v", F.struct(-F.col("hr"), -F.col("step_m"), F.col("v"))).alias("winner"), F.count("*").alias("n")).where("n > 1")
    return best.select(_number("c").alias("c"), _number("winner").alias("winner"), "n")


@query("SELECT o_orderkey AS activity_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def primary_anti_join(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("activity_id")).join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("activity_id")), "activity_id", "left_anti")


@query(f"{REC} SELECT DISTINCT athlete_id, CAST(round(lat * 1000) AS BIGINT) AS r, CAST(round(lon * 1000) AS BIGINT) AS c FROM record")
def heat_cells_distinct(spark, sf):
    return records(spark, sf).select("athlete_id", F.round(F.col("lat") * 1000).cast("long").alias("r"), F.round(F.col("lon") * 1000).cast("long").alias("c")).distinct()


@query(f"{REC}, s AS (SELECT athlete_id, hr % 10 AS a, lead(hr % 10) OVER (PARTITION BY athlete_id ORDER BY i) AS b FROM record) SELECT a, b, count(DISTINCT athlete_id) AS runs FROM s WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2 HAVING count(DISTINCT athlete_id) >= 2")
def cell_transitions(spark, sf):
    s = records(spark, sf).select("athlete_id", (F.col("hr") % 10).alias("a"), F.lead(F.col("hr") % 10).over(W.partitionBy("athlete_id").orderBy("i")).alias("b"))
    once = s.where("b is not null and a <> b").distinct()  # then a plain count: the distinct is partial before the shuffle
    return once.groupBy("a", "b").agg(F.count("*").alias("runs")).where("runs >= 2")


@query(f"{ACT} SELECT athlete_id, min_by(activity_id, (moving_s / CAST(dist_m AS DOUBLE), activity_id)) AS activity_id, count(*) AS attempts, date_diff('day', min(day), max(day)) AS span_days FROM activity GROUP BY 1")
def segment_pr(spark, sf):
    pace = F.struct(F.col("moving_s") / F.col("dist_m"), F.col("activity_id"))
    return activities(spark, sf).groupBy("athlete_id").agg(F.min_by("activity_id", pace).alias("activity_id"), F.count("*").alias("attempts"), F.datediff(F.max("day"), F.min("day")).cast("long").alias("span_days"))


@query(f"{ACT} SELECT activity_id, CAST(row_number() OVER w AS INT) AS lap, count(*) OVER (PARTITION BY athlete_id, date_trunc('year', day)) AS laps FROM activity WINDOW w AS (PARTITION BY athlete_id, date_trunc('year', day) ORDER BY day, activity_id)")
def lap_numbering(spark, sf):
    w = W.partitionBy("athlete_id", F.trunc("day", "year"))
    return activities(spark, sf).select("activity_id", F.row_number().over(w.orderBy("day", "activity_id")).alias("lap"), F.count("*").over(w).alias("laps"))


@query(f"{REC}, s AS (SELECT athlete_id, hr - lag(hr) OVER (PARTITION BY athlete_id ORDER BY i) AS x FROM record) SELECT athlete_id, CAST(sum(greatest(x, 0)) AS BIGINT) AS gain, CAST(sum(greatest(-x, 0)) AS BIGINT) AS loss FROM s WHERE x IS NOT NULL GROUP BY 1")
def elevation_gain(spark, sf):
    s = records(spark, sf).select("athlete_id", (F.col("hr") - F.lag("hr").over(W.partitionBy("athlete_id").orderBy("i"))).alias("x")).where("x is not null")
    return s.groupBy("athlete_id").agg(F.sum(F.greatest("x", F.lit(0))).alias("gain"), F.sum(F.greatest(-F.col("x"), F.lit(0))).alias("loss"))


@query(f"""{REC}, s AS (SELECT *, epoch - lag(epoch) OVER (PARTITION BY athlete_id ORDER BY i) AS dt FROM record), t AS (SELECT *, sum(dt) OVER (PARTITION BY athlete_id ORDER BY i) - dt AS before, sum(dt) OVER (PARTITION BY athlete_id) AS total FROM s WHERE dt > 0),
h AS (SELECT athlete_id, CAST(sum(step_m) FILTER (before < total / 2.0e0) AS DOUBLE) / sum(hr * dt) FILTER (before < total / 2.0e0) AS a, CAST(sum(step_m) FILTER (before >= total / 2.0e0) AS DOUBLE) / sum(hr * dt) FILTER (before >= total / 2.0e0) AS b FROM t GROUP BY 1)
SELECT athlete_id, {r('(a - b) / a * 100')} AS decoupling FROM h WHERE a > 0 AND b IS NOT NULL""")
def decoupling(spark, sf):
    w = W.partitionBy("athlete_id")
    s = records(spark, sf).withColumn("dt", F.col("epoch") - F.lag("epoch").over(w.orderBy("i"))).where("dt > 0")
    s = s.withColumn("first", F.sum("dt").over(w.orderBy("i").rowsBetween(W.unboundedPreceding, 0)) - F.col("dt") < F.sum("dt").over(w) / 2)
    half = lambda k: F.sum(F.when(F.col("first") == k, F.col("step_m"))).cast("double") / F.sum(F.when(F.col("first") == k, F.col("hr") * F.col("dt")))
    h = s.groupBy("athlete_id").agg(half(True).alias("a"), half(False).alias("b")).where("a > 0 and b is not null")
    return rounded(h.select("athlete_id", ((F.col("a") - F.col("b")) / F.col("a") * 100).alias("decoupling")), "decoupling")


HAV = "2 * 6371000.0e0 * asin(least(1.0e0, sqrt(pow(sin((radians(q) - radians(p)) / 2), 2) + cos(radians(p)) * cos(radians(q)) * pow(sin(radians(t - s) / 2), 2))))"


@query(f"{REC}, x AS (SELECT athlete_id, lat AS q, lon AS t, lag(lat) OVER w AS p, lag(lon) OVER w AS s FROM record WINDOW w AS (PARTITION BY athlete_id ORDER BY i)) SELECT athlete_id, {r(f'sum({HAV})', 2)} AS metres FROM x WHERE p IS NOT NULL GROUP BY 1")
def arc_length(spark, sf):
    w = W.partitionBy("athlete_id").orderBy("i")
    s = records(spark, sf).withColumn("p", F.lag("lat").over(w)).withColumn("s", F.lag("lon").over(w)).where("p is not null")
    return rounded(s.groupBy("athlete_id").agg(F.sum(ph.haversine_m(F.col("p"), F.col("s"), F.col("lat"), F.col("lon"))).alias("metres")), "metres", digits=2)


@query(f"{ACT} SELECT count(*) AS runs, {r('sum(dist_m) / 1000.0e0')} AS km, CAST(sum(moving_s) AS BIGINT) AS seconds, max_by(activity_id, (dist_m, -activity_id)) AS longest FROM activity")
def overall_totals(spark, sf):
    a = activities(spark, sf).agg(F.count("*").alias("runs"), (F.sum("dist_m") / 1000).alias("km"), F.sum("moving_s").alias("seconds"), F.max_by("activity_id", F.struct("dist_m", -F.col("activity_id"))).alias("longest"))
    return rounded(a, "km")


@query(f"{ACT} SELECT activity_id, CAST(floor(s / 60) AS BIGINT) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS pace FROM (SELECT activity_id, CAST(round(moving_s / (dist_m / 1000.0e0)) AS BIGINT) AS s FROM activity) x")
def pace_text(spark, sf):
    return activities(spark, sf).select("activity_id", ph.clock(F.col("moving_s") / (F.col("dist_m") / 1000)).alias("pace"))
