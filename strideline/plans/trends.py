"""Queries over days, months, bests and goals, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.functions import physiology as ph
from strideline.operators import load, ordered
from strideline.operators import summaries as sm
from strideline.plans.catalog import ACT, BANDS, CURVE, DAILY, DAYS, GA, K, POINTS, RATIO, REC, _daily, _points, query, r, rounded
from strideline.sources.views import activities, records, table

#: Levels of age grades by their least percentage; days of tapering by the greatest distance.
LEVELS = ((100, "world record"), (90, "world class"), (80, "national class"), (70, "regional class"), (60, "local class"))
TAPER = ((10_200, 7), (21_519.45, 10), (float("inf"), 14))


@query(f"""{ACT}, t AS (SELECT squad, CAST(date_trunc('week', day) AS DATE) AS week, sum(dist_m) / 1000.0e0 AS km, array_to_string(list(activity_id || ':' || dist_m ORDER BY day, activity_id), ' ') AS runs FROM activity GROUP BY 1, 2),
spine AS (SELECT squad, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM t GROUP BY squad) SELECT squad, week, {r('coalesce(km, 0)')} AS km, coalesce(runs, '') AS runs FROM spine LEFT JOIN t USING (squad, week)""")
def weekly_breakdown(spark, sf):
    """Weeks with their runs in order; weeks without any have none."""
    a = activities(spark, sf).withColumn("week", F.to_date(F.trunc("day", "week")))
    runs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", "activity_id", "dist_m"))), lambda x: F.concat(x["activity_id"].cast("string"), F.lit(":"), x["dist_m"].cast("string"))), " ")
    t = a.groupBy(K, "week").agg((F.sum("dist_m") / 1000).alias("km"), runs.alias("runs"))
    spine = t.groupBy(K).agg(F.expr("sequence(min(week), max(week), interval 7 days)").alias("w")).select(K, F.explode("w").alias("week"))
    return rounded(spine.join(t, [K, "week"], "left").select(K, "week", F.coalesce("km", F.lit(0.0)).alias("km"), F.coalesce("runs", F.lit("")).alias("runs")), "km")


EFFORTS = f"{ACT}, effort AS (SELECT activity_id, athlete_id, squad, day, label, band_m, {GA} * band_m / dist_m AS ga_s, moving_s * band_m / dist_m AS s, elapsed_s > 0 AND (elapsed_s - moving_s) / CAST(elapsed_s AS DOUBLE) >= 0.2e0 AS rest FROM activity JOIN (VALUES {BANDS}) b(label, band_m) ON dist_m >= band_m WHERE moving_s > 0)"


def _efforts(spark, sf):
    """An effort over each band that an activity is long enough for, even-paced, raw and grade-adjusted."""
    bands = F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.lit(float(m)).alias("band_m")) for n, m in sm.DISTANCES)))
    a = activities(spark, sf).where("moving_s > 0").withColumn("b", bands).where("dist_m >= b.band_m")
    ga = ph.ga_seconds(F.col("moving_s"), F.col("gain_m"), F.col("dist_m") / 1000)
    rest = F.coalesce((F.col("elapsed_s") > 0) & ((F.col("elapsed_s") - F.col("moving_s")) / F.col("elapsed_s") >= 0.2), F.lit(False))
    part = lambda t: t * F.col("b.band_m") / F.col("dist_m")  # noqa: E731  first times, then over, as the SQL does: equal efforts stay equal to the last bit
    return a.select("activity_id", "athlete_id", K, "day", "b.label", "b.band_m", part(ga).alias("ga_s"), part(F.col("moving_s")).alias("s"), rest.alias("rest"))


@query(f"{EFFORTS} SELECT squad, label, min_by(activity_id, (round(ga_s, 6), activity_id)) AS holder, {r('min(ga_s)')} AS ga_s FROM effort GROUP BY 1, 2")
def effort_holders(spark, sf):
    return rounded(_efforts(spark, sf).groupBy(K, "label").agg(F.min_by("activity_id", F.struct(F.round("ga_s", 6), "activity_id")).alias("holder"), F.min("ga_s").alias("ga_s")), "ga_s")


VD = "((0.000104e0 * (band_m / (s / 60)) * (band_m / (s / 60)) + 0.182258e0 * (band_m / (s / 60)) - 4.60e0) / (0.8e0 + 0.1894393e0 * exp(-0.012778e0 * s / 60) + 0.2989558e0 * exp(-0.1932605e0 * s / 60)))"


@query(f"{EFFORTS}, p AS (SELECT squad, CAST(date_trunc('month', day) AS DATE) AS month, activity_id, max({VD}) AS v FROM effort WHERE band_m >= 5000 GROUP BY 1, 2, 3) SELECT squad, month, {r('max(v)')} AS vdot FROM p GROUP BY 1, 2")
def vdot_of_four(spark, sf):
    """The month's best VDOT over an activity's efforts of 5 km and more."""
    v, t = F.col("band_m") / (F.col("s") / 60), F.col("s") / 60
    vdot = (0.000104 * v * v + 0.182258 * v - 4.60) / (0.8 + 0.1894393 * F.exp(-0.012778 * t) + 0.2989558 * F.exp(-0.1932605 * t))
    return rounded(_efforts(spark, sf).where("band_m >= 5000").groupBy(K, F.trunc("day", "month").alias("month")).agg(F.max(vdot).alias("vdot")), "vdot")


GRADES = f"""{EFFORTS}, factor AS (SELECT sex, label, band_m, age, band_m * 0.17e0 + CASE sex WHEN 'female' THEN 20 ELSE 0 END AS open_s, round(1 - 0.00008e0 * pow(greatest(age - 30, 0), 2), 4) AS factor FROM (VALUES ('male'), ('female')) s(sex), (VALUES {BANDS}) b(label, band_m), range(5, 101) g(age)),
aged AS (SELECT e.*, CASE WHEN athlete_id % 2 = 0 THEN 'male' ELSE 'female' END AS sex, 1 + athlete_id % 110 - CAST(floor(date_diff('day', day, max(day) OVER ()) / 365.25e0) AS BIGINT) AS age FROM effort e),
graded AS (SELECT a.*, open_s / (s * factor) * 100 AS pct FROM aged a JOIN factor f ON f.sex = a.sex AND f.label = a.label AND f.age = greatest(5, least(100, a.age)))"""


def age_factors(spark):
    """sex, label, age, factor, open_s by a rule; archive.read_age_factors reads a published table of the same columns."""
    bands = F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.lit(float(m)).alias("band_m")) for n, m in sm.DISTANCES)))
    t = spark.range(5, 101).select(F.col("id").alias("age"), F.explode(F.array(F.lit("male"), F.lit("female"))).alias("sex")).select("age", "sex", bands.alias("b"))
    open_s = F.col("b.band_m") * 0.17 + F.when(F.col("sex") == "female", 20).otherwise(0)
    return t.select("sex", "b.label", "age", open_s.alias("open_s"), F.round(1 - 0.00008 * F.pow(F.greatest(F.col("age") - 30, F.lit(0)), F.lit(2)), 4).alias("factor"))


def graded(efforts, factors):
    """efforts with pct: the best time of all over the time's equivalent at no handicap; the age is held within the table."""
    latest = efforts.agg(F.max("day").alias("_latest"))
    e = efforts.crossJoin(F.broadcast(latest)).withColumn("age", F.col("age_now") - F.floor(F.datediff("_latest", "day") / 365.25))  # latest is one row
    e = e.withColumn("age", F.greatest(F.lit(5), F.least(F.lit(100), "age")))
    return e.join(F.broadcast(factors), ["sex", "label", "age"]).withColumn("pct", F.col("open_s") / (F.col("s") * F.col("factor")) * 100)  # 96 ages, two sexes, a few distances


def _graded(spark, sf):
    e = _efforts(spark, sf).withColumn("sex", F.when(F.col("athlete_id") % 2 == 0, "male").otherwise("female")).withColumn("age_now", 1 + F.col("athlete_id") % 110)
    return graded(e, age_factors(spark))


@query(f"{GRADES} SELECT squad, CAST(date_trunc('month', day) AS DATE) AS month, {r('max(pct)')} AS pct FROM graded WHERE NOT rest GROUP BY 1, 2")
def age_grade_monthly(spark, sf):
    return rounded(_graded(spark, sf).where("not rest").groupBy(K, F.trunc("day", "month").alias("month")).agg(F.max("pct").alias("pct")), "pct")


LEVEL = "CASE " + " ".join(f"WHEN pct >= {p} THEN '{n}'" for p, n in LEVELS) + " ELSE 'recreational' END"


@query(f"{GRADES}, b AS (SELECT squad, label, max_by(activity_id, (pct, -activity_id)) AS activity_id, max(pct) AS pct FROM graded WHERE NOT rest OR band_m < 1000 GROUP BY 1, 2) SELECT squad, label, activity_id, {r('pct')} AS pct, {LEVEL} AS level FROM b")
def age_grade_best(spark, sf):
    b = _graded(spark, sf).where("not rest or band_m < 1000").groupBy(K, "label").agg(F.max_by("activity_id", F.struct("pct", -F.col("activity_id"))).alias("activity_id"), F.max("pct").alias("pct"))
    level = F.coalesce(*(F.when(F.col("pct") >= p, n) for p, n in LEVELS), F.lit("recreational"))
    return rounded(b.withColumn("level", level), "pct")


@query(f"{ACT}, l AS (SELECT max(day) AS as_of FROM activity) SELECT squad, count(*) AS runs, {r('sum(dist_m) / 1000.0e0')} AS km, count(*) FILTER (day >= date_trunc('week', as_of)) AS week_runs, {r('coalesce(sum(dist_m) FILTER (day >= date_trunc(' + chr(39) + 'week' + chr(39) + ', as_of)), 0) / 1000.0e0')} AS week_km FROM activity, l GROUP BY 1")
def totals_with_week(spark, sf):
    """Totals, and those of the ISO week of the newest activity."""
    a = activities(spark, sf)
    a = a.crossJoin(F.broadcast(a.agg(F.trunc(F.max("day"), "week").alias("monday"))))  # one row
    now = F.col("day") >= F.col("monday")
    t = a.groupBy(K).agg(F.count("*").alias("runs"), (F.sum("dist_m") / 1000).alias("km"), F.count(F.when(now, 1)).alias("week_runs"), (F.coalesce(F.sum(F.when(now, F.col("dist_m"))), F.lit(0)) / 1000).alias("week_km"))
    return rounded(t, "km", "week_km")


@query(f"""{DAYS}, spine AS (SELECT squad, CAST(unnest(generate_series(date_trunc('month', min(day)), max(day), INTERVAL 1 MONTH)) AS DATE) AS month FROM days GROUP BY squad), k AS (SELECT s.squad, month, km, row_number() OVER (PARTITION BY s.squad, month ORDER BY km DESC) q FROM spine s JOIN days d ON d.squad = s.squad AND date_trunc('month', d.day) <= month)
SELECT squad, month, CAST(coalesce(max(CASE WHEN km >= q THEN q END), 0) AS BIGINT) AS e FROM k GROUP BY 1, 2""")
def eddington_by_month(spark, sf):
    """The Eddington number at each month's end, months without activity too."""
    return sm.eddington_progression(sm.daily_km(activities(spark, sf), K), K, every_month=True).withColumn("e", F.col("e").cast("long"))


@query(f"""{RATIO}, e AS (SELECT squad, day AS last, chronic, greatest(0, least(CASE WHEN tsb < -25 OR acwr > 1.5e0 THEN 0.8e0 * chronic WHEN tsb < -10 OR acwr > 1.3e0 THEN chronic WHEN tsb > 12 AND acwr < 1.1e0 THEN greatest(acute, chronic) * 1.10e0 ELSE greatest(acute, chronic) * 1.05e0 END, 1.3e0 * chronic)) AS target FROM ratio WHERE i = l AND i >= 13 AND chronic > 0),
v AS (SELECT a.squad, sum(dist_m) / 1000.0e0 AS km28, sum(gain_m) AS gain28, coalesce(sum(dist_m) FILTER (a.day >= last - 6), 0) / 1000.0e0 AS km7 FROM activity a JOIN e ON e.squad = a.squad AND a.day >= last - 27 GROUP BY 1), l AS (SELECT d.squad, sum(load) AS load28 FROM daily d JOIN e ON e.squad = d.squad AND d.day >= last - 27 GROUP BY 1),
w AS (SELECT squad, target / CASE WHEN km28 > 0 THEN load28 / km28 ELSE 10 END AS km, CASE WHEN km28 > 0 THEN gain28 / km28 ELSE 0 END AS gpk, km7 FROM e JOIN v USING (squad) JOIN l USING (squad))
SELECT squad, CAST(round_even(km, 0) AS BIGINT) AS target_km, CAST(round_even(round_even(km, 0) * 0.40e0, 0) AS BIGINT) AS long_run_km, CAST(round_even(round_even(km, 0) * gpk / 10.0e0, 0) * 10 AS BIGINT) AS target_gain, {r('km7', 1)} AS last7_km FROM w""")
def next_week_volume(spark, sf):
    """The target load as kilometres and metres of climbing, by the squad's own ratios over the last 28 days."""
    d = _daily(spark, sf)
    plan = load.plan_targets(d, K).select(K, "target")
    last = d.groupBy(K).agg(F.max("day").alias("last"))  # a row a squad
    a = activities(spark, sf).join(last, K).where("day >= date_sub(last, 27)")
    v = a.groupBy(K).agg((F.sum("dist_m") / 1000).alias("km28"), F.sum("gain_m").alias("gain28"), (F.coalesce(F.sum(F.when(F.col("day") >= F.date_sub("last", 6), F.col("dist_m"))), F.lit(0)) / 1000).alias("km7"))
    l28 = d.join(last, K).where("day >= date_sub(last, 27)").groupBy(K).agg(F.sum("load").alias("load28"))
    w = plan.join(v, K).join(l28, K)
    has = F.col("km28") > 0
    km = F.bround(F.col("target") / F.when(has, F.col("load28") / F.col("km28")).otherwise(10.0))
    gpk = F.when(has, F.col("gain28") / F.col("km28")).otherwise(0.0)
    return rounded(w.select(K, km.cast("long").alias("target_km"), F.bround(km * 0.40).cast("long").alias("long_run_km"), (F.bround(km * gpk / 10.0) * 10).cast("long").alias("target_gain"), F.col("km7").alias("last7_km")), "last7_km", digits=1)


#: Bounds of the five zones around critical speed, as parts of its pace.
CS_BOUNDS = (("Z1 easy", 1.30, 1.155), ("Z2 endurance", 1.155, 1.08), ("Z3 tempo", 1.08, 1.02), ("Z4 threshold", 1.02, 0.97), ("Z5 VO2/speed", 0.97, 0.85))
CS = f"{POINTS}, cs AS (SELECT squad, regr_slope(band_m, best_s) AS cs, regr_intercept(band_m, best_s) AS dp FROM points WHERE band_m >= 1200 GROUP BY squad HAVING count(*) >= 2)"
_CSV = ", ".join(f"('{n}', {lo}e0, {hi}e0)" for n, lo, hi in CS_BOUNDS)


@query(f"{CS} SELECT squad, zone, {r('1000 / cs * lo')} AS lo_s, {r('1000 / cs * hi')} AS hi_s FROM cs, (VALUES {_CSV}) z(zone, lo, hi) WHERE cs > 0")
def critical_speed_zones(spark, sf):
    c = sm.critical_speed(_points(spark, sf), K).where("cs > 0")
    z = F.explode(F.array(*(F.struct(F.lit(n).alias("zone"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in CS_BOUNDS)))
    return rounded(c.withColumn("z", z).select(K, "z.zone", (1000 / F.col("cs") * F.col("z.lo")).alias("lo_s"), (1000 / F.col("cs") * F.col("z.hi")).alias("hi_s")), "lo_s", "hi_s")


@query(f"{CS}, p AS (SELECT squad, moving_s, {GA} / (dist_m / 1000.0e0) / (1000 / cs) AS x FROM activity JOIN cs USING (squad) WHERE dist_m > 0 AND moving_s > 0 AND cs > 0) SELECT squad, CAST(CASE WHEN x >= 1.155e0 THEN 0 WHEN x >= 1.08e0 THEN 1 WHEN x >= 1.02e0 THEN 2 WHEN x >= 0.97e0 THEN 3 ELSE 4 END AS INT) AS zone, CAST(sum(moving_s) AS BIGINT) AS seconds FROM p GROUP BY 1, 2")
def critical_speed_zone_time(spark, sf):
    """Time by the zone of each run's average grade-adjusted pace; paces outside all bands count for the nearest."""
    c = sm.critical_speed(_points(spark, sf), K).where("cs > 0").select(K, "cs")
    km = F.col("dist_m") / 1000
    a = activities(spark, sf).where("dist_m > 0 and moving_s > 0").join(c, K)  # a row a squad
    x = ph.ga_seconds(F.col("moving_s"), F.col("gain_m"), km) / km / (1000 / F.col("cs"))
    zone = F.when(x >= 1.155, 0).when(x >= 1.08, 1).when(x >= 1.02, 2).when(x >= 0.97, 3).otherwise(4)
    return a.groupBy(K, zone.alias("zone")).agg(F.sum("moving_s").alias("seconds"))


@query(f"{CS} SELECT p.squad, label, {r('best_s')} AS best_s, {r('CASE WHEN (band_m - dp) / cs > 0 THEN (band_m - dp) / cs END')} AS model_s FROM points p JOIN cs USING (squad) WHERE band_m >= 1200 AND cs > 0")
def critical_speed_table(spark, sf):
    p = _points(spark, sf)
    c = sm.critical_speed(p, K).where("cs > 0").select(K, "cs", "dprime")
    t = (F.col("band_m") - F.col("dprime")) / F.col("cs")
    return rounded(p.where("band_m >= 1200").join(c, K).select(K, "label", "best_s", F.when(t > 0, t).alias("model_s")), "best_s", "model_s")


THR = f"{CURVE}, five AS (SELECT squad, 5000 / min(best_s) AS raw FROM points WHERE band_m = 5000 GROUP BY 1), few AS (SELECT squad, count(*) AS n FROM points GROUP BY 1), thr AS (SELECT squad, a, b, round(CASE WHEN n >= 2 THEN 5000 / (a * pow(5000, b)) ELSE raw END, 4) AS thr FROM curve JOIN few USING (squad) LEFT JOIN five USING (squad))"


def _threshold(spark, sf):
    p = _points(spark, sf)
    few = p.groupBy(K).agg(F.count("*").alias("n"), F.min(F.when(F.col("band_m") == 5000, F.col("best_s"))).alias("five"))
    c = sm.power_curve(p, K).join(few, K)
    return c.select(K, "a", "b", F.round(F.when(F.col("n") >= 2, 5000 / (F.col("a") * F.pow(F.lit(5000.0), F.col("b")))).otherwise(5000 / F.col("five")), 4).alias("thr"))


@query(f"{THR} SELECT squad, thr FROM thr")
def robust_threshold(spark, sf):
    """Speed over 5 km off the fitted curve, else of the best 5 km."""
    return _threshold(spark, sf).select(K, "thr")


def sql_clock(s: str) -> str:
    """Minutes and rounded seconds, 60 carried."""
    m = f"CAST(floor(({s}) / 60) AS BIGINT)"
    sec = f"CAST(round_even(({s}) - 60 * floor(({s}) / 60), 0) AS BIGINT)"
    return f"CASE WHEN {sec} = 60 THEN ({m} + 1) || ':00' ELSE {m} || ':' || lpad(CAST({sec} AS VARCHAR), 2, '0') END"


def minutes_text(s):
    """M:SS of seconds; 60 s carry."""
    m, sec = F.floor(s / 60), F.bround(s - 60 * F.floor(s / 60)).cast("long")
    return F.when(sec == 60, F.concat((m + 1).cast("string"), F.lit(":00"))).otherwise(F.concat(m.cast("string"), F.lit(":"), F.lpad(sec.cast("string"), 2, "0")))


def hours_text(s):
    """H:MM:SS, or M:SS under an hour; seconds carry into minutes, minutes never into hours."""
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), F.bround(s - 60 * F.floor(s / 60)).cast("long")
    m, sec = F.when(sec == 60, m + 1).otherwise(m), F.when(sec == 60, 0).otherwise(sec)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(sec))).otherwise(F.concat_ws(":", m.cast("string"), two(sec)))


PACES = "('1 km', 1000.0e0), ('1 mile', 1609.344e0), ('5 km', 5000.0e0), ('10 km', 10000.0e0), ('15 km', 15000.0e0), ('Half', 21097.5e0)"


@query(f"{THR} SELECT squad, label, {sql_clock('a * pow(d, b) / (d / 1000)')} || '/km' AS pace, {sql_clock('1000 / thr / 1.03e0')} || '–' || {sql_clock('1000 / thr / 0.88e0')} AS z4, {sql_clock('1000 / thr / 0.88e0')} || '–' || {sql_clock('1000 / thr / 0.82e0')} AS z3 FROM thr, (VALUES {PACES}) v(label, d)")
def current_paces(spark, sf):
    """Even-effort paces off the curve, and the pace ranges of threshold and tempo."""
    v = F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.lit(d).alias("d")) for n, d in (("1 km", 1000.0), ("1 mile", 1609.344), ("5 km", 5000.0), ("10 km", 10000.0), ("15 km", 15000.0), ("Half", 21097.5)))))
    t = _threshold(spark, sf).withColumn("v", v)
    p = lambda part: minutes_text(1000 / F.col("thr") / part)
    pace = minutes_text(F.col("a") * F.pow(F.col("v.d"), F.col("b")) / (F.col("v.d") / 1000))
    return t.select(K, "v.label", F.concat(pace, F.lit("/km")).alias("pace"), F.concat(p(1.03), F.lit("–"), p(0.88)).alias("z4"), F.concat(p(0.88), F.lit("–"), p(0.82)).alias("z3"))


HMS = "CASE WHEN s >= 3600 THEN floor(s / 3600)::BIGINT || ':' || lpad((m + c)::VARCHAR, 2, '0') || ':' || lpad(x::VARCHAR, 2, '0') ELSE (m + c) || ':' || lpad(x::VARCHAR, 2, '0') END"


@query(f"{ACT}, t AS (SELECT activity_id, moving_s * 1.37e0 AS s, dist_m FROM activity), u AS (SELECT *, CAST(floor((s - 3600 * floor(s / 3600)) / 60) AS BIGINT) AS m, CAST(round_even(s - 60 * floor(s / 60), 0) AS BIGINT) AS raw FROM t), w AS (SELECT *, CASE WHEN raw = 60 THEN 1 ELSE 0 END AS c, CASE WHEN raw = 60 THEN 0 ELSE raw END AS x FROM u) SELECT activity_id, {HMS} AS time, {sql_clock('s / (dist_m / 1000.0e0)')} || '/km' AS pace, CASE WHEN v > 0 THEN '+' || v WHEN v < 0 THEN CAST(v AS VARCHAR) ELSE '+0' END AS signed FROM (SELECT *, CAST(round_even(sin(activity_id) * 3, 0) AS BIGINT) AS v FROM w) q")
def time_texts(spark, sf):
    """Times, paces, and whole numbers with a sign but no -0."""
    a = activities(spark, sf).select("activity_id", (F.col("moving_s") * 1.37).alias("s"), "dist_m", F.bround(F.sin("activity_id") * 3).cast("long").alias("v"))
    signed = F.when(F.col("v") < 0, F.col("v").cast("string")).otherwise(F.concat(F.lit("+"), F.col("v").cast("string")))
    return a.select("activity_id", hours_text(F.col("s")).alias("time"), F.concat(minutes_text(F.col("s") / (F.col("dist_m") / 1000)), F.lit("/km")).alias("pace"), signed.alias("signed"))


@query("""SELECT o_orderkey AS id, raw, coalesce(CAST(try_strptime(raw, '%Y-%m-%d') AS DATE), CAST(try_strptime(raw || '-01', '%Y-%m-%d') AS DATE)) AS day, try_strptime(raw, '%Y-%m-%d') IS NOT NULL AS exact, CAST(CASE WHEN d <= 10200 THEN 7 WHEN d <= 21519.45 THEN 10 ELSE 14 END AS INT) AS taper_days
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE 'soon' END AS raw, 5000 + o_orderkey % 40000 AS d FROM orders) q""")
def race_dates(spark, sf):
    """A race's date: a day, or a month, which stands for its first day; and how long its taper is."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    o = table(spark, sf, "orders").select(k.alias("id"), F.when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "yyyy-MM")).otherwise("soon").alias("raw"), (5000 + k % 40000).alias("d"))
    exact = F.try_to_date("raw", "yyyy-MM-dd")
    days = F.coalesce(*(F.when(F.col("d") <= top, n) for top, n in TAPER))
    return o.select("id", "raw", F.coalesce(exact, F.try_to_date(F.concat("raw", F.lit("-01")), "yyyy-MM-dd")).alias("day"), exact.isNotNull().alias("exact"), days.alias("taper_days"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%-d %b %Y') AS short, strftime(o_orderdate, '%b %y') AS month, strftime(o_orderdate, '%A') AS weekday FROM orders")
def date_labels(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return d.select("day", F.date_format("day", "d MMM yyyy").alias("short"), F.date_format("day", "MMM yy").alias("month"), F.date_format("day", "EEEE").alias("weekday"))


@query(f"{ACT} SELECT squad, n, count(*) AS runs FROM (SELECT squad, day, max(day) OVER (PARTITION BY squad) AS last FROM activity) a, (VALUES (30), (90), (180), (365)) v(n) WHERE day >= last - n GROUP BY 1, 2")
def trailing_ranges(spark, sf):
    """Runs of each range up to the newest day, whose first day counts too."""
    a = activities(spark, sf)
    last = a.groupBy(K).agg(F.max("day").alias("last"))  # a row a squad
    return a.join(last, K).withColumn("n", F.explode(F.array(*map(F.lit, (30, 90, 180, 365))))).where("day >= date_sub(last, n)").groupBy(K, "n").agg(F.count("*").alias("runs"))


@query(f"{ACT}, m AS (SELECT squad, CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS runs FROM activity GROUP BY 1, 2) SELECT squad, month, runs FROM (SELECT *, row_number() OVER (PARTITION BY squad ORDER BY month DESC) AS q FROM m) x WHERE q <= 12")
def last_months(spark, sf):
    m = activities(spark, sf).groupBy(K, F.trunc("day", "month").alias("month")).agg(F.count("*").alias("runs"))
    return m.withColumn("q", F.row_number().over(W.partitionBy(K).orderBy(F.desc("month")))).where("q <= 12").drop("q")


RACES = "('Five', 5000.0e0, 1500), ('Local ten', 10150.0e0, 3000), ('Half', 21097.5e0, 7000), ('Odd', 12345.0e0, NULL)"
STANDARD = "('5 km', 5000.0e0), ('10 km', 10000.0e0), ('15 km', 15000.0e0), ('Half', 21097.5e0)"


@query(f"""{CURVE}, ten AS (SELECT squad, min(best_s) AS t10 FROM points WHERE band_m = 10000 GROUP BY 1), race(name, d, target) AS (VALUES {RACES}), p AS (SELECT c.squad, name, d, target, CASE WHEN t10 > 0 THEN t10 * pow(d / 10000, 1.06e0) WHEN a > 0 THEN a * pow(d, b) ELSE 0 END AS pred FROM curve c LEFT JOIN ten USING (squad), race)
SELECT squad, name, {r('pred')} AS pred, CASE WHEN target IS NULL OR pred > target THEN 'amber' ELSE 'green' END AS status, CASE WHEN target IS NOT NULL THEN CAST(floor(abs(pred - target) / (d / 1000)) AS BIGINT) || 's/km ' || CASE WHEN pred > target THEN 'over' ELSE 'under' END ELSE '' END AS gap, CAST(greatest(0, least(100, round_even((coalesce(target, pred) - pred) / (d / 1000) / 120 * 100 + 50, 0))) AS INT) AS bar FROM p""")
def race_cards(spark, sf):
    """Predictions of configured races (from the 10 km best, else off the curve) against their targets."""
    p = _points(spark, sf)
    ten = p.where("band_m = 10000").groupBy(K).agg(F.min("best_s").alias("t10"))
    race = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(d).alias("d"), F.lit(t).cast("int").alias("target")) for n, d, t in (("Five", 5000.0, 1500), ("Local ten", 10150.0, 3000), ("Half", 21097.5, 7000), ("Odd", 12345.0, None)))))
    c = sm.power_curve(p, K).join(ten, K, "left").withColumn("r", race).select(K, "r.*", "a", "b", "t10")
    pred = F.when(F.col("t10") > 0, ph.riegel(F.col("t10"), 10_000.0, F.col("d"))).when(F.col("a") > 0, F.col("a") * F.pow("d", F.col("b"))).otherwise(0.0)
    c = c.withColumn("pred", pred)
    km = F.col("d") / 1000
    over = F.col("pred") > F.col("target")
    gap = F.when(F.col("target").isNotNull(), F.concat(F.floor(F.abs(F.col("pred") - F.col("target")) / km).cast("string"), F.lit("s/km "), F.when(over, "over").otherwise("under"))).otherwise("")
    bar = F.greatest(F.lit(0), F.least(F.lit(100), F.bround((F.coalesce("target", "pred") - F.col("pred")) / km / 120 * 100 + 50))).cast("int")
    return rounded(c.select(K, "name", "pred", F.when(F.col("target").isNull() | over, "amber").otherwise("green").alias("status"), gap.alias("gap"), bar.alias("bar")), "pred")


@query(f"{CURVE}, p AS (SELECT p.squad, p.label, best_s / (p.band_m / 1000) AS cur, a * pow(p.band_m, b) / (p.band_m / 1000) * 0.97e0 AS lo, a * pow(p.band_m, b) / (p.band_m / 1000) * 1.003e0 AS hi FROM points p JOIN curve USING (squad)), q AS (SELECT *, CAST(CASE WHEN cur > hi THEN floor(cur - hi) ELSE floor(abs(lo - cur)) END AS BIGINT) AS g FROM p) SELECT squad, label, CASE WHEN cur <= lo THEN 'exceeds' WHEN cur <= hi THEN 'on target' ELSE 'below target' END AS status, CASE WHEN cur <= hi THEN '-' ELSE '+' END || CASE WHEN g >= 60 THEN (g // 60) || ':' || lpad(CAST(g % 60 AS VARCHAR), 2, '0') ELSE CAST(g AS VARCHAR) END || 's/km' AS gap FROM q")
def speed_status(spark, sf):
    """How each best pace stands against its target range."""
    p = _points(spark, sf)
    c = p.join(sm.power_curve(p, K), K)
    km = F.col("band_m") / 1000
    cur, own = F.col("best_s") / km, F.col("a") * F.pow("band_m", F.col("b")) / km
    lo, hi = own * 0.97, own * 1.003
    g = F.floor(F.when(cur > hi, cur - hi).otherwise(F.abs(lo - cur))).cast("long")
    text = F.when(g >= 60, F.concat(F.floor(g / 60).cast("string"), F.lit(":"), F.lpad((g % 60).cast("string"), 2, "0"))).otherwise(g.cast("string"))
    return c.select(K, "label", F.when(cur <= lo, "exceeds").when(cur <= hi, "on target").otherwise("below target").alias("status"), F.concat(F.when(cur <= hi, "-").otherwise("+"), text, F.lit("s/km")).alias("gap"))


@query(f"{EFFORTS}, p AS (SELECT squad, label, band_m, activity_id, s FROM effort), h AS (SELECT squad, label, min_by(activity_id, (round(s, 6), activity_id)) AS holder FROM p GROUP BY 1, 2), hold AS (SELECT DISTINCT squad, holder FROM h), pts AS (SELECT h.squad, h.holder, p.label, p.band_m, min(p.s) AS s FROM hold h JOIN p ON p.squad = h.squad AND p.activity_id <> h.holder WHERE p.band_m >= 1200 GROUP BY 1, 2, 3, 4) SELECT squad, holder, {r('regr_slope(band_m, s)')} AS cs FROM pts GROUP BY 1, 2 HAVING count(*) >= 2")
def leave_holder_out(spark, sf):
    """The fit without the activity that holds a best, for each that does. Two bests a band are enough: the best, and the best of others."""
    e = _efforts(spark, sf)
    top = e.withColumn("q", F.row_number().over(W.partitionBy(K, "label").orderBy(F.round("s", 6), "activity_id"))).where("q <= 2")  # an activity has one effort a band
    holders = top.where("q = 1").select(K, F.col("activity_id").alias("holder")).distinct()
    pts = holders.join(top.where("band_m >= 1200"), K).where("activity_id <> holder").groupBy(K, "holder", "band_m").agg(F.min("s").alias("s"))
    return rounded(pts.groupBy(K, "holder").agg(F.count("*").alias("n"), F.regr_slope("band_m", "s").alias("cs")).where("n >= 2").select(K, "holder", "cs"), "cs")


@query(f"""{DAILY}, e AS (SELECT squad, max(i) AS l FROM daily GROUP BY 1), ext AS (SELECT squad, k, i, load FROM daily, range(0, 8) g(k) UNION ALL SELECT squad, k, l + j, 0 FROM e, range(1, 8) q(j), range(0, 8) g(k) WHERE j <= k), w AS (SELECT squad, k, i, sum(load) OVER v7 AS acute, avg(load) OVER v28 * 7 AS chronic, avg(load) OVER v7 AS m, stddev_pop(load) OVER v7 AS sd, max(i) OVER (PARTITION BY squad, k) AS l FROM ext WINDOW v7 AS (PARTITION BY squad, k ORDER BY i ROWS 6 PRECEDING), v28 AS (PARTITION BY squad, k ORDER BY i ROWS 27 PRECEDING))
SELECT squad, CAST(k AS BIGINT) AS k, {r('acute')} AS acute, {r('CASE WHEN chronic > 0 THEN acute / chronic ELSE 0 END')} AS acwr, {r('CASE WHEN sd > 1e-9 THEN m / sd ELSE 0 END')} AS monotony, {r('CASE WHEN sd > 1e-9 THEN acute * m / sd ELSE 0 END', 2)} AS strain FROM w WHERE i = l""")
def rest_preview_all(spark, sf):
    """The load figures as they will stand after 0 to 7 days of rest; only the last 28 days decide them."""
    d = _daily(spark, sf)
    last = d.groupBy(K).agg(F.max("i").alias("l"))  # a row a squad
    near = d.join(last, K).where("i > l - 28").select(K, "i", "load", "l")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))
    rest = last.withColumn("k", k).where("k > 0").withColumn("i", F.explode(F.expr("sequence(l + 1, l + cast(k as int))"))).select(K, "k", "i", F.lit(0.0).alias("load"), "l")
    ext = near.withColumn("k", k).select(K, "k", "i", "load", "l").union(rest).withColumn("at", F.col("l") + F.col("k"))
    acute = F.when(F.col("i") > F.col("at") - 7, F.col("load"))
    g = ext.where("i > at - 28").groupBy(K, "k").agg(F.sum(acute).alias("acute"), (F.avg("load") * 7).alias("chronic"), F.avg(acute).alias("m"), F.stddev_pop(acute).alias("sd"))
    mono = F.when(F.col("sd") > 1e-9, F.col("m") / F.col("sd")).otherwise(0.0)
    out = g.select(K, "k", "acute", F.when(F.col("chronic") > 0, F.col("acute") / F.col("chronic")).otherwise(0.0).alias("acwr"), mono.alias("monotony"), (mono * F.col("acute")).alias("strain"))
    return rounded(rounded(out, "acute", "acwr", "monotony"), "strain", digits=2)


@query(f"{REC}, s AS (SELECT athlete_id, 1 + i % 40 - CASE WHEN i % 9 = 0 THEN 60 ELSE 0 END AS dt, CASE WHEN i % 5 <> 0 THEN (hr - 40) / 40.0e0 END AS f FROM record WHERE i > 1) SELECT athlete_id, CAST(CASE WHEN f < 0.77e0 THEN 0 WHEN f < 0.87e0 THEN 1 WHEN f < 0.93e0 THEN 2 WHEN f < 1.03e0 THEN 3 ELSE 4 END AS INT) AS zone, CAST(sum(dt) AS BIGINT) AS seconds FROM s WHERE dt > 0 AND dt <= 30 AND f IS NOT NULL GROUP BY 1, 2")
def record_zone_seconds(spark, sf):
    """Seconds by zone of a recording's steps; those of 0, over 30 s or without speed don't count."""
    i = F.col("i")
    s = records(spark, sf).where("i > 1").select("athlete_id", (1 + i % 40 - F.when(i % 9 == 0, 60).otherwise(0)).alias("dt"), F.when(i % 5 != 0, (F.col("hr") - 40) / 40.0).alias("f"))
    f = F.col("f")
    zone = F.when(f < 0.77, 0).when(f < 0.87, 1).when(f < 0.93, 2).when(f < 1.03, 3).otherwise(4)
    return s.where("dt > 0 and dt <= 30 and f is not null").groupBy("athlete_id", zone.alias("zone")).agg(F.sum("dt").cast("long").alias("seconds"))


SPLITS = "WITH s AS (SELECT l_orderkey AS id, CASE WHEN l_quantity > 5 THEN 200 + l_quantity * 4 END AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS km FROM lineitem WHERE l_orderkey % 5 <> 0)"


def _km(spark, sf):
    w = W.partitionBy("id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    s = table(spark, sf, "lineitem").where("l_orderkey % 5 <> 0").withColumn("id", F.col("l_orderkey"))
    return s.select("id", F.when(F.col("l_quantity") > 5, 200 + F.col("l_quantity") * 4).alias("t"), F.row_number().over(w).alias("km"))


@query(f"{SPLITS}, z AS (SELECT id, CASE WHEN f < 0.71e0 THEN 0 WHEN f < 0.82e0 THEN 1 WHEN f < 0.88e0 THEN 2 WHEN f < 1.03e0 THEN 3 ELSE 4 END AS zone, t FROM (SELECT id, t, 1000 / t / 3.5e0 AS f FROM s WHERE t > 0) q), a AS (SELECT id, " + ", ".join(f"coalesce(sum(t) FILTER (zone = {i}), 0) AS z{i + 1}" for i in range(5)) + f"""  FROM z GROUP BY 1), o AS (SELECT o_orderkey AS id, 3000 + o_orderkey % 9000 AS d, 1000 + o_orderkey % 2500 AS m FROM orders),
b AS (SELECT o.id, CASE WHEN f < 0.71e0 THEN 0 WHEN f < 0.82e0 THEN 1 WHEN f < 0.88e0 THEN 2 WHEN f < 1.03e0 THEN 3 ELSE 4 END AS zone, m FROM (SELECT id, m, CAST(d AS DOUBLE) / m / 3.5e0 AS f FROM o) o)
SELECT b.id, CASE WHEN a.id IS NOT NULL THEN 'splits' ELSE 'avg' END AS source, """ + ", ".join(f"{r(f'coalesce(z{i + 1}, CASE WHEN zone = {i} THEN m ELSE 0 END)', 1)} AS z{i + 1}" for i in range(5)) + " FROM b LEFT JOIN a USING (id)")
def zone_seconds_with_fallback(spark, sf):
    """Seconds by zone from the splits; a run without any counts whole for the zone of its average speed."""
    s = _km(spark, sf).where("t > 0").withColumn("zone", sm.zone(1000 / F.col("t") / 3.5))
    a = s.groupBy("id").agg(*(F.sum(F.when(F.col("zone") == i, F.col("t")).otherwise(0.0)).alias(f"z{i + 1}") for i in range(5)))
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(k.alias("id"), (3000 + k % 9000).alias("d"), (1000 + k % 2500).alias("m"))
    o = o.withColumn("zone", sm.zone(F.col("d") / F.col("m") / 3.5)).join(a, "id", "left")
    return rounded(o.select("id", F.when(F.col("z1").isNotNull(), "splits").otherwise("avg").alias("source"), *(F.coalesce(f"z{i + 1}", F.when(F.col("zone") == i, F.col("m")).otherwise(0)).alias(f"z{i + 1}") for i in range(5))), *(f"z{i + 1}" for i in range(5)), digits=1)


@query(f"{SPLITS}, n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM s), h AS (SELECT id, avg(coalesce(t, 0)) FILTER (km <= n // 2) AS a, avg(coalesce(t, 0)) FILTER (km > n // 2) AS b, min_by(km, (t, km)) FILTER (t > 0) AS best FROM n WHERE n >= 2 GROUP BY 1) SELECT id, best AS best_km, CASE WHEN floor(b - a + 0.5e0) < -3 THEN 'negative' WHEN floor(b - a + 0.5e0) > 3 THEN 'positive' ELSE 'even' END AS split FROM h")
def split_type(spark, sf):
    """Whether the second half was faster or slower by more than 3 s a km, and the fastest km (the first of equal ones)."""
    s = _km(spark, sf).withColumn("n", F.count("*").over(W.partitionBy("id"))).where("n >= 2")
    first = F.col("km") <= F.floor(F.col("n") / 2)
    t = F.coalesce("t", F.lit(0.0))
    h = s.groupBy("id").agg(F.avg(F.when(first, t)).alias("a"), F.avg(F.when(~first, t)).alias("b"), F.min_by("km", F.when(F.col("t") > 0, F.struct("t", "km"))).alias("best"))
    d = F.floor(F.col("b") - F.col("a") + 0.5)
    return h.select("id", F.col("best").cast("long").alias("best_km"), F.when(d < -3, "negative").when(d > 3, "positive").otherwise("even").alias("split"))


KMG = f"{REC}, s AS (SELECT athlete_id, i, CAST(d AS DOUBLE) AS d, CASE WHEN i % 3 <> 0 THEN hr END AS alt, CASE WHEN i % 4 <> 0 THEN 150 + hr % 30 END AS cad FROM record), b AS (SELECT *, CAST(floor((d - min(d) OVER w) / 1000) AS BIGINT) AS km, floor((max(d) OVER w - min(d) OVER w) / 1000) AS n FROM s WINDOW w AS (PARTITION BY athlete_id))"


@query(f"{KMG}, g AS (SELECT athlete_id, km, alt - lag(alt) OVER (PARTITION BY athlete_id ORDER BY i) AS x FROM b WHERE alt IS NOT NULL), a AS (SELECT athlete_id, km, sum(greatest(x, 0)) AS gain, sum(greatest(-x, 0)) AS loss FROM g GROUP BY 1, 2), c AS (SELECT athlete_id, km, avg(cad) AS cad, max(n) AS n FROM b GROUP BY 1, 2) SELECT athlete_id, km, CAST(coalesce(gain, 0) AS BIGINT) AS gain_m, CAST(coalesce(loss, 0) AS BIGINT) AS loss_m, {r('cad')} AS cad FROM c LEFT JOIN a USING (athlete_id, km) WHERE km < n")
def km_climb(spark, sf):
    """Climb, descent and mean cadence of each whole km; a change of height counts for the km in which it ends, over samples
    without one."""
    w = W.partitionBy("athlete_id")
    i = F.col("i")
    s = records(spark, sf).select("athlete_id", "i", F.col("d").cast("double").alias("d"), F.when(i % 3 != 0, F.col("hr")).alias("alt"), F.when(i % 4 != 0, 150 + F.col("hr") % 30).alias("cad"))
    s = s.withColumn("km", F.floor((F.col("d") - F.min("d").over(w)) / 1000)).withColumn("n", F.floor((F.max("d").over(w) - F.min("d").over(w)) / 1000))
    before = F.last("alt", ignorenulls=True).over(w.orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("x", F.col("alt") - before).where("km < n")
    up = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0)).cast("long")
    g = s.groupBy("athlete_id", "km").agg(up(F.coalesce("x", F.lit(0))).alias("gain_m"), up(F.coalesce(-F.col("x"), F.lit(0))).alias("loss_m"), F.avg("cad").alias("cad"))
    return rounded(g, "cad")


PAUSED = f"{REC}, s AS (SELECT *, epoch - lag(epoch) OVER (PARTITION BY athlete_id ORDER BY i) AS dt FROM record), t AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY dt) q, count(*) OVER (PARTITION BY athlete_id) n FROM s WHERE dt IS NOT NULL), m AS (SELECT athlete_id, max(CASE WHEN q = floor(n / 2.0e0) + 1 THEN dt END) AS m FROM t GROUP BY 1), f AS (SELECT t.*, i - row_number() OVER (PARTITION BY athlete_id ORDER BY i) AS g FROM t JOIN m USING (athlete_id) WHERE dt >= greatest(20, 5.0e0 * m)), pause AS (SELECT athlete_id, min(i) AS first_i, count(*) AS steps, sum(dt) AS seconds FROM f GROUP BY athlete_id, g)"


@query(f"{PAUSED} SELECT athlete_id, count(*) AS pauses, CAST(sum(seconds) AS BIGINT) AS seconds FROM pause GROUP BY 1")
def pause_summary(spark, sf):
    return ordered.pauses(records(spark, sf), "athlete_id", factor=5.0).groupBy("athlete_id").agg(F.count("*").alias("pauses"), F.sum("seconds").cast("long").alias("seconds"))


@query(f"{PAUSED} SELECT r.athlete_id, r.i, EXISTS (SELECT 1 FROM pause p WHERE p.athlete_id = r.athlete_id AND r.i BETWEEN p.first_i AND p.first_i + p.steps - 1) AS paused FROM record r")
def paused_steps(spark, sf):
    """Which steps lie in a pause; an athlete's pauses are one short array beside its steps."""
    e = records(spark, sf)
    p = ordered.pauses(e, "athlete_id", factor=5.0).groupBy("athlete_id").agg(F.collect_list(F.struct("first_i", "steps")).alias("p"))
    inside = F.exists("p", lambda x: (F.col("i") >= x["first_i"]) & (F.col("i") < x["first_i"] + x["steps"]))
    return e.join(p, "athlete_id", "left").select("athlete_id", F.col("i").cast("long").alias("i"), F.coalesce(inside, F.lit(False)).alias("paused"))
