"""Fits, totals, rankings, zones and classes over activities, per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.functions.physiology import vdot

#: The distances of best efforts, in metres.
DISTANCES = (("400m", 400.0), ("1/2mi", 804.672), ("1km", 1000.0), ("1mi", 1609.344), ("2mi", 3218.69), ("5k", 5000.0), ("10k", 10000.0), ("15k", 15000.0), ("10mi", 16093.4), ("20k", 20000.0), ("half", 21097.5))


def interval_session(a: DataFrame) -> Column:
    """Rest of at least a fifth of the elapsed time."""
    return F.when(F.col("elapsed_s") > 0, (F.col("elapsed_s") - F.col("moving_s")) / F.col("elapsed_s") >= 0.2).otherwise(False)


def best_points(acts: DataFrame, key: str) -> DataFrame:
    """key, label, dist_m, best_s: the least even-pace time over each distance that an activity covers."""
    bands = F.array(*(F.struct(F.lit(n).alias("label"), F.lit(m).alias("band_m")) for n, m in DISTANCES))
    e = acts.select(key, "dist_m", "moving_s", F.explode(bands).alias("b")).where("dist_m >= b.band_m")
    return e.groupBy(key, F.col("b.label").alias("label"), F.col("b.band_m").alias("band_m")).agg(F.min(F.col("moving_s") * F.col("b.band_m") / F.col("dist_m")).alias("best_s"))


def critical_speed(points: DataFrame, key: str, least_m: float = 1200) -> DataFrame:
    """key, cs, dprime, r2 of the line distance = cs * time + dprime, from two points of at least least_m."""
    p = points.where(F.col("band_m") >= least_m)
    got = p.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope("band_m", "best_s").alias("cs"), F.regr_intercept("band_m", "best_s").alias("dprime"), F.regr_r2("band_m", "best_s").alias("r2"))
    return got.where("n >= 2").drop("n")


def power_curve(points: DataFrame, key: str, lo: float = 1.0, hi: float = 1.15) -> DataFrame:
    """key, a, b of time = a * distance^b on logarithms; b is held in [lo, hi] and a follows from it; one point alone has b 1.06."""
    t, d = F.ln("best_s"), F.ln("band_m")
    g = points.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope(t, d).alias("s"), F.avg(t).alias("t"), F.avg(d).alias("d"))
    g = g.withColumn("b", F.when(F.col("n") < 2, 1.06).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("s")))))
    return g.select(key, F.exp(F.col("t") - F.col("b") * F.col("d")).alias("a"), "b")


def monthly_best(acts: DataFrame, key: str, score: Column, out: str) -> DataFrame:
    return acts.groupBy(key, F.trunc("day", "month").alias("month")).agg(F.max(score).alias(out))


def activity_vdot() -> Column:
    return vdot(F.col("dist_m"), F.col("moving_s"))


def period_totals(acts: DataFrame, key: str, unit: str) -> DataFrame:
    """key, period, km, gain_m, seconds, runs for every week (from Monday) or month from the key's first to its last."""
    t = acts.groupBy(key, F.trunc("day", unit).alias("period")).agg(F.sum("dist_m").alias("m"), F.sum("gain_m").alias("gain_m"), F.sum("moving_s").alias("seconds"), F.count("*").alias("runs"))
    step = {"week": "interval 7 day", "month": "interval 1 month"}[unit]
    spine = t.groupBy(key).agg(F.min("period").alias("lo"), F.max("period").alias("hi")).select(key, F.explode(F.expr(f"sequence(lo, hi, {step})")).alias("period"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(t, [key, "period"], "left").select(key, "period", (F.coalesce("m", F.lit(0)) / 1000).alias("km"), zero("gain_m"), zero("seconds"), zero("runs"))


def daily_km(acts: DataFrame, key: str) -> DataFrame:
    return acts.groupBy(key, "day").agg((F.sum("dist_m") / 1000).alias("km"))


def eddington_reached(days: DataFrame, key: str) -> DataFrame:
    """key, n, day: when the Eddington number became n, which is the n-th day of at least n km.

    Each day counts once for every whole km up to its length, and a window holds the days of one key and one n, so nothing
    gathers all of a key's days in one place.
    """
    n = days.select(key, "day", "km", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor("km").cast("int")))).alias("n")).where("km >= n")
    return n.withColumn("_q", F.row_number().over(W.partitionBy(key, "n").orderBy("day"))).where("_q = n").select(key, "n", "day")


def eddington(days: DataFrame, key: str) -> DataFrame:
    """key, e: the most days e of at least e kilometres each; and need, how many more such days e + 1 takes."""
    e = eddington_reached(days, key).groupBy(key).agg(F.max("n").alias("_e"))
    both = days.join(e, key, "left").withColumn("e", F.coalesce("_e", F.lit(0)))
    return both.groupBy(key, "e").agg((F.col("e") + 1 - F.count_if(F.col("km") >= F.col("e") + 1)).alias("need"))


def eddington_distribution(days: DataFrame, key: str) -> DataFrame:
    """key, n, days of at least n km, for n from 1 to the longest day; counts are summed from the top, so no row is compared with all others."""
    per = days.where("km >= 1").groupBy(key, F.floor("km").alias("n")).agg(F.count("*").alias("c"))
    spine = per.groupBy(key).agg(F.max("n").alias("hi")).select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("hi"))).alias("n"))
    return spine.join(per, [key, "n"], "left").select(key, "n", F.sum(F.coalesce("c", F.lit(0))).over(W.partitionBy(key).orderBy(F.desc("n"))).alias("days"))


def eddington_progression(days: DataFrame, key: str, every_month: bool = False) -> DataFrame:
    """key, month, e at the end of each month with activity, or of every month from the first to the last."""
    month = F.trunc("day", "month").alias("month")
    reached = eddington_reached(days, key).groupBy(key, month).agg(F.count("*").alias("new"))
    spine = days.select(key, month).distinct()
    if every_month:
        spine = days.groupBy(key).agg(F.expr("sequence(trunc(min(day), 'month'), trunc(max(day), 'month'), interval 1 month)").alias("m")).select(key, F.explode("m").alias("month"))
    e = F.coalesce(F.sum("new").over(W.partitionBy(key).orderBy("month")), F.lit(0)).cast("int")
    return spine.join(reached, [key, "month"], "left").select(key, "month", e.alias("e"))


def top_by_band(acts: DataFrame, key: str, k: int = 3) -> DataFrame:
    """key, label, rank, activity_id, seconds of the k fastest over each distance; interval sessions count only under 1 km."""
    bands = F.array(*(F.struct(F.lit(n).alias("label"), F.lit(m).alias("band_m")) for n, m in DISTANCES))
    e = acts.withColumn("b", F.explode(bands)).where((F.col("dist_m") >= F.col("b.band_m")) & (~interval_session(acts) | (F.col("b.band_m") < 1000)))
    e = e.select(key, F.col("b.label").alias("label"), "activity_id", (F.col("moving_s") * F.col("b.band_m") / F.col("dist_m")).alias("seconds"))
    r = F.row_number().over(W.partitionBy(key, "label").orderBy("seconds", "activity_id"))
    return e.withColumn("rank", r).where(F.col("rank") <= k)


def zone(fraction: Column, bounds=(0.71, 0.82, 0.88, 1.03)) -> Column:
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(fraction < bounds[i], i).otherwise(out)
    return out


def classify(km: Column, is_interval: Column, ratio: Column, z: list[Column]) -> Column:
    """The class of a run from its length, rest, all-out ratio and zone shares; the first rule that holds counts."""
    return (
        F.when(km < 1.0, "misc").when(is_interval, "intervals").when((ratio >= 0.98) & (km >= 3.0), "race").when(z[4] >= 0.40, "race")
        .when((z[3] >= 0.50) | (z[3] + z[4] >= 0.60), "threshold").when(z[2] + z[3] >= 0.35, "tempo").when(z[0] >= 0.70, "recovery").otherwise("easy")
    )


def long_tag(acts: DataFrame, key: str) -> DataFrame:
    """acts with is_long: at least 10 km, the key's upper quartile and 1.3 times its median, both interpolated."""
    d = acts.groupBy(key).agg(F.percentile("dist_m", 0.75).alias("p75"), F.percentile("dist_m", 0.5).alias("p50"))
    return acts.join(d, key).withColumn("is_long", (F.col("dist_m") >= 10000) & (F.col("dist_m") >= F.col("p75")) & (F.col("dist_m") >= 1.3 * F.col("p50"))).drop("p75", "p50")


def histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, bin, lo, n with round(sqrt(count)) bins, from 5 to 12; the largest value is in the last."""
    w = df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.greatest(F.lit(5), F.least(F.lit(12), F.round(F.sqrt(F.count("*"))).cast("int"))).alias("bins"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))), F.col("bins") - 1)).otherwise(0)
    return df.join(w, key).groupBy(key, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def recency_mean(df: DataFrame, key: str, value: str, half_life: float = 30.0) -> DataFrame:
    """df with trend: the mean of all values up to the day, each weighted by 1/2 per half_life days of age."""
    age = F.datediff("day", F.min("day").over(W.partitionBy(key)))
    weight = F.pow(F.lit(2.0), age / half_life)
    w = W.partitionBy(key).orderBy("day").rangeBetween(W.unboundedPreceding, 0)
    return df.withColumn("_w", weight).withColumn("trend", F.sum(F.col(value) * F.col("_w")).over(w) / F.sum("_w").over(w)).drop("_w")


def search(acts: DataFrame, text: str = "", column: str = "name", ranges: dict[str, tuple] | None = None, order: str = "day", desc: bool = True) -> DataFrame:
    """Rows whose column holds the text in any case and whose values lie in all ranges (None: open), sorted."""
    keep = F.lower(F.col(column)).contains(text.lower()) if text else F.lit(True)
    for c, (lo, hi) in (ranges or {}).items():
        keep = keep & (F.col(c) >= lo if lo is not None else F.lit(True)) & (F.col(c) <= hi if hi is not None else F.lit(True))
    return acts.where(keep).orderBy(F.desc(order) if desc else F.asc(order), "activity_id")
