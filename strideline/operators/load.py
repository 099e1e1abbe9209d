"""Training load: sessions, dense daily series, and what follows from them. Every function works per key."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.functions.physiology import ga_seconds


def index_percentile(df: DataFrame, key: str, value: str, q: float, out: str, width: float = 1.0) -> DataFrame:
    """key and the value at place int(n * q) of the key's sorted values, counted from 0 (no interpolation).

    Values are first counted in steps of `width`, before the shuffle too; the counts tell in which step the place lies, and
    only the rows of that step are put in order. So no task sorts all rows of a key.
    """
    v = df.where(F.col(value).isNotNull()).select(key, value, F.floor(F.col(value) / width).alias("_s"))
    w = W.partitionBy(key)
    steps = v.groupBy(key, "_s").agg(F.count("*").alias("_c")).withColumn("_below", F.sum("_c").over(w.orderBy("_s")) - F.col("_c"))
    steps = steps.withColumn("_at", F.floor(F.sum("_c").over(w) * q) + 1 - F.col("_below")).where((F.col("_at") >= 1) & (F.col("_at") <= F.col("_c")))
    ranked = v.join(steps.select(key, "_s", "_at"), [key, "_s"]).withColumn("_r", F.row_number().over(w.orderBy(value)))
    return ranked.where("_r = _at").select(key, F.col(value).alias(out))


def session_loads(acts: DataFrame, key: str) -> DataFrame:
    """activity_id, key, day, ga_pace, load: 10 a kilometre, times the squared intensity against the key's threshold pace."""
    km = F.col("dist_m") / 1000
    paced = acts.where((F.col("dist_m") > 0) & (F.col("moving_s") > 0)).withColumn("ga_pace", ga_seconds(F.col("moving_s"), F.col("gain_m"), km) / km)
    threshold = index_percentile(paced, key, "ga_pace", 0.15, "threshold_pace")
    effort = F.greatest(F.lit(0.5), F.least(F.lit(1.5), F.col("threshold_pace") / F.col("ga_pace")))
    return paced.join(threshold, key).select("activity_id", key, "day", "ga_pace", (km * 10 * effort * effort).alias("load"))


def daily_series(loads: DataFrame, key: str, rest_days: int = 0) -> DataFrame:
    """key, day, i, load for every day from the key's first to its last, and rest_days more; days without a session have 0."""
    by_day = loads.groupBy(key, "day").agg(F.sum("load").alias("load"))
    spine = by_day.groupBy(key).agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(key, F.posexplode(F.expr(f"sequence(lo, date_add(hi, {rest_days}), interval 1 day)")).alias("i", "day"))
    return spine.join(by_day, [key, "day"], "left").select(key, "day", "i", F.coalesce("load", F.lit(0.0)).alias("load"))


def ewma(daily: DataFrame, key: str, tau: float, out: str, value: str = "load", span: int = 1000) -> DataFrame:
    """The recurrence x += (1 - e^(-1/tau)) * (value - x) from 0, in closed form.

    Weights grow as e^(i/tau), so days are taken in spans that can't overflow; what a span inherits is the value at the
    end of the one before (older ones have decayed below double precision).
    """
    base = daily.withColumn("_b", F.floor(F.col("i") / span)).withColumn("_o", F.col("i") % span)
    within = F.sum(F.col(value) * F.exp(F.col("_o") / tau)).over(W.partitionBy(key, "_b").orderBy("_o")) * F.exp(-F.col("_o") / tau) * (1 - exp(-1 / tau))
    base = base.withColumn("_w", within)
    before = F.max_by("_w", "_o").over(W.partitionBy(key).orderBy("_b").rangeBetween(-1, -1))
    return base.withColumn(out, F.col("_w") + F.coalesce(before, F.lit(0.0)) * F.exp(-(F.col("_o") + 1) / tau)).drop("_b", "_o", "_w")


def fitness_form(daily: DataFrame, key: str) -> DataFrame:
    """key, day, i, load, ctl (42 days), atl (7 days), tsb (the day before's ctl less its atl)."""
    both = ewma(ewma(daily, key, 42, "ctl"), key, 7, "atl")
    return both.withColumn("tsb", F.lag(F.col("ctl") - F.col("atl"), 1, 0.0).over(W.partitionBy(key).orderBy("i")))


def _last(key: str, n: int):
    return W.partitionBy(key).orderBy("i").rowsBetween(1 - n, 0)


def workload_ratio(daily: DataFrame, key: str) -> DataFrame:
    """acute (7 days), chronic (a week's mean of up to 28 days) and their ratio, 0 without chronic load."""
    d = daily.withColumn("acute", F.sum("load").over(_last(key, 7))).withColumn("chronic", F.avg("load").over(_last(key, 28)) * 7)
    return d.withColumn("acwr", F.when(F.col("chronic") > 0, F.col("acute") / F.col("chronic")).otherwise(0.0))


def monotony_strain(daily: DataFrame, key: str) -> DataFrame:
    w = _last(key, 7)
    sd, n = F.stddev_pop("load").over(w), F.count("load").over(w)
    d = daily.withColumn("monotony", F.when((n >= 2) & (sd > 1e-9), F.avg("load").over(w) / sd).otherwise(0.0))
    return d.withColumn("strain", F.col("monotony") * F.sum("load").over(w))


def strain_baseline(strain: DataFrame, key: str) -> DataFrame:
    """key, safe, high: mean plus one and two deviations of the last 90 positive strains before the last 7 days; 0 under 8 of them."""
    w = W.partitionBy(key).orderBy(F.desc("i"))
    old = strain.withColumn("_r", F.row_number().over(w)).where("_r > 7 and strain > 0").withColumn("_k", F.row_number().over(w)).where("_k <= 90")
    m, s, n = F.avg("strain"), F.stddev_pop("strain"), F.count("*")
    return old.groupBy(key).agg(F.when(n >= 8, m + s).otherwise(0.0).alias("safe"), F.when(n >= 8, m + 2 * s).otherwise(0.0).alias("high"))


def plan_targets(daily: DataFrame, key: str) -> DataFrame:
    """Next week's load from the last day's ratio and form; keys under 14 days or without chronic load have none."""
    d = fitness_form(workload_ratio(daily, key), key).withColumn("_l", F.max("i").over(W.partitionBy(key))).where("i = _l and i >= 13 and chronic > 0")
    base = F.greatest("acute", "chronic")
    tired, loaded = (F.col("tsb") < -25) | (F.col("acwr") > 1.5), (F.col("tsb") < -10) | (F.col("acwr") > 1.3)
    fresh = (F.col("tsb") > 12) & (F.col("acwr") < 1.1)
    pick = lambda a, b, c, e: F.when(tired, a).when(loaded, b).when(fresh, c).otherwise(e)
    target = pick(0.8 * F.col("chronic"), F.col("chronic"), base * 1.10, base * 1.05)
    return d.select(key, "acute", "chronic", "acwr", "tsb", pick(F.lit("recover"), F.lit("hold"), F.lit("build"), F.lit("build gradually")).alias("advice"), F.greatest(F.lit(0.0), F.least(target, 1.3 * F.col("chronic"))).alias("target"))


def rest_day_preview(daily: DataFrame, key: str, most: int = 7) -> DataFrame:
    """key, k, ctl, atl, tsb after k more days of rest, k from 0 to most: both averages only decay."""
    now = fitness_form(daily, key).withColumn("_l", F.max("i").over(W.partitionBy(key))).where("i = _l")
    k = F.col("k")
    now = now.select(key, "ctl", "atl", F.col("tsb").alias("t0"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("k"))
    return now.select(key, "k", (F.col("ctl") * F.exp(-k / 42)).alias("ctl"), (F.col("atl") * F.exp(-k / 7)).alias("atl"), F.when(k == 0, F.col("t0")).otherwise(F.col("ctl") * F.exp(-(k - 1) / 42) - F.col("atl") * F.exp(-(k - 1) / 7)).alias("tsb"))


def taper_projection(daily: DataFrame, key: str, days: int, taper_days: int, cut: float = 0.5) -> DataFrame:
    """key, load, ctl_race, tsb_hold, tsb_taper on the morning after days - 1 more days at the mean of the last 28, the last taper_days of them cut."""
    d = fitness_form(daily, key).withColumn("_m", F.avg("load").over(_last(key, 28))).withColumn("_l", F.max("i").over(W.partitionBy(key))).where("i = _l")
    n, easy = days - 1, min(taper_days, days - 1)

    def after(x: Column, tau: float, cut_days: int) -> Column:
        full = F.col("_m") + (x - F.col("_m")) * exp(-(n - cut_days) / tau)
        low = F.col("_m") * (1 - cut)
        return low + (full - low) * exp(-cut_days / tau)

    ctl, atl = F.col("ctl"), F.col("atl")
    return d.select(key, F.col("_m").alias("load"), after(ctl, 42, easy).alias("ctl_race"), (after(ctl, 42, 0) - after(atl, 7, 0)).alias("tsb_hold"), (after(ctl, 42, easy) - after(atl, 7, easy)).alias("tsb_taper"))
