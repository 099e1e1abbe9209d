"""Fitness from heart rate: steady windows of a recording, their oxygen uptake, and a run's estimate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.functions.physiology import oxygen_cost, slope_cost

#: Seconds of a window, warm-up, lag of the heart and longest gap; speeds; grades; steadiness; reserve; uptake.
WINDOW_S, WARMUP_S, LAG_S, GAP_S = 150.0, 300.0, 20.0, 20.0
SPEEDS, MOST_GRADE, GRADE_LIMIT, STEADY, RESERVE, UPTAKE, REST_UPTAKE = (2.0, 7.0), 0.15, 0.45, 1.35, (0.50, 0.95), (25.0, 90.0), 3.5
LEAST_READINGS, LEAST_WINDOWS = 3, 4


def graded_speed(a: Column, b: Column, fallback: Column) -> tuple[Column, Column]:
    """Grade-adjusted speed between two samples (structs of t, d in metres, elev), and the grade; null if nothing passes."""
    dt, dd = b["t"] - a["t"], b["d"] - a["d"]
    grade = F.coalesce((b["elev"] - a["elev"]) / dd, fallback)
    grade = F.greatest(F.lit(-GRADE_LIMIT), F.least(F.lit(GRADE_LIMIT), grade))
    ok = (dt > 0) & (dd > 0)
    return F.when(ok, dd / dt * slope_cost(grade) / slope_cost(F.lit(0.0))), F.when(ok, grade)


def windows(track: DataFrame, key: str) -> DataFrame:
    """key, w, i0, i1, t0, t1: windows of WINDOW_S or more, one after the other, after the warm-up; none goes over a gap.

    Where a window begins depends on where the one before ended, so this is a fold over the times of one recording, which
    is bounded; all else is done on the windows by Spark. i counts the samples of a recording from 0.
    """
    kind = track.schema[key].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        t, rows, at = pdf["t"].tolist(), [], 0
        while at < len(t) and t[at] < WARMUP_S:
            at += 1
        end = at
        while end + 1 < len(t):
            if t[end + 1] - t[end] > GAP_S:
                at = end = end + 1
                continue
            end += 1
            if t[end] - t[at] >= WINDOW_S:
                rows.append((pdf[key].iloc[0], len(rows), at, end, float(t[at]), float(t[end])))
                at = end
        return pd.DataFrame(rows, columns=[key, "w", "i0", "i1", "t0", "t1"])

    return track.select(key, "i", "t").groupBy(key).applyInPandas(fold, f"{key} {kind}, w long, i0 long, i1 long, t0 double, t1 double")


def window_uptake(track: DataFrame, key: str, hr_max: float, hr_rest: float, fallback: Column | None = None) -> DataFrame:
    """key, w, vo2max of the windows that are steady aerobic running. track: key, i (from 0), t (s), d (m), elev, hr."""
    w = windows(track, key)
    part = F.explode(F.sequence(F.lit(0), F.lit(4)))
    ends = w.withColumn("q", part).withColumn("i", (F.col("i0") + F.floor((F.col("i1") - F.col("i0")) * F.col("q") / 4)).cast("long"))
    five = ends.join(track.select(key, F.col("i").cast("long").alias("i"), F.struct(F.col("i").cast("long").alias("i"), F.col("t").cast("double").alias("t"), F.col("d").cast("double").alias("d"), F.col("elev").cast("double").alias("elev")).alias("p")), [key, "i"])
    five = five.groupBy(key, "w").agg(F.transform(F.sort_array(F.collect_list(F.struct("q", "p"))), lambda x: x["p"]).alias("p"))
    bucket = lambda t: F.floor(t / WINDOW_S)
    late = w.select(key, "w", (F.col("t0") + LAG_S).alias("a"), (F.col("t1") + LAG_S).alias("b")).withColumn("_b", F.explode(F.sequence(bucket(F.col("a")), bucket(F.col("b")))))
    beats = track.where("hr is not null").select(key, F.col("t").alias("bt"), "hr", bucket(F.col("t")).alias("_b"))
    hr = late.join(beats, [key, "_b"]).where("bt between a and b").groupBy(key, "w").agg(F.avg("hr").alias("hr"), F.count("*").alias("n")).where(F.col("n") >= LEAST_READINGS)
    none = fallback if fallback is not None else F.lit(0.0)
    p = F.col("p")
    speed, grade = graded_speed(p[0], p[4], none)
    raw = (p[4]["d"] - p[0]["d"]) / (p[4]["t"] - p[0]["t"])
    quarters = F.array(*(F.when(p[k + 1]["i"] > p[k]["i"], graded_speed(p[k], p[k + 1], none)[0]) for k in range(4)))
    s = five.join(hr, [key, "w"]).withColumn("v", speed).withColumn("grade", grade).withColumn("raw", raw).withColumn("quarters", quarters)
    s = s.where(F.col("raw").between(*SPEEDS) & (F.abs("grade") <= MOST_GRADE) & F.forall("quarters", lambda x: F.coalesce(x > 0, F.lit(False))))
    s = s.where(F.array_max("quarters") / F.array_min("quarters") <= STEADY).withColumn("hrr", (F.col("hr") - hr_rest) / (hr_max - hr_rest)).where(F.col("hrr").between(*RESERVE))
    vo2 = oxygen_cost(F.col("v") * 60)
    best = REST_UPTAKE + (vo2 - REST_UPTAKE) / F.col("hrr")
    return s.where(vo2 > REST_UPTAKE).select(key, "w", best.alias("vo2max")).where(F.col("vo2max").between(*UPTAKE))


def run_uptake(track: DataFrame, key: str, hr_max: float, hr_rest: float) -> DataFrame:
    """key, vo2max (the upper quartile of its windows), windows: runs with LEAST_WINDOWS or more."""
    g = window_uptake(track, key, hr_max, hr_rest).groupBy(key).agg(F.percentile("vo2max", 0.75).alias("vo2max"), F.count("*").alias("windows"))
    return g.where(F.col("windows") >= LEAST_WINDOWS)


def monthly_uptake(estimates: DataFrame, runs: DataFrame, key: str, owner: str | None = None) -> DataFrame:
    """(owner,) month, vo2max, runs, windows, hr_runs: the best estimate of each month, of how many runs and windows, and how
    many of all the months' runs have heart rates at all. Months without an estimate have no row.

    estimates: key, vo2max, windows (run_uptake); runs: key, day, hr_pts (samples with a heart rate) and the owner.
    """
    by = [owner] if owner else []
    r = runs.where("day is not null")
    got = r.join(estimates, key).groupBy(*by, F.trunc("day", "month").alias("month")).agg(F.round(F.max("vo2max"), 1).alias("vo2max"), F.count("*").alias("runs"), F.sum("windows").alias("windows"))
    beating = r.where("hr_pts > 0").groupBy(*by, F.trunc("day", "month").alias("month")).agg(F.count("*").alias("hr_runs"))
    return got.join(beating, [*by, "month"], "left").select(*by, "month", "vo2max", "runs", "windows", F.coalesce("hr_runs", F.lit(0)).alias("hr_runs"))
