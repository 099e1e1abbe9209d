"""Run records: an export's typed rows joined with what their recordings gave, heart rate, effort, type and pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Plausible heart rates, exponent of race pace, shares and distances of the classes.
HR_RANGE, RIEGEL_B, LONG_KM, LONG_RATIO = (20, 250), 1.06, 10.0, 1.3
LONG_ABSORBS, LONG_DOUBLES = ("easy", "recovery"), ("tempo", "threshold", "race")


def with_recordings(rows: DataFrame, parsed: DataFrame, sport: str = "run") -> DataFrame:
    """All rows with their recordings' columns, null where there is none, of one sport: a part of the export's type or of the
    recording's sport; "all" keeps every row."""
    joined = rows.join(parsed.withColumnRenamed("fit_file", "activity_id"), "activity_id", "left")
    if sport == "all":
        return joined
    has = lambda c: F.coalesce(F.lower(F.col(c)).contains(sport.lower()), F.lit(False))
    return joined.where(has("sport") | has("fit_sport"))


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose date parses and whose distance is above 0."""
    return rows.where("start is not null and dist_m > 0")


def is_interval(elapsed: Column, moving: Column) -> Column:
    """A fifth of the time or more at rest."""
    return F.coalesce((elapsed > 0) & ((elapsed - moving) / elapsed >= 0.20), F.lit(False))


def heart_rate(device: Column, exported: Column) -> Column:
    """The device's figure, else the export's, each only if plausible; half goes to the even number."""
    ok = lambda c: F.when(c.between(*HR_RANGE), c)
    return F.bround(F.coalesce(ok(device), ok(exported))).cast("int")


def hr_coverage(points: Column, of: Column, average: Column) -> Column:
    return F.when(F.coalesce(points, F.lit(0)) > 0, "full").when(average.isNotNull(), "avg").otherwise("none")


def hr_rank(points: Column, average: Column) -> Column:
    """2: readings in the stream, 1: an average only, 0: none."""
    return F.when(F.coalesce(points, F.lit(0)) > 0, 2).when(average.isNotNull(), 1).otherwise(0)


def effort_ratio(dist_m: Column, moving_s: Column, threshold: Column) -> Column:
    """The run's speed as a part of race speed over its distance, from the speed over 5 km; null without one."""
    speed = threshold * F.pow(dist_m / 5000.0, F.lit(1 - RIEGEL_B))
    return F.when((threshold > 0) & (dist_m > 0) & (moving_s > 0), F.round(dist_m / moving_s / speed, 3))


def long_rules(runs: DataFrame, kind: str = "run_type", km: str = "dist_km", key: str | None = None) -> DataFrame:
    """is_long, and the type beside it: an easy or recovery run that is long is "long" alone, a workout or race keeps its
    type, all others are never long."""
    group = [F.col(key)] if key else []
    q = runs.groupBy(*group).agg(F.percentile(km, 0.75).alias("_p75"), F.percentile(km, 0.5).alias("_p50"))  # percentile counts equal values before the shuffle
    r = runs.join(q, key) if key else runs.crossJoin(F.broadcast(q))  # without a key one row
    far = (F.col("_p50") > 0) & (F.col(km) >= LONG_KM) & (F.col(km) >= F.col("_p75")) & (F.col(km) >= LONG_RATIO * F.col("_p50"))
    absorbed = far & F.col(kind).isin(*LONG_ABSORBS)
    r = r.withColumn("is_long", F.coalesce(absorbed | (far & F.col(kind).isin(*LONG_DOUBLES)), F.lit(False)))
    return r.withColumn(kind, F.when(absorbed, "long").otherwise(F.col(kind))).drop("_p75", "_p50")


def declared_races(runs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """runs (activity_id, dup_of, run_type) with type race where ids (activity_id) names them or the run that they are
    duplicates of; and the ids that match no run."""
    wanted = ids.where("activity_id is not null").select(F.col("activity_id").alias("_id")).distinct()
    either = runs.select("activity_id", F.explode(F.array_compact(F.array("activity_id", "dup_of"))).alias("_id")).join(wanted, "_id")
    pinned = either.select("activity_id").distinct().withColumn("_race", F.lit(True))
    out = runs.join(pinned, "activity_id", "left").withColumn("run_type", F.when(F.col("_race"), "race").otherwise(F.col("run_type"))).drop("_race")
    return out, wanted.join(either, "_id", "left_anti").select(F.col("_id").alias("activity_id"))


def override_pairs(pairs: DataFrame, blocked: DataFrame, forced: DataFrame) -> DataFrame:
    """a, b (a < b): pairs without the blocked ones that aren't forced, and the forced ones."""
    order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    closed = order(blocked).join(order(forced), ["a", "b"], "left_anti")
    return order(pairs).join(closed, ["a", "b"], "left_anti").union(order(forced)).distinct()


def winners(members: DataFrame, pinned: DataFrame, blocked: DataFrame) -> DataFrame:
    """loser, winner: of each group c the pinned member, else the smallest in gps, hr rank, stream and polyline size, records
    and id; a blocked pair is never reported, though it may share a group."""
    rank = F.struct(F.when(F.col("gps"), 0).otherwise(1), -F.col("hr_rank"), -F.col("stream_n"), -F.col("records"), -F.col("poly_n"), F.col("v"))
    best = members.groupBy("c").agg(F.min_by("v", rank).alias("best"))
    pin = members.join(pinned.select(F.col("v")).distinct(), "v").groupBy("c").agg(F.min("v").alias("pin"))
    got = members.join(best, "c").join(pin, "c", "left").select(F.col("v").alias("loser"), F.coalesce("pin", "best").alias("winner")).where("loser <> winner")
    both = blocked.select(F.col("a").alias("loser"), F.col("b").alias("winner")).union(blocked.select("b", "a"))
    return got.join(both, ["loser", "winner"], "left_anti")


def decoupling(segments: DataFrame, key: str, least_s: float = 2400.0, cover: float = 0.8) -> DataFrame:
    """key, decoupling (%): speed per beat of the first half of the valid time against the second. segments: key, i, t0 and
    dt (s), v and ga_v (m/s), hr (may be null). Steps before 300 s, of 0 or over 20 s, or outside 2 to 7 m/s don't count; null
    results (too short, too few readings in a half) are left out."""
    w = W.partitionBy(key)
    s = segments.where("t0 >= 300 and dt > 0 and dt <= 20 and v between 2.0 and 7.0 and ga_v > 0")
    s = s.withColumn("total", F.sum("dt").over(w)).withColumn("half", F.when(F.sum("dt").over(w.orderBy("i").rowsBetween(W.unboundedPreceding, 0)) - F.col("dt") < F.col("total") / 2, 0).otherwise(1))
    with_hr = F.when(F.col("hr").isNotNull(), F.col("dt"))
    h = s.where(F.col("total") >= least_s).groupBy(key, "half").agg(F.sum("dt").alias("t"), F.sum(with_hr).alias("t_hr"), (F.sum(F.col("hr") * F.col("dt")) / F.sum(with_hr)).alias("hr"), (F.sum(F.col("ga_v") * F.col("dt")) / F.sum("dt")).alias("v"))
    ok = h.where((F.col("t_hr") >= cover * F.col("t")) & (F.col("hr") > 0) & (F.col("v") > 0)).withColumn("ef", F.col("v") / F.col("hr"))
    both = ok.groupBy(key).agg(F.max(F.when(F.col("half") == 0, F.col("ef"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("ef"))).alias("b"))
    return both.where("a is not null and b is not null").select(key, ((F.col("a") - F.col("b")) / F.col("a") * 100).alias("decoupling"))


def reps(track: DataFrame, key: str, order: str = "i", t: str = "t", d: str = "d", fast: float = 2.0, rest: int = 5) -> DataFrame:
    """key, start_t, end_t, dist_m, time_s of each repetition: it begins a sample before the first fast step, goes on over
    fewer than `rest` slow steps in a row and ends with the last fast one; one still open at the end runs to the last sample."""
    w = W.partitionBy(key).orderBy(order)
    s = track.select(key, order, F.col(t).alias("t"), F.col(d).cast("double").alias("d")).withColumn("n", F.row_number().over(w)).withColumn("pt", F.lag("t").over(w)).withColumn("pd", F.lag("d").over(w))
    s = s.withColumn("last_n", F.max("n").over(W.partitionBy(key))).withColumn("last_t", F.max_by("t", "n").over(W.partitionBy(key))).withColumn("last_d", F.max_by("d", "n").over(W.partitionBy(key)))
    f = s.where((F.col("t") > F.col("pt")) & ((F.col("d") - F.col("pd")) / (F.col("t") - F.col("pt")) >= fast))
    f = f.withColumn("new", F.coalesce(F.col("n") - F.lag("n").over(W.partitionBy(key).orderBy("n")) > rest, F.lit(True)))
    f = f.withColumn("rep", F.sum(F.col("new").cast("int")).over(W.partitionBy(key).orderBy("n")))
    g = f.groupBy(key, "rep").agg(F.min_by("pt", "n").alias("start_t"), F.min_by("pd", "n").alias("d0"), F.max_by("t", "n").alias("end_t"), F.max_by("d", "n").alias("d1"), F.max("n").alias("hi"), F.first("last_n").alias("ln"), F.first("last_t").alias("lt"), F.first("last_d").alias("ld"))
    is_open = F.col("ln") - F.col("hi") < rest
    g = g.withColumn("end_t", F.when(is_open, F.col("lt")).otherwise(F.col("end_t"))).withColumn("d1", F.when(is_open, F.col("ld")).otherwise(F.col("d1")))
    return g.select(key, "start_t", "end_t", (F.col("d1") - F.col("d0")).alias("dist_m"), (F.col("end_t") - F.col("start_t")).alias("time_s")).where("dist_m > 0 and time_s > 0")
