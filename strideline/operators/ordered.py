"""Operators over ordered samples: as-of joins, islands, range-frame best efforts, crossings and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def around(key: str, *order: str) -> list[tuple[str, W]]:
    """("lo", "hi") with the rows of a key up to each one, and from it on: both begin at an end, as a frame that reaches to the
    last row is gone through again for each row."""
    return [(name, W.partitionBy(key).orderBy(*map(way, order)).rowsBetween(W.unboundedPreceding, 0)) for name, way in (("lo", F.asc), ("hi", F.desc))]


def asof_nearest(probes: DataFrame, readings: DataFrame, key: str, at: str, value: str, tolerance: float) -> DataFrame:
    """probes with the nearest reading's value, the earlier one on ties, null beyond the tolerance.

    Both sides go through one shuffle by key and a sort by time each way; the last reading before each probe is taken from
    one, the first after it from the other, in one pass each and without a range join. Of readings at one time the largest
    value counts.
    """
    r = readings.groupBy(key, at).agg(F.max(value).alias(value))
    cols = [c for c in probes.columns if c not in (key, at)]
    both = probes.withColumn("_side", F.lit(0)).withColumn("_v", F.lit(None).cast(r.schema[value].dataType)).withColumn("_t", F.lit(None).cast(r.schema[at].dataType))
    both = both.unionByName(r.select(key, at, F.lit(1).alias("_side"), F.col(value).alias("_v"), F.col(at).alias("_t")), allowMissingColumns=True)
    for name, over in around(key, at, "_side"):
        both = both.withColumn(f"_{name}", F.last(F.when(F.col("_side") == 1, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v"))), ignorenulls=True).over(over))
    gap_lo, gap_hi = F.col(at) - F.col("_lo.t"), F.col("_hi.t") - F.col(at)
    near = F.when(gap_hi.isNull() | (gap_lo <= gap_hi), F.when(gap_lo <= tolerance, F.col("_lo.v"))).when(gap_hi <= tolerance, F.col("_hi.v"))
    return both.where("_side = 0").select(key, at, *cols, near.alias(value))


def asof_linear(probes: DataFrame, readings: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """probes with the value interpolated between the readings around them, held at the ends."""
    r = readings.groupBy(key, at).agg(F.max(value).alias(value))
    cols = [c for c in probes.columns if c not in (key, at)]
    both = probes.withColumn("_side", F.lit(0)).unionByName(r.select(key, at, F.lit(1).alias("_side"), F.col(value).cast("double").alias("_v")), allowMissingColumns=True)
    for name, over in around(key, at, "_side"):
        both = both.withColumn(f"_{name}", F.last(F.when(F.col("_side") == 1, F.struct(F.col(at).alias("t"), F.col("_v").alias("v"))), ignorenulls=True).over(over))
    share = (F.col(at) - F.col("_lo.t")) / (F.col("_hi.t") - F.col("_lo.t"))
    between = F.col("_lo.v") + share * (F.col("_hi.v") - F.col("_lo.v"))
    return both.where("_side = 0").select(key, at, *cols, F.when(F.col("_hi.t") == F.col(at), F.col("_hi.v")).when(F.col("_lo").isNull(), F.col("_hi.v")).when(F.col("_hi").isNull(), F.col("_lo.v")).otherwise(between).alias(value))


def best_effort(samples: DataFrame, key: str, target: float, d: str = "d", t: str = "epoch") -> DataFrame:
    """key, best_s: the least time over any stretch of at least target; keys that never get so far are left out."""
    ahead = F.expr(f"min(`{t}`) over (partition by `{key}` order by cast(`{d}` as double) range between cast({target} as double) following and unbounded following)")
    return samples.withColumn("_e", ahead - F.col(t)).groupBy(key).agg(F.min("_e").alias("best_s")).where("best_s is not null")


def best_around(times: DataFrame, key: str, at: str, value: str, reaches: tuple[int, ...]) -> DataFrame:
    """key, at, best: for each row (one for a key and time, in seconds; value may be null) the largest value from so many days
    before it to just under one day more after it, by the first of the reaches (ascending) that has any.

    Such a span holds whole days but for the rest of its first and the beginning of its last one. Largest values of whole
    days come from a table of days, in which a frame is never longer than a span has days. A first or last day is only
    asked where its own largest value would change the result; the day's rows and those who ask go through one sort each
    way.
    """
    day, second = F.floor(F.col(at) / 86400).cast("long"), F.pmod(F.col(at), F.lit(86400)).cast("long")
    t = times.select(key, at, value, day.alias("_d"), second.alias("_s"))
    w = W.partitionBy(key).orderBy("_d")
    span = lambda lo, hi: F.max("_m").over(w.rangeBetween(lo, hi))
    reach = lambda n: F.struct(F.lit(n).cast("long").alias("n"), span(1 - n, n).alias("whole"), span(-n, -n).alias("first"), span(n + 1, n + 1).alias("last"))
    days = t.groupBy(key, "_d").agg(F.max(value).alias("_m")).select(key, "_d", F.array(*map(reach, reaches)).alias("_r"))
    # where whole days have a value, no wider reach is asked
    some = F.transform("_r", lambda x: x["whole"].isNotNull())
    until = F.when(F.array_contains(some, True), F.array_position(some, True)).otherwise(len(reaches)).cast("int")
    days = days.select(key, "_d", F.slice("_r", F.lit(1), until).alias("_r"))
    r = t.select(key, at, "_d", "_s").join(days, [key, "_d"])
    better = lambda x, side: x[side] > F.coalesce(x["whole"], F.lit(float("-inf")))
    ask = lambda side, on: F.transform(F.filter("_r", lambda x: better(x, side)), lambda x: F.struct(x["n"].alias("n"), F.lit(side).alias("side"), on(x["n"]).alias("on")))
    asked = r.select(key, at, "_s", F.explode(F.concat(ask("first", lambda n: F.col("_d") - n), ask("last", lambda n: F.col("_d") + n + 1))).alias("q")).select(key, F.col("q.on").alias("_d"), "_s", F.col(at).alias("_at"), "q.n", "q.side", F.lit(None).cast("double").alias("_v"))
    rows = t.where(F.col(value).isNotNull()).select(key, "_d", "_s", F.lit(None).cast(t.schema[at].dataType).alias("_at"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("side"), F.col(value).cast("double").alias("_v"))
    both = asked.unionByName(rows)
    before = F.max("_v").over(W.partitionBy(key, "_d").orderBy("_s").rangeBetween(W.unboundedPreceding, -1))
    since = F.max("_v").over(W.partitionBy(key, "_d").orderBy(F.desc("_s")).rangeBetween(W.unboundedPreceding, 0))
    edge = both.withColumn("_b", F.when(F.col("side") == "last", before)).withColumn("_f", F.when(F.col("side") == "first", since)).where("side is not null")
    edge = edge.groupBy(key, F.col("_at").alias(at), "n").agg(F.max(F.coalesce("_b", "_f")).alias("_e")).where("_e is not null").groupBy(key, at).agg(F.collect_list(F.struct("n", "_e")).alias("_edges"))
    r = r.join(edge, [key, at], "left").withColumn("_edges", F.coalesce("_edges", F.array().cast("array<struct<n:bigint,_e:double>>")))
    of = F.transform("_r", lambda x: F.array_max(F.array_append(F.transform(F.filter("_edges", lambda e: e["n"] == x["n"]), lambda e: e["_e"]), x["whole"])))
    return r.select(key, at, F.try_element_at(F.filter(of, lambda v: v.isNotNull()), F.lit(1)).alias("best"))


def crossings(samples: DataFrame, key: str, step: float, d: str = "d", t: str = "epoch") -> DataFrame:
    """key, n, at_s: when each multiple of step is passed, by linear interpolation; the first sample starts at 0."""
    w = W.partitionBy(key).orderBy("i")
    s = samples.withColumn("_d", F.col(d).cast("double"))
    s = s.withColumn("_p", F.lag("_d").over(w)).withColumn("_q", F.lag(t).over(w)).where("_d > _p")
    s = s.withColumn("n", F.explode(F.sequence(F.floor(F.col("_p") / step) + 1, F.greatest(F.floor(F.col("_d") / step), F.floor(F.col("_p") / step) + 1)))).where(F.col("n") * step <= F.col("_d"))
    return s.select(key, "n", (F.col("_q") + (F.col("n") * step - F.col("_p")) / (F.col("_d") - F.col("_p")) * (F.col(t) - F.col("_q"))).alias("at_s"))


def islands(samples: DataFrame, key: str, flag) -> DataFrame:
    """samples whose flag holds, with `island` equal for neighbours in order of i."""
    f = samples.where(flag)
    return f.withColumn("island", F.col("i") - F.row_number().over(W.partitionBy(key).orderBy("i")))


def pauses(samples: DataFrame, key: str, floor_s: float = 20.0, factor: float = 5.0) -> DataFrame:
    """key, first_i, seconds, steps of each pause: neighbouring steps of at least floor_s and factor times the key's upper median step."""
    w = W.partitionBy(key)
    s = samples.withColumn("dt", F.col("epoch") - F.lag("epoch").over(w.orderBy("i"))).where("dt is not null")
    s = s.withColumn("_r", F.row_number().over(w.orderBy("dt"))).withColumn("_n", F.count("*").over(w))
    s = s.withColumn("_m", F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("dt"))).over(w))
    return islands(s, key, F.col("dt") >= F.greatest(F.lit(floor_s), F.col("_m") * factor)).groupBy(key, "island").agg(F.min("i").alias("first_i"), F.sum("dt").alias("seconds"), F.count("*").alias("steps")).drop("island")


def merge_intervals(spans: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """key and the union of its closed intervals, as disjoint ones, nulls last. Both windows go through one sort, so that equal
    intervals keep their places and each is numbered by what came before it."""
    w = W.partitionBy(key).orderBy(F.asc_nulls_last(lo), F.asc_nulls_last(hi))
    s = spans.withColumn("_e", F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("_g", F.sum(F.when(F.col("_e").isNull() | (F.col(lo) > F.col("_e")), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(key, "_g").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_g")


def moving_mean(samples: DataFrame, key: str, value: str, half: int, out: str) -> DataFrame:
    """The centred mean over 2 * half + 1 samples, fewer at the ends."""
    return samples.withColumn(out, F.avg(value).over(W.partitionBy(key).orderBy("i").rowsBetween(-half, half)))


def downsample(samples: DataFrame, key: str, spacing: float, d: str = "d") -> DataFrame:
    """The first sample in each bin of spacing, counted from the key's first, and the last sample."""
    w = W.partitionBy(key)
    s = samples.withColumn("_b", F.floor((F.col(d).cast("double") - F.min(F.col(d).cast("double")).over(w)) / spacing))
    s = s.withColumn("_p", F.lag("_b").over(w.orderBy("i"))).withColumn("_l", F.max("i").over(w))
    return s.where((F.col("_p").isNull()) | (F.col("_b") > F.col("_p")) | (F.col("i") == F.col("_l"))).drop("_b", "_p", "_l")


def band_join(a: DataFrame, at: str, width: int, residual, left: str = "l", right: str = "r", row: tuple[str, ...] = ("id",), equal: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of a whose `at` differ by at most width and for which residual(l, r) holds, l before r by at and row.

    The columns in row must tell all rows apart that have one `at`: rows that are equal in them don't pair.

    Rows meet in buckets of the band's width; the right side is copied into its own bucket and the one before, so the
    join is an equi-join and each pair is made once. Columns in `equal` must agree too and are part of its key.
    """
    b = a.withColumn("_bucket", F.floor(F.col(at) / width))
    same = [F.col(c).alias(f"_e{i}") for i, c in enumerate(equal)]
    x = b.select("_bucket", *same, F.struct(*a.columns).alias(left))
    y = b.select(F.explode(F.array(F.col("_bucket"), F.col("_bucket") - 1)).alias("_bucket"), *same, F.struct(*a.columns).alias(right))
    key = lambda s: F.struct(F.col(f"{s}.{at}"), *(F.col(f"{s}.{c}") for c in row))
    on = ["_bucket", *(f"_e{i}" for i in range(len(equal)))]
    return x.join(y, on).where((key(left) < key(right)) & (F.col(f"{right}.{at}") - F.col(f"{left}.{at}") <= width) & residual(left, right)).drop(*on)


def band_keys(a: DataFrame, key: str, at: str, width: int, near, block: int = 64, deal: int = 32_768, wide: int = 4) -> DataFrame:
    """p, q: the keys of all pairs of rows of a whose `at` differ by at most width and for which near(l, r), which is
    symmetric, holds; each pair once, none of a key with itself.

    Rows meet in buckets of `wide` widths, whose borders lie between the full hours at which many begin. Only rows up to a
    width behind a border are copied, into the bucket before, and both sides of the join read one shuffle. A bucket of more
    than `deal` rows is dealt over several tasks by both sides. Within a task, rows that are equal but for their key are one
    set, in blocks of so many keys; only blocks are held against one another. Keys are paired last, so a pair costs no test
    and no shuffle.
    """
    cols, span = [c for c in a.columns if c != key], wide * width
    into, bucket = F.pmod(F.col(at) + span // 2, F.lit(span)), F.floor((F.col(at) + span // 2) / span)
    own, late = F.struct(bucket.alias("b"), F.lit(False).alias("late")), F.struct((bucket - 1).alias("b"), F.lit(True).alias("late"))
    rows = a.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_to", F.explode(F.when(into <= width, F.array(own, late)).otherwise(F.array(own))))
    rows = rows.select(F.col("_to.b").alias("_b"), F.col("_to.late").alias("_late"), *a.columns)
    hot = rows.groupBy("_b").agg(F.ceil(F.count("*") / deal).alias("_tasks")).where("_tasks > 1")  # one of `deal` rows at most
    mine = F.pmod(F.xxhash64(key), F.col("_tasks"))
    rows = rows.join(F.broadcast(hot), "_b", "left").withColumn("_tasks", F.coalesce("_tasks", F.lit(1).cast("long")))
    rows = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tasks") - 1)))
    task = (F.least("_mine", "_other") * F.col("_tasks") + F.greatest("_mine", "_other")).alias("_task")
    side = F.when(F.col("_mine") == F.col("_other"), 0).when(F.col("_mine") < F.col("_other"), 1).otherwise(2).alias("_side")
    n = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * a.sparkSession.sparkContext.defaultParallelism)
    on = ["_b", "_task"]  # in a fixed number of partitions, as few bytes make many pairs
    sets = rows.select("_b", task, side, "_late", *a.columns).repartition(n, *on).groupBy(*on, "_side", "_late", *cols).agg(F.collect_list(key).alias("keys"))
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(keys) - 1) div {block} as int)")), lambda k: F.slice("keys", k * block + 1, F.lit(block)))
    blocks = sets.withColumn("keys", F.explode(cut)).withColumn("least", F.array_min("keys"))
    x, y = (blocks.select(*on, *(F.col(c).alias(f"{s}_{c}") for c in ("_side", "_late", *cols, "least", "keys"))) for s in "lr")
    l, r = ({c: F.col(f"{s}_{c}") for c in ("_side", "_late", *cols, "least")} for s in "lr")
    row = lambda s: F.struct(*(s[c] for c in cols))  # noqa: E731  only asked where both times and least keys are equal
    tie = l["least"] == r["least"]
    first = (l[at] < r[at]) | ((l[at] == r[at]) & ((l["least"] < r["least"]) | (tie & (row(l) <= row(r)))))
    here = ~(l["_late"] & r["_late"]) & ((l["_side"] == 0) & (r["_side"] == 0) | (l["_side"] != r["_side"]))  # others meet in their own bucket or task
    met = x.join(y, on).where((r[at] - l[at] <= width) & first & here & near(l, r))
    # coalesce ends the join's step: else the keys of all blocks that one block meets would be paired before the first pair is let go
    met = met.select((tie & (row(l) == row(r))).alias("own"), "l_keys", "r_keys").coalesce(n)
    pairs = met.select("own", F.explode("l_keys").alias("p"), "r_keys").select("own", "p", F.explode("r_keys").alias("q"))
    return pairs.where("p < q or (not own and p <> q)").select("p", "q")
