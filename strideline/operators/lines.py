"""Operators on lines and places: densify, resample, anchors, windows, clusters, coverage and nearest places."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.functions.physiology import haversine_m
from strideline.operators import graph, ordered

#: Fixed value: metres of a degree of latitude in the flat projection.
DEGREE_M = 111_320.0
#: How narrow the search for a nearest place begins (a quarter so many times), and with how many places in a cell.
NARROWEST, FEW_PLACES = 8, 32
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def bearing_label(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The first direction from one place to another as one of eight."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    turn = F.when(deg < 0, deg + 360).otherwise(deg)
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor((turn + 22.5) / 45) % 8 + 1).cast("int"))


def before(key: str, order: str, *cols: str) -> dict[str, Column]:
    """p_<col>: each column at the sample before."""
    w = W.partitionBy(key).orderBy(order)
    return {f"p_{c}": F.lag(c).over(w) for c in cols}


def densify(track: DataFrame, key: str, order: str, values: list[str], step: float = 15.0) -> DataFrame:
    """key, order, j, values: samples, and between two that are farther apart than step int(gap / step) more, at even parts
    of the way; j is 0 for a sample and counts what was put before it."""
    s = track.withColumns(before(key, order, *values))
    gap = haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    n = F.when(gap > step, F.floor(gap / step)).otherwise(0).cast("int")
    s = s.withColumn("_n", F.coalesce(n, F.lit(0))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    share = F.col("j") / (F.col("_n") + 1)
    put = lambda c: F.when(F.col("j") == 0, F.col(c)).otherwise(F.col(f"p_{c}") + share * (F.col(c) - F.col(f"p_{c}")))
    return s.select(key, order, "j", *(put(c).alias(c) for c in values))


def resample(track: DataFrame, key: str, order: str, step: float) -> DataFrame:
    """key, order, k, lat, lon: the first place, then for each piece of way max(1, int(length / step)) places at even parts."""
    s = track.withColumns(before(key, order, "lat", "lon"))
    gap = haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    s = s.withColumn("_g", gap).where("_g is null or _g > 0").withColumn("_n", F.coalesce(F.greatest(F.lit(1), F.floor(F.col("_g") / step).cast("int")), F.lit(1)))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    put = lambda c: F.coalesce(F.col(f"p_{c}") + F.col("k") / F.col("_n") * (F.col(c) - F.col(f"p_{c}")), F.col(c))
    return s.select(key, order, "k", put("lat").alias("lat"), put("lon").alias("lon"))


def decimate(track: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most `most` samples of a key at an even stride, whose places are rounded half to even; all if there are no more."""
    w = W.partitionBy(key)
    s = track.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    stride = (F.col("_n") - 1) / (most - 1)
    k = F.floor(F.col("_i") / stride)  # the place of one of the numbers around it may round to this sample
    hits = [F.least(F.bround((k + d) * stride), F.col("_n") - 1) == F.col("_i") for d in (-1, 0, 1, 2)]
    valid = [(k + d >= 0) & (k + d < most) for d in (-1, 0, 1, 2)]
    some = F.lit(False)
    for h, v in zip(hits, valid, strict=True):
        some = some | (h & v)
    return s.where((F.col("_n") <= most) | some).drop("_i", "_n")


def anchors(track: DataFrame, key: str, order: str, apart: float = 50.0) -> DataFrame:
    """The first sample of a key, each that is `apart` metres or more from the last one kept, and the last: a fold over one
    recording, which is bounded, so a task holds one at a time."""
    cols = [key, order, "lat", "lon"]
    schema = track.select(*cols).schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(order)
        lat, lon = np.radians(pdf["lat"].to_numpy(float)), np.radians(pdf["lon"].to_numpy(float))
        keep, last = [0], 0
        for i in range(1, len(pdf) - 1):
            h = np.sin((lat[i] - lat[last]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[last]) * np.sin((lon[i] - lon[last]) / 2) ** 2
            if 2 * 6371000.0 * np.arcsin(min(1.0, h**0.5)) >= apart:
                keep.append(i)
                last = i
        return pdf.iloc[[*keep, len(pdf) - 1] if len(pdf) > 1 else keep]

    return track.select(*cols).where("lat is not null and lon is not null").groupBy(key).applyInPandas(fold, schema)


def steepest_window(track: DataFrame, key: str, order: str, d: str, elev: str, least_m: int = 150) -> DataFrame:
    """key, lo, hi, grade: of each sample's shortest window of least_m or more the steepest, the first of equal ones; windows
    with an end without height don't count."""
    end = W.partitionBy(key).orderBy(d).rangeBetween(least_m, W.unboundedFollowing)
    pick = F.min(F.struct(F.col(d).alias("d"), F.col(order).alias("i"), F.col(elev).alias("e"))).over(end)
    s = track.withColumn("_e", pick).where(F.col("_e").isNotNull() & F.col(elev).isNotNull() & F.col("_e.e").isNotNull())
    s = s.withColumn("grade", (F.col("_e.e") - F.col(elev)) / (F.col("_e.d") - F.col(d)))
    best = s.groupBy(key).agg(F.max_by(F.struct(F.col(order).alias("lo"), F.col("_e.i").alias("hi"), "grade"), F.struct("grade", -F.col(order))).alias("b"))
    return best.select(key, "b.lo", "b.hi", "b.grade")


def bracket(probes: DataFrame, fixes: DataFrame, key: str, at: str, values: list[str], snap: float | None = 60.0) -> DataFrame:
    """probes with the fixes' values at their places: linear between the fixes around them; the nearer one's (the earlier of
    equals) where these are more than snap apart; the end's own beyond the ends. Of fixes at one place the last counts."""
    f = fixes.groupBy(key, at).agg(F.max(F.struct(*values)).alias("_v"))
    cols = [c for c in probes.columns if c not in (key, at)]
    none = F.lit(None).cast(f.schema["_v"].dataType)
    both = probes.withColumn("_side", F.lit(0)).withColumn("_v", none).unionByName(f.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    fix = F.when(F.col("_side") == 1, F.struct(F.col(at).alias("at"), F.col("_v").alias("v")))
    for name, over in ordered.around(key, at, "_side"):
        both = both.withColumn(f"_{name}", F.last(fix, ignorenulls=True).over(over))
    near = both.where("_side = 0")
    gap, share = F.col("_hi.at") - F.col("_lo.at"), (F.col(at) - F.col("_lo.at")) / (F.col("_hi.at") - F.col("_lo.at"))

    def value(c: str) -> Column:
        lo, hi = F.col(f"_lo.v.{c}"), F.col(f"_hi.v.{c}")
        out = F.when(F.col("_lo").isNull(), hi).when(F.col("_hi").isNull(), lo)
        if snap is not None:
            out = out.when(gap > snap, F.when(F.col(at) - F.col("_lo.at") <= F.col("_hi.at") - F.col(at), lo).otherwise(hi))
        return out.otherwise(lo + (hi - lo) * share)

    return near.select(key, at, *cols, *(value(c).alias(c) for c in values))


def nearby(a: DataFrame, b: DataFrame, within_m: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows of a (struct l) and b (struct r) at most within_m apart, with their distance m; equal rows each meet.

    Places meet in bands of latitude of that height and, in each, columns of longitude of that width at the band's far
    side, so dense places only meet their neighbours; works to 80 degrees of latitude, also across 180 degrees of
    longitude. A row of a asks in nine cells, or fewer where some are the same.
    """
    step = within_m / 6371000.0 * 180 / 3.141592653589793
    band = lambda df: F.floor(F.col(lat) / step).cast("long")
    width = lambda row: step / F.cos(F.radians(F.least(F.lit(80.0), (F.abs(row.cast("double") + 0.5) + 0.5) * step)))  # noqa: E731  of a band's columns
    count = lambda row: F.floor(F.lit(360.0) / width(row)).cast("long")  # noqa: E731  whole columns around the globe
    place = lambda row: F.floor((F.col(lon) + 180) / 360 * count(row)).cast("long")
    cell = lambda row, d: F.struct(row.alias("r"), F.pmod(place(row) + d, count(row)).alias("c"))
    asked = F.array_distinct(F.array(*(cell(band(a) + dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1))))
    x = a.select(F.struct(*a.columns).alias("l"), F.explode(asked).alias("_k"))
    y = b.select(F.struct(*b.columns).alias("r"), cell(band(b), 0).alias("_k"))
    m = haversine_m(F.col(f"l.{lat}"), F.col(f"l.{lon}"), F.col(f"r.{lat}"), F.col(f"r.{lon}"))
    return x.join(y, "_k").select("l", "r", m.alias("m")).where(F.col("m") <= within_m)


def clusters(places: DataFrame, within_m: float, id_col: str = "id") -> DataFrame:
    """id, c: single-link clusters; c is the smallest id of a cluster.

    Places in one cell, the diagonal of which is shorter than within_m, link for sure; of a cell only its outermost places
    meet those of others, and all of them only where that leaves two cells near one another apart.
    """
    step = within_m / 1.5 / 6371000.0 * 180 / 3.141592653589793
    row = F.floor(F.col("lat") / step).cast("long")
    flat = F.least(F.abs(row), F.abs(row + 1)) * step  # a cell is widest at the side towards the equator
    width = F.when(flat > 85, step).otherwise(step / F.cos(F.radians(flat)))
    node = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct(row.alias("r"), F.floor(F.col("lon") / width).alias("c")))
    rows, nodes = graph.grouped(places.select(id_col, "lat", "lon"), id_col, node, ("lat", "lon"))
    known = F.col("size") <= F.size("few")
    ends = nodes.select("n", F.explode("few").alias("p")).select("n", "p.lat", "p.lon")
    sure = nearby(ends, ends, within_m).where("l.n < r.n").select(F.col("l.n").alias("a"), F.col("r.n").alias("b")).distinct()
    one = nodes.select("n", known.alias("known"), F.col("few")[0]["lat"].alias("lat"), F.col("few")[0]["lon"].alias("lon"))
    maybe = nearby(one, one, 3 * within_m).where("l.n < r.n and not (l.known and r.known)").select(F.col("l.n").alias("a"), F.col("r.n").alias("b"))
    c = graph.joined_nodes(rows, id_col, sure, maybe, lambda p, q: haversine_m(p["lat"], p["lon"], q["lat"], q["lon"]) <= within_m)
    return places.select(id_col).join(c.select(F.col("v").alias(id_col), F.col("c").alias("_c")), id_col, "left").select(id_col, F.coalesce("_c", id_col).alias("c"))


def nearest(probes: DataFrame, places: DataFrame, within_m: float, id_col: str, order: str, fits: Callable[[Column, Column], Column] | None = None, alike: tuple[str, ...] = ()) -> DataFrame:
    """id, r, m: the nearest place of each probe within a distance, of those for which fits(l, r) holds; of equally near ones
    the last by `order`. fits may look at the columns `alike` of places.

    Probes first ask in a quarter of a quarter ... of the distance, so small that few places share a cell, and only those
    that find none there ask four times as far; of places at one point only the last of each `alike` is asked.
    """
    last = places.where("lat is not null and lon is not null").groupBy("lat", "lon", *alike).agg(F.max_by(F.struct(*places.columns), order).alias("_r"))
    last = graph.checkpointed(last.select("_r.*"))
    cell = lambda k: F.struct(F.lit(k).alias("k"), *(F.floor(F.col(c) / (within_m / 4.0**k / DEGREE_M)).alias(c) for c in ("lat", "lon")))
    counts = last.select(F.explode(F.array(*map(cell, range(NARROWEST + 1)))).alias("c")).groupBy("c").agg(F.count("*").alias("n")).groupBy("c.k").agg(F.max("n").alias("n")).collect()  # a row a width
    start = min((r["k"] for r in counts if r["n"] <= FEW_PLACES), default=NARROWEST) if counts else 0
    open_, found = probes, None
    for k in range(start, -1, -1):
        far = within_m / 4.0**k
        met = nearby(open_, last, far)
        met = (met if fits is None else met.where(fits(F.col("l"), F.col("r")))).withColumn("m", F.round("m", 6))
        best = met.groupBy(F.col(f"l.{id_col}").alias(id_col)).agg(F.min_by(F.struct("r", "m"), F.struct("m", -F.col(f"r.{order}"))).alias("b")).select(id_col, "b.r", "b.m")
        if k:
            best = graph.checkpointed(best.where(F.col("m") <= far - 1e-5))  # one as near may lie just beyond
            open_ = graph.checkpointed(open_.join(best.select(id_col), id_col, "left_anti"))
        found = best if found is None else found.unionByName(best)
    return found


def shared(cells: DataFrame, key: str, least: float, block: int = 1024, digits: int | None = None) -> DataFrame:
    """a, b, share: pairs of keys (a < b) by how much of the smaller one's cells (r, c) they share, where it is so much; the
    share is rounded if digits are given.

    Keys with the same cells are counted as one set of cells. Only sets meet by cell and are added up; their members, in
    blocks, are then paired within a task, so the pairs of keys are never shuffled. Two blocks are one row, and these rows
    are dealt evenly over tasks, as most tracks may have one set.
    """
    sets = cells.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("r", "c"))).alias("_s"))  # a track has few cells
    named = graph.checkpointed(sets.groupBy("_s").agg(F.min(key).alias("_k"), F.ceil(F.count("*") / block).alias("blocks")))
    visit = named.select("_k", F.size("_s").alias("n"), F.explode("_s").alias("cell"))
    side = lambda p: visit.select(F.col("_k").alias(p), F.col("n").alias(f"n{p}"), "cell")
    met = side("x").join(side("y"), "cell").where("x <= y").groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("both"))
    share = F.col("both") / F.least("nx", "ny")
    met = met.where(F.col("both") >= least * F.least("nx", "ny")).select("x", "y", (share if digits is None else F.round(share, digits)).alias("share"))
    dealt = sets.join(named, "_s").groupBy("_k", F.pmod(F.xxhash64(key), F.col("blocks")).alias("block")).agg(F.collect_list(key).alias("members"))
    dealt = graph.checkpointed(dealt.select("_k", "block", "members"))
    of = lambda k, n, m: dealt.select(F.col("_k").alias(k), F.col("block").alias(n), F.col("members").alias(m))
    n = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * cells.sparkSession.sparkContext.defaultParallelism)
    two = met.join(of("x", "bx", "p"), "x").join(of("y", "by", "q"), "y").where("x < y or bx <= by")
    two = two.select(((F.col("x") == F.col("y")) & (F.col("bx") == F.col("by"))).alias("own"), "share", "p", "q").repartition(n)
    # coalesce ends the step between the two: else all pairs of two blocks would be made before the first one is let go
    pairs = two.select("own", "share", F.explode("p").alias("p"), "q").coalesce(n).select("own", "share", "p", F.explode("q").alias("q"))
    return pairs.where("not own or p < q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "share")


def coverage(line: DataFrame, by: DataFrame, key: str, within_m: float) -> DataFrame:
    """key, share: how much of each line's points, equal ones each, lies within a distance of any point of `by`."""
    some = line.select(key, "lat", "lon").withColumn("_p", F.monotonically_increasing_id())
    near = nearby(some, by.select("lat", "lon"), within_m).groupBy(F.col(f"l.{key}").alias(key), F.col("l._p")).agg(F.lit(1).alias("_o")).groupBy(key).agg(F.count("*").alias("_n"))
    return line.groupBy(key).agg(F.count("*").alias("n")).join(near, key, "left").select(key, (F.coalesce("_n", F.lit(0)) / F.col("n")).alias("share"))


def fastest_spans(spans: DataFrame, key: str, lo: str, hi: str, cost: str) -> DataFrame:
    """Spans of a key taken fastest first, each if it doesn't meet one taken before: a fold over one key's few spans."""
    schema = spans.schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[int] = []
        for i in pdf.sort_values([cost, lo, hi]).index:
            if all(pdf.at[i, hi] < pdf.at[j, lo] or pdf.at[i, lo] > pdf.at[j, hi] for j in taken):
                taken.append(i)
        return pdf.loc[taken]

    return spans.groupBy(key).applyInPandas(fold, schema)


def traversals(cells: DataFrame, chain: DataFrame, run: str, order: str, length: float, least: float = 0.8, lo: float = 0.7, hi: float = 1.4) -> DataFrame:
    """run, start_i, end_i, dist_m, time_s: each run's fastest way along a chain of cells.

    cells: run, order, r, c, d, t of a run's ordered distinct cells; chain: n, r, c. A way enters near the chain's first cell,
    leaves near its last one, later, at a plausible distance and covers enough of the chain's cells. Starts and ends of one
    run meet within the range of distances only.
    """
    ends = chain.agg(F.min_by(F.struct("r", "c"), "n").alias("a"), F.max_by(F.struct("r", "c"), "n").alias("b"), F.count_distinct("r", "c").alias("size"))  # one row
    s = cells.join(F.broadcast(chain.select("r", "c").distinct().withColumn("on", F.lit(1))), ["r", "c"], "left").crossJoin(F.broadcast(ends))  # a chain has 2400 cells at most
    near = lambda e: (F.abs(F.col("r") - F.col(f"{e}.r")) <= 1) & (F.abs(F.col("c") - F.col(f"{e}.c")) <= 1)
    start = s.where(near("a")).select(run, F.col(order).alias("si"), F.col("d").alias("sd"), F.col("t").alias("st"), "size")
    end = s.where(near("b")).select(run, F.col(order).alias("ei"), F.col("d").alias("ed"), F.col("t").alias("et"))
    width = length * (hi - lo) if hi > lo else length
    bucket = lambda x: F.floor(x / width)  # noqa: E731  a start meets ends from lo to hi lengths on, in three buckets at most
    x = start.withColumn("_b", F.explode(F.array(*(bucket(F.col("sd") + length * lo) + k for k in (0, 1)))))
    pairs = x.join(end.withColumn("_b", bucket(F.col("ed"))), [run, "_b"]).where((F.col("ei") > F.col("si")) & (F.col("ed") - F.col("sd")).between(length * lo, length * hi) & (F.col("et") > F.col("st")))
    on = s.where("on = 1").select(run, F.col(order).alias("i"), "r", "c")
    seen = pairs.join(on, run).where((F.col("i") >= F.col("si")) & (F.col("i") <= F.col("ei"))).groupBy(run, "si", "ei", "sd", "ed", "st", "et", "size").agg(F.count_distinct("r", "c").alias("n"))
    ok = seen.where(F.col("n") >= least * F.col("size"))
    best = ok.groupBy(run).agg(F.min_by(F.struct(F.col("si").alias("start_i"), F.col("ei").alias("end_i"), (F.col("ed") - F.col("sd")).alias("dist_m"), (F.col("et") - F.col("st")).alias("time_s")), F.struct(F.col("et") - F.col("st"), "si", "ei")).alias("b"))
    return best.select(run, "b.*")


def deviation(line: DataFrame, by: DataFrame, key: str, order: str, within_m: float = 100.0) -> DataFrame:
    """key, metres: the mean distance of each line's points from the nearest piece of the line `by` of the same key, in a flat
    projection around the line's first point.

    Pieces are listed in the squares of side within_m that their box with a margin of one touches, and points meet those of
    their own square: a nearest piece that is no farther than within_m is among them. Only points that have none meet all
    pieces of their key.
    """
    first = line.groupBy(key).agg(F.min_by(F.struct("lat", "lon"), order).alias("o"))
    mx = DEGREE_M * F.cos(F.radians("o.lat"))
    flat = lambda df, lat, lon, x, y: df.withColumn(x, (F.col(lon) - F.col("o.lon")) * mx).withColumn(y, (F.col(lat) - F.col("o.lat")) * DEGREE_M)
    pieces = by.withColumns(before(key, order, "lat", "lon")).where("p_lat is not null").select(key, "p_lat", "p_lon", "lat", "lon").join(first, key)
    pieces = flat(flat(pieces, "p_lat", "p_lon", "ax", "ay"), "lat", "lon", "bx", "by").select(key, "ax", "ay", "bx", "by")
    points = flat(line.select(key, order, "lat", "lon").join(first, key), "lat", "lon", "x", "y").select(key, order, "x", "y")
    square = lambda v: F.floor(v / within_m).cast("long")
    listed = pieces.withColumn("_c", F.explode(F.sequence(square(F.least("ax", "bx")) - 1, square(F.greatest("ax", "bx")) + 1))).withColumn("_r", F.explode(F.sequence(square(F.least("ay", "by")) - 1, square(F.greatest("ay", "by")) + 1)))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.when(dx * dx + dy * dy == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy))))
    least = F.min(F.hypot(F.col("x") - F.col("ax") - t * dx, F.col("y") - F.col("ay") - t * dy)).alias("d")
    near = points.withColumn("_c", square(F.col("x"))).withColumn("_r", square(F.col("y"))).join(listed, [key, "_c", "_r"]).groupBy(key, order).agg(least).where(F.col("d") <= within_m)
    far = points.join(near.select(key, order), [key, order], "left_anti").join(pieces, key).groupBy(key, order).agg(least)
    return near.union(far).groupBy(key).agg(F.avg("d").alias("metres"))


def best_effort_span(track: DataFrame, key: str, order: str, d: str, t: str, metres: int) -> DataFrame:
    """key, from_d, to_d, seconds: the fastest stretch of `metres` or more; of equally fast ones the earliest."""
    end = W.partitionBy(key).orderBy(d).rangeBetween(metres, W.unboundedFollowing)
    s = track.withColumn("_e", F.min(F.struct(F.col(t).alias("t"), F.col(d).alias("d"))).over(end)).where("_e is not null")
    best = s.groupBy(key).agg(F.min_by(F.struct(F.col(d).alias("from_d"), F.col("_e.d").alias("to_d"), (F.col("_e.t") - F.col(t)).alias("seconds")), F.struct(F.col("_e.t") - F.col(t), F.col(order))).alias("b"))
    return best.select(key, "b.*")


def with_heights(track: DataFrame, cache: DataFrame, key: str, order: str, least_share: float = 0.8, width: int = 3) -> DataFrame:
    """track with heights from a cache (place, elev) for recordings that have places and no height at all.

    Anchors along the way get the cached heights of their places (four decimals); a recording is filled if enough of its
    anchors have one. Those are smoothed over 2 * width + 1 anchors and put on all samples between them by distance.
    """
    bare = track.groupBy(key).agg(F.count("elev").alias("e"), F.count("lat").alias("n")).where("e = 0 and n > 1").select(key)
    some = track.join(bare, key, "left_semi")
    at = anchors(some, key, order).join(some.select(key, order, "d"), [key, order]).withColumn("place", F.format_string("%.4f,%.4f", F.col("lat"), F.col("lon")))
    got = at.join(cache.select("place", F.col("elev").alias("h")), "place", "left")
    enough = got.groupBy(key).agg((F.count("h") / F.count("*")).alias("share")).where(F.col("share") >= least_share).select(key)
    got = got.where("h is not null").join(enough, key, "left_semi")
    w = W.partitionBy(key)
    smooth = F.when(F.count("*").over(w) < 3, F.col("h")).otherwise(F.avg("h").over(w.orderBy(order).rowsBetween(-width, width)))
    fixes = got.select(key, "d", smooth.alias("h"))
    filled = bracket(some.select(key, order, "d"), fixes, key, "d", ["h"], snap=None)
    return track.join(filled.select(key, order, "h"), [key, order], "left").withColumn("elev", F.coalesce("elev", "h")).drop("h")


def nearest_edges(points: DataFrame, edges: DataFrame, id_col: str, within_m: float = 35.0) -> DataFrame:
    """id, edge, m: the nearest edge (edge, lat1, lon1, lat2, lon2) of each point within a distance, the first of equals.

    Edges are copied into the grid cells of their box with a margin, points meet the edges of their own cell.
    """
    step = within_m / DEGREE_M
    cell = lambda x: F.floor(x / step).cast("long")
    wide = 3.0  # covers a degree of longitude at 70 degrees of latitude
    e = edges.withColumn("_r", F.explode(F.sequence(cell(F.least("lat1", "lat2")) - 1, cell(F.greatest("lat1", "lat2")) + 1)))
    col = lambda x: F.floor(x / (step * wide)).cast("long")
    e = e.withColumn("_c", F.explode(F.sequence(col(F.least("lon1", "lon2")) - 1, col(F.greatest("lon1", "lon2")) + 1)))
    j = points.withColumn("_r", cell(F.col("lat"))).withColumn("_c", col(F.col("lon"))).join(e, ["_r", "_c"])
    mx = DEGREE_M * F.cos(F.radians("lat"))
    x = lambda lon: (F.col(lon) - F.col("lon")) * mx
    y = lambda lat: (F.col(lat) - F.col("lat")) * DEGREE_M
    dx, dy = x("lon2") - x("lon1"), y("lat2") - y("lat1")
    t = F.when(dx * dx + dy * dy == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x("lon1") * dx + y("lat1") * dy) / (dx * dx + dy * dy))))
    m = F.hypot(x("lon1") + t * dx, y("lat1") + t * dy)
    near = j.withColumn("m", m).where(F.col("m") <= within_m)
    return near.groupBy(id_col).agg(F.min_by(F.struct("edge", "m"), F.struct("m", "edge")).alias("b")).select(id_col, "b.*")
